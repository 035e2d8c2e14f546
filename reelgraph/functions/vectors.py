"""Vector arithmetic in doubles, and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a, b, metric: str = "cosine") -> Column:
    """Cosine, or the squared distance as some indexes report it."""
    if metric == "cosine":
        return cosine(a, b)
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalized(a) -> Column:
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def fused(a, b) -> Column:
    """Mean of two unit vectors, again of unit length."""
    return normalized(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def box_iou(a, b) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 without intersection or area."""
    g = lambda v, i: F.try_element_at(_col(v), F.lit(i + 1)).cast("double")
    w = F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0))
    h = F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1))
    inner = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda v: (g(v, 2) - g(v, 0)) * (g(v, 3) - g(v, 1))
    return F.when((inner > 0) & (area(a) + area(b) - inner > 0), inner / (area(a) + area(b) - inner)).otherwise(F.lit(0.0))


def histogram_distance(a, b) -> Column:
    """Bhattacharyya distance of two histograms."""
    total = lambda v: F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))
    shared = F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(shared, F.sqrt(total(a) * total(b))), F.lit(0.0))))


def frame_importance(hist, sem, motion, audio, text, with_motion: bool = True) -> Column:
    """Weighted sum of the signals that make a frame worth keeping."""
    if with_motion:
        return 0.25 * _col(hist) + 0.25 * _col(sem) + 0.15 * _col(motion) + 0.15 * _col(audio) + 0.20 * _col(text)
    return 0.30 * _col(hist) + 0.30 * _col(sem) + 0.18 * _col(audio) + 0.22 * _col(text)


def keyframes_of(duration) -> Column:
    return F.greatest(F.lit(2), F.floor(_col(duration) / 5).cast("int"))


def dense_sampling(span) -> Column:
    """Struct (fps, most) for the frames of a question's window."""
    s = _col(span)
    fps = F.when(s <= 30, 5.0).when(s <= 300, 2.0).otherwise(F.lit(8.0) / F.greatest(s, F.lit(1.0)))
    return F.struct(fps.alias("fps"), F.when(s <= 300, 16).otherwise(8).alias("most"))


def tail_extended(t0, t1) -> Column:
    span = _col(t1) - _col(t0)
    return F.when((span > 5) & (span < 120), _col(t1) + 60).otherwise(_col(t1))


def reference_frames(span, budget: int) -> Column:
    return F.least(F.lit(budget), F.greatest(F.lit(6), F.floor(_col(span) / 12).cast("int")))


def speech_confidence(avg_logprob) -> Column:
    return F.coalesce(_col(avg_logprob), F.lit(0.8)) + 1.0


def audio_confidence(rms, threshold) -> Column:
    return F.least(F.lit(1.0), _col(rms) / _col(threshold))
