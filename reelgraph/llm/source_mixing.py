"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target size: its weight's share of all sizes, at most ``most`` times its own size;
what is above is shared again by weight.  Inside a source a document's expected number of copies grows
with its merit, the number of binary digits of its size: ``level * merit``, ``most`` at most, with the
level at which the expected words of all its documents add up to the target.  The whole part is allocated
as it is; the rest, which differs from document to document, is its probability of one more copy.

Documents are ranked by the odds of a random number over the odds of that probability, and the first
ones are taken until the words that the source still lacks are reached: a sample of fixed size, in words,
with unequal probabilities.  The random number is a hash of id and text, so reruns agree.

The place in the ranking at which a source is full is found by sums over 4,096 ranges of the ranking,
and row by row only in the one range that holds the place: no task gets all rows of a source.

Defined cases: a null text has no words and the merit of one word; rows without a source are a source of
their own, the last one; rows without an id are told apart by their texts; rows that repeat an id and a
text share their random number and are taken or left together; texts of any length count whole; other
columns, whatever their names, are kept by ``mix_documents`` and ignored by ``mix_sizes``; no rows, or
no words at all, give targets and takings of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20
#: Rows up to which the table of sources and merits is broadcast, and parts of each of its rows beyond.
BROADCAST_ROWS, SALTS = 100_000, 64
DRAW_BITS, RANGE_BITS = 52, 12


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds rg_target to a table of rg_source and rg_source_size; one row per source."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("rg_source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    t = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("rg_source_size") * F.lit(float(most))).withColumn("total", F.sum("rg_source_size").over(everything))
    # the sources at their cap are the first ones by cap over weight
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rg_source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.max(fits).over(everything))  # levels of sources at their cap do not fit; later ones are lower
    return t.withColumn("rg_target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("rg_source", "rg_source_size", "rg_target")


def levels(classes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """By source and merit (columns rg_source, rg_merit, rg_words): target, whole copies and chance of one more."""
    sums = classes.groupBy("rg_source").agg(F.sum("rg_words").alias("rg_source_size"))
    t = targets(sums, weights, most).withColumnRenamed("rg_source", "rg_of")
    c = classes.join(t, F.col("rg_source").eqNullSafe(F.col("rg_of"))).drop("rg_of")
    of = Window.partitionBy("rg_source")
    # merits at the cap are the greatest ones
    down = of.orderBy(F.desc("rg_merit"))
    above = F.coalesce(F.sum("rg_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("rg_merit") * F.col("rg_words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = c.withColumn("level", F.when(below > 0, (F.col("rg_target") - most * above) / below))
    c = c.withColumn("level", F.max(F.when(F.col("level") * F.col("rg_merit") <= most, F.col("level"))).over(of))
    expected = F.when(F.col("rg_source_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("rg_merit"), F.lit(float(most)))))).otherwise(F.lit(0.0))
    c = c.withColumn("rg_expected", expected).withColumn("rg_whole", F.floor("rg_expected")).withColumn("rg_chance", F.col("rg_expected") - F.floor("rg_expected"))
    c = c.withColumn("rg_lack", F.col("rg_target") - F.sum(F.col("rg_whole") * F.col("rg_words")).over(of))
    # the source's own odds only shift its ranking, so that its places spread evenly
    open_words = F.sum(F.when(F.col("rg_chance") > 0, F.col("rg_words"))).over(of)
    c = c.withColumn("rg_usual", F.least(F.greatest(F.coalesce(F.col("rg_lack") / open_words, F.lit(0.5)), F.lit(1e-12)), F.lit(1 - 1e-12)))
    return c.select("rg_source", "rg_merit", "rg_source_size", "rg_target", "rg_whole", "rg_chance", "rg_lack", "rg_usual")


def _joined(rows: DataFrame, table: DataFrame, small: bool, on: tuple[str, ...] = ("rg_source", "rg_merit")) -> DataFrame:
    """Rows with the columns of a table that has one row for each key; a hot key is split where it is shuffled."""
    right = table.select(*[F.col(c).alias(f"of_{c}") if c in on else F.col(c) for c in table.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    if small:
        return rows.join(F.broadcast(right), same).drop(*[f"of_{c}" for c in on])
    rows = rows.withColumn("rg_salt", F.pmod("rg_draw", F.lit(SALTS)))
    right = right.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(right, same & (F.col("rg_salt") == F.col("of_salt"))).drop(*[f"of_{c}" for c in on], "rg_salt", "of_salt")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Helper columns: source, size, merit, random number and what breaks ties of the ranking."""
    size = word_count(F.col(text_col))
    return docs.withColumns({"rg_source": F.col(source_col), "rg_size": size, "rg_tie": F.xxhash64(F.col(id_col), F.col(text_col), F.lit(SEED + 1))}).withColumns({
        "rg_merit": F.length(F.bin(F.greatest(F.col("rg_size"), F.lit(1)))), "rg_draw": F.shiftrightunsigned(F.xxhash64("rg_tie", F.lit(SEED)), 64 - DRAW_BITS),
    })


def _place() -> F.Column:
    """Place in a source's ranking by the odds of the random number over the odds of the chance.

    x / (1 + x) of that ratio, as a whole number, after dividing by the ratio at the source's usual chance.
    """
    u = (F.col("rg_draw") + 0.5) / F.lit(float(1 << DRAW_BITS))
    p, usual = F.col("rg_chance"), F.col("rg_usual")
    high, low = u * (1 - p) * usual, (1 - u) * p * (1 - usual)
    return F.least(F.floor(high / (high + low) * F.lit(float(1 << DRAW_BITS))), F.lit((1 << DRAW_BITS) - 1)).cast("bigint")


def plan(drawn: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, bool]:
    """By source and merit: target, whole copies, chance, and the place up to which one more copy is taken."""
    classes = drawn.groupBy("rg_source", "rg_merit").agg(F.sum("rg_size").alias("rg_words"))
    table = materialize(levels(classes, weights, most), "levels")
    small = table.count() <= BROADCAST_ROWS
    open_rows = _joined(drawn.select("rg_source", "rg_merit", "rg_size", "rg_draw", "rg_tie"), table.where("rg_chance > 0").drop("rg_source_size", "rg_target", "rg_whole"), small)
    ranked = open_rows.select("rg_source", "rg_size", "rg_tie", "rg_lack", "rg_draw", _place().alias("rg_place")).withColumn("rg_range", F.shiftright("rg_place", DRAW_BITS - RANGE_BITS))
    summed = ranked.groupBy("rg_source", "rg_range", "rg_lack").agg(F.sum("rg_size").alias("n"))
    running = Window.partitionBy("rg_source").orderBy("rg_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = summed.withColumn("upto", F.sum("n").over(running)).where("upto >= rg_lack").groupBy("rg_source").agg(F.min_by(F.struct("rg_range", (F.col("upto") - F.col("n")).alias("before")), "rg_range").alias("x"))
    edge = materialize(full.select("rg_source", F.col("x.rg_range").alias("rg_edge"), F.col("x.before").alias("rg_before")), "edges")
    last = _joined(ranked, edge, small, ("rg_source",)).where("rg_range = rg_edge")
    # equal places are taken or left together
    last = last.groupBy("rg_source", "rg_place", "rg_tie", "rg_lack").agg(F.sum("rg_size").alias("n"), F.first("rg_before").alias("rg_before"))
    last = last.withColumn("upto", F.col("rg_before") + F.sum("n").over(Window.partitionBy("rg_source").orderBy("rg_place", "rg_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the one that crosses the edge is taken if that comes nearer
    near = F.abs(F.col("upto") - F.col("rg_lack")) < F.abs(F.col("upto") - F.col("n") - F.col("rg_lack"))
    place = F.struct("rg_place", "rg_tie")
    ends = last.groupBy("rg_source").agg(F.max(F.when((F.col("upto") <= F.col("rg_lack")) | ((F.col("upto") - F.col("n") < F.col("rg_lack")) & near), place)).alias("rg_end"), F.min("rg_place").alias("rg_first"))
    nothing = F.struct((F.col("rg_first") - 1).alias("rg_place"), F.lit(0).cast("bigint").alias("rg_tie"))
    ends = ends.select(F.col("rg_source").alias("rg_of"), F.coalesce("rg_end", nothing).alias("rg_end"))
    out = materialize(table.join(ends, F.col("rg_source").eqNullSafe(F.col("rg_of")), "left").drop("rg_of", "rg_lack"), "mix")
    forget(table, edge)
    return out, small


def _with_copies(drawn: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    d = _joined(drawn, table, small)
    # a source without an end is not filled by all its rows with a chance: rounding only, so all are taken
    extra = F.when(F.col("rg_chance") > 0, F.coalesce(F.struct(_place().alias("rg_place"), "rg_tie") <= F.col("rg_end"), F.lit(True))).otherwise(F.lit(False))
    return d.withColumn("rg_copies", F.col("rg_whole") + extra.cast("bigint"))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Size, its source's size and target, and words taken of every row."""
    drawn = _drawn(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    drawn = materialize(drawn.select(F.col(id_col).alias("rg_id"), "rg_source", "rg_size", "rg_merit", "rg_draw", "rg_tie"), "sizes")
    d = _with_copies(drawn, *plan(drawn, weights, most))
    return d.select(
        F.col("rg_id").alias(id_col), F.col("rg_size").alias("size"), F.col("rg_source_size").alias("source_size"), F.col("rg_target").alias("target"),
        (F.col("rg_copies") * F.col("rg_size")).alias("taken"), F.col("rg_copies").alias("copies"),
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as many times as it is taken, with its own columns."""
    columns = docs.columns
    drawn = _drawn(docs, id_col, text_col, source_col)
    sizes = materialize(drawn.select("rg_source", "rg_size", "rg_merit", "rg_draw", "rg_tie"), "sizes")
    table, small = plan(sizes, weights, most)
    forget(sizes)
    d = _with_copies(drawn, table, small).where("rg_copies > 0")
    return d.withColumn("rg_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rg_copies")))).select(*columns)
