"""SimHash near-duplicates through anchor points of a covering code.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one 32-bit half.  The
anchors of a half are the words of the perfect Hamming code of length 31, with the 32nd bit as it is:
every half lies within one bit of exactly one anchor, its home.  A half that differs from another by
one bit lies within radius plus threshold, two bits, of the other's home; so each fingerprint is
replicated to its home and to all anchors within two bits (one, fifteen and one more with the 32nd bit
turned, in each half), and within an anchor the fingerprints at home are compared with all others.

Equal fingerprints are one class with one representative, the smallest id.  Within an anchor links are
reported only as far as they join what was not joined yet, so a large group of near copies does not
give all its pairs; components stay the same.  An anchor with more than ``RUN_ROWS`` fingerprints is
put off and compared in pairs of chunks.

Defined cases: a text without words, null or empty, has fingerprint zero and links like any other; texts of
any length count whole; a repeated id counts as rows of one document; rows without an id have a
fingerprint, no component, and take no part in linking; a bit that exactly half of the shingles set is 0;
other columns, whatever their names, are kept by ``keep_one_each`` and ignored otherwise; no rows give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, held, id_column, materialize, slices
from .components import connected_components

THRESHOLD = 3
SHINGLE, HASH_SEED = 3, 42
#: Fingerprints of one anchor that are compared at once; more are compared in pairs of chunks, by several tasks.
RUN_ROWS = 20_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str) -> int:
    """64-bit fingerprint: the majority of the hashes of three-word shingles, bit by bit."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        digests, n = digest(joined, HASH_SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: 1 - SHINGLE - 1] + 1).tolist()][: len(words) - SHINGLE + 1]
        digests = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())])
        n = len(starts)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(rows[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every row, as a signed 64-bit number ``fp``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for batch, texts in slices(batches, text_col):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([id_column(batch, id_col), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the exclusive or of the positions (from one) of the bits that are set."""
    out = np.zeros(len(word), np.uint64)
    for bit in range(31):
        out ^= np.where(word >> np.uint64(bit) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within two bits of each 32-bit half, a row each; the first is its home.

    Entries that do not exist are the home once more.
    """
    one = np.uint64(1)
    word, free = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    s = _syndrome(word)
    home = np.where(s > 0, word ^ (one << (np.maximum(s, one) - one)), word)
    out = [home | free, home | (free ^ np.uint64(0x80000000))]
    for i in range(1, 32):
        j = s ^ np.uint64(i)
        pair = (s > 0) & (j > np.uint64(i))
        far = word ^ (one << np.uint64(i - 1)) ^ (one << (np.maximum(j, one) - one))
        out.append(np.where(pair, far | free, home | free))
    return out[0], np.stack(out, axis=1)


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            rep, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = fp.view(np.uint64)
            for side in (0, 1):
                half = bits >> np.uint64(32) if side else bits & np.uint64(0xFFFFFFFF)
                home, every = anchors(half)
                fresh = np.concatenate((np.ones((len(half), 1), bool), every[:, 1:] != home[:, None]), axis=1)
                row, column = np.nonzero(fresh)
                key = (every[row, column] | np.uint64(side) << np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row]), pa.array(column == 0)], ["anchor", "fp", "rep", "home"])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining pairs of places; a label is the smallest place that links lead to."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _links_of_run(fp: np.ndarray, rep: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that is linked in one anchor's run: each class to the first of its component."""
    bits, at = fp.view(np.uint64), np.flatnonzero(home)
    label = np.arange(len(fp))
    block = max(1, 2_000_000 // max(len(fp), 1))
    for lo in range(0, len(at), block):
        mine = at[lo : lo + block]
        row, column = np.nonzero(np.bitwise_count(bits[mine][:, None] ^ bits[None, :]) <= THRESHOLD)
        label = _joined(label, mine[row], column)
    tied = np.flatnonzero(rep[label] != rep)
    return [(int(x), int(y)) for x, y in zip(rep[tied], rep[label[tied]])]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor in; links (a, b), or rows of anchors put off, out."""
    names = ["a", "b", "anchor", "fp", "home"]
    carried: list[np.ndarray] | None = None
    put_off: int | None = None

    def links(pairs_a, pairs_b):
        n = len(pairs_a)
        return pa.RecordBatch.from_arrays([pa.array(pairs_a, pa.int64()), pa.array(pairs_b, pa.int64()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_()))], names)

    def later(anchor, fp, rep, home):
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(anchor), pa.array(fp), pa.array(home)], names)

    def runs(anchor, fp, rep, home):
        if not len(anchor):
            return
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        size = np.diff(edge)
        homes = np.add.reduceat(home.astype(np.int64), edge[:-1])
        busy = (size > 1) & (homes > 0)
        # short runs: neighbours at each distance, all runs at once
        short = np.repeat(busy & (size <= 16), size)
        f, r, h, k = fp[short].view(np.uint64), rep[short], home[short], anchor[short]
        for d in range(1, 16):
            if len(f) <= d:
                break
            hit = np.flatnonzero((k[d:] == k[:-d]) & (h[d:] | h[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= THRESHOLD) & (r[d:] != r[:-d]))
            if len(hit):
                yield links(r[hit], r[hit + d])
        for i in np.flatnonzero(busy & (size > 16)).tolist():
            a, b = edge[i], edge[i + 1]
            found = _links_of_run(fp[a:b], rep[a:b], home[a:b])
            if found:
                yield links([x for x, _ in found], [x for _, x in found])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, fp, rep = (batch.column(i).to_numpy() for i in range(3))
        home = batch.column(3).to_numpy(zero_copy_only=False)
        if put_off is not None:
            same = int(np.searchsorted(anchor, put_off, "right"))
            if same:
                yield later(anchor[:same], fp[:same], rep[:same], home[:same])
                anchor, fp, rep, home = anchor[same:], fp[same:], rep[same:], home[same:]
            if not len(anchor):
                continue
            put_off = None
        if carried is not None:
            anchor, fp, rep, home = (np.concatenate(x) for x in zip(carried, (anchor, fp, rep, home)))
            carried = None
        last = int(np.searchsorted(anchor, anchor[-1], "left"))
        yield from runs(anchor[:last], fp[:last], rep[:last], home[:last])
        if len(anchor) - last > RUN_ROWS:
            put_off = int(anchor[-1])
            yield later(anchor[last:], fp[last:], rep[last:], home[last:])
        else:
            carried = [x[last:] for x in (anchor, fp, rep, home)]
    if carried is not None:
        yield from runs(*carried)


_COMPARED = "a bigint, b bigint, anchor bigint, fp bigint, home boolean"


def _compared(rows: DataFrame) -> DataFrame:
    return materialize(rows.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare, _COMPARED), "links")


def class_links(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between representatives of classes (columns rep, fp) that join all near ones, and the tables that hold them."""
    tables = []
    found = _compared(classes.select("rep", "fp").mapInArrow(_replicate, "anchor bigint, fp bigint, rep bigint, home boolean"))
    tables.append(found)
    links = found.where("b is not null").select("a", "b")
    late = found.where("b is null").select("anchor", "fp", F.col("a").alias("rep"), "home")
    while late.take(1):
        sizes = late.groupBy("anchor").agg(F.ceil(F.count("*") * 4 / RUN_ROWS).cast("int").alias("chunks"))
        cut = late.join(sizes, "anchor").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        key = F.xxhash64("anchor", F.least("chunk", "other"), F.greatest("chunk", "other"))
        found = _compared(spread.select(key.alias("anchor"), "fp", "rep", "home"))
        tables.append(found)
        links = links.union(found.where("b is not null").select("a", "b"))
        late = found.where("b is null").select("anchor", "fp", F.col("a").alias("rep"), "home")
    return links, tables


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row (columns doc_id, fp, component_id)."""
    marks = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links, tables = class_links(classes)
    roots = connected_components(links)  # checkpointed
    forget(*tables)
    resolved = classes.join(roots, classes["rep"] == roots["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("root"))
    joined = marks.join(resolved, (marks["fp"] == resolved["class_fp"]) & marks["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", "fp", F.col("root").alias("component_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("rg_gone")).distinct()
    return docs.join(drop, docs[id_col].cast("long") == drop["rg_gone"], "left_anti")
