"""Token ids in a compact binary format: range asymmetric numeral systems with shared static tables.

Format (version 1).  A data set is a folder with two Parquet tables.  ``tables`` has one row per token
that occurs: its id and its share of 2^20 slots.  ``blocks`` has one row per block, in ascending order of
documents from file to file: ``part`` and ``first`` (the block's place: ids before it inside its part),
the ids and lengths of its documents, and the payload.  A payload is

    magic 'RANS' | version u16 | lanes u16 | tokens u64 | steps per checkpoint u32 | checkpoints u32
    words u64 | crc32 of the rest u32 | word offset u64 of each checkpoint
    lane states u64 of each checkpoint | words u32

Token i belongs to lane i mod lanes.  Every checkpoint holds all lane states, so decoding may begin at
any of them (``read_span`` reads no more than the stretches between checkpoints that it needs); blocks
share nothing but the tables, so they are encoded and decoded in parallel.

Defined cases: a null text counts as empty; an empty text is one end id; a text of any length is one
document, in a block of its own if it is longer than a block; rows are ordered by id, nulls first, and
repeated ids by a hash of their texts; other columns, whatever their names, are ignored; no rows make an
empty data set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch_path, slices
from .word_bpe import word_bpe

MAGIC, VERSION, HEAD = b"RANS", 1, "<4sHHQIIQI"
SLOT_BITS = 20
LOW = np.uint64(1 << 31)
LANES, BLOCK_TOKENS, CHECKPOINT_STEPS = 1024, 262_144, 128
#: Documents of a part at most, about.
PART_ROWS = 200_000


def normalized_shares(counts: np.ndarray) -> np.ndarray:
    """Slots of each token out of 2^20: in proportion, and at least one for every token that occurs."""
    slots, total = 1 << SLOT_BITS, int(counts.sum())
    seen = counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    if seen.sum() > slots:
        raise ValueError("more tokens than slots")
    share = np.where(seen, np.maximum(1, (counts.astype(np.float64) * slots / total).astype(np.int64)), 0)
    rest = slots - int(share.sum())
    order = np.argsort(-share, kind="stable")
    share[order[0]] += max(rest, 0)
    k = 0
    while rest < 0:  # the single slots of rare tokens are taken from the most frequent ones
        take = min(-rest, int(share[order[k]]) - 1)
        share[order[k]] -= take
        rest, k = rest + take, k + 1
    return share


class Tables:
    def __init__(self, share: np.ndarray):
        self.share = share.astype(np.uint64)
        self.base = (np.cumsum(self.share) - self.share).astype(np.uint64)
        self.token = np.repeat(np.arange(len(share), dtype=np.uint32), share)
        self.limit = self.share << np.uint64(63 - SLOT_BITS)


def encode_block(ids: np.ndarray, tables: Tables) -> bytes:
    n = len(ids)
    lanes = int(max(1, min(LANES, n // 64)))
    steps = -(-n // lanes)
    states = np.full(lanes, LOW, np.uint64)
    share, base, limit = tables.share[ids], tables.base[ids], tables.limit[ids]
    bits, low32 = np.uint64(SLOT_BITS), np.uint64(32)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    counts: list[int] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = states[: b - a]
        s = share[a:b]
        full = x >= limit[a:b]
        if full.any():
            words.append(x[full].astype(np.uint32))
            counts.append(len(words[-1]))
            x = np.where(full, x >> low32, x)
        else:
            counts.append(0)
        q = x // s
        states[: b - a] = (q << bits) + (x - q * s) + base[a:b]
        if step % CHECKPOINT_STEPS == 0:
            marks.append(states.copy())
    counts.reverse()
    upto = np.concatenate(([0], np.cumsum(counts)))[:: CHECKPOINT_STEPS][: len(marks)].astype("<u8")
    body = upto.tobytes() + (np.concatenate(marks[::-1]) if marks else states[:0]).astype("<u8").tobytes() + (np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)).astype("<u4").tobytes()
    return struct.pack(HEAD, MAGIC, VERSION, lanes, n, CHECKPOINT_STEPS, len(marks), int(sum(counts)), zlib.crc32(body)) + body


def decode_block(payload: bytes, tables: Tables, checkpoint: int | None = None, span: tuple[int, int] | None = None) -> np.ndarray:
    """All ids of a block, those from one checkpoint to the next, or those of a span."""
    magic, version, lanes, n, every, marks, n_words, crc = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    at = struct.calcsize(HEAD)
    if zlib.crc32(memoryview(payload)[at:]) != crc:
        raise ValueError("the block's checksum does not match")
    upto = np.frombuffer(payload, "<u8", marks, at)
    states = np.frombuffer(payload, "<u8", marks * lanes, at + 8 * marks).reshape(marks, lanes)
    words = np.frombuffer(payload, "<u4", n_words, at + 8 * marks * (1 + lanes)).astype(np.uint64)
    mask, bits, low32 = np.uint64((1 << SLOT_BITS) - 1), np.uint64(SLOT_BITS), np.uint64(32)
    out = np.empty(n, np.uint32)
    wide = every * lanes
    chosen = range(marks) if checkpoint is None else (checkpoint,)
    if span is not None:
        chosen = range(span[0] // wide, min(marks, -(-span[1] // wide)))
    for mark in chosen:
        x, w = states[mark].astype(np.uint64), int(upto[mark])
        for step in range(mark * every, min((mark + 1) * every, -(-n // lanes))):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            y = x[: b - a]
            slot = y & mask
            token = tables.token[slot]
            out[a:b] = token
            y = tables.share[token] * (y >> bits) + slot - tables.base[token]
            low = np.flatnonzero(y < LOW)
            if len(low):
                y[low] = (y[low] << low32) | words[w : w + len(low)]
                w += len(low)
            x[: b - a] = y
    if span is not None:
        return out[span[0] : min(n, span[1])]
    return out if checkpoint is None else out[checkpoint * wide : min(n, (checkpoint + 1) * wide)]


def tokenize(docs: DataFrame, model: str, end_id: int, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Ids of every document in ascending order of id: part, ids before it in its part, and its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, offset = word_bpe(model), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4")
        for batch, texts in slices(batches, text_col):
            rows = [np.append(ids.astype("<u4"), tail) for ids in w.encode_batch(texts)]
            sizes = np.array([len(r) for r in rows], np.int64)
            first = offset + np.cumsum(sizes) - sizes
            offset += int(sizes.sum())
            wide = "<u2" if max(w.vocabulary, end_id + 1) <= 65536 else "<u4"
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part, np.int32)), pa.array(first), batch.column(batch.schema.get_field_index(id_col)), pa.array([r.astype(wide).tobytes() for r in rows], pa.binary()), pa.array(sizes)], ["part", "first", "doc_id", "ids", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    # rows that repeat an id, or have none, are told apart by a hash of their texts, so that no range holds them all
    order = [F.col(id_col), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"part int, first bigint, doc_id {kind}, ids binary, n_tokens bigint")


def _width(n_ids: int) -> str:
    return "<u2" if n_ids <= 65536 else "<u4"


def count_ids(ids: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled, one per id reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            data = b"".join(v.as_buffer().to_pybytes() for v in batch.column(0))
            total += np.bincount(np.frombuffer(data, _width(n_ids)), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["token", "n"])

    counts = ids.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_ids, np.int64)
    out[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def write_blocks(ids: DataFrame, share: np.ndarray, path: str, parts: int) -> None:
    """Blocks of whole documents, in order, about ``BLOCK_TOKENS`` ids each; written with Spark's commit."""
    spark, n_ids = ids.sparkSession, len(share)
    shared = spark.sparkContext.broadcast(share.astype(np.int32))  # one entry per id of the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        held: list[np.ndarray] = []
        docs: list = []
        sizes: list[int] = []
        place = (0, 0)

        def block() -> pa.RecordBatch:
            data = np.concatenate(held)
            row = [[place[0]], [place[1]], [list(docs)], [list(sizes)], [encode_block(data, tables)]]
            held.clear(), docs.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        schema = None
        total = 0
        for batch in batches:
            if schema is None:
                schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])
            for part, first, doc, value, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if held and (part != place[0] or first != place[1] + total or total + size > BLOCK_TOKENS):
                    yield block()
                if not held:
                    place, total = (part, first), 0
                held.append(np.frombuffer(value.as_buffer(), _width(n_ids)))
                docs.append(doc)
                sizes.append(size)
                total += size
        if held:
            yield block()

    kind = ids.schema["doc_id"].dataType.simpleString()
    blocks = ids.select("part", "first", "doc_id", "ids", "n_tokens").mapInArrow(run, f"part int, first bigint, doc_ids array<{kind}>, sizes array<bigint>, payload binary")
    # file by file in the order of the parts
    blocks = blocks.repartitionById(parts, "part").sortWithinPartitions("first")
    blocks.write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/blocks")
    seen = np.flatnonzero(share)
    spark.createDataFrame([(int(t), int(share[t])) for t in seen], "token int, share int").coalesce(1).write.parquet(f"{path}/tables")


def read_tables(spark, path: str) -> np.ndarray:
    """Shares by id; as many rows as the vocabulary has ids at most."""
    rows = spark.read.schema("token int, share int").parquet(f"{path}/tables").toPandas()
    share = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 0, np.int64)
    share[rows["token"].to_numpy(np.int64)] = rows["share"].to_numpy(np.int64)
    return share


def read_documents(spark, path: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Documents of a data set: id, ids before it in the whole set, number of ids, and their checksum."""
    share = read_tables(spark, path)
    shared = spark.sparkContext.broadcast(share.astype(np.int32))
    blocks = spark.read.schema(f"part int, first bigint, doc_ids array<{id_type}>, sizes array<bigint>, payload binary").parquet(f"{path}/blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            names = ["part", "first", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
            for row in range(batch.num_rows):
                part, first, sizes = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), np.array(batch.column(3)[row].as_py(), np.int64)
                ids = decode_block(batch.column(4)[row].as_py(), tables).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                columns = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(first + ends - sizes), batch.column(2)[row].values, pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[e - s : e].astype(np.int64) for s, e in zip(sizes.tolist(), ends.tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    docs = blocks.mapInArrow(run, f"part int, first bigint, doc_id {id_type}, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    base = _bases(spark, blocks)
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _bases(spark, blocks: DataFrame) -> DataFrame:
    """Ids before each part; one row per part: as many as the writer had tasks."""
    sums = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases, before = [], 0
    for r in sums:
        bases.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(bases, "part int, base bigint")


def read_span(spark, path: str, start: int, stop: int) -> DataFrame:
    """Ids from place ``start`` to ``stop`` of the whole set (columns start, ids), a row per block that holds some.

    Each task decodes from the checkpoint before its first id to the one behind its last.
    """
    shared = spark.sparkContext.broadcast(read_tables(spark, path).astype(np.int32))
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "first", "sizes", "payload")
    at = blocks.join(F.broadcast(_bases(spark, blocks)), "part").withColumn("begin", F.col("base") + F.col("first")).withColumn("end", F.col("begin") + F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lo = max(0, start - begin)
                ids = decode_block(payload, tables, span=(lo, stop - begin)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([begin + lo]), pa.array([ids], pa.list_(pa.int64()))], ["start", "ids"])

    return at.where((F.col("begin") < stop) & (F.col("end") > start)).select("begin", "payload").mapInArrow(run, "start bigint, ids array<bigint>")


def write_documents(docs: DataFrame, model: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize all documents and write them as a data set at ``path``."""
    spark = docs.sparkSession
    n_ids = max(word_bpe(model).vocabulary, end_id + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    held = scratch_path(spark, "ids")
    table = tokenize(docs, model, end_id, id_col, text_col, parts)
    table.write.option("compression", "zstd").parquet(held)
    ids = spark.read.schema(table.schema).parquet(held)
    write_blocks(ids, normalized_shares(count_ids(ids, n_ids)), path, parts)
    drop_path(spark, held)


def round_trip(docs: DataFrame, model: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents to the shared folder and report what is read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_documents(docs, model, end_id, path, id_col, text_col)
    return read_documents(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)
