"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map (a
double-array trie).  The normaliser records, for each byte it writes, the byte of the source it came
from, and every piece of the encoding is projected through that record to a span of the original UTF-8
bytes; where a model's map is empty, the record of a whole text is written at once.

Segmentation: pieces are merged by the model's scores.  The vocabulary is compiled into a transducer
(``transducer``) that splits many places of many texts at once; where no piece joins two neighbouring
characters the text falls apart, and a character that is no piece stands for its bytes.  Models of
another kind, texts with the character NUL, and texts with a very long run of characters that leads to
new states all the time go to the library as a whole; the result is the same.

Defined cases: a null text counts as empty; an empty text has the end id only and decodes to an empty
text; repeated rows are encoded each, and ids may be null; a text of any length is encoded whole; other
columns of the table are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, id_column, slices, tokenizer_path
from .transducer import Transducer

BLANK = "▁"
#: Characters of a run without a break from which on it is tried whether its states recur, and characters of the trial.
LONG_RUN, TRIAL = 4096, 1024


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at a position."""
        units = self.units
        node, best = 0, None
        base = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node = base ^ data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            base = node ^ (unit >> 10 << ((unit & 512) >> 6))
            if unit & 256:
                value = units[base] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return best


@dataclass
class Normalized:
    text: str
    #: source[i]: the original byte from which byte i came; one more entry for the end.
    source: np.ndarray


class Normalizer:
    """Longest-prefix normalisation with source alignment, by the rules a model states."""

    def __init__(self, spec, blank_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = blank_suffix

    @property
    def plain(self) -> bool:
        """Only blanks change, one for one, behind a blank put in front."""
        return not self.map.units and self.prefix and not self.trim and self.escape and not self.suffix

    def alignment(self, text: str) -> np.ndarray:
        """The source of each byte of the normalised text, and of its end."""
        if not self.plain:
            return self(text).source
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            return np.zeros(1, np.int64)
        width = np.where(data == 32, len(BLANK.encode()), 1)
        width[0] += len(BLANK.encode())  # the blank in front comes from the first byte
        return np.append(np.repeat(np.arange(len(data)), width), len(data))

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """Place, length and replacement of what is read; whether it stays as it is, byte for byte."""
        at, end = 0, len(data)
        while at < end:
            found = self.map.longest(data, at) if self.map.units else None
            if found:
                size, out = found
            else:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at : at + size]
            yield at, size, out, not found
            at += size

    def __call__(self, text: str) -> Normalized:
        data = text.encode()
        steps = list(self._steps(data))
        if self.trim:
            while steps and steps[0][2] in (b" ", b""):
                steps.pop(0)
        blank = BLANK.encode() if self.escape else b" "
        out, source = bytearray(), []
        if steps and self.prefix and not self.suffix:
            out += blank
            source += [steps[0][0]] * len(blank)
        was_blank = self.trim
        for at, _, piece, same in steps:
            if self.trim and was_blank:
                piece = piece.lstrip(b" ")
            for i, byte in enumerate(piece):
                put = blank if byte == 32 else bytes((byte,))
                out += put
                source += [at + i if same else at] * len(put)
            if piece:
                was_blank = piece.endswith(b" ")
        end = steps[-1][0] + steps[-1][1] if steps else 0
        if self.trim:
            while out.endswith(blank) and (len(out) > len(blank) or not self.prefix):
                del out[-len(blank) :]
                end = source[len(out)]
                del source[len(out) :]
        if steps and self.prefix and self.suffix:
            source += [end] * len(blank)
            out += blank
        return Normalized(out.decode(errors="replace"), np.array([*source, end], dtype=np.int64))


@dataclass
class Encoding:
    ids: np.ndarray
    #: Spans in bytes of the original UTF-8 text, one per id but the end id.
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """One model: encoding with spans, decoding, and what a worker has met so far."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.eos = self.lib.eos_id()
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.compiled = (
            model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and self.normalizer.plain
            and all(c in normal for p in normal for c in p) and not any(p.type == 4 for p in model.pieces)
        )
        if self.compiled:
            self._compile(model, normal)
        #: Bytes of the normalised text under each piece; 0 for the unknown piece, which differs.
        self.sizes = np.array([1 if p.type == 6 else 0 if p.type == 2 else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.unknown = self.lib.unk_id()
        self.decimal = [str(i) for i in range(len(self.sizes))]

    def _compile(self, model, normal: dict[str, int]) -> None:
        text, score = [p.piece for p in model.pieces], [p.score for p in model.pieces]

        def merge(a: int, b: int) -> tuple[float, int] | None:
            joined = normal.get(text[a] + text[b])
            return None if joined is None else (-score[joined], joined)

        self.machine = Transducer(merge, {i: tuple(normal[c] for c in p) for p, i in normal.items()})
        self.single = np.full(0x110000, -1, np.int32)  # the piece of a character, or -1
        for p, i in normal.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.single[ord(" ")] = normal[BLANK]
        self.byte = np.array([self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.symbols = np.unique(self.single[self.single >= 0])
        rank = {int(i): k for k, i in enumerate(self.symbols)}
        #: By rank of the characters: does a piece join the two?
        self.joined = np.zeros((len(rank), len(rank)), bool)
        for p in normal:
            for x, y in zip(p, p[1:]):
                self.joined[rank[normal[x]], rank[normal[y]]] = True
        self.rank = np.zeros(len(text), np.int32)
        self.rank[self.symbols] = np.arange(len(self.symbols))

    def _split(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts by the transducer; None for a text that it does not cover."""
        joined = "".join([f" {t}\0" if t else "\0" for t in texts])
        units = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        single = self.single[units]
        stops = np.flatnonzero(units == 0)  # of texts without the character itself
        place = np.flatnonzero(single >= 0)
        used = single[place]
        ends = np.ones(len(place), bool)
        rank = self.rank[used]
        ends[:-1] = ~self.joined[rank[:-1], rank[1:]] | (np.diff(place) > 1)
        present = np.flatnonzero(np.bincount(used, minlength=len(self.rank)))
        column = np.zeros(len(self.rank), np.int32)
        column[present] = self.machine.columns_of(present)
        column = column[used]
        last = np.flatnonzero(ends)
        first = np.concatenate(([0], last + 1))[: len(last)]
        odd = {int(np.searchsorted(stops, place[first[i]])) for i in np.flatnonzero(last - first >= LONG_RUN).tolist() if self.machine.widens(column, int(first[i]), int(first[i]) + TRIAL)}
        if odd:
            rest = iter(self._split([t for k, t in enumerate(texts) if k not in odd]) if len(odd) < len(texts) else ())
            return [None if k in odd else next(rest) for k in range(len(texts))]
        where, ids = self._tokens(column, ends, place)
        alone = np.flatnonzero((single < 0) & (units != 0))
        if len(alone):  # characters that stand for their bytes
            raw = [chr(c).encode() for c in units[alone].tolist()]
            where = np.concatenate((where, np.repeat(alone, [len(r) for r in raw])))
            order = np.argsort(where, kind="stable")
            where, ids = where[order], np.concatenate((ids, self.byte[np.frombuffer(b"".join(raw), np.uint8)]))[order]
        cut = np.searchsorted(where, stops)
        return [ids[lo:hi] for lo, hi in zip([0, *cut[:-1].tolist()], cut.tolist())]

    def _tokens(self, column: np.ndarray, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, at = self.machine.tokens(column, ends)
        return place[at], tokens.astype(np.int32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        out: list = [None] * len(texts)
        fast = [k for k, t in enumerate(texts) if self.compiled and "\0" not in t]
        for k, ids in zip(fast, self._split([texts[k] for k in fast]) if fast else ()):
            out[k] = ids
        whole = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(whole, self.lib.encode([texts[k] for k in whole], num_threads=1) if whole else ()):
            out[k] = np.array(ids, dtype=np.int32)
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans of the pieces of a text, through the normaliser's record."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        source = self.normalizer.alignment(text)
        if (ids == self.unknown).any():
            at, bounds, normal = 0, [], self.normalizer(text).text.encode()
            for i in ids.tolist():  # one unknown piece for all characters that the vocabulary lacks
                at += self._unknown(normal[at:].decode()) if i == self.unknown else int(self.sizes[i])
                bounds.append(at)
            ends = np.array(bounds)
        else:
            ends = np.cumsum(self.sizes[ids])
        edges = source[np.minimum(np.concatenate(([0], ends)), len(source) - 1)]
        return edges[:-1], edges[1:]

    def _unknown(self, rest: str) -> int:
        size = 0
        for c in rest:
            if self.lib.piece_to_id(c) != self.unknown:
                break
            size += len(c.encode())
        return size

    def encode(self, text: str | None) -> Encoding:
        """Ids with the end id, and the span of each piece."""
        text = text or ""
        ids = self.encode_batch([text])[0]
        starts, ends = self.spans(text, ids)
        return Encoding(np.append(ids, np.int32(self.eos)), starts, ends)

    def decode(self, ids) -> str:
        return self.lib.decode(ids)


def codec(model: str) -> Codec:
    """The model of a worker, loaded once; a bare name is a public vocabulary."""
    models = held("sentencepiece")
    if model not in models:
        models[model] = Codec(model if "/" in model else tokenizer_path(model))
    return models[model]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, spans in original bytes and the decoded text of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, texts in slices(batches, text_col):
            rows = [c.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [id_column(batch, id_col), pa.array([r.ids for r in rows], pa.list_(pa.int32())), pa.array([r.starts for r in rows], pa.list_(pa.int64())), pa.array([r.ends for r in rows], pa.list_(pa.int64())), pa.array([c.decode(r.ids.tolist()) for r in rows])],
                ["id", "ids", "starts", "ends", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the encoding, of the decoded text and of the spans (starts, then ends, as little-endian
    64-bit integers); ``span_bytes`` is what the spans of a text cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        decimal = c.decimal.__getitem__
        for batch, texts in slices(batches, text_col):
            counts, digests, decoded, covered, spans = [], [], [], [], []
            for text, ids in zip(texts, c.encode_batch(texts)):
                starts, ends = c.spans(text, ids)
                covered.append(int((ends - starts).sum()))
                spans.append(hashlib.sha256(starts.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest())
                all_ids = [*ids.tolist(), c.eos]
                counts.append(len(all_ids))
                digests.append(hashlib.sha256(" ".join(map(decimal, all_ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(all_ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [id_column(batch, id_col), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64()), pa.array(spans, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, span_bytes bigint, spans_sha256 string").withColumnRenamed("id", id_col)
