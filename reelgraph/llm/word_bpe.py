"""Byte-level BPE over lower-cased words, compiled from a tokenizer's JSON description.

The description splits a text into words by the class of its characters; each word's UTF-8 bytes are
merged, and the last symbol of a word carries a mark.  All of UTF-8 runs through the compiled tables:
texts in the first 256 code points, which the normaliser maps one to one, as they are, others as the
library's normaliser writes them; the class of each further character is asked of the library once.  A
text that may hold a special token goes to the library as a whole, and so does one with a very long word
that leads to new states all the time (random letters); the result is the same.
"""

from __future__ import annotations

import json

import numpy as np

from .common import held, tokenizer_path
from .transducer import Transducer

#: What the compiled tables cover (fixed values of the description's format).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BLANK, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Symbols of a word from which on it is tried whether its states recur, and symbols of the trial.
LONG_WORD, TRIAL = 4096, 1024


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, UNKNOWN, np.uint8)
    for c in range(256):
        kind = unicodedata.category(chr(c))[0]
        out[c] = BLANK if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return out


def _byte_names() -> dict[str, int]:
    """Byte-level names: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary = max(model["vocab"].values()) + 1
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = max([self.vocabulary, *(t["id"] + 1 for t in spec["added_tokens"])])
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
        self.compiled = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and split.get("pattern") == {"Regex": WORDS} and split.get("invert") is True
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
        )
        if self.compiled:
            self._compile(model)

    def _compile(self, model: dict) -> None:
        vocab, names, suffix = model["vocab"], _byte_names(), "</w>"
        inner = [vocab[c] for c in sorted(names, key=names.get)]
        ending = [vocab[c + suffix] for c in sorted(names, key=names.get)]
        #: Symbol of a byte, and of a byte that ends a word.
        self.symbol = np.array([*inner, *ending], np.int32)
        #: The transducer's column of each, -1 until it is met.
        self.column = np.full(512, -1, np.int32)
        spelled = {}
        for token, i in vocab.items():
            body, end = (token[: -len(suffix)], True) if token.endswith(suffix) else (token, False)
            if all(c in names for c in body) and body:
                row = [inner[names[c]] for c in body]
                spelled[i] = (*row[:-1], ending[names[body[-1]]]) if end else tuple(row)
        joins = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joins.setdefault((vocab[a], vocab[b]), (order, vocab[a + b]))
        by_token: dict[int, list] = {}
        for (a, b), (order, i) in joins.items():
            by_token.setdefault(i, []).append((order, a, b))
        # a token that merges never build is no token for the encoder
        built = {i for _, i in joins.values()} | set(inner) | set(ending)
        self.machine = Transducer(lambda a, b: joins.get((a, b)), {i: s for i, s in spelled.items() if i in built}, frozenset(ending), {i: x[0] for i, x in by_token.items() if len(x) == 1})
        self.kind = _classes()

    def covers(self, text: str) -> bool:
        return self.compiled and not any(s in text for s in self.specials)

    def _normalized(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.lib.normalizer.normalize_str(text)
        return text.lower()

    def _learn(self, points: np.ndarray) -> None:
        """Classes of characters that were not met before, as the library splits them."""
        split = self.lib.pre_tokenizer.pre_tokenize_str
        for p in np.unique(points).tolist():
            c = chr(p)
            self.kind[p] = BLANK if not split(c) else LETTER if len(split("a" + c)) == 1 else DIGIT if len(split(c + c)) == 2 else OTHER

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table columns of all bytes of words, marks of words' last bytes, and where each text ends."""
        texts = [self._normalized(t) for t in texts]
        joined = " ".join(texts)
        stops = np.cumsum([len(t) + 1 for t in texts])
        try:
            points = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind.take(points)
        if points.dtype != np.uint8 and (kind == UNKNOWN).any():
            self._learn(points[kind == UNKNOWN])
            kind = self.kind.take(points)
        n = len(points)
        last = np.ones(n, bool)
        last[:-1] = (kind[:-1] != kind[1:]) | (kind[:-1] == DIGIT)
        quote = np.flatnonzero(points == 39)
        quote = quote[(quote == 0) | (kind[np.maximum(quote, 1) - 1] != OTHER)]
        if len(quote):
            ahead = np.concatenate((points, np.zeros(2, points.dtype)))
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            last[quote[short | pair]] = False
            last[quote[short] + 1] = True
            last[quote[pair] + 1] = False
            last[quote[pair] + 2] = True
        word = kind != BLANK
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == n:  # one byte a character
            data, ends = raw[word], last[word]
            upto = np.cumsum(word)
        else:
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000) if points.dtype != np.uint8 else 1 + (points >= 0x80).astype(np.int8)
            data = raw[np.repeat(word, width)]
            upto = np.cumsum(width * word, dtype=np.int64)
            ends = np.zeros(len(data), bool)
            ends[upto[word & last] - 1] = True
        place = np.multiply(ends, 256, dtype=np.int16)
        place += data
        columns = self.column.take(place)
        if len(columns) and columns.min() < 0:  # bytes that were not met before
            fresh = np.unique(place[columns < 0])
            self.column[fresh] = self.machine.columns_of(self.symbol[fresh])
            columns = self.column.take(place)
        return columns, ends, upto[np.minimum(stops, n) - 1] if n else np.zeros(len(texts), np.int64)

    def _compiled(self, texts: list[str]) -> tuple[list[int], list[int], tuple]:
        """Which texts run through the tables, which through the library, and the symbols of the first."""
        fast = [k for k, t in enumerate(texts) if self.covers(t)]
        if not fast:
            return [], list(range(len(texts))), (np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.int64))
        got = self._symbols([texts[k] for k in fast])
        columns, ends, stops = got
        last = np.flatnonzero(ends)
        first = np.concatenate(([0], last + 1))[: len(last)]
        odd = {int(np.searchsorted(stops, first[i], "right")) for i in np.flatnonzero(last - first >= LONG_WORD).tolist() if self.machine.widens(columns, int(first[i]), int(first[i]) + TRIAL)}
        if odd:
            fast = [k for i, k in enumerate(fast) if i not in odd]
            got = self._symbols([texts[k] for k in fast]) if fast else (columns[:0], ends[:0], stops[:0])
        chosen = set(fast)
        return fast, [k for k in range(len(texts)) if k not in chosen], got

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens around it."""
        out: list = [None] * len(texts)
        fast, slow, (columns, ends, stops) = self._compiled(texts)
        tokens, at = self.machine.tokens(columns, ends)
        cut = np.searchsorted(at, stops).tolist()
        for k, lo, hi in zip(fast, [0, *cut[:-1]], cut):
            out[k] = tokens[lo:hi]
        for k in slow:
            out[k] = np.array(self.lib.encode(texts[k], add_special_tokens=False).ids, np.int32)
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """Numbers of tokens, by composed state maps of chunks."""
        out = [0] * len(texts)
        fast, slow, (columns, ends, stops) = self._compiled(texts)
        for k in slow:
            out[k] = len(self.lib.encode(texts[k], add_special_tokens=False).ids)
        begins = np.concatenate(([0], stops))[: len(stops)]
        for k, total in zip(fast, self.machine.counts(columns, ends, begins, stops).tolist()):
            out[k] = total
        return out


def word_bpe(model: str) -> WordBpe:
    """The vocabulary of a worker, loaded once; a bare name is a public vocabulary."""
    models = held("word bpe")
    if model not in models:
        models[model] = WordBpe(model if "/" in model else tokenizer_path(model))
    return models[model]
