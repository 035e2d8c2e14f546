"""License scans by conditional compression.

A template is confirmed by its exact wording: with case, punctuation and blanks folded, its words must stand
in the text in order, but for at most ``MOST_DIFFERENCES`` words that are put in, left out or replaced; its
identifying words may not be among them.  So every passage holds its template's first identifying word, and
the words around each of these are all that needs to be looked at: no other gate leaves anything out.  They
are cut, across line ends, into blocks of twice the words of the longest passage; neighbouring blocks share
one such length, so each passage lies whole in one of them.

A block is a candidate for the templates whose identifying words it holds, with all but so many of their
other words.  It is compressed with each of them as raw Zstandard dictionary; they are ranked by how far
they shrink it, against compression without a dictionary, and confirmed by their wording, also where they do
not shrink it.  SPDX tags are read as expressions.

Every confirmed license of a block is reported.  A passage gives way to one whose identifying words hold
its own and more ("GNU Lesser General" to "GNU General"); the opening that the BSD licenses share counts
for the one whose last clause follows within ``BODY_WORDS`` words, else for BSD-2-Clause.

Defined cases: null and empty texts have no blocks and no rows, nor has an empty table; texts of any length
are scanned whole; a license that stands in a text several times is reported once, with the number of its
passages that do not overlap (column ``blocks``), and all licenses of a text are reported, in order of their
names; equal reductions keep the templates' order; repeated rows are scanned each; other columns, whatever
their names, are ignored.  Words cut by a hyphen at a line's end are not joined.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices

#: Wordings of notices and bodies by license (fixed values; words in capitals and numbers identify it).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the APACHE License, Version 2.0.", "APACHE License Version 2.0, JANUARY 2004"),
    "MIT": (
        "Released under the MIT License.",
        "Permission is HEREBY granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to DEAL in the Software without RESTRICTION",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without FEE is HEREBY granted"),
    "BSD-2-Clause": ("Licensed under the BSD 2-CLAUSE License.", "REDISTRIBUTION and use in SOURCE and BINARY forms, with or without modification, are permitted provided that the following conditions are met"),
    "BSD-3-Clause": ("Licensed under the BSD 3-CLAUSE License.", "nor the names of its contributors may be used to ENDORSE or PROMOTE products derived from this software without specific prior written permission"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the MOZILLA Public License, v. 2.0.", "MOZILLA Public License Version 2.0"),
    "Unlicense": ("This is free and UNENCUMBERED software released into the public domain",),
    **{
        name: (
            f"This {work} is licensed under the GNU {kind} Public License, version {number}.",
            f"under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {number} of the License",
            f"under the terms of the GNU {kind} Public License version {number} as published by the Free Software Foundation",
            f"GNU {kind} PUBLIC LICENSE Version {number}, {month} {year}",
        )
        for name, work, kind, number, month, year in (
            ("GPL-2.0", "work", "GENERAL", "2", "JUNE", 1991),
            ("GPL-3.0", "work", "GENERAL", "3", "29 JUNE", 2007),
            ("LGPL-2.1", "library", "LESSER GENERAL", "2.1", "FEBRUARY", 1999),
            ("LGPL-3.0", "library", "LESSER GENERAL", "3", "29 JUNE", 2007),
            ("AGPL-3.0", "work", "AFFERO GENERAL", "3", "19 NOVEMBER", 2007),
        )
    },
    **{
        f"CC-{kind}-4.0": (f"Licensed under CC {kind} 4.0.", *([f"Licensed under CC {kind.replace('-', ' ')} 4.0."] if "-" in kind else []), f"CREATIVE COMMONS {full} 4.0 International License")
        for kind, full in (
            ("BY", "ATTRIBUTION"),
            ("BY-SA", "ATTRIBUTION-SHAREALIKE"),
            ("BY-NC", "ATTRIBUTION-NONCOMMERCIAL"),
            ("BY-ND", "ATTRIBUTION-NODERIVATIVES"),
            ("BY-NC-SA", "ATTRIBUTION-NONCOMMERCIAL-SHAREALIKE"),
            ("BY-NC-ND", "ATTRIBUTION-NONCOMMERCIAL-NODERIVATIVES"),
        )
    },
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "CREATIVE COMMONS CC0 1.0 Universal"),
}
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)", re.I)
#: Licenses that share an opening, and the one whose own clause follows it.
OPENINGS = {"BSD-3-Clause": "BSD-2-Clause"}
BODY_WORDS = 300
MOST_DIFFERENCES = 2
#: Blocks that a worker remembers, and characters of a block that is remembered.
MOST_MET, MET_CHARS = 10_000, 2000


_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]]):
        wordings = [(k, t) for k, ts in templates.items() for t in ([ts] if isinstance(ts, str) else ts)]
        self.names = [k for k, _ in wordings]
        self.words = [_words(t) for _, t in wordings]
        self.marks = [set(_words(" ".join(re.findall(r"[A-Z0-9][A-Z0-9.-]+|[0-9]", t)))) for _, t in wordings]
        #: The first identifying word of each template; a passage cannot lack it.
        self.anchors = {next(w for w in words if w in marks and w.isalpha()) for words, marks in zip(self.words, self.marks)}
        self.by_tag = {k.lower(): k for k in templates}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.primed = [self._primed(" ".join(w)) for w in self.words]
        self.tags = {k: self._primed(f"spdx-license-identifier {' '.join(_words(k))}") for k in templates}
        self.reach = max(map(len, self.words)) + MOST_DIFFERENCES
        self.met: dict[str, list[tuple]] = {}

    @staticmethod
    def _primed(text: str) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False)

    def _gain(self, compressor: zstandard.ZstdCompressor, data: bytes) -> float:
        return 1 - len(compressor.compress(data)) / len(self.plain.compress(data))

    def passages(self, template: int, block: list[str]) -> list[tuple[int, int, int]]:
        """Passages of a block that confirm a template: first word, end, and the words that differ."""
        wanted, marks = self.words[template], self.marks[template]
        if not marks <= set(block):
            return []
        found = []
        for skipped in range(min(MOST_DIFFERENCES + 1, len(wanted))):
            if skipped and wanted[skipped - 1] in marks:
                break
            for start in (i for i, w in enumerate(block) if w == wanted[skipped]):
                # by words left out and put in, so far; both together give the place in the block
                states = {(skipped, 0)}
                for j in range(skipped, len(wanted)):
                    after = set()
                    for left, more in states:
                        if left < MOST_DIFFERENCES and wanted[j] not in marks:
                            after.add((left + 1, more))
                        for extra in range(more, MOST_DIFFERENCES + 1):
                            at = start + j - left + extra
                            if at < len(block) and block[at] == wanted[j]:
                                after.add((left, extra))
                    states = after
                    if not states:
                        break
                found += [(start, start + len(wanted) - left + more, max(left, more)) for left, more in states]
        return found

    def block(self, block: str) -> list[tuple[int, int, int, int, float, frozenset]]:
        """Confirmed passages of a block: template, first word, end, differing words, reduction, identifying places."""
        if block not in self.met:
            found = self._block(block)
            if len(block) > MET_CHARS:
                return found
            if len(self.met) > MOST_MET:
                self.met.clear()
            self.met[block] = found
        return self.met[block]

    def _block(self, block: str) -> list[tuple[int, int, int, int, float, frozenset]]:
        words, data = block.split(), block.encode()
        held = set(words)
        candidates = [i for i, wanted in enumerate(self.words) if self.marks[i] <= held and sum(w in held for w in wanted) >= len(wanted) - MOST_DIFFERENCES]
        ranked = sorted(((self._gain(self.primed[i], data), i) for i in candidates), key=lambda x: (-x[0], x[1]))
        return [(i, a, b, n, gain, frozenset(p for p in range(a, b) if words[p] in self.marks[i])) for gain, i in ranked for a, b, n in self.passages(i, words)]

    def _found(self, text: str) -> set[tuple[int, int, int, int, float, frozenset]]:
        """Confirmed passages of a text's blocks, at their places in the text."""
        low = text.lower()
        words = _WORD.findall(low)
        spans: list[list[int]] = []
        for at in (i for i, w in enumerate(words) if w in self.anchors):
            low_, high = max(0, at - self.reach), min(len(words), at + self.reach + 2)
            if spans and low_ <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low_, high])
        out = set()
        for low_, high in spans:
            for start in range(low_, max(high - self.reach, low_ + 1), self.reach):
                block = " ".join(words[start : min(high, start + 2 * self.reach)])
                out |= {(i, a + start, b + start, n, g, frozenset(p + start for p in marks)) for i, a, b, n, g, marks in self.block(block)}
        return out

    def text(self, text: str) -> dict[str, tuple[float, int, int]]:
        """By license: the best reduction, the fewest differing words, and the number of passages."""
        out: dict[str, tuple[float, int, int]] = {}
        found = self._found(text)
        places: dict[int, list[frozenset]] = {}
        for f in found:
            for p in f[5]:
                places.setdefault(p, []).append(f[5])
        by_name: dict[str, list[tuple]] = {}
        for f in found:
            if not any(f[5] < other for p in f[5] for other in places[p]):
                by_name.setdefault(self.names[f[0]], []).append(f)
        for name, opening in OPENINGS.items():
            clauses = sorted(f[1] for f in by_name.get(name, []) if "endorse" in self.marks[f[0]])
            if clauses and opening in by_name:
                follows = lambda f: (at := bisect_left(clauses, f[2])) < len(clauses) and clauses[at] <= f[2] + BODY_WORDS
                by_name[opening] = [f for f in by_name[opening] if "redistribution" not in self.marks[f[0]] or not follows(f)]
        for name, passages in by_name.items():
            if passages:
                count, end = 0, -1
                for f in sorted(passages, key=lambda f: f[2]):
                    if f[1] >= end:
                        count, end = count + 1, f[2]
                out[name] = max(f[4] for f in passages), min(f[3] for f in passages), count
        for m in SPDX.finditer(text):
            data = " ".join(_words(m.group())).encode()
            for tag in re.findall(r"[^\s()]+", m.group(1)):
                name = self.by_tag.get(tag.lower()) or self.by_tag.get(re.sub(r"(-only|-or-later|\+)$", "", tag.lower()))
                if name:
                    g, d, c = out.get(name, (-1.0, 0, 0))
                    out[name] = max(g, self._gain(self.tags[name], data)), 0, c + 1
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license: blocks, differing words and size reduction."""
    known = dict(templates or TEMPLATES)

    anchors = sorted(Scanner(known).anchors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("license scan")
        scanner = Scanner(known)
        for batch, texts in slices(batches, text_col):
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            rows = [(i, name, c, n, round(gain, 6)) for i, t in zip(ids, texts) for name, (gain, n, c) in sorted(scanner.text(t).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (batch.schema.field(id_col).type, pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["id", "license", "blocks", "differences", "reduction"])

    kind = docs.schema[id_col].dataType.simpleString()
    # what holds no template's first identifying word, and no tag, has no passage
    likely = docs.select(id_col, text_col).where(F.col(text_col).rlike(rf"(?i)(?<![a-z])(?:{'|'.join(anchors)})(?![a-z])|SPDX-License-Identifier:"))
    return likely.mapInArrow(run, f"id {kind}, license string, blocks bigint, differences bigint, reduction double").withColumnRenamed("id", id_col)
