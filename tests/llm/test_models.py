"""Language, quality, rules and licenses: contracts, edge cases and held-out accuracy."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelgraph.llm import language_id, license_scan, quality_classifier, quality_rules

from .conftest import prose

STEMS = {"en": ("the", "and", "ing", "tion", "er", "with"), "de": ("der", "ung", "ich", "ein", "keit", "über"), "fr": ("le", "ment", "eau", "été", "que", "oui")}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(3, 60), STEMS[lang]), lang) for i, lang in enumerate(["en", "de", "fr"] * 120)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ² ½ ... !", "fr"), (1003, "the and with", None), (None, "der ung ich", "de"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_is_learned_without_held_out_rows(spoken):
    model = language_id.fit(spoken)
    got = language_id.identify(spoken.withColumn("score", F.lit("clash")), model).collect()
    lang = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    assert len(got) == spoken.count()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    proper = [r for r in held if r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in proper) >= 0.95 * len(proper)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1000, 1001, 1002)} == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_ignores_held_out_labels(spoken):
    wrong = spoken.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language_id.fit(wrong).languages == ["de", "en", "fr"]


def test_language_without_labels(spark, spoken, empty):
    assert language_id.fit(empty) is None
    got = language_id.identify(spoken, None).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["und"]
    assert language_id.identify(empty, None).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        text = prose(rng, rng.randint(30, 150))
        kind = "clean" if i % 10 < 7 else "noise" if i % 10 < 9 else "toxic"
        if kind == "noise":
            text = " ".join(w + rng.choice(["***", "###", "%%%"]) for w in text.split())
        if kind == "toxic":
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot,", "moron", "scum"]))
            text = " ".join(w)
        rows.append((i, text))
        if i % 2 or i % 10 == 8:
            labels.append((i, int(kind != "noise"), int(kind == "toxic")))
    rows += [(5000, None), (5001, ""), (5002, "short one")]
    labels += [(5000, None, 0), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_grades_in_order(graded):
    docs, labels = graded
    model = quality_classifier.fit(docs, labels)
    assert model.thresholds[0] <= model.thresholds[1]
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs.withColumn("kept", F.lit("clash")), model).collect()}
    assert len(got) == docs.count()
    clean = [got[i]["kept"] for i in range(900) if i % 10 < 7]
    noise = [got[i]["kept"] for i in range(900) if i % 10 in (7, 8)]
    toxic = [got[i]["kept"] for i in range(900) if i % 10 == 9]
    assert sum(clean) >= 0.98 * len(clean) and sum(noise) <= 0.02 * len(noise) and sum(toxic) <= 0.1 * len(toxic)
    kept = quality_classifier.filter_documents(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_without_labels(spark, graded, empty):
    docs, labels = graded
    assert quality_classifier.fit(docs, labels.where("false")) is None
    assert quality_classifier.classify(docs, None).where("kept").count() == docs.count()
    assert quality_classifier.classify(empty, None).count() == 0


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, r, n < 20 or 100 * r > 30 * n


def test_rule_statistics(spark, docs, texts, empty):
    rng = random.Random(1)
    more = {100: "x y z w " * 12 + prose(rng, 300), 101: "one line\n\none line\n  \none line", 102: " ".join(rng.choice("ab") for _ in range(400)), 103: "#| é\x1c <b>"}
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in quality_rules.judge(all_docs, None).collect()}
    for i, t in {**texts, **more}.items():
        if i != 12:
            r = got[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t), i
            assert r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(empty, None).count() == 0


def test_forest_keeps_clean_and_rejects_noise(graded):
    docs, labels = graded
    forest = quality_rules.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, forest).collect()}
    clean = [got[i]["kept"] for i in range(900) if i % 10 not in (7, 8) and not got[i]["base_failed"]]
    noise = [got[i]["kept"] for i in range(900) if i % 10 in (7, 8)]
    assert sum(clean) >= 0.98 * len(clean) and sum(noise) <= 0.2 * len(noise)
    kept = quality_rules.filter_documents(docs, forest)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.fit(docs, labels.where("false")) is None


def test_licenses(spark, empty):
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nReleased under the MIT license"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0."), (4, "a driving licence is needed here"), (5, None), (6, ""),
        (7, "This work is licensed under the GNU General Public License, version 3."), (8, "It is licensed under the Apache License, Version 2.0, as said"), (9, "This work is licensed under the GNU Affero General Public License, version 3."),
        (10, "We released a license plate under the bridge"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("clash"))
    got = {(r["doc_id"], r["license"], r["blocks"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {(1, "MIT", 2), (2, "CC-BY-NC-4.0", 1), (3, "CC-BY-4.0", 1), (7, "GPL-3.0", 1), (8, "Apache-2.0", 1), (9, "AGPL-3.0", 1)}
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_in_a_long_line():
    rng = random.Random(12)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for n in (0, 15, 40, 700, 1000, 2500, 12000):
        words = prose(rng, n).split()
        at = rng.randint(0, n)
        got = scanner.text(" ".join([*words[:at], "Licensed under the Apache License, Version 2.0.", *words[at:]]))
        assert {k: (d, c) for k, (_, d, c) in got.items()} == {"Apache-2.0": (0, 1)}, n
    near = scanner.text("the under license " * 9 + "It is licensed today under the new Apache License, Version 2.0, the license " * 2)
    assert near["Apache-2.0"][1:] == (1, 2)


BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
        ("Licensed under the MIT or Apache License, Version 2.0", {"MIT", "Apache-2.0"}),
        ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy", {"MPL-2.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", {"MIT"}),
        (BSD + " * 1. of source", {"BSD-2-Clause"}),
        (BSD + "word " * 100 + "3. Neither the name of the holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.", {"BSD-3-Clause"}),
        ("# SPDX-License-Identifier: MIT\nimport os", {"MIT"}),
        ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) AND MIT */", {"GPL-2.0", "BSD-2-Clause", "MIT"}),
        ("under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or", {"GPL-2.0"}),
        ("This library is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("Licensed under CC BY NC 4.0.", {"CC-BY-NC-4.0"}),
        ("licensed drivers are hereby asked for permission to endorse redistribution", set()),
    ],
)
def test_every_license_of_a_text(text, want):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    assert set(scanner.text(text)) == want
    assert set(scanner.text("some words before " * 60 + text + " and some after" * 60)) == want


def test_forest_rejects_repeats_without_symbols(spark, graded):
    docs, labels = graded
    rng = random.Random(13)
    rows = [(9000 + i, " ".join(w for w in prose(rng, 8).split() for _ in range(5 + i % 3))) for i in range(12)]
    rows += [(9100 + i, "\n".join(line for _ in range(8) for line in (prose(rng, 9), "read more here"))) for i in range(12)]
    more = docs.union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    marked = labels.union(spark.createDataFrame([(i, 0, 0) for i, _ in rows if i % 2], "doc_id bigint, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality_rules.judge(more, quality_rules.fit(more, marked)).collect()}
    assert not any(got[i]["base_failed"] for i, _ in rows)
    for first in (9000, 9100):
        assert sum(got[i]["kept"] for i, _ in rows if first <= i < first + 100) <= 1
    clean = [got[i]["kept"] for i in range(900) if i % 10 not in (7, 8) and not got[i]["base_failed"]]
    assert sum(clean) >= 0.98 * len(clean)


def brute_passages(scanner, text):
    """Passages of all templates over all words of a text, by edit alignments, without blocks or gates."""
    words, found = license_scan._words(text), set()
    for t, (wanted, marks) in enumerate(zip(scanner.words, scanner.marks)):
        n = len(wanted)
        for start in range(len(words)):
            # (template place, left out, put in): all ways on, from a word that matches
            todo = [(j, j, 0) for j in range(min(license_scan.MOST_DIFFERENCES + 1, n)) if wanted[j] == words[start] and not set(wanted[:j]) & marks]
            seen = set()
            while todo:
                j, left, more = todo.pop()
                if (j, left, more) in seen:
                    continue
                seen.add((j, left, more))
                if j == n:
                    found.add((t, start, start + n - left + more, max(left, more)))
                    continue
                if left < license_scan.MOST_DIFFERENCES and wanted[j] not in marks:
                    todo.append((j + 1, left + 1, more))
                for extra in range(more, license_scan.MOST_DIFFERENCES + 1):
                    at = start + j - left + extra
                    if at < len(words) and words[at] == wanted[j]:
                        todo.append((j + 1, left, extra))
    return {p for p in found if scanner.marks[p[0]] <= set(words[p[1] : p[2]])}


def test_no_passage_is_lost_by_blocks_or_gates():
    rng = random.Random(17)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    wordings = [" ".join(w) for w in scanner.words]
    for k in range(60):
        words = prose(rng, rng.randint(0, 90)).split()
        for _ in range(rng.randint(1, 3)):
            notice = rng.choice(wordings).split()
            for _ in range(rng.randint(0, 3)):  # words left out, replaced, put in
                at = rng.randrange(len(notice))
                notice[at : at + rng.randint(0, 1)] = [rng.choice(["x", "license", "the"])] * rng.randint(0, 1)
            at = rng.randint(0, len(words))
            words[at:at] = notice
        text = " ".join(words)
        got = {f[:4] for f in scanner._found(text)}
        assert {(i, a, b) for i, a, b, _ in got} == {(i, a, b) for i, a, b, _ in brute_passages(scanner, text)}, text


def test_ranking_is_by_size_reduction():
    import zstandard

    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    block = "released under the mit license licensed under the apache license version 2.0 and gnu general public license version 3 29 june 2007"
    got = scanner._block(block)
    plain = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(block.encode()))
    want = {}
    for i, words in enumerate(scanner.words):
        d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        want[i] = 1 - len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False).compress(block.encode())) / plain
    assert got and all(f[4] == want[f[0]] for f in got)
    order = [f[0] for f in got]
    assert order == sorted(order, key=lambda i: (-want[i], i)) and {scanner.names[i] for i in order} >= {"MIT", "Apache-2.0", "GPL-3.0"}


def brute_features(text):
    """The forest's statistics by their names, from words and lines as lists."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, symbols = len(words), set("#*$%&|<>")
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    plain = lambda c: c.isascii() and c.isalnum() or ord(c) > 127
    stretches = [words[i : i + quality_rules.STRETCH] for i in range(0, n, quality_rules.STRETCH)]
    return {
        "symbols_per_word": sum(c in symbols for c in text) / n, "mark_share": sum(c in "!?" for c in text) / n,
        "bare_share": sum(any(c in symbols for c in w) and not any(map(plain, w)) for w in words) / n, "symbol_word_share": sum(any(c in symbols for c in w) for w in words) / n,
        "repeat_share": brute_rules(text)[4] / n, "distinct_share": sum(len(set(s)) for s in stretches) / n, "top_word_share": max(map(words.count, set(words))) / n,
        "twin_share": sum(a == b for a, b in zip(words, words[1:])) / n, "dup_line_share": brute_rules(text)[3] / max(len(lines), 1), "mean_word": sum(map(len, words)) / n,
    }


def test_forest_equals_a_plain_walk(graded, texts):
    """Statistics from the text, paths node by node, and the verdict of every document."""
    docs, labels = graded
    forests = quality_rules.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, forests).collect()}
    for r in docs.collect():
        if not (r["text"] or "").split():
            continue
        found = brute_features(r["text"])
        assert quality_rules.statistics(r["text"])[1] == pytest.approx([found[name] for name in quality_rules.FEATURES])
        x, worst = [found[name] for name in quality_rules.FEATURES], 0.0
        if r["doc_id"] % 7:
            continue
        for columns, forest in forests.parts:
            own, paths = x[columns], []
            for feature, split, left, path in zip(forest.feature, forest.split, forest.left, forest.path):
                node = 0
                while feature[node] >= 0:
                    node = left[node] + (own[feature[node]] >= split[node])
                paths.append(path[node])
            worst = max(worst, 2 ** (-sum(paths) / len(paths) / forest.scale) / forest.threshold)
        row = got[r["doc_id"]]
        assert row["anomaly"] == pytest.approx(worst)
        assert row["kept"] == (worst <= 1 and not row["base_failed"]) or worst == pytest.approx(1)


def plain_threshold(score, good, most):
    """Calibration over lists: of all thresholds that keep enough good rows, the one with the largest gain."""
    right, wrong = sorted(s for s, g in zip(score, good) if g), [s for s, g in zip(score, good) if not g]
    floor = right[min(len(right) - 1, most)]
    options = {floor, right[-1] + 1e-6, *(s for s in wrong if s > floor)}
    return max(options, key=lambda t: (sum(s > t for s in wrong) - 4 * sum(s > t for s in right), -t))


def test_forests_learn_from_every_labelled_row(spark):
    """The thresholds are those over all labelled rows, thousands of them."""
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice(("ab", "cde", "fgh!", "ijkl")) + str(rng.randrange(200)) + rng.choice(("#", "", "", "")) * (i % 9 == 0) for _ in range(rng.randint(20, 30)))) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    forests = quality_rules.fit(docs, labels)
    measured = [(i % 9 > 0, *quality_rules.statistics(t)) for i, t in rows]
    measured = [(good, f) for good, base, f in measured if not quality_rules.base_failed(base)]
    x, good = __import__("numpy").array([f for _, f in measured]), [g for g, _ in measured]
    assert len(good) > 8000
    most, stays = -(-985 * sum(good) // 1000), [True] * len(good)
    for columns, forest in forests.parts:
        score = forest.scores(x[:, columns]).tolist()
        assert forest.threshold == plain_threshold([s for s, k in zip(score, stays) if k], [g for g, k in zip(good, stays) if k], most)
        stays = [k and s <= forest.threshold for k, s in zip(stays, score)]


def test_trees_draw_from_all_rows(spark):
    n = 9000
    rows = spark.range(n).select("id", F.array(*[F.col("id").cast("double") + k for k in range(3)]).alias("features"))
    x, drawn = quality_rules.draw(rows)
    again, same = quality_rules.draw(rows.repartition(7))
    assert (x == again).all() and (drawn == same).all() and drawn.shape == (quality_rules.TREES, quality_rules.TREE_ROWS)
    assert all(len({x[k][0] for k in tree}) == quality_rules.TREE_ROWS for tree in drawn)
    met = {int(row[0]) for row in x}
    assert len(met) == len(x) > 0.9 * n and all(row.tolist() == [row[0], row[0] + 1, row[0] + 2] for row in x)


@pytest.mark.parametrize("steps, n, most", [(7, 400, 150), (100000, 900, 500), (5000, 900, 10**6), (1, 50, 3), (100000, 300, 0)])
def test_thresholds_equal_plain_calibration(spark, steps, n, most):
    rng = random.Random(steps + n)
    rows = [(rng.randint(1, steps) / steps * (0.5 if g else 1), g) for g in (rng.random() < 0.7 for _ in range(n))]
    scored = spark.createDataFrame(rows, "score double, good boolean").repartition(3)
    assert quality_rules.calibrate(scored, most) == plain_threshold(*zip(*rows), most)


def test_kernel_counts_the_ngrams_both_texts_hold():
    bins = lambda t: {i for i, x in enumerate(language_id.presence(t)) if x}
    texts = ["the and with", "der ung ich ein", "été le ment", "the ung été", "x"]
    model = language_id.train(__import__("numpy").stack([language_id.presence(t) for t in texts]), ["en", "de", "fr", "en", "de"])
    kernel = model.kernel(__import__("numpy").stack([language_id.presence(t) for t in texts]))
    held = [bins(t) for t in texts]
    columns = [{i for i, x in enumerate(model.landmarks[:, k]) if x} for k in range(model.landmarks.shape[1])]
    for a, row in zip(held, kernel):
        for b, value in zip(columns, row):
            assert value == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, rel=1e-5)
    grams = {g for n in (1, 2, 3) for t in [" the and with ".encode()] for g in {t[i : i + n] for i in range(len(t) - n + 1)}}
    assert len(bins("the and with")) <= len(grams) and len(bins("the and with")) > 0.95 * len(grams)


def test_grades_follow_the_cumulative_link(graded):
    import math

    docs, labels = graded
    model = quality_classifier.fit(docs, labels)
    for r in docs.where("doc_id < 60").collect():
        score = float(sum(model.weights[b] for b in quality_classifier.features(r["text"])))
        upto = [1 / (1 + math.exp(score - t)) for t in model.thresholds]  # P(grade <= k)
        mass = [upto[0], upto[1] - upto[0], 1 - upto[1]]
        assert min(mass) >= 0 and sum(mass) == pytest.approx(1)
        expected, tail, kept = quality_classifier._judged(model, [r["text"]])
        assert expected[0] == pytest.approx(sum(k * m for k, m in enumerate(mass)), abs=1e-5) and tail[0] == pytest.approx(mass[2], abs=1e-5) and bool(kept[0]) == (tail[0] >= model.cut)
