"""Encoding, counting and binary output against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from reelgraph.llm import sentencepiece_codec as S
from reelgraph.llm import token_counts, token_output
from reelgraph.llm.word_bpe import WordBpe, word_bpe

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(WORDS))


def test_sentencepiece_equals_library(docs, texts, library):
    got = {r["doc_id"]: r for r in S.digest_documents(docs.withColumn("n_tokens", F.lit(9)).withColumn("id", F.lit("x")), PIECES).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[i]["span_bytes"] == len((t or "").encode())


def test_spans_give_pieces(texts):
    c = S.codec(PIECES)
    for t in ("Hello wörld", "a  b\n▁c 漢🎉"):
        e, raw = c.encode(t), t.encode()
        assert e.starts[0] == 0 and e.ends[-1] == len(raw) and (e.starts[1:] == e.ends[:-1]).all()
        plain = [p for p in c.lib.id_to_piece(e.ids[:-1].tolist())]
        for piece, a, b in zip(plain, e.starts, e.ends):
            if not piece.startswith("<0x") and a < b:
                assert raw[a:b].decode().replace(" ", "▁") in piece


def test_normalizer_follows_a_compiled_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = proto.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    ours = S.Normalizer(model.normalizer_spec)
    for t in ("ｆｕｌｌ　width ①②", "  a  b ", "", "ﬁne ﾊﾟ é", "a b\tc\r\n", "   "):
        n = ours(t)
        assert n.text == lib.normalize(t), t
        assert len(n.source) == len(n.text.encode()) + 1 and (np.diff(n.source) >= 0).all()


def test_word_counts_equal_library(docs, texts, words):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, WORDS).collect()}
    for i, t in texts.items():
        n = len(words.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048), i


def test_random_texts_equal_library(words):
    rng = np.random.default_rng(3)
    letters = [chr(i) for i in range(256)] + list("aaathe's''s'll've re ") * 4
    samples = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)] + ["'" * 4000, "ab" * 3000]
    w = word_bpe(WORDS)
    for t, ids, n in zip(samples, w.encode_batch(samples), w.count_batch(samples)):
        want = words.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and n == len(want)


def test_binary_output_round_trip(spark, docs, texts, words, tmp_path):
    path = f"file://{tmp_path}/set"
    token_output.write_documents(docs, WORDS, 2, path)
    got = {r["doc_id"]: r for r in token_output.read_documents(spark, path, with_ids=True).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*words.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert list(got[i]["ids"]) == ids and got[i]["start"] == start and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_block_checkpoints_and_checksums():
    ids = (np.random.default_rng(1).zipf(1.4, 400_000) % 5000).astype(np.uint32)
    tables = token_output.Tables(token_output.normalized_shares(np.bincount(ids, minlength=5000)))
    payload = token_output.encode_block(ids, tables)
    assert (token_output.decode_block(payload, tables) == ids).all()
    every = token_output.LANES * token_output.CHECKPOINT_STEPS
    assert (token_output.decode_block(payload, tables, 2) == ids[2 * every : 3 * every]).all()
    with pytest.raises(ValueError):
        token_output.decode_block(payload[:-1] + bytes([payload[-1] ^ 1]), tables)
    for n in (0, 1, 65):
        assert (token_output.decode_block(token_output.encode_block(ids[:n], tables), tables) == ids[:n]).all()


def test_shares_fill_all_slots():
    counts = np.array([0, 1, 10**12, 3, 0, 7])
    share = token_output.normalized_shares(counts)
    assert share.sum() == 1 << token_output.SLOT_BITS and ((share > 0) == (counts > 0)).all()


def test_empty_tables(empty):
    assert S.digest_documents(empty, PIECES).count() == 0
    assert token_counts.count_tokens(empty, WORDS).count() == 0
    assert token_output.round_trip(empty, WORDS, 2).count() == 0


def test_repeated_rows_and_null_ids(spark, words):
    rows = [(5, "b b"), (None, "z"), (5, "b b"), (2, None), (5, "a")]
    got = token_output.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string"), WORDS, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 2, 5, 5, 5]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_states_keep_within_their_bound(words, monkeypatch):
    """Tables are dropped in the middle of texts, on every path, without a change of the result."""
    from reelgraph.llm import transducer

    monkeypatch.setattr(transducer, "MOST_BYTES", 200_000)
    rng = np.random.default_rng(4)
    samples = ["".join(rng.choice(list("etaoinshrdlu" * 3 + " "), rng.integers(1, 3000))) for _ in range(40)]
    w, c = WordBpe(public_tokenizers.path(WORDS)), S.Codec(public_tokenizers.path(PIECES))
    for _ in range(2):
        for t, ids, n, pieces in zip(samples, w.encode_batch(samples), w.count_batch(samples), c.encode_batch(samples)):
            want = words.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want and n == len(want) and pieces.tolist() == c.lib.encode(t)
        step = transducer.CHUNK * 1000  # what one step of all lanes may add
        assert w.machine.size < 200_000 + step and c.machine.size < 200_000 + step
    assert w.machine.filled > 4 * len(w.machine.states) and c.machine.filled > 4 * len(c.machine.states)


def test_all_of_utf8_runs_through_the_tables(words, monkeypatch):
    rng = np.random.default_rng(6)
    parts = ["“quoted”", "don’t", "it's", "—", "naïve", "漢字", "ДОБРО", "ΣΑΣ", "İ", "ﬁne", "①", "٣", "🎉", "é", "​", "\xa0", " ", " ", " ", "word", "they're"]
    samples = ["".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(300)] + ["".join(map(chr, rng.integers(1, 0xD7FF, 40))) for _ in range(300)]
    want = [words.encode(t, add_special_tokens=False).ids for t in samples]
    w = WordBpe(public_tokenizers.path(WORDS))
    sentence = S.Codec(public_tokenizers.path(PIECES))
    pieces = [sentence.lib.encode(t) for t in samples]

    class Silent:
        normalizer, pre_tokenizer = w.lib.normalizer, w.lib.pre_tokenizer

        def encode(self, *_, **__):
            raise AssertionError("a text went to the library")

    monkeypatch.setattr(w, "lib", Silent())
    monkeypatch.setattr(sentence, "lib", Silent())
    assert [i.tolist() for i in w.encode_batch(samples)] == want
    assert w.count_batch(samples) == [len(i) for i in want]
    assert [i.tolist() for i in sentence.encode_batch(samples)] == pieces


def test_state_maps_of_long_words(words, monkeypatch):
    """Chunks inside words are entered in several states, and maps that lack one are extended."""
    from reelgraph.llm import transducer

    rng = np.random.default_rng(7)
    samples = ["".join(rng.choice(["ing", "tion", "a", "aa", "er"], 4000)) for _ in range(3)] + ["a" * 9000, "x y", "", "ab" * 3000]
    want = [len(words.encode(t, add_special_tokens=False).ids) for t in samples]
    for chunk, warm in ((1024, (64, 16)), (64, (4, 1)), (16, (8, 2))):
        monkeypatch.setattr(transducer, "CHUNK", chunk)
        monkeypatch.setattr(transducer, "WARM", warm)
        w = WordBpe(public_tokenizers.path(WORDS))
        columns, ends, stops = w._symbols(samples)
        several = [len(e) for e in w.machine.guesses(columns, ends, np.arange(0, len(columns), chunk))]
        assert chunk > 64 or max(several) > 1
        assert w.count_batch(samples) == want
        assert [len(i) for i in w.encode_batch(samples)] == want


def test_a_long_random_word_costs_about_what_the_library_takes(words):
    import time

    t = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz"), 300_000))
    start = time.perf_counter()
    n = len(words.encode(t, add_special_tokens=False).ids)
    library, start = time.perf_counter() - start, time.perf_counter()
    assert word_bpe(WORDS).count_batch([t]) == [n]
    assert time.perf_counter() - start < 2 * library + 1


def test_spans_follow_the_alignment(texts):
    """Every piece's span, against a plain walk through the normalised text."""
    c = S.codec(PIECES)
    for t in filter(None, texts.values()):
        e, at, out = c.encode(t), 0, []
        source = [0, 0, 0] + [i for i, b in enumerate(t.encode()) for _ in range(3 if b == 32 else 1)] + [len(t.encode())]
        for i in e.ids[:-1].tolist():
            to = at + (1 if c.lib.is_byte(i) else len(c.lib.id_to_piece(i).encode()))
            out.append((source[at], source[to]))
            at = to
        assert list(zip(e.starts.tolist(), e.ends.tolist())) == out
        assert c.normalizer(t).source.tolist() == source == c.normalizer.alignment(t).tolist()


def test_blocks_are_in_order_and_spans_are_read_by_checkpoints(spark, docs, texts, words, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 4000)
    path = f"file://{tmp_path}/set"
    token_output.write_documents(docs, WORDS, 2, path)
    met = [i for f in sorted(glob.glob(f"{tmp_path}/set/blocks/part-*")) for row in pq.read_table(f, columns=["doc_ids"]).column(0).to_pylist() for i in row]
    assert met == sorted(texts)
    ids = [x for i in sorted(texts) for x in (*words.encode(texts[i] or "", add_special_tokens=False).ids, 2)]
    for start, stop in ((0, 10), (100, 9000), (len(ids) - 3, len(ids) + 50), (5, 5)):
        got = [x for r in token_output.read_span(spark, path, start, stop).orderBy("start").collect() for x in r["ids"]]
        assert got == ids[start:stop], (start, stop)
    long = (np.random.default_rng(1).zipf(1.4, 400_000) % 5000).astype(np.uint32)
    tables = token_output.Tables(token_output.normalized_shares(np.bincount(long, minlength=5000)))
    payload = token_output.encode_block(long, tables)
    for a, b in ((0, 1), (131_071, 131_073), (250_000, 399_999), (399_990, 500_000)):
        assert (token_output.decode_block(payload, tables, span=(a, b)) == long[a:b]).all()
