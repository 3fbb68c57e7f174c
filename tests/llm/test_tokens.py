"""Token counts, blocks and packing against the tokenizers library."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deltaloom.llm import packing, token_blocks, token_counts
from deltaloom.llm.tokens import Encoder, vocabulary

TEXTS = [None, "", " ", "\n", "a  b\n\n c\t\td's 'S can't I'LL\xa0x \x1cfoo\x1d  end  ", "½ ²x ª\x85y  \n z", "<|endoftext|> hi <|startoftext|>", "  lead", "é É ß ÿ Ÿ µ", "İstanbul Σς", "x" * 3000 + " y", "The quick brown fox. " * 900, "日本語 text", "áé"]
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


@functools.cache
def library(name):
    return Tokenizer.from_file(vocabulary(name))


def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_encoder_equals_library(name):
    own = Encoder(name)
    for _ in range(2):  # new, then kept
        for text, got in zip(TEXTS, own.encode_all(TEXTS), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(name, text)


@pytest.fixture(scope="module", params=[WORDS, BYTES])
def pair(request):
    return Encoder(request.param), token_counts.TokenCounter(request.param), library(request.param)


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.characters(max_codepoint=0xFF, exclude_categories=["Cs"]), st.sampled_from(" \n\t'sSdDxX.,<|>é")), max_size=60))
def test_any_latin_text(pair, text):
    encoder, counter, lib = pair
    want = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == want
    assert counter.count_all([text]) == [len(want)]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sSdDxX.,é’“”—…\u2009\u3000\u200bжЖΣσ日́")), max_size=40))
def test_any_text(pair, text):
    encoder, counter, lib = pair
    want = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == want
    assert counter.count_all([text]) == [len(want)]


def test_long_texts_in_segments(pair, monkeypatch):
    from deltaloom.llm import tokens

    encoder, counter, lib = pair
    text = "The quick  brown\n\n fox, l’été — жук.\t" * 300
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    for x in (text, "x" * 200, "x" * 120 + " y", text + "<|endoftext|>"):
        want = lib.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode_all(["a", x, None])[1], "<u4").tolist() == want
        assert counter.count_all([x, "a"])[0] == len(want)
    assert len(encoder.segments(text)) > 100


def test_what_is_kept_has_a_bound():
    encoder = Encoder(WORDS, 10)
    encoder.encode_all([" ".join(f"w{i}" for i in range(50))])
    assert len(encoder.kept) == 10


def test_whole_tokens_are_proven():
    counter = token_counts.TokenCounter(WORDS)
    assert len(counter.proven) > 20_000 and "the" in counter.proven
    assert all(len(ids_of(WORDS, x)) == 1 for x in sorted(counter.proven)[:200])


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens string")


def test_counts(spark):
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark), WORDS).collect()}
    for i, t in enumerate(TEXTS):
        n = len(ids_of(WORDS, t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert token_counts.token_counts(frame(spark, []), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=600), st.integers(1, 100))
def test_segments_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    cut = len(x) // 3
    data = token_blocks.encode_segment(x, [5, None], [cut, len(x) - cut], percentile)
    back, docs, lengths = token_blocks.decode_segment(data)
    assert back.tolist() == ids and docs == [5, None] and lengths.tolist() == [cut, len(x) - cut]


def test_blocks_are_patched_not_widened():
    x = np.full(128, 7, np.uint32)
    x[5] = 60_000
    assert len(token_blocks.encode_segment(x, [1], [128])) < 128


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_blocks, "SEGMENT_IDS", 50)
    docs = frame(spark).repartition(3)
    got = token_blocks.read_blocks(token_blocks.write_blocks(docs, WORDS, 2)).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        want = [*ids_of(WORDS, t), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), crc(want))
        at += len(want)
    assert token_blocks.read_blocks(token_blocks.write_blocks(frame(spark, []), WORDS, 2)).count() == 0


def test_blocks_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, "c"), (None, None)], "doc_id long, text string")
    got = token_blocks.read_blocks(token_blocks.write_blocks(docs, WORDS, 2), with_ids=True).collect()
    assert len(got) == 5 and sorted(r["start"] for r in got) == [0, *np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist()]
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_patterns_use_up_the_histogram(histogram):
    used = dict.fromkeys(histogram, 0)
    for count, lengths in packing.shortest_pack_first(histogram, 64):
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += count
    assert used == histogram


def check_packed(rows, texts, limit=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        want, at = [*ids_of(BYTES, t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == crc(want[at : at + r["length"]])
            at += r["length"]
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit


def test_packing(spark, monkeypatch):
    texts = [*TEXTS, *("w " * n for n in range(1, 60)), *["same text"] * 50]
    monkeypatch.setattr(packing, "SALTS", 7)
    packed = packing.pack_documents(frame(spark, texts).repartition(4), BYTES, 1, with_ids=True)
    rows = packed.collect()
    check_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= total // 2048 + 2
    assert all(len(r["ids"]) == 4 * r["n_ids"] for r in packing.sequences(packed).collect())
    assert packing.pack_documents(frame(spark, []), BYTES, 1).count() == 0
