import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievelake.llm import byte_bpe, token_count
from sievelake.llm.common import bounded_bytes

TEXTS = [
    "", "a", " ", "\n\n  x\t", "it's 'S don't WE'LL", "日本語テスト 🎉👩‍👩‍👧", "é́ ́a ² １２", "a" * 5000, " " * 3000, "ab" * 4000, "\x00\x1c\x85 ",
    "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y", "<|endoftext", "word " * 2000, " 　z",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples(spark, sf):
    return TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_ids_are_those_of_the_library(spark, sf, reference):
    texts = samples(spark, sf)
    codec = byte_bpe.Codec(*byte_bpe.vocabulary())
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = reference.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want)
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]


def test_every_code_point(reference):
    codec = byte_bpe.Codec(*byte_bpe.vocabulary())
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = reference.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want), ascii(text)


def test_counts_are_those_of_the_library(spark, sf):
    texts = samples(spark, sf)
    own = token_count.Counter(bounded_bytes(P.path("byte_bpe_50k.json")), P.PATTERN)
    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert [own.count(t) for t in texts] == [len(e.ids) for e in want]


def test_merging_by_hand():
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "a"): 2}
    assert token_count.count_merged(list("abab"), ranks) == 1
    assert token_count.count_merged(list("bab"), ranks) == 2
    assert token_count.count_merged(["a"], ranks) == 1
    assert token_count.count_merged([], ranks) == 0


def test_frames_with_nulls_and_clashing_columns(spark, reference):
    ranks, pattern = byte_bpe.vocabulary()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id bigint, text string, IDS string")
    coded = byte_bpe.decode(byte_bpe.encode(df, ranks, pattern), ranks, pattern)
    rows = coded.orderBy("doc_id").collect()
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert [bytes(r.decoded) for r in rows] == [b"", b"", b"hello world", b"hello world"]
    n = 4 * len(reference.encode_ordinary("hello world"))
    assert [len(r.ids) for r in rows] == [0, 0, n, n]
    both = byte_bpe.round_trip(df, ranks, pattern).orderBy("doc_id")
    assert both.columns == coded.columns and both.collect() == rows
    counted = token_count.count_tokens(df.withColumnRenamed("IDS", "N_TOKENS"), bounded_bytes(P.path("byte_bpe_50k.json")), pattern)
    assert counted.columns == ["doc_id", "text", "n_tokens"]
    assert [r.n_tokens for r in counted.orderBy("doc_id").collect()] == [0, 0, 2, 2]
    empty = df.limit(0)
    assert byte_bpe.encode(empty, ranks, pattern).collect() == []


def test_a_full_memo_does_not_change_results(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    monkeypatch.setattr(token_count, "MEMO", 3)
    codec = byte_bpe.Codec(*byte_bpe.vocabulary())
    assert [codec.decode(codec.encode([t]))[0] for t in TEXTS] == [t.encode() for t in TEXTS]
    own = token_count.Counter(bounded_bytes(P.path("byte_bpe_50k.json")), P.PATTERN)
    assert own.count("one two three four five one two three") == 8


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, "repeated id"), (None, "no id")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n_tokens string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_op5_query_equals_the_library(spark, documents, reference):
    sf_dir, rows = documents
    want = set()
    for doc, text in rows:
        ids = reference.encode_ordinary(text or "")
        want.add((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = byte_bpe.op5_query(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_op8_query_equals_the_library(spark, documents):
    sf_dir, rows = documents
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for doc, text in rows:
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        want.add((doc, len((text or "").encode()), n, n > 512))
    got = token_count.op8_query(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == want and len({r.over_limit for r in got}) == 2


def test_stage_keeps_other_columns(spark, documents):
    docs = spark.read.parquet(f"{documents[0]}/documents.parquet").selectExpr("*", "1 AS _decoded", "2 AS decoded_bytes")
    out = byte_bpe.stage(spark, docs, "")
    assert out.columns == ["doc_id", "text", "_decoded", "decoded_bytes", "token_ids", "n_tokens", "round_trip"]
    rows = out.collect()
    assert len(rows) == len(documents[1]) and all(r.round_trip and 4 * r.n_tokens == len(r.token_ids) and r.decoded_bytes == 2 for r in rows)
