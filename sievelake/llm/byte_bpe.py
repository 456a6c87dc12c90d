"""Byte-level BPE encoding and decoding by a sentencepiece model made straight from a rank file.

The vocabulary's byte strings become sentencepiece BPE pieces: every byte is mapped to one printable
character, the score of a piece is its negative rank, normalisation is the identity, and piece ``i``
has rank ``i``, so the model's ids are the file's ids. Nothing is trained. Text is split by the
public pre-token pattern, each pre-token is encoded on its own, and decoding is the inverse mapping
from id to bytes.

Ids are held as little-endian unsigned 32-bit integers in one binary value per text, so a text of
any length is one value. Null text counts as empty (no ids). Lone surrogates cannot occur in a Spark
string; other rows and columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bounded_bytes, held, text_or_empty, vocabulary_path

#: Pre-tokens whose ids a worker remembers; the memo is emptied when full, results don't depend on it.
MEMO = 200_000
#: Characters of a pre-token that is remembered at most.
MEMO_CHARS = 64
#: Bytes of text that are split into pre-tokens at once; they take some twenty times as much as Python objects.
CHUNK = 1 << 20


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else one from U+0100 on."""
    keeps = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in keeps:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(data: bytes) -> list[bytes]:
    """Byte strings of a rank file, in order of rank; ranks must be 0, 1, 2, ..."""
    ranks = dict(reversed(line.split()) for line in data.splitlines() if line.strip())
    pieces = [base64.b64decode(ranks[b"%d" % i]) for i in range(len(ranks))]
    if len(set(pieces)) != len(pieces):
        raise ValueError("a byte string has two ranks")
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces, an unknown piece after them, BPE, identity normalisation."""
    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        name = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, name) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    unknown, none = len(pieces), (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces) + 1)  # model_type BPE, vocab_size
    trainer += _field(40, unknown) + _field(41, none) + _field(42, none) + _field(43, none)
    out += _field(2, trainer)
    # name; no dummy prefix, white space neither removed nor escaped
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes with one vocabulary; made once per worker."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(data)
        model = sentencepiece.SentencePieceProcessor()
        model.LoadFromSerializedProto(serialise_model(self.pieces))
        self.encode_batch = lambda texts: model.encode(texts, num_threads=1)
        self.split = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.table = {ord(c): self.chars[b] for b, c in enumerate(map(chr, range(256)))}
        self.memo: dict[str, bytes] = {}

    def mapped(self, token: str) -> str:
        return token.encode().decode("latin-1").translate(self.table)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = list({token for tokens in split for token in tokens if token not in memo})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for token, ids in zip(part, self.encode_batch([self.mapped(t) for t in part]), strict=True):
                memo[token] = struct.pack(f"<{len(ids)}I", *ids)
        out = [b"".join([memo[token] for token in tokens]) for tokens in split]
        for token in fresh:
            if len(token) > MEMO_CHARS:
                del memo[token]
        return out

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        pieces = self.pieces
        return [b"".join([pieces[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in ids]


def codec(data: bytes, pattern: str) -> Codec:
    return held(("codec", hash(data), pattern), lambda: Codec(data, pattern))


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text in ``out_col``; null text has none."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(shipped.value, pattern)
        return lambda texts: [own.encode([t or "" for t in texts.to_pylist()])]

    return arrow_map(df, text_col, [T.StructField(out_col, T.BinaryType())], make, CHUNK)


def round_trip(
    df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """``df`` with the ids of each whole text, and the bytes decoded from those ids, in one pass."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(shipped.value, pattern)

        def both(texts):
            ids = own.encode([t or "" for t in texts.to_pylist()])
            return [ids, own.decode(ids)]

        return both

    return arrow_map(df, text_col, [T.StructField(c, T.BinaryType()) for c in (ids_col, out_col)], make, CHUNK)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for in ``out_col``; an id outside the vocabulary raises."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(shipped.value, pattern)
        return lambda ids: [own.decode(ids.to_pylist())]

    return arrow_map(df, ids_col, [T.StructField(out_col, T.BinaryType())], make, CHUNK)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Bytes of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    return bounded_bytes(vocabulary_path(name)), public_tokenizers.PATTERN


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty("text").alias("text"))
    return round_trip(docs, ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its ids (token_ids), their number (n_tokens) and whether they decode to its text
    (round_trip). Columns of ``docs`` with these names are replaced; all others stay."""
    ranks, pattern = vocabulary()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text_or_empty("text").alias("_text"))
    coded = round_trip(whole, ranks, pattern, "_text", "token_ids", "_decoded")
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", "round_trip")]
    return coded.select(
        *kept,
        "token_ids",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        (F.col("_decoded") == F.encode("_text", "utf-8")).alias("round_trip"),
    )
