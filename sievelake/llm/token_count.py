"""Token counts by byte-pair merging on a heap and a linked list, without emitting identifiers.

A pre-token's bytes are symbols in a doubly linked list; a heap holds adjacent pairs by rank and
place; the lowest-rank pair is popped and merged until none is left. The count is the number of
initial symbols minus the number of merges. Special strings of the tokenizer file that stand inside
a text count as one token each, as that library does by default.

Null text counts as empty: no bytes, no tokens. Other columns pass through, and a column named like
the output is replaced.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import MEMO_CHARS, byte_characters
from .common import arrow_map, bounded_bytes, held, text_or_empty, vocabulary_path

#: Pre-tokens whose counts a worker remembers; the memo is emptied when full, results don't depend on it.
MEMO = 1_000_000


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the adjacent pairs have been merged, lowest rank first."""
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapify(heap)
    symbol, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i = heappop(heap)
        j = after[i] if symbol[i] else n
        if j >= n or ranks.get((symbol[i], symbol[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbol[i] += symbol[j]
        symbol[j] = ""
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
            heappush(heap, (r, h))
    return n - merges


class Counter:
    """Counts tokens as a byte-level BPE tokenizer file has it; made once per worker."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        file = json.loads(data)
        model, split = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or file["normalizer"] or split["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser or prefix space is known")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        names = [t["content"] for t in file["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not known")
        names.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.memo: dict[str, int] = {}

    def piece(self, token: str) -> int:
        return count_merged(list(token.encode().decode("latin-1").translate(self.table)), self.ranks)

    def plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for token in self.split(text):
            n = memo.get(token)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = self.piece(token)
                if len(token) <= MEMO_CHARS:
                    memo[token] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def counter(data: bytes, pattern: str) -> Counter:
    return held(("counter", hash(data), pattern), lambda: Counter(data, pattern))


def count_tokens(
    df: DataFrame, tokenizer: bytes, pattern: str, text_col: str = "text", out_col: str = "n_tokens"
) -> DataFrame:
    """``df`` with the number of tokens of each whole text in ``out_col``."""
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        own = counter(shipped.value, pattern)
        return lambda texts: [[own.count(t or "") for t in texts.to_pylist()]]

    return arrow_map(df, text_col, [T.StructField(out_col, T.LongType())], make)


def op8_query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty("text").alias("text"))
    counted = count_tokens(docs, bounded_bytes(vocabulary_path("byte_bpe_50k.json")), public_tokenizers.PATTERN)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
