"""Benchmark decontamination by pigeonhole edit matching.

Document and test item are lower-cased, and every run of other characters than letters and digits
becomes one space. An item of n characters allows k = n // 10 edits and is split into k + 1 pieces;
where the item occurs with k edits or fewer, one piece at least occurs unchanged. One automaton
finds the exact hits of all pieces in a document; each hit names an item and a place, and the text
around it is verified with Myers' bit-parallel edit distance (one machine word as long as the item).

The pigeonhole holds at every scale: of m pieces with fewer than m edits, one half has fewer edits
than pieces. So a hit is verified in growing neighbourhoods of its piece, two or three pieces first
and the whole item last, and is dropped at the first that has too many edits.

The test items are the stated query set: they are shipped to the executors in blocks of bounded size
(``BLOCK_CHARS``), so their number is not limited. The documents are read once: if there are several
blocks, a task takes its documents in groups of ``GROUP_BYTES`` and matches a group against one block after
the other. A worker holds one block's automaton at a time; bit vectors are made when a hit needs them.

A match is reported as (document, item, distance, begin, end), with offsets into the normalised
text; the end is that of the first occurrence with the least distance. An item of fewer than
``MIN_CHARS`` normalised characters says nothing inside a text: it matches a document that consists of
nothing else. Null and empty items and documents never match. Items with equal texts match alike. Other
columns are ignored; rows that repeat an id are matched each on its own, with or without an id.
"""

from __future__ import annotations

import functools
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks, held

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 10
MIN_CHARS = 20
#: Characters of test items in one block; its automaton takes some 100 bytes for each.
BLOCK_CHARS = 2_000_000
#: Bytes of text that a task matches against a block before it takes the next one, if there are several.
GROUP_BYTES = 32 << 20
#: Bit vectors that a matcher keeps, of a few kB each; others are made again.
PATTERNS = 4096

SCHEMA = "doc_id bigint, item_id bigint, distance int, begin int, end int"

_other = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _other.sub(" ", (text or "").lower()).strip()


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """The item cut into one piece more than it may have edits: (offset, piece), of about equal length."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the substring of ``text`` nearest to the item, the first one; None if over ``most``."""
        full, last = (1 << self.size) - 1, self.size - 1
        plus, minus, score = full, 0, self.size
        best, end = most + 1, -1
        left = len(text)
        get = self.masks.get
        for at, c in enumerate(text):
            eq = get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            score += (up >> last & 1) - (down >> last & 1)
            if score < best:
                best, end = score, at + 1
            left -= 1
            if score - left >= best:
                break  # the rest can't get below the best
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
        return (best, end) if best <= most else None

    def begin(self, text: str, end: int, distance: int) -> int:
        """Where the match that ends at ``end`` begins (the latest such place)."""
        back = Pattern.__new__(Pattern)
        back.size = self.size
        back.masks = {c: int(f"{m:0{self.size}b}"[::-1], 2) for c, m in self.masks.items()}
        found = back.search_anchored(text[max(0, end - self.size - distance) : end][::-1], distance)
        return end - found

    def search_anchored(self, text: str, distance: int) -> int:
        """Length of the shortest prefix of ``text`` within ``distance`` of the item."""
        row = list(range(self.size + 1))
        order = {i: c for c, m in self.masks.items() for i in range(self.size) if m >> i & 1}
        for n, c in enumerate(text, 1):
            left, row[0] = row[0], n
            for i in range(1, self.size + 1):
                left, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, left + (order[i - 1] != c))
            if row[-1] <= distance:
                return n
        return len(text)


@functools.cache
def neighbourhoods(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces, the (first, last) runs of pieces around it, growing, without the whole."""
    out: list[list] = [[] for _ in range(n)]

    def split(first: int, last: int) -> None:
        if last - first < 2:
            return
        if last - first < n:
            for piece in range(first, last):
                out[piece].insert(0, (first, last))
        middle = (first + last) // 2
        split(first, middle)
        split(middle, last)

    split(0, n)
    return out


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.short: dict[str, list[int]] = {}
        self.items = []
        for item_id, text in items:
            if len(text) < MIN_CHARS:
                self.short.setdefault(text, []).append(item_id)
            else:
                self.items.append((item_id, text))
        places: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(self.items):
            for n, (_, piece) in enumerate(pieces(text)):
                places.setdefault(piece, []).extend((i, n))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, array("i", where))
        if self.items:
            self.automaton.make_automaton()
        self.pattern = functools.lru_cache(PATTERNS)(lambda i, begin, end: Pattern(self.items[i][1][begin:end]))
        self.cuts = functools.lru_cache(PATTERNS)(lambda i: pieces(self.items[i][1]))

    def close_by(self, i: int, piece: int, start: int, text: str) -> bool:
        """Whether every neighbourhood of a piece that stands in its place has few enough edits.

        Of a run's other pieces, which have no more edits than there are pieces, one has one edit at most, so half of
        it stands in the text unchanged: that is looked for first.
        """
        cut = self.cuts(i)
        for first, last in neighbourhoods(len(cut))[piece]:
            begin, end = cut[first][0], cut[last - 1][0] + len(cut[last - 1][1])
            most = last - first - 1
            around = text[max(0, start + begin - most) : max(0, start + end + most)]
            for n in range(first, last):
                half = cut[n][1]
                if n != piece and (half[: len(half) // 2] in around or half[len(half) // 2 :] in around):
                    break
            else:
                return False
            if not self.pattern(i, begin, end).search(around, most):
                return False
        return True

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, begin, end) of every item that occurs in a normalised text."""
        out = [(item_id, 0, 0, len(text)) for item_id in self.short.get(text, ()) if text]
        if not self.items:
            return out
        starts: dict[int, set[int]] = {}
        for at, where in self.automaton.iter(text):
            for i, piece in zip(where[::2], where[1::2], strict=True):
                offset, own = self.cuts(i)[piece]
                start = at + 1 - len(own) - offset
                if start not in starts.get(i, ()) and self.close_by(i, piece, start, text):
                    starts.setdefault(i, set()).add(start)
        for i, found in starts.items():
            item_id, item = self.items[i]
            most, pattern = budget(item), self.pattern(i, 0, len(item))
            best = None
            for start in sorted(found):
                low, high = max(0, start - most), max(0, start + len(item) + most)
                hit = pattern.search(text[low:high], most if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], low + hit[1])
                    if not best[0]:
                        break
            if best:
                out.append((item_id, best[0], pattern.begin(text, best[1], best[0]), best[1]))
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised test items in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        text = normalised(row.text)
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def matched(rows: DataFrame, benchmark: DataFrame, text_col: str, give: Callable, schema: T.StructType) -> DataFrame:
    """One pass over ``rows``: ``give`` makes a batch from one of them and the matches of each of its texts."""
    bounded_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    shipped = [context.broadcast(block) for block in blocks(benchmark)]
    run_key = uuid.uuid4().hex
    if not shipped:
        return rows.mapInArrow(lambda batches: (give(b, [[]] * b.num_rows) for b in batches), schema)

    def matcher(n: int) -> Matcher:
        return held(("matcher", run_key, n), lambda: Matcher(shipped[n].value))

    def several(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[[] for _ in range(part.num_rows)] for part in group]
        for n in range(len(shipped)):
            own = matcher(n)
            for part, lists in zip(group, found, strict=True):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                for text, matches in zip(texts, lists, strict=True):
                    matches += own.matches(normalised(text))
        for part, lists in zip(group, found, strict=True):
            yield give(part, lists)

    def run(batches):
        group, size = [], 0
        for batch in batches:
            for part in chunks(batch, text_col):
                group.append(part)
                size += part.column(part.schema.get_field_index(text_col)).nbytes
                if len(shipped) == 1 or size > GROUP_BYTES:
                    yield from several(group)
                    group, size = [], 0
        yield from several(group)

    return rows.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, begin, end) of every test item that occurs in a document."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def give(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        out = [(doc, *match) for doc, matches in zip(part.column(0).to_pylist(), found, strict=True) for match in matches]
        columns = [pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.int32()) for i in range(5)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "begin", "end"])

    return matched(rows, benchmark, "text", give, T._parse_datatype_string(SCHEMA))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no test item occurs, with their columns as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def give(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        clean = pa.array([not matches for matches in found], pa.bool_())
        return pa.RecordBatch.from_arrays([part.column(0).filter(clean)], names=["_doc"])

    return matched(whole, benchmark, "_text", give, whole.select("_doc").schema).select("_doc.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which no test item occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
