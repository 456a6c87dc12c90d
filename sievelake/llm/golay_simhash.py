"""SimHash near-duplicate groups, with candidates from Golay-code fuzzy hashing.

A document's fingerprint has 64 bits, one majority vote each over the XXH64 hashes of its word
shingles. To find all fingerprints within three bits of each other, a fingerprint is cut into three
segments, each read as a word of the perfect binary Golay code [23, 12, 7] (padded with zeros). Each
word has a nearest codeword, at distance three or less, and up to five more at distance four.

If two words differ in one bit or not at all, the nearest codeword of one lies within distance four
of the other. By pigeonhole, three errors leave two of three segments with one error each at most.
For such a pair of segments, one side looks up all codewords near its first segment with the nearest
one of its second, the other side the nearest of its first with all near its second: they meet at the
second side's nearest codeword of the first segment and the first side's nearest of the second. So
some 32 keys of a fingerprint, whichever side they stand for, lose no link.

Only different fingerprints are joined: all documents with one fingerprint count as one node, so a
group of copies of any size costs one row. Fingerprints meet in buckets by key, where the Hamming
distance of candidates is verified. A bucket gives its links as a spanning forest (all of them, if it
has few members): as many links as members at most, and the same components as all of its pairs. A
bucket of more than ``BUCKET`` members is put off and dealt to pairs of blocks, each a bucket of its own.
Links become components by min-label propagation with pointer jumping, each round written to the
shared folder.

Null and empty texts have fingerprint zero and are linked like any other. A fingerprint is a node, whatever
the ids of its rows: rows with equal ids are linked by their fingerprints only, and rows without id link others.
A null id names a component only if it has no other id. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, written

SEED = 42
SEGMENT_BITS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Buckets of so many members give all their links.
SMALL = 8
#: Members of a bucket that one task compares with each other at most.
BUCKET = 4096
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class Golay:
    """Codewords near a 23-bit word, as 12-bit codeword indices."""

    def __init__(self):
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        of_bit = [remainder(1 << b) for b in range(23)]
        self.low, self.high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for table, first, bits in ((self.low, 0, 12), (self.high, 12, 11)):
            for x in range(1 << bits):
                for b in range(bits):
                    if x >> b & 1:
                        table[x] ^= of_bit[first + b]
        #: Per syndrome: the error to the nearest codeword, then those of weight four.
        self.errors = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, int)
        errors = [(0, 0)]
        level = [(0, 0, 0)]
        for _ in range(4):
            level = [(e | 1 << b, s ^ of_bit[b], b + 1) for e, s, first in level for b in range(first, 23)]
            errors += [(e, s) for e, s, _ in level]
        for e, s in errors:  # by weight
            self.errors[s, filled[s]] = e
            filled[s] += 1

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords within distance four, the nearest first, -1 where there are fewer."""
        errors = self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def near_indices(fingerprints: np.ndarray) -> list[np.ndarray]:
    """Codeword indices of the three segments of unsigned 64-bit fingerprints."""
    out, shift = [], 0
    for bits in SEGMENT_BITS:
        segment = (fingerprints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        out.append(golay().near(segment.astype(np.int64)))
        shift += bits
    return out


def key_table(fingerprints: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint for one side of the join: the left one spreads the first segment of a pair."""
    near = near_indices(fingerprints)
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        a, b = (near[i], near[j][:, :1]) if left else (near[i][:, :1], near[j])
        key = (np.int64(p) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        row, at, to = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        rows.append(row)
        keys.append(key[row, at, to])
    return np.concatenate(rows), np.concatenate(keys)


def with_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp, node) of every node under each of its keys."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column(0).to_numpy().view(np.uint64)
                (r1, k1), (r2, k2) = key_table(fps, True), key_table(fps, False)
                row, key = np.unique(np.stack([np.concatenate((r1, r2)), np.concatenate((k1, k2))]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *[c.take(pa.array(row)) for c in part.columns]], names=["key", "fp", "node"]
                )

    return nodes.select("fp", "node").mapInArrow(run, "key bigint, fp bigint, node bigint")


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different fingerprints ``most`` bits apart, as places: a spanning forest of all such links."""
    heads, tails = [], []
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            v = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[v]) <= most
            new = left[near]
            if len(new):
                heads.append(np.full(len(new), v))
                tails.append(new)
                frontier += new.tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def bucket_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by key, as places."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    size = np.repeat(sizes, sizes)
    heads, tails = [], []
    small = size <= SMALL
    for step in range(1, SMALL):
        at = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]))
        if not len(at):
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= most]
        heads.append(at)
        tails.append(at + step)
    for start, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = forest(fps[start : start + n], most)
        heads.append(a + start)
        tails.append(b + start)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def links_by_bucket(keyed: DataFrame, most: int, put_off: int | None) -> DataFrame:
    """(key, a, b) from (key, fp, node): links with key null, and (key, fp, node) of buckets over ``put_off`` members."""

    def emit(keys, fps, nodes):
        a, b = bucket_links(keys, fps, most)
        a, b = nodes[a], nodes[b]
        ok = a != b
        n = int(ok.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a[ok]), pa.array(b[ok])], names=["key", "a", "b"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        hot = None  # the key of a bucket that is being put off
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            keys, fps, nodes = (np.concatenate(x) for x in zip(held, new, strict=True))
            end = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            whole = [x[:end] for x in (keys, fps, nodes)]
            held = [x[end:] for x in (keys, fps, nodes)]
            big = [whole[0] == hot] if hot is not None else []
            if put_off:
                starts = np.flatnonzero(np.concatenate(([True], whole[0][1:] != whole[0][:-1]))) if end else np.zeros(0, int)
                sizes = np.diff(np.concatenate((starts, [end]))).astype(int)
                big.append(np.repeat(sizes > put_off, sizes))
                if len(held[0]) > put_off or held[0][0] == hot:
                    hot = held[0][0]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held], names=["key", "a", "b"])
                    held = [x[:0] for x in held]
            off = np.logical_or.reduce(big) if big else np.zeros(end, bool)
            if off.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[off].view(np.int64)) for x in whole], names=["key", "a", "b"])
            if end:
                yield from emit(*[x[~off] for x in whole])
        if len(held[0]):
            if hot is not None and held[0][0] == hot:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held], names=["key", "a", "b"])
            else:
                yield from emit(*held)

    sorted_ = keyed.select("key", "fp", "node").repartition("key").sortWithinPartitions("key", "fp")
    return sorted_.mapInArrow(run, "key bigint, a bigint, b bigint")


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of nodes (fp, node) whose fingerprints differ in ``most`` bits at most (three or fewer).

    They connect what all such pairs connect; a pair may come more than once.
    """
    if most > 3:
        raise ValueError("two of three segments are only sure to have one error at most if there are three or fewer")
    found = written(links_by_bucket(with_keys(nodes), most, BUCKET), "bucket-links")
    pairs = found.where("key is null").select("a", "b")
    late = found.where("key is not null").select("key", F.col("a").alias("fp"), F.col("b").alias("node"))
    if late.isEmpty():
        return pairs
    blocks = late.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("n"))
    own = late.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    name = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = links_by_bucket(dealt.select(name.alias("key"), "fp", "node"), most, None)
    return pairs.union(rest.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached."""
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.least("component", "m").alias("low"), F.col("component").alias("was")
        )
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = written(
            low.join(up, "low").select("node", F.least("low", "up").alias("component"), "was"), "labels"
        )
        discard(labels)
        labels = step
        if step.where("component < was").isEmpty():
            discard(both)
            return labels.select("node", "component")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [
            pa.array(np.array([fingerprint(t or "", shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))
        ]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return arrow_map(rows, "_text", [T.StructField("_fp", T.LongType())], make).select("_id", "_fp")


def near_groups(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """(_id, _fp, _component) of every row: smallest id reachable over fingerprints ``most`` bits apart."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("id")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), most))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("_component"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "_component")
    return rows.join(of_fp, "_fp").select("_id", "_fp", "_component")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
