"""Near-duplicate removal by SimHash with Golay keys, completed to an exact similarity join.

Two documents are alike if the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased; the
whole sequence if there are fewer words) is 0.8 or more, computed on the whole texts. Of each group of documents
that such pairs connect the one with the smallest id stays. Documents with equal sets are one node.

First the SimHash operator (:mod:`golay_simhash`) links nodes whose fingerprints, taken over words, differ in three
bits at most; each link is verified on the shingles. No number of fingerprints makes that whole: a passage that is
added at the end or one word repeated many times moves a fingerprint far and the shingles little. So what SimHash has
not connected goes through a prefix filter, which loses no pair: with the shingles of all documents in one order, two
sets that are alike share one among the first n - ceil(0.8 n) + 1 of each. The order is that of the hashes, with
shingles that are frequent in a sample put last, so that a common line is hardly ever a key. Any order finds the
same pairs; the sample decides what is compared, not what is found. Nodes meet in buckets by key, where sizes
and places of the key rule out most pairs, and in large buckets a short bitmap of each set, too (see below).

A bucket of up to ``SMALL`` nodes offers all its pairs between different components. A larger one first offers each
node's neighbours in order of size. Once these are verified and connected, the nodes that may have partners further away
meet again and offer pairs ``WIDER`` times as far apart, if still in different components, and so on, until every pair
of every bucket is verified, ruled out or connected by verified links. A large group of near copies so costs a few pairs
per member and bucket.

A candidate pair is ruled out without a look at the texts where a small bitmap of each set (the parity of the shingles
that fall on each bit) shows more differences than pairs that are alike can have; else the whole sets are intersected.

Null and empty texts have no word, aren't alike and all stay. Rows are told apart by id and text, whether or not ids
are unique or null (a null id comes last); rows equal in both stay or go together. Columns pass through as they are.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, discard, held, written
from .golay_simhash import components, fingerprint
from .golay_simhash import links as simhash_links

SHINGLE = 5
SIMILARITY = 0.8
#: Buckets of so many nodes offer all their pairs at once.
SMALL = 8
#: Neighbours on either side that a larger bucket offers first.
STEPS = 2
#: By how much further apart pairs may be in each next round.
WIDER = 8
#: Pairs that all larger buckets together offer in one last round.
AT_ONCE = 1_000_000
#: Documents that say which shingles are frequent, in how many of them, and how many such shingles are shipped at most.
SAMPLE, FREQUENT, SHIPPED = 20_000, 2, 1_000_000
#: Bits of a set's bitmap at most.
MOST_BITS = 4096
#: Bits of the bitmap that goes along with the nodes of large buckets.
SHORT_BITS = 512
#: Node numbers that are broadcast at most to fetch their sets (8 bytes each).
BROADCAST_NODES = 500_000
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 1 << 20


def hashes(text: str) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, len(words) - width + 1))


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first of a set's sorted shingles, those in ``frequent`` (sorted) last: every similar set has one of them, too."""
    n = len(found)
    take = n - math.ceil(SIMILARITY * n - 1e-9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = frequent[at] == found
        found = np.concatenate((found[~late], found[late]))
    return found[:take]


def bitmap(found: np.ndarray, size: int | None = None) -> bytes:
    """Per bit, whether an odd number of hashes falls on it; twice as many bits as hashes or more, up to a bound, or ``size``."""
    size = size or min(MOST_BITS, max(64, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(a: bytes, b: bytes) -> int:
    """A number that the sets of two bitmaps differ in at least."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample have; their number is bounded."""
    n = texts.count()
    part = int(min(1.0, SAMPLE / max(n, 1)) * 2**20)
    some = texts.where(F.pmod(F.xxhash64(F.lit("frequent"), "_k"), F.lit(2**20)) < part).select("_text")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                all_ = np.concatenate([np.zeros(0, np.uint64), *map(hashes, part.column(0).to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array(all_.view(np.int64))], names=["h"])

    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    top = counts.orderBy(F.desc("c"), "h").limit(SHIPPED).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def described(texts: DataFrame) -> DataFrame:
    """What is needed of each text: (_id, _k, _k2, digest of the set, n, keys, bits, short, fp)."""
    shipped = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))
    run_key = uuid.uuid4().hex
    names = ["_id", "_k", "_k2", "_set", "n", "keys", "bits", "short", "fp"]

    def run(batches):
        frequent = held(("frequent", run_key), lambda: shipped.value)
        for batch in batches:
            for part in chunks(batch, "_text"):
                all_ = part.column(3).to_pylist()
                found = [hashes(t) for t in all_]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()),
                        pa.array([len(h) for h in found], pa.int64()),
                        lists([prefix(h, frequent) for h in found]),
                        pa.array([bitmap(h) for h in found], pa.binary()),
                        pa.array([bitmap(h, SHORT_BITS) for h in found], pa.binary()),
                        pa.array(np.array([fingerprint(t, 1) for t in all_], np.uint64).view(np.int64)),
                    ],
                    names=names,
                )

    return texts.mapInArrow(
        run, "_id bigint, _k bigint, _k2 bigint, _set binary, n bigint, keys array<bigint>, bits binary, short binary, fp bigint"
    )


def offered(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, apart: np.ndarray, ranks: np.ndarray, short: np.ndarray, before: int, steps: range):
    """Pairs so many steps apart in rows sorted by key that differ in ``apart``, had ranks more than ``before`` apart and may
    be alike by their sizes, by the places of the key and by the bitmaps ``short``, as places, piece by piece."""
    heads, tails, held = [], [], 0
    room = sizes - places  # shingles from the key on: no more can be shared, if the key is the first that is
    for step in steps:
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        to = at + step
        least = SIMILARITY / (1 + SIMILARITY) * (sizes[at] + sizes[to]) - 1e-6
        ok = (np.minimum(room[at], room[to]) >= least) & (apart[at] != apart[to]) & (ranks[to] - ranks[at] > before)
        at, to = at[ok], to[ok]
        if short.shape[1]:
            most = (1 - SIMILARITY) / (1 + SIMILARITY) * (sizes[at] + sizes[to]) + 1e-6
            near = np.bitwise_count(short[at] ^ short[to]).sum(axis=1) <= most
            at, to = at[near], to[near]
        heads.append(at)
        tails.append(to)
        held += len(at)
        if held >= HELD_PAIRS:
            yield np.concatenate(heads), np.concatenate(tails)
            heads, tails, held = [], [], 0
    if held:
        yield np.concatenate(heads), np.concatenate(tails)


def bucket_pairs(keyed: DataFrame, high: int, before: int) -> DataFrame:
    """(key, n, p, a, b) from (key, n, p, node, component, rank, short): candidates with key null, of different components, up to
    ``high`` places apart in their bucket and more than ``before`` by the ranks they had in it the last time; and, with a
    key, the nodes a that may have partners further away, and their ranks b."""

    def emit(keys, sizes, places, nodes, groups, ranks, short):
        names = ["key", "n", "p", "a", "b"]

        def batch(a, b):
            pairs = np.unique(np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(pairs[0]), pa.array(pairs[1])], names=names)

        for a, b in offered(keys, sizes, places, groups, ranks, short, before, range(1, high + 1)):
            yield batch(a, b)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        of = np.diff(np.concatenate((starts, [len(keys)])))
        size = np.repeat(of, of)
        # nodes that may have a partner further away: sizes differ by a fifth at most, and less if the key comes late
        bucket, place = np.repeat(np.arange(len(of)) << 32, of), np.arange(len(keys))
        most = np.minimum(sizes / SIMILARITY, (1 + SIMILARITY) / SIMILARITY * (sizes - places) - sizes) + 1e-6
        last = np.searchsorted(bucket + sizes, bucket + most.astype(np.int64), "right") - 1
        first = np.searchsorted(bucket + sizes, bucket + np.ceil(SIMILARITY * sizes - 1e-6).astype(np.int64))
        late = np.flatnonzero((size > max(high, SMALL)) & ((last - place > high) | (place - first > high)))
        small = np.flatnonzero(size <= SMALL)  # these are done at once
        for a, b in offered(keys[small], sizes[small], places[small], groups[small], ranks[small], short[small], before, range(high + 1, SMALL)):
            yield batch(small[a], small[b])
        kept = [x[late] for x in (keys, sizes, places, nodes, place - np.repeat(starts, of))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = batch.column(6)
            bits = np.zeros((len(bits), 0), np.uint64) if bits.null_count else np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), -1)
            held.append([*[c.to_numpy() for c in batch.columns[:6]], bits])
            rows += batch.num_rows
            if rows < 1 << 18 or held[0][0][0] == held[-1][0][-1]:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last bucket may go on
            held, rows = [[x[end:] for x in whole]], rows - end
            yield from emit(*[x[:end] for x in whole])
        if held:
            yield from emit(*[np.concatenate(x) for x in zip(*held, strict=True)])

    sorted_ = keyed.select("key", "n", "p", "node", "component", "rank", "short").repartition("key").sortWithinPartitions("key", "n", "node")
    return sorted_.mapInArrow(run, "key bigint, n bigint, p bigint, a bigint, b bigint")


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose bitmaps don't rule out that they are alike."""
    a = rows.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = rows.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            n, left, right = (batch.column(i).to_pylist() for i in (2, 3, 4))
            most = [x * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6 for x in n]
            mask = pa.array([differences(x, y) <= m for x, y, m in zip(left, right, most, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, set) of the rows (row, _k, _k2) that are wanted, made again from their texts."""
    few = wanted.count() <= BROADCAST_NODES
    some = texts.join(F.broadcast(wanted) if few else wanted, ["_k", "_k2"]).select("row", "_text")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                found = lists([hashes(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["row", "set"])

    return some.mapInArrow(run, "row bigint, set array<bigint>")


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, as a table."""
    left = written(possible(pairs, rows), "near-possible")
    ends = left.select(F.col("a").alias("row")).union(left.select("b")).distinct()
    wanted = written(rows.select("row", "_k", "_k2").join(ends, "row", "left_semi"), "near-wanted")
    sets = written(sets_of(texts, wanted), "near-sets")
    a = sets.select(F.col("row").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("row").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    alike = common >= SIMILARITY * (F.size("set_a") + F.size("set_b") - common) - 1e-9
    out = written(left.join(a, "a").join(b, "b").where(alike).select("a", "b"), "near-links")
    discard(left, wanted, sets)
    return out


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    both = [F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")]
    return [F.xxhash64(*both).alias("_k"), F.xxhash64(F.lit("second"), *both).alias("_k2")]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, _k2, keep) of every document that has a near copy; keep is (id, _k, _k2) of the one that stays."""
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), *doc_key(id_col, text_col), text.alias("_text"))
    texts = texts.where(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    # the number is part of the table once that is written
    rows = written(described(texts).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    first = written(rows.groupBy("_set").agg(F.min("row").alias("node")), "near-nodes")
    same = rows.select("_set", "row").join(first, "_set").where("row <> node")
    alike = written(same.select(F.col("node").alias("a"), F.col("row").alias("b")), "near-links")
    firsts = first.select(F.col("node").alias("row"))
    nodes = rows.select("row", "n", "keys", "fp").join(firsts, "row", "left_semi").withColumnRenamed("row", "node")
    # SimHash: nodes of one fingerprint with the first of them, and that with the first of near fingerprints
    of_fp = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    star = nodes.select("fp", F.col("node").alias("b")).join(of_fp.withColumnRenamed("node", "a"), "fp").where("a <> b")
    pairs = simhash_links(of_fp).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(star.select("a", "b"))
    seen = written(pairs.distinct(), "near-pairs")
    alike = alike.union(verified(seen, rows, texts))
    groups = components(alike)
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("p", "key")).select("key", "n", F.col("p").cast("long").alias("p"), "node")
    keyed = with_component(keyed, groups).withColumn("rank", F.lit(0).cast("long")).withColumn("short", F.lit(None).cast("binary"))
    high, before = STEPS, -1
    while True:
        found = written(bucket_pairs(keyed, high, before), "near-buckets")
        pairs = written(found.where("key is null").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.isEmpty():
            seen = seen.union(pairs)
            new = verified(pairs, rows, texts)
            if not new.isEmpty():
                # what is connected already counts as one edge per node
                groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
        late = with_component(found.where("key is not null").select("key", "n", "p", F.col("a").alias("node"), F.col("b").alias("rank")), groups)
        mixed = late.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
        short = rows.select(F.col("row").alias("node"), "short")
        keyed = written(late.join(mixed.select("key"), "key").join(short, "node"), "near-open")
        discard(found)
        left = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("pairs")).first()
        if left.c is None:
            break
        high, before = left.c if left.pairs <= AT_ONCE else WIDER * high, high
    members = rows.select("_id", "_k", "_k2", "row").join(groups.withColumnRenamed("node", "row"), "row")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_k").alias("k"), F.col("_k2").alias("k2"))
    keep = members.groupBy("component").agg(F.min(order).alias("keep"))
    return members.join(keep, "component").select("_id", "_k", "_k2", "keep")


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one of each group of near copies."""
    gone = near_groups(docs, id_col, text_col).where((F.col("_k") != F.col("keep.k")) | (F.col("_k2") != F.col("keep.k2")))
    gone = gone.select(F.col("_k").alias("_gone"), F.col("_k2").alias("_gone2")).distinct()
    k, k2 = doc_key(id_col, text_col)
    return docs.join(gone, (k == gone["_gone"]) & (k2 == gone["_gone2"]), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies."""
    return near_dedup(docs)
