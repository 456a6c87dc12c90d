r"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; from every sentence on, the shortest run of consecutive sentences that
has at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is hashed (128 bits, over the words,
so white space doesn't matter). The runs of all documents are compared by hash. The first place where
a run stands (smallest document id, then row, then position) keeps it; sentences that are covered by any other
place of a repeated run are removed.

Which run starts at a sentence depends only on the text from there on, so a passage that stands in
several documents gives the same runs in each. A run that a text's end cuts short is not hashed.

Words are what stands between ASCII white space. Sentences end at line breaks and after words that end in ``.``, ``!``,
``?``, ``,``, ``;``, ``:`` or ``|``, wherever that is. One of more than ``LONG`` words is cut again by winnowing: after the
word with the least hash, taken with the word before (the last of equal ones), of each window of ``LONG`` words. So no
sentence has more words, and a passage falls into the same sentences wherever it stands, but for some ``LONG`` words
at either edge: any passage of 50 words that is repeated holds a whole run. The white space that follows belongs to the sentence, so the sentences joined
again are the text.

A repeat within one document counts like one between documents. Null and empty texts have no runs. Rows are
told apart by their place in their file (:func:`common.located`), so rows that share an id, or have none, are
documents of their own, and of equal rows one keeps its runs. A null id comes first. Other columns are passed through,
but the outputs replace columns of their names.

Runs of all texts take more room than the texts, so they are neither kept nor joined one by one. Documents that follow each other in a
file are a block. It sends each of its different hashes once, with the smallest id that has it (:func:`sent`), and gets one
bit back: whether another block has an earlier place (:func:`later`). Next to the texts, the runs are made
again and the bits laid on them (:func:`deduplicated`). A run that stands everywhere comes once from each block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks, located, to_arrow

MIN_SENTENCES = 2
MIN_WORDS = 25
#: Words of a sentence at most.
LONG = 8
#: Rows of a block at most, and bytes of its texts (one row may have more). Rows of one block have one ``_row // GROUP``.
GROUP = 256
TOGETHER = 2 << 20
#: Buckets of hashes at least, and bytes of text for each; more text gets more buckets.
BUCKETS = 1024
BUCKET_BYTES = 64 << 20

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_stop = np.zeros(256, bool)
_stop[list(b".!?,;:|")] = True
#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 18
#: Odd factor of the words' hash, modulo 2**64, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
MIXER = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def word_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: its bytes as digits to the base FACTOR."""
    if not _powers:
        for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            _powers.append(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * BLOCK, factor, np.uint64)))))
    up, down = _powers
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        # the words that begin in a block; of a very long one the first block of bytes counts
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK)))
        begin = starts[first:last] - starts[first]
        end = np.minimum(ends[first:last] - starts[first], begin + BLOCK)
        piece = data[starts[first] : starts[first] + end.max()]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * up[1 : len(piece) + 1], dtype=np.uint64)))
        out[first:last] = (sums[end] - sums[begin]) * down[begin]
        first = last
    return out


class Cut:
    """The words and sentences of some texts, as arrays; sentence i has the words from first[i] up to end[i]."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        space = _space[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edges = np.concatenate(([0], edges))
        self.starts, ends = edges[::2], edges[1::2]
        self.begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))  # of the texts
        # a word ends its sentence if a line break or another text follows
        lines, n = np.searchsorted(np.flatnonzero(data == 10), ends), len(ends)
        stops = _stop[data[ends - 1]] if n else np.zeros(0, bool)
        if n:
            stops[:-1] |= lines[1:] > lines[:-1]  # line breaks up to the end of each word
            stops[-1] = True
        sentence = np.cumsum(stops) - stops
        size = np.bincount(sentence, minlength=1)
        if n >= LONG and size.max() > LONG:
            marks = word_marks(data, self.starts, ends)
            before = np.concatenate((np.zeros(1, np.uint64), marks[:-1]))
            heads = np.searchsorted(self.starts, self.begins[:-1])
            before[heads[heads < n]] = 0  # nothing stands before a text's first word
            marks += before * np.uint64(MIXER)
            marks ^= marks >> np.uint64(32)
            marks *= np.uint64(MIXER)
            marks >>= np.uint64(32)
            at = np.flatnonzero((sentence[LONG - 1 :] == sentence[: 1 - LONG or None]) & (size[sentence[LONG - 1 :]] > LONG))
            windows = np.lib.stride_tricks.sliding_window_view(marks, LONG)
            for k in range(0, len(at), BLOCK):
                some = at[k : k + BLOCK]
                stops[some + LONG - 1 - windows[some, ::-1].argmin(axis=1)] = True
        self.end = np.flatnonzero(stops) + 1
        self.first = np.concatenate(([0], self.end[:-1])) if n else self.end
        self.text = np.searchsorted(self.begins, self.starts[self.first], "right") - 1  # of each sentence

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first sentence, sentences, two halves of the hash) of every run."""
        n = len(self.end)
        last = np.maximum(np.searchsorted(self.end, self.first + MIN_WORDS), np.arange(n) + MIN_SENTENCES - 1)
        ok = np.flatnonzero(last < n)
        ok = ok[self.text[last[ok]] == self.text[ok]]
        last = last[ok]
        words = self.data.split()
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        joined = memoryview(b" ".join(words))
        del words
        digest = xxhash.xxh3_128_digest
        spans = zip(offsets[self.first[ok]].tolist(), (offsets[self.end[last]] - 1).tolist(), strict=True)
        found = b"".join([digest(joined[a:b]) for a, b in spans])
        before = np.searchsorted(self.text, self.text[ok])  # the first sentence of its text
        return self.text[ok], ok - before, last - ok + 1, np.frombuffer(found, "<u8").reshape(-1, 2)

    def counts(self) -> np.ndarray:
        """The number of sentences of each text; white space alone is one."""
        some = np.diff(self.begins) > 1
        return np.maximum(np.bincount(self.text, minlength=len(some)), some)

    def parts(self, i: int = 0) -> list[bytes]:
        """The sentences of a text, each with the white space after it."""
        begin, end = int(self.begins[i]), int(self.begins[i + 1]) - 1
        a, b = np.searchsorted(self.text, (i, i + 1))
        at = [begin, *self.starts[self.first[a + 1 : b]].tolist(), end] if end > begin else []
        return [self.data[x:y] for x, y in zip(at, at[1:], strict=False)]


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space after it."""
    return [p.decode() for p in Cut([text.encode()]).parts()]


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces that may be blocks: following rows of one group of one file."""
    file, row = numbers(batch, "_file"), numbers(batch, "_row")
    other = (file[1:] != file[:-1]) | (row[1:] // GROUP != row[:-1] // GROUP) | (row[1:] <= row[:-1])
    for a, b in itertools.pairwise([0, *(np.flatnonzero(other) + 1).tolist(), len(row)]):
        yield from chunks(batch.slice(a, b - a), text, TOGETHER)


def by_hash(of: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's runs by hash and place, and where in it each different hash begins."""
    rank = np.empty(len(ids), np.uint16)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((rank[of], h[:, 1], h[:, 0]))  # keeps the order of the runs of one text
    h = h[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def bucket_count(placed: DataFrame, text_col: str) -> int:
    """A power of two."""
    size = placed.agg(F.sum(F.octet_length(F.col("_doc")[text_col].cast("string")))).first()[0] or 0
    return max(BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())


def no_id_first(id_col: str) -> Column:
    return F.coalesce(F.col("_doc")[id_col].cast("long"), F.lit(-(2**63))).alias("_id")


def sent(placed: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Of every block, by bucket, its different hashes in order and the smallest id of each, as bytes.

    Ids are written as what they exceed ``least`` by, in ``width`` bytes.
    """
    rows = placed.select(no_id_first(id_col), "_file", "_row", F.col("_doc")[text_col].cast("string").alias("text"))
    names = ["bucket", "_file", "_row", "_last", "least", "width", "hashes", "ids"]
    shift = np.uint64(65 - buckets.bit_length())

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                own, row = numbers(part, "_id"), numbers(part, "_row")
                of, _, _, h = Cut([t or b"" for t in part.column(3).cast(pa.binary()).to_pylist()]).runs()
                if not len(of):
                    continue
                order, begin = by_hash(of, h, own)
                h, ids = h[order[begin]], own[of[order[begin]]]
                least = ids.min()
                more = (ids - least).view(np.uint64)
                width = max(1, (int(more.max()).bit_length() + 7) // 8)
                bucket = (h[:, 0] >> shift).astype(np.int32)
                edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)])).astype(np.int32)
                n = len(edges) - 1
                same = [np.full(n, x, np.int64) for x in (numbers(part, "_file")[0], row[0], row[-1], least)]
                kinds = ((16, h.tobytes()), (width, more.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()))
                data = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges * np.int32(k)), pa.py_buffer(x)]) for k, x in kinds]
                made = [pa.array(x) for x in (bucket[edges[:-1]], *same, np.full(n, width, np.int32))]
                yield pa.RecordBatch.from_arrays([*made, *data], names=names)

    return rows.mapInArrow(run, "bucket int, _file bigint, _row bigint, _last bigint, least bigint, width int, hashes binary, ids binary")


def later(runs: DataFrame) -> DataFrame:
    """Of every block and bucket: a bit for each of its hashes, set if another block has an earlier place."""

    def run(table):
        hashes, width = table.column("hashes").to_pylist(), numbers(table, "width")
        sizes = np.array([len(x) // 16 for x in hashes])
        h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        more = np.zeros((len(h), 8), np.uint8)
        ids = table.column("ids").to_pylist()
        for w in np.unique(width).tolist():
            some = b"".join([x for x, of in zip(ids, width.tolist(), strict=True) if of == w])
            more[np.repeat(width == w, sizes), :w] = np.frombuffer(some, np.uint8).reshape(-1, w)
        ids = more.view("<u8")[:, 0].view("<i8") + np.repeat(numbers(table, "least"), sizes)
        block = np.empty(len(sizes), np.int32)
        block[np.lexsort((numbers(table, "_row"), numbers(table, "_file")))] = np.arange(len(sizes))
        block = np.repeat(block, sizes)
        # only hashes that share a half need to be ordered any further
        some = np.argsort(h[:, 0])
        twin = h[some[1:], 0] == h[some[:-1], 0]
        some = some[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]
        some = some[np.lexsort((block[some], ids[some], h[some, 1], h[some, 0]))]
        bits = np.zeros(len(h), bool)
        bits[some[1:]] = (h[some[1:]] == h[some[:-1]]).all(axis=1)
        ends = np.cumsum(sizes)
        made = [np.packbits(bits[a:b]).tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        return table.select(["_file", "_row", "_last", "bucket"]).append_column("bits", pa.array(made, pa.binary()))

    return runs.groupBy("bucket").applyInArrow(run, "_file bigint, _row bigint, _last bigint, bucket int, bits binary")


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (first, number) spans as sorted, disjoint (begin, end) intervals."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(spans):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + n))
        else:
            out.append((at, at + n))
    return out


def removed_runs(cut: Cut, ids: np.ndarray, bits: dict[int, bytes], buckets: int) -> dict[int, list[tuple[int, int]]]:
    """(first sentence, sentences) of the runs that go, by text of a block, from the bits of its buckets."""
    of, at, n, h = cut.runs()
    if not len(of):
        return {}
    order, begin = by_hash(of, h, ids)
    bucket, sizes = np.unique(h[order[begin], 0] >> np.uint64(65 - buckets.bit_length()), return_counts=True)
    gone = np.ones(len(of), bool)  # of places in one block only the first may stay
    gone[order[begin]] = np.concatenate(
        [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=k) for b, k in zip(bucket.tolist(), sizes.tolist(), strict=True)]
    )
    of, at, n = of[gone], at[gone], n[gone]
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
    return {int(of[a]): list(zip(at[a:b].tolist(), n[a:b].tolist(), strict=True)) for a, b in itertools.pairwise(edges)}


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: its columns, with the text that is left (as it was where nothing repeats), n_sentences, n_removed
    and removed (begin and end character of each stretch taken out of the original text)."""
    bounded_batches(docs.sparkSession)
    placed = located(docs)
    buckets = bucket_count(placed, text_col)
    rest = [c for c in docs.columns if c != text_col]
    own = F.struct(F.lit(0).alias("_"), *[F.col("_doc")[c].alias(c) for c in rest]).alias("_rest")
    rows = placed.select("_file", "_row", no_id_first(id_col), own, F.col("_doc")[text_col].cast("string").alias("_whole"))
    # the bits of a block come just before its documents
    every = rows.unionByName(later(sent(placed, id_col, text_col, buckets)), allowMissingColumns=True)
    every = every.withColumn("_group", F.expr(f"_row div {GROUP}")).repartition("_file", "_group")
    every = every.sortWithinPartitions("_file", "_row", F.col("_last").asc_nulls_last())
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [
        T.StructField("_text", T.StringType()),
        T.StructField("n_sentences", T.IntegerType()),
        T.StructField("n_removed", T.IntegerType()),
        T.StructField("removed", span),
    ]
    schema = T.StructType([every.schema["_rest"], *fields])
    kinds = [to_arrow(f.dataType) for f in fields]

    def cut_block(block, bits):
        texts = block.column("_whole").cast(pa.binary()).to_pylist()
        cut = Cut([t or b"" for t in texts])
        gone, stretches = [0] * len(texts), [[] for _ in texts]
        for i, spans in removed_runs(cut, numbers(block, "_id"), bits, buckets).items():
            texts[i], gone[i], stretches[i] = cut_out(cut.parts(i), spans)
        made = [texts, cut.counts().astype(np.int32), gone, stretches]
        made = [pa.array(x, kind) for x, kind in zip(made, [pa.binary(), *kinds[1:]], strict=True)]
        made[0] = made[0].cast(kinds[0])
        return pa.RecordBatch.from_arrays([block.column("_rest").combine_chunks(), *made], names=schema.names)

    def run(batches):
        key, bits, held = None, {}, []  # of the block at hand

        def whole():
            if held:
                yield cut_block(pa.Table.from_batches(held), bits)
                held.clear()

        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("_last")).is_null().to_numpy(zero_copy_only=False)
            for a, b in itertools.pairwise([0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(docs)]):
                part = batch.slice(a, b - a)
                if not docs[a]:
                    columns = [part.column(c).to_pylist() for c in ("_file", "_row", "_last", "bucket", "bits")]
                    for *place, bucket, some in zip(*columns, strict=True):
                        if place != key:
                            yield from whole()
                            key, bits = place, {}
                        bits[bucket] = some
                    continue
                file, row = numbers(part, "_file"), numbers(part, "_row")
                # rows that belong to the block come first; what follows without bits has no runs
                n = int(((file == key[0]) & (row <= key[2])).sum()) if key else 0
                if n:
                    held.append(part.slice(0, n))
                if n < len(row):
                    yield from whole()
                    for piece in blocks(part.slice(n), "_whole"):
                        yield cut_block(pa.Table.from_batches([piece]), {})
        yield from whole()

    done = every.mapInArrow(run, schema)
    outputs = {"n_sentences", "n_removed", "removed"}
    kept = [F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns if c.lower() not in outputs]
    return done.select(*kept, "n_sentences", "n_removed", "removed")


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of :func:`deduplicated`, the documents that lose sentences."""
    return deduplicated(docs, id_col, text_col).where("n_removed > 0")


def cut_out(parts: list[bytes], spans: list[tuple[int, int]]) -> tuple[bytes, int, list[dict]]:
    """What is left of a text's sentences without those of some spans, how many went, and the stretches taken out."""
    starts = [0, *itertools.accumulate(len(p.decode()) for p in parts)]
    gone = covered(spans)
    left, at = [], 0
    for a, b in gone:
        left += parts[at:a]
        at = b
    left += parts[at:]
    stretches = [{"begin": starts[a], "end": starts[b]} for a, b in gone]
    return b"".join(left), sum(b - a for a, b in gone), stretches


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs)
