"""Helpers shared by the corpus operators: shared folders, Arrow column maps, folds."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a batch function sees at most (one row may exceed it).
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where all runs in one process (``local[n]``) may that be
    unset: then a temporary folder is made once and remembered in the session.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("sievelake.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        spark.conf.set("sievelake.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the driver ends."""
    root = f"{shared_dir(spark)}/sievelake-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(delete, spark, root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if the driver's JVM still runs."""
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing that is still to run reads them."""
    for table in tables:
        delete(table.sparkSession, table._written_at)


def located(docs: DataFrame) -> DataFrame:
    """(_doc, _file, _row): the columns of ``docs`` as one value, and a locator of its own for each row.

    The locator is a key of the file and the row's index in it; a frame that doesn't come straight from files is written
    to the shared folder first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    if "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.select(whole, *place)
        except AnalysisException:
            pass
    return written(docs.select(whole), "located").select("_doc", *place)


def fold(column: str, n: int) -> Column:
    """crc32 of the column's text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


#: Bytes of text that a sample on the driver has, about, at most.
SAMPLE_BYTES = 64 << 20


def spread_sample(rows: DataFrame, id_col: str, most: int, text_col: str = "text", sizes: DataFrame | None = None) -> list[Row]:
    """At most ``most`` rows and about ``SAMPLE_BYTES`` of text, chosen by a hash of the id and in an order given by it,
    on the driver.

    The share that is taken follows from the counts, some less than ``most`` rows, so the limit, which
    keeps the bound, hardly ever cuts. Where ``rows`` come from a join, ``sizes`` has the same rows with the bytes of the
    text as column ``bytes`` only, so that no texts are shuffled to count them.
    """
    if sizes is None:
        sizes = rows.select(F.octet_length(text_col).alias("bytes"))
    n, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n > most or size > SAMPLE_BYTES:
        part = int(min(0.9 * most / n, SAMPLE_BYTES / max(size, 1)) * 2**20)
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast("string")), F.lit(2**20)) < part)
    got = rows.limit(most).collect()
    return sorted(got, key=lambda r: (zlib.crc32(f"order{r[id_col]}".encode()), str(r)))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Rows that Arrow hands to a worker at once, so that a batch of long texts stays small on either side.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches of ``BATCH_ROWS`` rows in this session, unless it asks for a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the values of ``column`` in a slice take about ``most`` bytes."""
    array = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def arrow_map(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """Add columns computed batch-wise from one string or binary column.

    ``make`` runs once per task and returns a function from an Arrow array to one list or array per
    field; it sees ``most`` bytes at a time or one row. A clashing column of ``df`` is replaced.
    """
    bounded_batches(df.sparkSession)
    df = without(df, *[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [to_arrow(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in chunks(batch, column, most):
                made = compute(part.column(part.schema.get_field_index(column)))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.FloatType(): pa.float32(),
        T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return simple[kind]


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks under a key; only one such thing, so that operators don't add up in memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine (never copied into the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A small file's bytes, to ship to executors; refuses files over ``most`` bytes."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return data
