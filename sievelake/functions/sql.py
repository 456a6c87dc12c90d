"""The scalars as SQL functions of a session, and functions of the user's own.

They are SQL functions, so the optimiser inlines them: a call costs what the expression costs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Name, parameters, type and body of each function.
FUNCTIONS = [
    ("token_count", "t STRING", "BIGINT", "CAST(ceil(char_length(t) / 4) AS BIGINT)"),
    ("piece_count", "t STRING", "BIGINT", r"CAST(size(regexp_extract_all(t, r'\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+', 0)) AS BIGINT)"),
    ("cut_tokens", "t STRING, budget INT", "STRING", "substring(t, 1, 4 * budget)"),
    ("word_set", "t STRING", "ARRAY<STRING>", r"array_distinct(filter(split(lower(t), r'\s+'), w -> w <> ''))"),
    ("word_overlap", "a ARRAY<STRING>, b ARRAY<STRING>", "INT", "size(array_intersect(a, b))"),
    ("word_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)"),
    ("squared_distance", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
     "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)"),
    ("keyed_uniform", "k STRING", "DOUBLE", f"CAST(conv(substring(md5(k), 1, 12), 16, 10) AS BIGINT) / {float(2**48)!r}D"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Make the engine's scalars known to ``spark.sql``; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]


def register_function(spark: SparkSession, name: str, function: Callable, kind: T.DataType | str) -> None:
    """Make a user's function on pandas columns known to ``spark.sql``: batches in Arrow, not row by row."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(function, kind))
