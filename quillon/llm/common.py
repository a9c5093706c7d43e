"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name.
SPACE = b" \t\n\x0b\x0c\r"
SALT = "quillon"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns' values: rows that agree in all of them share results, others don't meet."""
    cols = [F.col(c) for c in columns]
    # null and value must differ in the hash, which skips nulls
    flags = reduce(lambda a, b: F.concat(a, b), [F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return [F.xxhash64(flags, *cols).alias("__k1"), F.xxhash64(F.lit(SALT), flags, *cols).alias("__k2")]
