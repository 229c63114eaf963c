"""Small column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def bucket_of(key: Column, n: int) -> Column:
    """CRC-32 of a key's text modulo ``n``: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % n


def hash_fraction(*keys: Column) -> Column:
    """A reproducible number in [0, 1) drawn from the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)


def append_columns(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    fields: list[T.StructField],
) -> DataFrame:
    """``df`` with columns that ``make`` computes batch by batch; the other columns pass through."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                names = [*batch.schema.names, *[f.name for f in fields]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage in columnar form."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
