"""CSV and Parquet tables under one root.

The root is any URI Hadoop reads (``s3a://``, ``gs://``, ``hdfs://`` or a path), so
object stores need nothing beyond their connector.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.operators.columns import clean_features, split_xy
from ballast.plans.features import FEATURE_JOBS
from ballast.session import path_exists, publish

# Columns whose type is set whatever the file looks like.
CSV_OVERRIDES = {"lending_club": {"id": "string"}}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A CSV file with a header; without a schema all columns are text."""
    reader = spark.read.options(**{"header": True, **options})
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def csv_with_overrides(spark: SparkSession, path: str, overrides: Mapping[str, str], **options) -> DataFrame:
    """Infer types from the whole file, except for the named columns.

    The named columns are read as their type from the text itself, so an id such as
    ``007`` keeps its zeros.
    """
    inferred = scan_csv(spark, path, inferSchema=True, **options).schema
    fields = [
        T.StructField(f.name, T.DataType.fromDDL(overrides[f.name]) if f.name in overrides else f.dataType)
        for f in inferred.fields
    ]
    return scan_csv(spark, path, T.StructType(fields), **options)


def csv_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, null_token: str, problem: str | None = None, **options
) -> DataFrame:
    """A CSV file in which cells that do not parse, or hold ``null_token``, are NULL.

    With ``problem`` a column of that name tells what is wrong with a line: ``short`` or ``long`` for the
    number of its fields, ``unparsable`` for a cell; NULL for good lines.
    """
    if problem is None:
        return scan_csv(spark, path, schema, nullValue=null_token, mode="PERMISSIVE", **options)
    line = "_line"
    wide = T.StructType([*schema.fields, T.StructField(line, T.StringType())])
    read = scan_csv(spark, path, wide, nullValue=null_token, mode="PERMISSIVE", columnNameOfCorruptRecord=line, **options)
    outside_quotes = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields, expected = F.size(F.split(F.col(line), outside_quotes, -1)), len(schema.fields)
    kind = F.when(fields < expected, "short").when(fields > expected, "long").otherwise("unparsable")
    # A cell is parsed only if its column is read: the place 1 depends on all of them, whatever is selected later.
    first = F.pmod(F.hash(*[f"`{f.name}`" for f in schema.fields]), F.lit(1)) + 1
    return read.withColumn(problem, F.element_at(F.array(F.when(F.col(line).isNotNull(), kind)), first)).drop(line)


def csv_quarantine(
    spark: SparkSession, path: str, schema: T.StructType, null_token: str, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The good lines, the others with their ``problem``, and how many there are of each kind."""
    read = csv_tolerant(spark, path, schema, null_token, "problem", **options)
    counts = read.groupBy(F.coalesce("problem", F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))
    return read.where(F.col("problem").isNull()).drop("problem"), read.where(F.col("problem").isNotNull()), counts


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_predictions_csv(predictions: DataFrame, path: str) -> None:
    """Predictions alone, one column with a header."""
    predictions.select("prediction").write.mode("overwrite").csv(path, header=True)


class DataRepository:
    """Raw, interim and final tables of each dataset, and a cache of the final ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw_path(self, dataset: str) -> str:
        return f"{self.root}/data/raw/{dataset}.csv"

    def interim_path(self, dataset: str) -> str:
        return f"{self.root}/data/interim/{dataset}.parquet"

    def final_path(self, dataset: str) -> str:
        return f"{self.root}/data/processed/{dataset}.parquet"

    def raw(self, dataset: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The raw CSV, by an explicit schema or by inference with the dataset's overrides."""
        if schema is not None:
            return scan_csv(self.spark, self.raw_path(dataset), schema)
        return csv_with_overrides(self.spark, self.raw_path(dataset), CSV_OVERRIDES.get(dataset, {}))

    def size_in_bytes(self, dataset: str) -> DataFrame:
        """Bytes of the raw files, from their listing; no content is read."""
        files = self.spark.read.format("binaryFile").load(self.raw_path(dataset))
        return files.select("length").agg(F.sum("length").alias("bytes"))

    def save_interim(self, dataset: str, df: DataFrame) -> None:
        write_parquet(df, self.interim_path(dataset))

    def interim(self, dataset: str) -> DataFrame:
        return scan_parquet(self.spark, self.interim_path(dataset))

    def save_final(self, dataset: str, df: DataFrame) -> None:
        """Features and target in one table: rows have no order to align two tables by.

        The table is written aside and takes its place only if its ids are unique.
        """
        split_xy(df)
        staged = f"{self.root}/data/staged/{dataset}-{uuid.uuid4().hex}.parquet"
        write_parquet(df, staged)
        if "row_id" in df.columns:
            repeated = scan_parquet(self.spark, staged).groupBy("row_id").count().where("count > 1").first()
            if repeated is not None:
                raise ValueError(f"row_id {repeated['row_id']!r} of {dataset!r} occurs {repeated['count']} times")
        publish(self.spark, staged, self.final_path(dataset))

    def is_processed(self, dataset: str) -> bool:
        """Whether the final table was written to its end."""
        return path_exists(self.spark, f"{self.final_path(dataset)}/_SUCCESS")

    def training_data(self, dataset: str) -> DataFrame:
        """The final table, kept in memory and on disk for repeated use."""
        if dataset not in self._cache:
            if not self.is_processed(dataset):
                raise ValueError(f"no training data for {dataset!r}")
            stored = scan_parquet(self.spark, self.final_path(dataset))
            self._cache[dataset] = stored.persist(StorageLevel.MEMORY_AND_DISK)
        return self._cache[dataset]

    def release(self) -> None:
        """Drop everything kept by :meth:`training_data`."""
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()


def process_datasets(
    repository: DataRepository,
    datasets: list[str],
    schemas: Mapping[str, T.StructType] | None = None,
    overwrite: bool = False,
) -> list[tuple[str, Exception]]:
    """Raw to interim to final table for each dataset; finished ones are skipped.

    Returns the datasets that failed with their errors, so one bad file does not
    stop the others.
    """
    failures: list[tuple[str, Exception]] = []
    for dataset in datasets:
        try:
            if repository.is_processed(dataset) and not overwrite:
                continue
            if dataset not in FEATURE_JOBS:
                raise ValueError(f"{dataset!r} is none of {sorted(FEATURE_JOBS)}")
            raw = repository.raw(dataset, (schemas or {}).get(dataset))
            repository.save_interim(dataset, FEATURE_JOBS[dataset](raw))
            repository.save_final(dataset, clean_features(repository.interim(dataset)))
        except Exception as error:
            failures.append((dataset, error))
    return failures
