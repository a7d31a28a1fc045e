"""Writing records, splits, reports and review forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.operators.sample import ordered_places

SPLITS = ("train", "dev", "test")


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines ordered by key over all files, columns in alphabetical order."""
    df.select(*sorted(df.columns)).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split; a record of an unknown split fails the job."""
    known = F.when(F.col(split).isin(*SPLITS), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(split, F.lit("null")))).cast("string"))
    df.withColumn(split, known).write.mode("overwrite").partitionBy(split).parquet(path)


def file_digests(spark, path: str) -> DataFrame:
    """(path, sha256) of files, for reports on what they were made of."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_report(stats: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def review_form(df: DataFrame, key: str, shown: list[str], asked: list[str], prefix: str = "DA") -> DataFrame:
    """(review_id, *shown, *asked): rows in the order of their digests with blank columns to fill in.

    Rows of one key are numbered in any order.
    """
    rows = ordered_places(df.withColumn("_d", F.sha2(F.col(key).cast("string"), 256)), "_d", key, name="_place")
    return rows.select(F.format_string(f"{prefix}%03d", "_place").alias("review_id"), *shown, *[F.lit("").alias(a) for a in asked])


def write_form(form: DataFrame, path: str) -> None:
    form.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """For foreachBatch: a batch that comes again after a failure overwrites its own folder."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_bundle(tables: dict[str, DataFrame], meta: dict[str, str], path: str) -> None:
    """Tables that belong together below one folder, with a row of metadata; the metadata come last, so a folder
    that has them is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([tuple(meta.values())], ", ".join(f"`{k}` string" for k in meta)).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
