"""JSON Lines and JSON sources and sinks, and stage tables that a later run can take up."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepairs.sources.schemas import REQUIRED, SCHEMAS


def read_jsonl(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Records of ``kind`` (see :data:`SCHEMAS`), or of whatever the lines hold if None.

    Blank lines are skipped and fields that the schema lacks ignored; a broken line or a record without a
    required field fails the job.
    """
    if kind is None:
        return spark.read.json(path)
    df = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)
    for name in REQUIRED[kind]:
        missing = F.raise_error(F.lit(f"{kind} record without {name}")).cast(df.schema[name].dataType)
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(missing))
    return df


def write_jsonl(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Nulls are written. ``single_file`` funnels all rows through one task: for small reports only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def stage_table(spark: SparkSession, path: str, build, *, reuse: bool = False) -> DataFrame:
    """The stage's Parquet table at ``path``: taken as it is if ``reuse`` and there, else built, written and reread."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (reuse and fs.exists(there)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reusable(stage: str, stages: list[str], *, resume_from: str | None = None, flag: bool = False) -> bool:
    """Whether an existing table of ``stage`` may be reused: by its flag, or as ``resume_from`` is not before it."""
    return flag or (resume_from is not None and stages.index(resume_from) >= stages.index(stage))
