"""Settings as a small JSON document in any file system Spark reads."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Extraction and ontology switches, with the defaults of missing keys."""

    llm_enabled: bool = False
    llm_model: str = ""
    entity_cap: int = 20
    automatic_ontology_growth: bool = True


def read(spark: SparkSession, path: str) -> Settings:
    """The newest settings under a folder; defaults where there is no such folder, unknown keys left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return Settings()
    rows = spark.read.text(path).collect()
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in json.loads(rows[0]["value"]).items() if k in known}) if rows else Settings()


def write(spark: SparkSession, path: str, settings: Settings) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def patch(settings: Settings, **changes) -> Settings:
    return replace(settings, **{k: v for k, v in changes.items() if v is not None})
