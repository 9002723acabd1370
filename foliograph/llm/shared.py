"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..operators.components import Scratch
from ..operators.components import materialise as written
from ..operators.components import remove_folder, scratch, shared_folder

__all__ = ["Scratch", "remove_folder", "scratch", "shared_dir", "written"]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name under `spark.checkpoint.dir`."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
