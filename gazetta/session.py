"""Sessions for the library, and what its Python functions need on the executors."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of this library starts with; a cluster's own settings take precedence.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session with the library's defaults; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster use ``--py-files`` as well."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def local_folder(context, name: str) -> str:
    """A folder of this machine, for sessions in one JVM; on a cluster the executors would not see it."""
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), name)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    context = ship(df.sparkSession).sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or local_folder(context, "gazetta-checkpoints"))
    return df.checkpoint(eager=True)
