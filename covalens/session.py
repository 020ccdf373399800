"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers that this driver starts import this package from its folder."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("covalens")
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names; only a local session may do without one."""
    import re
    import tempfile
    import uuid

    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = where or tempfile.gettempdir()
    return f"{where.rstrip('/')}/covalens/{uuid.uuid4().hex}/{tag}"
