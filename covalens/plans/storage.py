"""Tables between the steps of a query, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from covalens.session import work_path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and later reads see the same rows in the same partitions."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
