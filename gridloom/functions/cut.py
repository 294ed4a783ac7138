"""Cutting lineage between the steps of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(frame: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """`frame` as a Parquet table in the folder of spark.checkpoint.dir, which all
    executors share.  Only where that is unset and the session is local, as in tests, a
    local folder is made and set for the session.  With `by`, rows lie in a folder for each
    value of that column, so a filter on it reads no others."""
    spark = frame.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame, part: str = "") -> None:
    """Deletes tables of `cut` that nothing will read any more: whatever was made from
    them must be cut itself.  part: only that folder of each, as in "kind=0"."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table.written_to}/{part}")
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
