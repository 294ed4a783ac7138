"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only where that is unset and the session is
    local, as in tests, a folder of this machine is made and set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a Parquet table in the shared folder: its lineage is cut, and a
    lost executor only costs a reread."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read any more: whatever was made
    from them must be written itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def among(table: DataFrame, few: bool) -> DataFrame:
    """`table` as the side of a join that goes to all tasks, if it has few rows: both sides
    would be shuffled over all partitions before Spark saw that."""
    return F.broadcast(table) if few else table


#: Rows of a small table that one task takes, and rows up to which a table is small.
A_TASK, SMALL = 1 << 12, 1 << 18


def gathered(frame: DataFrame, rows: int | None) -> DataFrame:
    """`frame`, whose last shuffle deals out about `rows` rows (None: not known), in no more
    tasks than so few need: there would be one for each partition that the session asks for.
    What is not small, or has fewer partitions, stays as it is."""
    return frame if rows is None or rows > SMALL else frame.coalesce(max(1, -(-rows // A_TASK)))


def fresh(name: str, *taken: str) -> str:
    """`name`, with underscores behind it until no column is called that."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def aside(frame: DataFrame, names: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """`frame` with columns that bear one of `names` renamed, and (new, old) of all its
    columns in order, with which `back` gives them their names again."""
    clash = {n.lower() for n in names}
    pairs = []
    for c in frame.columns:
        pairs.append((fresh(f"{c}__own", *frame.columns, *names) if c.lower() in clash else c, c))
    return frame.select(*[frame[old].alias(new) for new, old in pairs]), pairs


def back(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return frame.select(*[frame[new].alias(old) for new, old in pairs])
