"""Session, shared folder, tables that cut lineage, and small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to be broadcast, once its rows have been counted.
BROADCAST_ROWS = 200_000


def session(app: str = "iolens", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for local use; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and the master is local, a temporary
    folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="iolens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_made: list[str] = []


@atexit.register
def _drop_local() -> None:
    """At the end of the process, where the shared folder is a mounted one; elsewhere call drop_written."""
    for path in _made:
        if path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path, ignore_errors=True)


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path of its own in the shared folder."""
    _made.append(f"{shared_dir(spark)}/iolens-{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_written(spark: SparkSession) -> None:
    """Deletes what this process wrote to the shared folder; results that still read it end."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_form(c: Column) -> Column:
    """Blanks at both ends removed, lower-cased."""
    return F.lower(F.trim(c))


def event_day(ts: Column) -> Column:
    """UTC date of microseconds since 1970 as YYYY-MM-DD; null for null."""
    return F.date_format(F.timestamp_micros(ts), "yyyy-MM-dd")


def records(df: DataFrame, id_col: str, cols: dict[str, Column]) -> DataFrame:
    """One row per record with the given columns, copies counted once.

    Copies carry the same id and equal data, so a hash-based DISTINCT over the
    id and the needed columns keeps one of each. Rows without id can't be told
    from copies; each of them counts as a record of its own.
    """
    key = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    picked = df.select(F.col(id_col).alias("_id"), key.alias("_lone"), *[c.alias(n) for n, c in cols.items()])
    return picked.distinct().drop("_id", "_lone")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it, else df as it is (shuffle join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
