"""Session defaults and the shared-folder checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the results rely on; everything about sizes is left to the cluster and to AQE.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(app: str = "veridelta", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's defaults; ``extra`` overrides them (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SEMANTICS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: that of spark.checkpoint.dir. Only a local master, as in tests, may do without; elsewhere
    a folder of the driver's machine would lose what other machines write."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="veridelta-ckpt-")
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``cut`` table that nothing reads any more, such as the last round of a loop."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().logical()
    at = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if at is not None and at.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed files in the shared folder, for tables that would be large as a ``cut``."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstore(df: DataFrame) -> None:
    """Delete the files of ``stored`` tables, or a union of them, that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while."""
    was = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and ``size`` bytes, written as text; else as it is, for the planner to shuffle."""
    width = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has anything, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0
