"""Session helpers: a default session, and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_written: list[str] = []
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "tidewell", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators assume; on a cluster use its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per context, so that a cluster needs no install."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return spark
    at = tempfile.mkdtemp(prefix="tidewell-code-")
    _own_dirs.append(at)
    root = Path(__file__).parent
    with zipfile.ZipFile(f"{at}/tidewell-code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(f"{at}/tidewell-code.zip")
    # hot keys are left to the skew join, also where the rows are grouped by the same key afterwards
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    sc._tidewell_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset (a local
    session, as in tests) a temporary folder is made and set for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tidewell-")
    _own_dirs.append(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@atexit.register
def _clean() -> None:
    for d in _own_dirs:
        shutil.rmtree(d, ignore_errors=True)


def cut(df: DataFrame, name: str = "cut", release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that
    outlive any executor, and whatever reads it twice does not compute it twice. release: delete
    the shuffle files of the write as soon as it is done, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    try:
        if release:
            spark.conf.set(_RELEASE, "true")
        df.write.mode("overwrite").parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that `cut` has written in this process and say how many. Call it when no
    result that reads them is needed any more; files in the shared folder stay otherwise."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan of too few files enough partitions for heavy row work. A scan that
    already has as many partitions as cores (any large input) is left as it is."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
