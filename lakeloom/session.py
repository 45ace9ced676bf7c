"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_work_dirs: list[str] = []
_run = uuid.uuid4().hex


def local_session(app: str = "lakeloom", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset in local mode (tests), one of our own that ends with the driver."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="lakeloom-"))
        atexit.register(shutil.rmtree, _own_dirs[0], True)
    return f"file://{_own_dirs[0]}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, used by nobody else; removed when the driver ends."""
    mine = f"{shared_dir(spark)}/lakeloom/{_run}"
    if mine not in _work_dirs:
        _work_dirs.append(mine)
        atexit.register(_clean, spark, mine)
    return f"{mine}/{uuid.uuid4().hex}/{label}"


def _clean(spark: SparkSession, path: str) -> None:
    """Best effort: what is left if the driver is killed is a folder that nobody reads."""
    try:
        _remove(spark, path)
    except Exception:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again.

    Unlike a block kept by an executor the written table outlives the loss of executors, and parquet keeps it
    smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeloom_paths = [path]
    return out


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads tables that materialize wrote and that nobody else reads: releasing it removes them."""
    df._lakeloom_paths = [p for t in tables for p in getattr(t, "_lakeloom_paths", ())]
    return df


def release(*tables: DataFrame) -> None:
    """Remove tables that materialize wrote, once nothing lazy reads them any more."""
    for df in tables:
        for path in getattr(df, "_lakeloom_paths", ()):
            _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
