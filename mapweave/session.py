"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session in a single process, as in tests, gets a temporary folder; any other is refused, since
    its executors could not see what the others write there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="mapweave-"))
    return "file://" + _LOCAL_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is put there goes with ``sweep``, or when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage; a lost executor costs at most the tasks it was running. Returns the table as a new
    DataFrame of the same schema.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and that no open plan reads any more.

    A session that has no JVM at hand leaves it to whoever looks after the shared folder.
    """
    _MADE.discard(path)
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables this process has made; results that read them must have been saved before."""
    for path in list(_MADE):
        remove(spark, path)


@atexit.register
def _at_exit() -> None:
    for folder in _LOCAL_DIR:
        shutil.rmtree(folder, ignore_errors=True)
        _MADE.difference_update([p for p in _MADE if p.startswith("file://" + folder)])
    try:
        if _MADE and (spark := SparkSession.getActiveSession()) is not None:
            sweep(spark)
    except Exception:  # the session is gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read table ``name`` of a folder of Parquet tables, only the given columns if any are given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def local_session(cpus: int = 8) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mapweave")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
