"""Session helpers: configuration, table loading, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for one machine (tests, bench). Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sent:
    """A broadcast object whose class the executors needn't be able to import. Callers bound its size."""

    def __init__(self, spark: SparkSession, value):
        self.held, self.kept = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"held": self.held, "kept": None}

    @property
    def value(self):
        if self.kept is None:
            self.kept = pickle.loads(self.held.value)
        return self.kept

    def drop(self) -> None:
        """Forget the value in this process; the next use loads it again."""
        self.kept = None
        if hasattr(self.held, "_value"):
            del self.held._value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary one is set only where none is named and all runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SCOPES: list[list[str]] = []  # the scratch paths of each open scope


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, deleted when its scope ends, or else this Python process.

    With keep it belongs to the scope around the innermost one.
    """
    path = f"{shared_dir(spark)}/marlstone-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    held = _SCOPES[: len(_SCOPES) - keep]
    if held:
        held[-1].append(path)
    else:
        atexit.register(_forget, spark, path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Scratch tables that are made inside, without keep, are deleted at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended first; the folder is only scratch
        pass


FILE_ROWS = 1 << 16


def cut(df: DataFrame, name: str, keep: bool = False, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back.

    Lost executors then cost no recomputation of what lies before the cut, and everything
    after it sees one and the same set of rows. With keep the table outlives the innermost scope.
    Where the number of rows is known (or a bound of it), a small table is written as few files,
    eight at least and one for each FILE_ROWS rows, however many partitions it comes in.
    """
    spark = df.sparkSession
    path = scratch(spark, name, keep)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
