"""Session set-up, the shared checkpoint folder and checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast; measured, not estimated.
BROADCAST_BYTES = 8 << 20


def build_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, else a
    temporary one of this machine, which only a local session may use."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
    sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is there goes when the driver ends."""
    path = f"{checkpoint_dir(spark)}/leafmill-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to a Parquet table in the shared checkpoint folder, and read back.

    It cuts the lineage as checkpoint() does but runs the plan only once, and later
    passes read only the columns they need. The tables go when the driver ends, or
    when ``discard`` is told that they are not needed any more.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._leafmill_path = path
    for tables in _open.tables[-1:] if hasattr(_open, "tables") else ():
        tables.append(back)
    return back


_open = threading.local()


@contextmanager
def temporaries() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, tables of ``written`` are noted, and deleted at the end but for those that the function given is called with.

    Nothing that is used later may still depend on the others.
    """
    _open.tables = [*getattr(_open, "tables", []), []]
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        noted = _open.tables.pop()
        discard(*(df for df in noted if all(df is not k for k in kept)))
        for tables in _open.tables[-1:]:
            tables += kept


#: The name under which iterations cut their lineage.
cut_lineage = written


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no result depends on; others are left alone."""
    for df in tables:
        if path := getattr(df, "_leafmill_path", None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the driver is ending, or the session has ended before
        pass


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted, stay under ``limit`` bytes
    at ``row_bytes`` each; otherwise ``df`` as it is, for a shuffled join."""
    most = max(1, limit // row_bytes)
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
