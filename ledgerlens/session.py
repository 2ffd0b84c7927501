"""Session settings, and tables that cut the lineage of a job."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "8", memory: str = "8g", **settings: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a session in one process (tests, benchmark) may leave it unset, and
    then gets a temporary folder; a cluster's executors would not see that.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors of {context.master} share")
        application = context.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="ledgerlens-")
        folder = _OWN_FOLDERS[application]
    return folder.rstrip("/")


class Tables:
    """The temporary tables of one piece of work, by path. They are dropped together."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def drop(self) -> None:
        """Drop the tables, those that exist."""
        while self.paths:
            drop_path(self.spark, self.paths.pop())

    @contextmanager
    def owning(self) -> Iterator[Tables]:
        """Whatever is written inside belongs to these tables."""
        token = _OWNER.set(self)
        try:
            yield self
        finally:
            _OWNER.reset(token)


_OWNER: ContextVar[Tables | None] = ContextVar("owner of temporary tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Tables]:
    """Drop at the end, also after a failure, whatever tables are written inside.

    Results that read these tables have to be written or collected inside.
    Scopes may be nested; a table belongs to the innermost. Without a scope
    a table lasts as long as the application.
    """
    tables = Tables(spark)
    try:
        with tables.owning():
            yield tables
    finally:
        tables.drop()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it exists, from whichever store it is in."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


_ROOTS: set[str] = set()


def _drop_at_exit(spark: SparkSession, root: str) -> None:
    """Tables that no scope has dropped go when Python ends, if the JVM is still there to remove them."""
    if root in _ROOTS:
        return
    _ROOTS.add(root)
    context = spark.sparkContext
    jvm, settings = context._jvm, context._jsc.hadoopConfiguration()

    def drop() -> None:
        with suppress(Exception):  # the JVM has ended before, and the cluster's own clean-up is left
            target = jvm.org.apache.hadoop.fs.Path(root)
            target.getFileSystem(settings).delete(target, True)

    atexit.register(drop)


def new_table_path(spark: SparkSession, label: str) -> str:
    """A path for a temporary table, which belongs to the scope that is open."""
    root = f"{shared_folder(spark)}/ledgerlens/{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    if owner := _OWNER.get():
        owner.paths.append(path)
    _drop_at_exit(spark, root)
    return path


def write_table(frame: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    The written copy survives lost executors, fixes anything that depends on
    a sampled layout, and gives Catalyst real sizes to choose joins by. `compression` names
    another codec than the session's, for tables as large as the input.
    """
    spark = frame.sparkSession
    path = new_table_path(spark, label)
    writer = frame.write if compression is None else frame.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def write_result(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """`write_table` of what `build` gives; the tables that `build` writes on its way are dropped then."""
    path = new_table_path(spark, label)
    with temporary_tables(spark):
        frame = build()
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
