"""The cluster's shared folder, and intermediate tables written there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see, as spark.checkpoint.dir names it. In local mode, where all are one process,
    a folder of our own where it is unset; it goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written within each scratch() that is open, the innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", codec).parquet(path)
    if _open:
        _open[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.textloom_path = path
    return table


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written within at its end, but for those given to the function it yields, which belong to the scratch()
    around it, if there is one."""
    own, kept = [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.textloom_path)
        return table

    _open.append(own)
    try:
        yield keep
    finally:
        _open.pop()
        for path in set(own) - set(kept):
            remove(spark, path)
        if _open:
            _open[-1].extend(kept)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(table: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more; other tables are left alone."""
    if "textloom_path" in table.__dict__:
        remove(table.sparkSession, table.textloom_path)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots written as __) for the actions within, then as before."""
    named = {k.replace("__", "."): str(v) for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_end(spark: SparkSession):
    """Within it, the shuffle files of an action go when the action has ended, so that those of many steps do not add up."""
    return conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")
