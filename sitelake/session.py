"""Session defaults and lineage truncation."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# A frame may be broadcast only when its size is known to stay under this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "sitelake", cores: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SITELAKE_DRIVER_MEMORY", "12g"))
    )
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per session; Python functions that run there import it."""
    context = spark.sparkContext
    if not getattr(context, "_sitelake_shipped", False):
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "sitelake.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(home.rglob("*.py")):
                out.write(path, path.relative_to(home.parent))
        context.addPyFile(str(archive))
        context._sitelake_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode alone a temporary one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return context.getCheckpointDir()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs here gives its shuffle files back when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame to the reliable checkpoint folder, so a lost executor never replays the loop."""
    ensure_checkpoint_dir(frame.sparkSession)
    with freed_shuffles(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)  # a query heeds the setting under which its frame was made


def collected(spark: SparkSession) -> None:
    """Let the driver collect its garbage. What Spark keeps for frames that are gone (checkpoints, broadcasts, plans) goes only then, and a loop of
    many small jobs would let the driver grow to its limit before."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """The frame written once as a table in the shared folder and read from there: a lost executor costs
    no recomputation, and row ids, ranks and random choices made before the write never change after it.
    With ``outlives`` it stays when the innermost ``dropped_tables`` ends, and goes with the next one."""
    path = shared_folder(frame.sparkSession, name)
    for paths in _scratch[-2:-1] if outlives else _scratch[-1:]:
        paths.append(path)
    with freed_shuffles(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def dropped_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes here are dropped at the end; what outlives them must be checkpointed before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_shared(spark: SparkSession, path: str) -> str | None:
    """A small text file on any file system Spark can reach; None where it is absent."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_shared(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file; the rename at the end is the commit."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    conf = context._jsc.hadoopConfiguration()
    where, new = hadoop.Path(path), hadoop.Path(path + ".tmp")
    stream = where.getFileSystem(conf).create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(where.getFileSystem(conf).makeQualified(where).toUri(), conf)
    files.rename(new, where, options)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder on any file system Spark can reach; none where it is absent."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a finished folder to its place, which must be free: readers see all of it or nothing."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    conf = context._jsc.hadoopConfiguration()
    old, new = hadoop.Path(staged), hadoop.Path(path)
    fs = new.getFileSystem(conf)
    fs.mkdirs(new.getParent())
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(fs.makeQualified(new).toUri(), conf).rename(old, new, options)
