"""Session, table and shared-folder helpers used by every operator here."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once.  Texts reach a megabyte, so
#: the default of 10,000 rows a batch would not be bounded in memory.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

#: What a worker process keeps between tasks, by operator.
CACHES: dict[str, dict] = {}

_SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a local folder is made and
    set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread, so that what
    follows survives lost executors without recomputing what came before.

    The path is added to ``scratch``, where the caller has one: tables that nothing
    reads once a later one is written, for ``discard``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, in any file system that
    Spark can write to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def python_ready(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable on executors."""
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        if not package.is_dir():  # already running from a shipped archive
            _SHIPPED[app] = ""
            return
        folder = tempfile.mkdtemp(prefix="ledgerfold-ship-")
        path = os.path.join(folder, f"{package.name}_src.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(package.rglob("*.py")):
                out.write(p, f"{package.name}/{p.relative_to(package)}")
        spark.sparkContext.addPyFile(path)
        _SHIPPED[app] = path


def worker_task(run, keeps: str = ""):
    """The task function ``run`` (batches in, batches out) with bounded leftovers:
    caches of other operators are dropped before it, and freed memory goes back to
    the system after it, as worker processes live on between stages."""

    def task(batches):
        lean_memory()
        for name in [x for x in CACHES if x != keeps]:
            CACHES.pop(name).clear()
        yield from run(batches)
        give_back()

    return task


#: mallopt's numbers of the C library: most arenas, and from which size on an
#: allocation is mapped, so that freeing it gives it back at once.
M_ARENA_MAX, M_MMAP_THRESHOLD = -8, -3
MAPPED_FROM = 1 << 18


def lean_memory() -> None:
    """Let a worker process keep as little freed memory as possible."""
    if "lean" not in _SHIPPED:
        _SHIPPED["lean"] = ""
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(M_ARENA_MAX, 1)
            libc.mallopt(M_MMAP_THRESHOLD, MAPPED_FROM)
        except (OSError, AttributeError):  # another C library
            pass


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shrink_heaps(spark: SparkSession) -> None:
    """Let executors collect their garbage between two stages, so that their heaps,
    grown to the bound by the stage before, leave memory to the next one's Python
    workers.  A row a task; that some executor gets none does no harm."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def cache(name: str) -> dict:
    return CACHES.setdefault(name, {})


def open_binary(uri: str, mode: str):
    """A binary file of the shared folder, for local and remote URIs alike.

    ``mode`` is ``rb`` (seekable) or ``wb``.  Local URIs are opened directly;
    others through ``pyarrow.fs``.
    """
    if uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/")
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    if "://" not in uri:
        if mode == "wb":
            os.makedirs(os.path.dirname(uri), exist_ok=True)
        return open(uri, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def publish(temporary: str, final: str) -> None:
    """Rename a finished file into place.  A second attempt of the same task
    replaces the first one's file by identical bytes."""
    if temporary.startswith("file:"):
        os.replace("/" + temporary[5:].lstrip("/"), "/" + final[5:].lstrip("/"))
    elif "://" not in temporary:
        os.replace(temporary, final)
    else:
        from pyarrow import fs

        store, a = fs.FileSystem.from_uri(temporary)
        _, b = fs.FileSystem.from_uri(final)
        if store.get_file_info(b).type != fs.FileType.NotFound:
            store.delete_file(b)
        store.move(a, b)


def remove(path: str) -> None:
    """Delete a local folder made by a test."""
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def text_of(column: str = "text") -> F.Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
