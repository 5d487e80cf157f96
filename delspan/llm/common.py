"""Helpers that the operators share: shared scratch tables, what workers keep, chunks of texts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: How to drop what a worker process keeps between tasks, by the name of what keeps it.
KEPT: dict[str, Callable[[], None]] = {}
CHUNK_CHARS = 1 << 19


def keep_only(*names: str) -> None:
    """To be called where a task begins: workers serve many operators one after another, and should only hold what the present one uses."""
    for name, drop in KEPT.items():
        if name not in names:
            drop()


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory: reused workers wait with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker holds no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def chunks(texts: Sequence[str | bytes | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about ``size`` together; a longer text is a run of its own."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if held and held + n > size:
            yield start, k
            start, held = k, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only on one machine may that be unset (as in tests): then a temporary folder is made, and
    removed when Python ends. On a cluster it would be another folder on each machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/delspan-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The written files outlive any executor, so later stages never recompute what stands before; the shuffle files of the
    write aren't needed after it and go at once, so a job of many steps needs disk for its largest step only. :func:`discard` removes
    the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote. No DataFrame that is still to be computed may read them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path.rpartition("/")[0])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, n_bytes: float, target: float = 16 << 20) -> int:
    """How many partitions of about ``target`` bytes ``n_bytes`` needs, at least the session's count."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(n_bytes // target) + 1)
