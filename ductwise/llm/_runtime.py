"""Session settings, shared storage and bounded training samples for the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches are small.
ARROW_ROWS = 500
#: Characters of a labelled text that is learnt from at most.
LONGEST = 100_000

_own_dirs: list[tempfile.TemporaryDirectory] = []
#: Folders of the open ``scratch`` blocks; each thread and each asynchronous task of a driver has its own.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("ductwise_scratch", default=())


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes and drop shuffle files once an execution has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", "8m"),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        spark.conf.set(key, value)


def tidy(run):
    """``run`` over Arrow batches, giving memory that allocators hold back to the system after each batch.

    Workers live on between stages, so what one keeps is missing to the next.
    """

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        pool = pa.default_memory_pool()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for out in run(batches):
            yield out
            del out
            pool.release_unused()
            if trim is not None:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, and only where the session has none, a temporary folder is made; on a cluster a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.TemporaryDirectory(prefix="ductwise-"))
        atexit.register(_own_dirs[0].cleanup)
    return f"file://{_own_dirs[0].name}"


def _folder(spark: SparkSession) -> str:
    """The folder of the innermost ``scratch``, or else that of this package."""
    return _scratch.get()[-1] if _scratch.get() else f"{shared_dir(spark)}/ductwise"


@contextmanager
def scratch(spark: SparkSession):
    """Tables written within are deleted at the end, once what outlives them is written ``under`` the folder that this gives."""
    outer = _folder(spark)
    own = f"{outer}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set((*_scratch.get(), own))
    try:
        yield outer
    finally:
        _scratch.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this package keeps in the shared folder, once a job has read its results."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, codec: str = "zstd", tasks: int | None = None, under: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    ``tasks`` merges the partitions of a table whose size is known, so that few rows don't become many files.
    ``under`` is another folder than the innermost one.
    """
    spark = df.sparkSession
    path = f"{under or _folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if tasks is None else df.coalesce(tasks)).write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text mod 3; rows of fold 1 are held out."""
    return F.crc32(doc_id.cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str, int]]:
    """At most ``per_class`` labelled documents for each value of ``label``, never of the held-out fold, in hash order.

    The sample is the rows with the smallest hash of doc_id, so it is the same in every run.  Rows without text or
    label and texts of more than ``LONGEST`` characters are left out; repeated labels of a document count once, with the larger label,
    and a repeated doc_id has the least of its texts.  Only this sample, bounded in rows and bytes, reaches the driver.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max(label).alias("label_"))
        .withColumn("order_", F.xxhash64("doc_id"))
    )
    picked = None
    for value in (0, 1):
        part = ids.where(F.col("label_") == value).orderBy("order_", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class ids: small enough to send to every executor
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "label_", "order_").agg(F.min("text").alias("text"))
    return [(r["doc_id"], r["text"], r["label_"]) for r in sorted(rows.collect(), key=lambda r: (r["order_"], r["doc_id"]))]


def class_shares(labels: DataFrame, label: str) -> dict[int, float]:
    """Share of each label among the rows that may be learnt from."""
    rows = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 1)).groupBy(F.col(label).alias("label_")).count().collect()
    total = sum(r["count"] for r in rows) or 1
    return {r["label_"]: r["count"] / total for r in rows}
