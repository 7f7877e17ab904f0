"""Shared plumbing: stored intermediates, folds, batches and text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches as bounded_batches

#: Text bytes that one vectorised step handles at once (one text may be longer).
SLICE_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: For tables whose rows are large: by default a page is closed after 100 rows at the earliest and a row group at 128 MB, and
#: both are held whole, in memory beside the heap too, where they are written and read. So they are closed row by row, at these bytes.
LARGE_ROWS = {"parquet.block.size": str(1 << 22), "parquet.page.size": str(1 << 18), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends at files that every executor can read, so a lost executor
    costs no recomputation of what came before.
    """
    path = f"{shared_folder(df.sparkSession)}/tracewright/{label}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing will read them again."""
    for df in stored:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str, n: int, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with one row of ``values`` for each key, no task getting all rows of a frequent key.

    Rows of a key with more than n / 10,000 rows are dealt over several tasks by the hash of column ``by``, and the
    key's value goes to each of them. Only the frequent keys and their numbers of parts are broadcast: at most 10,000
    if ``rows`` has ``n`` rows. Keys are counted in ``counted``, a stored table with the keys of ``rows``, or in ``rows`` itself.
    """
    heavy = max(100, n // 10_000)
    parts = (rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("_parts")).where("_parts > 1")
    dealt = rows.join(F.broadcast(parts), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = values.join(F.broadcast(parts), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def row_hash(row: Column) -> Column:
    """A hash of a whole row, given as a struct, to break ties between rows alike in all that an operator looks at."""
    return F.xxhash64(F.to_json(row))


def released(step):
    """``step``, a generator of batches, that gives its worker's free memory back to the system when it ends.

    Workers are kept for later tasks; what they no longer use would count against the executor all that time.
    """

    def run(batches):
        import ctypes
        import gc

        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns, so that clashing names elsewhere cannot matter; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def text_slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about ``limit`` bytes of text in all ``columns``, at least one row each."""
    if not batch.num_rows:
        return
    sizes = sum(pa.compute.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  (registers pa.compute)
