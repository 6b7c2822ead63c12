"""What the operators share: written tables in the cluster's shared folder, size-checked lookups, Arrow text buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many bytes is broadcast, after its size has been measured; a larger one is shuffled.
BROADCAST_BYTES = 24 << 20
#: Rows of a hot key are dealt over so many salts where a lookup table is shuffled.
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset, on a local master (tests), a temporary folder is set first."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skytally-"))
        root = spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/skytally-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def materialise(df: DataFrame, folder: str | None = None, name: str = "table", row_bytes: Column | None = None, compression: str | None = None, **measures: Column) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there, whichever executor is lost.

    The rows, the sum of row_bytes and other aggregates asked for are counted while the table is written; measured() has them."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    measures = {"rows": F.count(F.lit(1))} | ({} if row_bytes is None else {"bytes": F.sum(row_bytes.cast("long"))}) | measures
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.mode("overwrite").parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._measured = observed(seen, list(measures))
    return table


def observed(seen: Observation, names: list[str]) -> dict:
    """What an ended action has counted; nothing if Spark hasn't told it after some seconds."""
    for _ in range(30):
        row = seen._jo.getOrEmpty()  # waits a tenth of a second
        if row.size():
            return {k: row.apply(k) for k in names}
    return {}


def measured(table: DataFrame) -> dict:
    return getattr(table, "_measured", {})


def is_empty(table: DataFrame) -> bool:
    rows = measured(table).get("rows")
    return table.isEmpty() if rows is None else rows == 0


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(spark: SparkSession, folder: str) -> None:
    """Delete a written table that no plan reads any more, and let Spark drop the shuffle files of plans that are gone."""
    drop_shuffles(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, which must be cheap to read (a written table), holds at most limit bytes; measured, not estimated."""
    seen = measured(df)
    if isinstance(row_bytes, int) and "rows" in seen:
        return seen["rows"] * row_bytes <= limit
    if "bytes" in seen:  # as row_bytes was when the table was written
        return (seen["bytes"] or 0) <= limit
    per_row = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return (df.agg(F.sum(per_row.cast("long"))).first()[0] or 0) <= limit


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], row_bytes: int | Column, how: str = "left", spread: Column | None = None) -> DataFrame:
    """big joined to the written table small, which has one row a key.

    small is broadcast if its measured size allows; else both sides are shuffled, with the rows of big dealt over SALTS salts
    (spread: what the salt is drawn from) so that a hot key does not meet in one task."""
    if is_small(small, row_bytes):
        return big.join(F.broadcast(small), list(on), how)
    salt = F.pmod(F.xxhash64(spread if spread is not None else F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")


def lookup_hot(big: DataFrame, small: DataFrame, on: Sequence[str], row_bytes: int | Column, weight: str, hot: int = 5000) -> DataFrame:
    """big joined (inner) to the written table small, which has one row a key and in weight the number of rows of big that have it.

    A small table is broadcast. Else the keys with more than hot rows, at most one in hot of big's rows, are broadcast, and the rest is shuffled."""
    plain = small.drop(weight)
    if is_small(small, row_bytes):
        return big.join(F.broadcast(plain), list(on))
    per_row = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    many = materialise(small.where(F.col(weight) > hot).drop(weight), row_bytes=per_row)
    few = small.where(F.col(weight) <= hot).drop(weight)
    if is_empty(many):
        return big.join(few, list(on))
    if not is_small(many, row_bytes):
        return lookup(big, plain, on, row_bytes, "inner")
    return big.join(F.broadcast(many), list(on)).unionByName(big.join(few, list(on)))


def give_back() -> None:
    """At the end of a task: freed memory goes back to the system, since an idle Python worker keeps what it holds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most so many bytes each, or of one row."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(end, n)))
        at = min(end, n)
    return out
