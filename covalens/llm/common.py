"""Pieces that several operators share: shared storage, sizing and packed blocks.

Tables between steps go to the folder that the cluster names in
``spark.checkpoint.dir``; a folder of our own is used only where that is unset.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python group holds at most on average.
GROUP_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a temporary folder; elsewhere it would not be shared."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or getattr(shared_dir, "own", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = shared_dir.own = tempfile.mkdtemp(prefix="covalens-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/covalens/{uuid.uuid4().hex}/{tag}"


#: Spark drops an execution's shuffle files as it ends, instead of when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and its shuffle files go.

    A step that has cached blocks of its own keeps them; blocks lost with an
    executor are made again, for which Spark repeats the shuffle.
    """
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``stored`` has written, once nothing reads it any more."""
    spark = table.sparkSession
    jvm, own = spark.sparkContext._jvm, shared_dir(spark)
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if "/covalens/" in folder and folder.split("/covalens/")[0].split(":")[-1].lstrip("/") == own.split(":")[-1].lstrip("/"):
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(texts: DataFrame, column: str = "text", size: int = GROUP_BYTES) -> int:
    """How many groups hold ``size`` bytes of text each, the shuffle's partitions at least."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(texts.sparkSession), math.ceil(total / size))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on from group to group."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: every input bit reaches every output bit."""
    x ^= x >> u64(30)
    x *= u64(0xBF58476D1CE4E5B9)
    x ^= x >> u64(27)
    x *= u64(0x94D049BB133111EB)
    x ^= x >> u64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for each pair (a, b), in that order."""
    out = a * u64(0x9E3779B97F4A7C15) + u64(salt)
    out ^= out >> u64(32)
    out += b
    return mixed(out)


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def unpacked(value, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype) if hasattr(value, "as_buffer") else np.frombuffer(value, dtype)


def few_bytes(values: np.ndarray) -> bytes:
    """Integers from 0 on, in as few bytes each as hold the largest."""
    wide = np.ascontiguousarray(values.astype("<u8"))
    width = max(1, -(-int(wide.max()).bit_length() // 8)) if len(wide) else 1
    return np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_few(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def small_ints(values: np.ndarray) -> tuple[int, bytes]:
    """The least value, and the values less it in few bytes."""
    base = int(values.min()) if len(values) else 0
    return base, few_bytes(values.astype(np.uint64) - u64(base))


def from_small(base: int, raw: bytes, n: int) -> np.ndarray:
    return (from_few(raw, n) + u64(base)).view(np.int64)


def dealt_texts(docs: DataFrame, group: Column, *columns) -> DataFrame:
    """(grp, blob): the rows of each group, packed and compressed, dealt by group and kept on disk.

    A blob holds what one batch of the input has for one group; ``texts_of``
    opens a group's blobs. A block lost with its executor is made again.
    """
    spark = docs.sparkSession
    rows = docs.select(group.cast("int").alias("grp"), *columns)

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            part = batch.column("grp").to_numpy(zero_copy_only=False)
            order = np.argsort(part, kind="stable")
            own = pa.Table.from_batches([batch]).drop_columns(["grp"]).take(pa.array(order))
            at = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(part) else []
            blobs = []
            for a, b in zip(at, np.r_[at[1:], len(part)], strict=True) if len(part) else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own.slice(a, b - a).combine_chunks())
                blobs.append(squeeze(sink.getvalue().to_pybytes()))
            yield pa.record_batch({"grp": pa.array(part[order][at] if len(part) else [], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    packed = rows.mapInArrow(pack, "grp int, blob binary")
    return packed.repartition(partitions(spark), "grp").sortWithinPartitions("grp").persist(StorageLevel.DISK_ONLY)


def texts_of(blobs: pa.Table) -> pa.Table:
    """The rows that ``dealt_texts`` packed for one group, in no certain order."""
    import zstandard

    tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_py())).read_all() for x in blobs.column("blob")]
    return pa.concat_tables(tables).combine_chunks()
