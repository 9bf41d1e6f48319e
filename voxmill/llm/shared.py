"""Written tables in the folder that all executors share, and the blocked exchange.

The blocked exchange answers "what does the whole corpus know about each n-gram
of my texts?" with few, large rows. Texts are packed into blocks; a block asks
each hash bucket about all of its distinct n-grams in one packed row; a bucket
sees all blocks' questions about its hashes and sends one packed reply to each
block. A frequent n-gram is one entry per block however often it occurs there,
so a hot key adds one entry for each block to its bucket. ``block_bytes`` and
``bucket_bytes`` bound what one task holds; a row carries about their product
over the input's size, so both should grow with the square root of very large
inputs, as far as executor memory allows.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs in this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting by which a query's shuffle files go when it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and ends the lineage. The shuffle files behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["written_to"] = path
    return table


#: Spark's setting for the bytes of one Arrow batch; by default 64 MB, or 10,000 rows if these are smaller.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int):
    """Jobs that run in here hand their rows to Python in Arrow batches of about ``most`` bytes, or one larger row."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written_by(df: DataFrame, name: str, key: str, buckets: int, **options: str) -> DataFrame:
    """Like ``written``, as a bucketed table: joins and groups by ``key`` read it where it lies, without a shuffle. Spark limits the number of buckets; they then hold more. ``options`` are the writer's."""
    spark = df.sparkSession
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").options(path=path, **options).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.__dict__.update(written_to=path, written_as=table)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` or ``written_by`` that no later step reads."""
    for df in tables:
        if path := df.__dict__.get("written_to"):
            spark = df.sparkSession
            if table := df.__dict__.get("written_as"):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def aside(docs: DataFrame, *own: str):
    """``docs`` with all columns but ``own`` under names of no meaning, and a function that gives a table of these its columns, names and order again."""
    held = [c if c in own else f"given{i}_" for i, c in enumerate(docs.columns)]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(h).alias(c) for h, c in zip(held, docs.columns, strict=True)))

    return docs.toDF(*held), back


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def runs(batches, block_bytes: int):
    """Rows in runs of at most ``block_bytes`` of ``text``, or of one longer text: a number of its own for each, and its rows."""
    block, parts, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0).to_numpy()
        at = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + block_bytes - size, side="right")) - 1
            if parts and hi <= lo:
                yield block, pa.Table.from_batches(parts)
                block, parts, size = block + 1, [], 0
                continue
            hi = max(hi, lo + 1)
            parts.append(batch.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
    if parts:
        yield block, pa.Table.from_batches(parts)


def _pack_rows(block_bytes: int):
    def pack(batches):
        for block, table in runs(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([to_bytes(table)], pa.binary())], names=["block", "rows"])

    return pack


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def block_buckets(total: int, block_bytes: int) -> int:
    """Buckets of a table of blocks: two blocks each, so a task of a later step is small."""
    return max(1, math.ceil(total / (2 * block_bytes)))


def packed_blocks(docs: DataFrame, block_bytes: int, total: int) -> DataFrame:
    """``(block, rows)``: the rows of ``docs`` in runs of about ``block_bytes`` of ``text`` (a longer text is a block of its own), packed as Arrow bytes.

    Written once, so that every step sees the same rows in the same order and place whatever is computed anew.
    """
    return written_by(docs.mapInArrow(_pack_rows(block_bytes), "block long, rows binary"), "blocks", "block", block_buckets(total, block_bytes))


def buckets_for(total: int, bucket_bytes: int) -> int:
    return max(1, math.ceil(total / bucket_bytes))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: equal ranges of its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place where each stands, and each value's number among them."""
    order = np.argsort(values)
    ordered = values[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, bool)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(head) - 1
    return ordered[head], order[head], number


def pack(values: np.ndarray) -> bytes:
    """Fixed-width integers as compressed byte planes; sorted or small ones take a few bytes or less."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T) if len(values) else np.zeros(0, np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, dtype: str, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype)
