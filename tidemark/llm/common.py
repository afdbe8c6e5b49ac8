"""What the operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Bytes, about, of the rows that Python works on at once; a longer row comes alone.
PIECE_BYTES = 1 << 20
#: Rows of a batch on its way to Python, whose bytes Spark bounds at 64 MB.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset a
    temporary folder stands in for it in local mode (tests); on a cluster, whose
    machines have no disk in common, that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: For each scope that is open, the tables written in it.
scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but those marked to be kept."""
    made: list[DataFrame] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.remove(made)
        discard(*made)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there,
    and the loss of an executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if scopes and not keep:
        scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no result to come depends on; those already deleted do no harm."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes, about, that a broadcast may take in every executor.
BROADCAST_BYTES = 32 << 20


def held(value: Column, kind: DataType) -> Column:
    """Bytes, about, of a value: eight for a number, and what texts hold, in structs, lists and maps too."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, StructType):
        return sum((held(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, MapType):
        lists = (F.map_keys(value), ArrayType(kind.keyType)), (F.map_values(value), ArrayType(kind.valueType))
        return sum((held(*x) for x in lists), F.lit(8).cast("long"))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, MapType, ArrayType)):
            total = F.aggregate(value, F.lit(8).cast("long"), lambda n, x: n + held(x, kind.elementType))
            return F.coalesce(total, F.lit(8).cast("long"))
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 8
    return F.lit(8).cast("long")


def width(df: DataFrame) -> Column:
    """Bytes, about, of a row."""
    return sum((held(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (materialized), marked for broadcast only if the bytes it holds are few enough."""
    total = df.agg(F.sum(width(df))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def hash_share(column: str | Column) -> Column:
    """A number in [0, 1) that is the same for equal values."""
    return F.shiftrightunsigned(F.xxhash64(column), 34) / F.lit(float(1 << 30))


def hashed_sample(df: DataFrame, column: str, bound: int) -> DataFrame:
    """``bound`` rows, about, of ``df`` (materialized), whose values of ``column`` differ: those of small hash.

    Nothing is ordered or limited, so tasks send the sample to the driver and no more.
    """
    share = bound / max(df.count(), 1)
    return df.where(hash_share(column) < share) if share < 1 else df


def small_batches(spark: SparkSession) -> None:
    """Hand few rows to Python at once, unless the session has a setting of its own.

    Results are lazy, so the setting stays: it must hold when they are written.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, BATCH_ROWS)


def bytes_of(column: pa.Array) -> np.ndarray:
    """Bytes, about, that each value of a column holds, in structs, lists and maps too."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    if pa.types.is_struct(kind):
        return sum((bytes_of(x) for x in column.flatten()), np.full(len(column), 8, np.int64))
    if pa.types.is_list(kind) or pa.types.is_map(kind) or pa.types.is_large_list(kind):
        ends = column.offsets.to_numpy()
        inner = column.values if not pa.types.is_map(kind) else pa.StructArray.from_arrays([column.keys, column.items], ["k", "v"])
        so_far = np.concatenate([[0], np.cumsum(bytes_of(inner))])
        return so_far[ends[1:]] - so_far[ends[:-1]] + 8
    return np.full(len(column), 8, np.int64)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text. Spark bounds what it sends at once by bytes,
    but Python's own objects take several times that."""
    if not batch.num_rows:
        return
    sizes = sum((bytes_of(column) for column in batch.columns), np.full(batch.num_rows, 16, np.int64))
    cuts = np.nonzero(np.diff(np.cumsum(sizes) // most))[0] + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return to the system what a task has freed: a worker outlives its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def give_back_on_driver(spark: SparkSession) -> None:
    """As ``give_back``, for the driver and its Java process: each of the hundreds of threads that plan, broadcast and
    delete for many small jobs leaves free memory behind. Where Java has no such command, nothing happens."""
    give_back()
    java = spark._jvm
    command = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = java.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # the server's own class is not open to callers, but its interface is
    call = {m.getName(): m for m in java.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}["invoke"]
    args = spark.sparkContext._gateway.new_array(java.java.lang.Object, 4)
    args[0], args[1] = command, "systemTrimNativeHeap"
    with suppress(Py4JError):
        call.invoke(server, args)


def worked(
    batches: Iterator[pa.RecordBatch], work: Callable[[], Callable[[pa.RecordBatch], object]], target: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """What a task of ``map_batches`` gives."""
    step = work()
    for batch in batches:
        for piece in pieces(batch):
            if (out := step(piece)) is not None:
                yield to_batch(out, target)
    # its caches and last rows go first, or there would be nothing to give back
    step = batch = piece = out = None
    give_back()


def map_batches(
    df: DataFrame, columns: list[str], work: Callable[[], Callable[[pa.RecordBatch], object]], schema: str
) -> DataFrame:
    """Run ``work()(batch)`` over Arrow batches, of bounded bytes, of the named columns.

    ``work`` is called once per task and may keep caches; its function returns
    a dict of column values (or None for no rows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from worked(batches, work, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(*columns).mapInArrow(run, schema)


def to_batch(values: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := values[f.name], pa.Array) else pa.array(x, type=f.type) for f in target], schema=target
    )
