"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, ship

#: Rows of an Arrow batch: texts may be long, and a Python worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 1024, "16m"
#: Rows that the Parquet reader decodes at a time: its vectors of long texts are large objects on the executor's heap.
READ_ROWS = 256

_SCRATCH: list[tuple[SparkSession, str]] = []

#: What empties the caches of each module, and the module whose functions this worker ran last.
_CACHES: dict[str, Callable[[], object]] = {}
_LAST: list[str] = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/rillflow/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs only a new read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table behind a frame from written(), once nothing reads it any more."""
    delete(df.sparkSession, df.scratch_path)
    _SCRATCH.remove((df.sparkSession, df.scratch_path))


@atexit.register
def _clear() -> None:
    for spark, path in _SCRATCH:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  its session may have ended; others may not have
            continue


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes, for good: plans read them when they run, which is after a query has been made."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def caches(module: str, clear: Callable[[], object]) -> None:
    """Says how a module's caches are emptied, see begin()."""
    _CACHES[module] = clear


def begin(module: str) -> None:
    """Empties other modules' caches: a worker that Spark uses again for another operator holds the caches of one only."""
    if _LAST[0] == module:
        return
    _LAST[0] = module
    for name, clear in _CACHES.items():
        if name != module:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str, raw: bool = False) -> DataFrame:
    """mapInArrow over dicts of Python lists (raw: over Arrow batches). fn maps an iterator of input batches to output batches,
    dicts of lists or Arrow arrays, once in each task."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind, module = to_arrow_schema(StructType.fromDDL(schema)), fn.__module__

    def run(batches):
        begin(module)
        for out in fn(b if raw else b.to_pydict() for b in batches):
            if len(next(iter(out.values()))):
                yield pa.RecordBatch.from_pydict({f.name: x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in kind}, schema=kind)

    return df.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed tokenizers; RILLFLOW_TOKENIZERS names another folder that holds it."""
    if folder := os.environ.get("RILLFLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
