"""What the corpus operators share: reading, Arrow maps, shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: bounds what a Python worker holds of short texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Freed memory back to the system: workers live on after a task, beside others on their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidied(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """fn over a task's batches, with its freed memory given back at the end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over each Arrow batch, whose columns go by position. No shuffle; one batch in memory at a time."""
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may have dots
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(tidied(run), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and where each starts (one more entry than texts). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where it is unset and all runs on one machine (tests) a local one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder: later steps read it again instead of computing it again, and lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "lz4").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Deletes tables made by `written` once all that was made from them is written itself."""
    for t in tables:
        if (path := getattr(t, "written_to", None)) is not None:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checked_text_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of a text column: two numbers by which sides and partitions are sized."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{column}`")))).first()
    return int(row[0]), int(row[1] or 0)
