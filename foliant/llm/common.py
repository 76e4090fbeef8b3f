"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word contracts: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
_LOCAL: dict[str, str] = {}  # temporary folders of local sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; without it, a local session gets a
    temporary one, and a cluster an error, as its machines would not see each other's files."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='foliant-')}")
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """What lies at path is read by this session alone, and goes when its driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing before it. The table goes at the end of the session."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or an iterator UDF, with free memory given back at both ends of a partition: Spark keeps its
    Python workers for later stages, whose own need comes on top of what they hold, and what the last batch of a
    partition held is free only when the next one begins."""

    def give_back() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


#: Rows of a file, about, where a small table is written.
FILE_ROWS = 20_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, which has no more rows than that, in tasks (and so files) for about FILE_ROWS rows each, or as it is dealt now
    if that is fewer: a table of a few rows a partition costs a file, and on some stores a process, for each of them."""
    wanted = max(1, -(-rows // FILE_ROWS))
    return df.coalesce(wanted) if wanted < partitions(df.sparkSession) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def searched(index: DataFrame, asks: DataFrame, tasks: int, build: Callable, schema: str) -> DataFrame:
    """index: shard, id, v. asks: shard, id, v and a column of its own. Gives every batch of asks of a shard to
    build(ids, vectors), which is called once for all rows of the shard, with (ids, vectors, the column).

    A shard's rows come first in a task and its asks follow, so a task holds what one shard builds and one batch, however
    many asks there are. Vectors of one shard have one length.
    """
    extra = next(c for c in asks.columns if c not in ("shard", "id", "v"))
    both = index.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast(dict(asks.dtypes)[extra]).alias(extra)).union(asks.select("shard", F.lit(1), "id", "v", extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, search, held = None, None, []
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.nonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0))[0] + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, search, held = shards[a], None, []
                if kinds[a] == 0:
                    held.append((part.column(2).to_numpy(), matrix(part.column(3))))
                    continue
                if search is None:
                    if not held:
                        continue
                    search = build(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held = []
                yield search(part.column(2).to_numpy(), matrix(part.column(3)), part.column(4))

    return both.repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(run), schema)


def numbered(df: DataFrame, keys: list[str], row: str, rows: int, name: str = "n") -> DataFrame:
    """Adds the number of each row within its keys, gapless from 0, without sorting a whole group in one task.

    Rows fall into hashed buckets; windows number a bucket, and the sizes of the buckets before it are added. The
    table of bucket sizes has at most (groups x 4096) rows; it is dealt by the same keys as the rows, and Spark decides by
    its size whether to broadcast it. Columns named _bucket, _rank, _start or _rows must not exist.
    """
    buckets = max(16, min(4096, rows // 50_000))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(row)
    return (
        dealt.withColumn("_rank", F.row_number().over(inside))
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_rank") - 1)
        .drop("_bucket", "_start", "_rank")
    )
