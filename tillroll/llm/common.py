"""Shared helpers: table reads, byte-balanced partitions, shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import work_path
from . import kernels as K

ROWS = 1000  # texts that are copied out of an Arrow batch at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def of_text(text: Column, rows, schema: T.StructType) -> Column:
    """A struct column made of a text column in Arrow batches: ``rows(bytes,
    offsets)`` gives the arrays of the struct's fields for a slice of texts.
    Only the text goes to Python and only the struct comes back; the other
    columns of the row stay where they are."""
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            out = []
            for i in range(0, max(len(t), 1), ROWS):
                buf, offs = K.utf8(t.slice(i, ROWS))
                out += [pa.StructArray.from_arrays(rows(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]), names=schema.names)
                        for a, b in K.slices(offs)]
            yield pa.concat_arrays(out) if out else pa.array([], to_arrow_type(schema))

    return F.arrow_udf(run, schema)(text)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage at a copy
    that every executor sees and that outlives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, "llm", name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these frames, once all that is made of
    them is written itself."""
    for df in frames:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def near_filter(big: DataFrame, keys: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """``big`` where ``on`` is among the distinct ``keys`` (a stored frame of
    one column). Up to ``most`` keys are broadcast, so that ``big`` is not
    shuffled; more are joined by key."""
    few = keys.limit(most + 1).count() <= most
    return big.join(F.broadcast(keys) if few else keys, on, "left_semi")
