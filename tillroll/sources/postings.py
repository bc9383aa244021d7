"""Substring search by trigram postings.

Kept beside a table at load: its rows with dense numbers, sorted by them, and
for every three-character piece of the searched texts (lower-cased) the numbers
of the rows that have it, sorted by piece. Texts also have their last one and
two characters as pieces, so a keyword shorter than three characters is the
beginning of some piece.

A search reads the postings of the keyword's pieces (both tables are sorted, so
Parquet statistics leave the rest out), keeps the rows that have all of them,
reads those, and verifies the keyword itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path
from .row_ids import ROW_ID, CREATED, with_row_ids
from .store import TableStore

SIZE = 3
FEW = 1000  # candidates that become a filter on the row number; more are joined


class SearchIndex:
    """Rows of one table and the postings of some of its text columns."""

    def __init__(self, spark: SparkSession, schema: T.StructType, columns: list[str], root: str | None = None):
        self.spark, self.schema, self.columns = spark, schema, columns
        self.root = (root or work_path(spark, "search")).rstrip("/")

    def save(self, df: DataFrame) -> int:
        """Indexes the rows of ``df``; returns their number."""
        rows, n = with_row_ids(TableStore(self.spark, f"{self.root}/ids"), "search", df.select(*self.schema.fieldNames()))
        rows = rows.drop(CREATED)
        rows.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID).write.mode("overwrite").parquet(f"{self.root}/rows")
        rows = self._rows()
        pieces = []
        for k, c in enumerate(self.columns):
            text = F.lower(F.col(c))
            at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
            pieces.append(rows.filter(F.length(c) > 0).select(
                F.lit(k).alias("field"), F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(SIZE))))).alias("piece"), ROW_ID))
        out = pieces[0]
        for p in pieces[1:]:
            out = out.unionByName(p)
        (out.repartitionByRange("field", "piece", ROW_ID).sortWithinPartitions("field", "piece", ROW_ID)
         .write.mode("overwrite").parquet(f"{self.root}/postings"))
        return n

    def _rows(self) -> DataFrame:
        schema = T.StructType([T.StructField(ROW_ID, T.LongType()), *self.schema.fields])
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def candidates(self, keyword: str) -> DataFrame:
        """Numbers of the rows that have all pieces of the keyword, in one of
        the columns."""
        k = keyword.lower()
        postings = self.spark.read.schema(f"field int, piece string, {ROW_ID} long").parquet(f"{self.root}/postings")
        if len(k) < SIZE:
            return postings.filter(F.col("piece").startswith(k)).select(ROW_ID).distinct()
        pieces = sorted({k[i:i + SIZE] for i in range(len(k) - SIZE + 1)})
        return (postings.filter(F.col("piece").isin(pieces)).groupBy("field", ROW_ID).agg(F.count("*").alias("n"))
                .filter(F.col("n") == len(pieces)).select(ROW_ID).distinct())

    def search(self, keyword: str) -> DataFrame:
        """The rows of which a searched column contains the keyword, without
        regard to case. An empty keyword finds nothing."""
        if not keyword:
            return self.spark.createDataFrame([], self.schema)
        found = self.candidates(keyword)
        some = [r[0] for r in found.limit(FEW + 1).collect()]
        rows = self._rows()
        rows = rows.filter(F.col(ROW_ID).isin(some)) if len(some) <= FEW else rows.join(found, ROW_ID, "left_semi")
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(keyword.lower()), F.lit(False))
        return rows.filter(hit).select(*self.schema.fieldNames())
