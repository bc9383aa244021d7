"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``, in
their order. ``run`` writes each stage's result as Parquet in the shared
folder and reads it again as the next one's documents.

Every stage takes nulls in any column, empty and very long texts, repeated
rows, empty tables and extra columns of any name; what becomes of them is said
below and in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.bpe import bpe_encode
from tillroll.llm.common import stored, table
from tillroll.llm.decontaminate import contamination
from tillroll.llm.minhash import near_duplicates
from tillroll.llm.quality import quality_scores, train
from tillroll.llm.queries import vocabulary_path
from tillroll.llm.secrets import find_secrets, redact, row_key


class _Renamed:
    """Documents under neutral column names, so that no column of theirs can
    clash with one that an operator adds."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{k}" for k in range(len(self.names))])
        self.id, self.text, self.source = (self.name(c) for c in ("doc_id", "text", "source"))

    def name(self, column: str) -> str:
        return f"c{self.names.index(column)}"

    def back(self, df: DataFrame, **changed: Column) -> DataFrame:
        return df.select(*[changed.get(c, F.col(self.name(c))).alias(c) for c in self.names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble accepts (score 0.7 or more).
    It is trained on the labelled ones among ``docs``. A null text is scored
    as an empty one; without labels all documents are accepted."""
    r = _Renamed(docs)
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return r.back(quality_scores(r.df, model, r.text).filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles,
    similarity 0.8), that with the smallest id; a row that repeats id and text
    of another goes. Documents without words and rows with a null id stay."""
    r = _Renamed(docs)
    found = near_duplicates(r.df, r.id, r.text, width=5, percent=80)
    change = stored(found.filter(F.col(r.id).isNotNull()).groupBy(F.col(r.id).alias("id"))
                    .agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "change")
    left = r.df.join(change, F.col(r.id) == F.col("id"), "left").filter("kept is null or kept")
    if not change.filter("n > 1").isEmpty():
        left = left.filter("n is null").unionByName(left.filter("n is not null").dropDuplicates([r.id, r.text]))
    return r.back(left)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a benchmark window whose hit words are at
    least a twentieth of their words; the others stay unchanged."""
    r = _Renamed(docs)
    found = contamination(r.df, table(spark, sf_dir, "benchmark"), r.text)
    return r.back(found.filter("not contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secret values in the texts (``[example]`` for values that
    many owners carry, else ``[secret]``) and, there, n_chars. All documents
    stay."""
    r = _Renamed(docs)
    found = (find_secrets(r.df, r.id, r.text, r.source).filter("size(judged) > 0")
             .select("row_key", "judged").dropDuplicates(["row_key"]))
    both = r.df.withColumn("key", row_key(r.id, r.text)).join(found, F.col("key") == F.col("row_key"), "left")
    text = F.when(F.col("judged").isNull(), F.col(r.text)).otherwise(redact(F.col(r.text), F.col("judged")))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        old = F.col(r.name("n_chars"))
        changed["n_chars"] = F.when(F.col("judged").isNull(), old).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType))
    return r.back(both, **changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids and the digests of
    the ids and of the decoded text. A null text has no ids."""
    r = _Renamed(docs)
    return bpe_encode(r.df, vocabulary_path(), r.text, keep=[r.id], decoded=False, digests=True).withColumnRenamed(
        r.id, "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline_{name}")
    return docs
