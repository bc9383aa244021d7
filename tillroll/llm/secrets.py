"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Spans: a text with matches is split at them; running sums over the lengths of
the parts and of the matches give every match's place in code points. The
secret value of each span is hashed, and the hashes are counted over the whole
corpus by distinct owner and distinct repository. A value that many owners or
very many repositories carry is a copied example; a value that stays with few
and looks random is a live-looking credential of its own. Counts are combined before the shuffle, and the join
back is a plain equi-join whose hot keys Spark can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Kind -> (pattern, group that holds the value, its least
#: length). Written with that length in the pattern where this finds the same.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = list(PATTERNS)


def _parts(docs: DataFrame, kind: str) -> DataFrame:
    """(row_key, rank, kind, pos, gap, m): the matches of one kind in texts
    that have some, and the length of what lies between each and the one
    before."""
    pattern = PATTERNS[kind][0]
    gaps = F.transform(F.split("t", pattern, -1), lambda x: F.length(x).cast("long"))
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m"))
    return (docs.filter(F.col("t").rlike(pattern))
            .select("row_key", F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(zipped).alias("pos", "p"))
            .select("row_key", "rank", "kind", "pos", "p.gap", "p.m").filter("m is not null"))


def spans(docs: DataFrame) -> DataFrame:
    """(row_key, start, rank, kind, end, value_start, value) of ``docs``
    (row_key, t): leftmost, non-overlapping per kind, in code points, end
    exclusive; matches whose value is too short are left out. Rows with equal
    keys count once.

    Places are running sums over a text's matches, so they cost no more than
    in proportion to them."""
    parts = reduce(DataFrame.unionByName, [_parts(docs, k) for k in KINDS])
    parts = parts.repartition("row_key").dropDuplicates(["row_key", "rank", "pos"])
    upto = Window.partitionBy("row_key", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    value, least = F.lit(None).cast("string"), F.lit(0)
    for rank, (pattern, group, size) in enumerate(PATTERNS.values()):
        value = F.when(F.col("rank") == rank, F.regexp_extract("m", pattern, group)).otherwise(value)
        least = F.when(F.col("rank") == rank, F.lit(size)).otherwise(least)
    placed = parts.select("row_key", "rank", "kind", "m", end.alias("end"), value.alias("value"), least.alias("least"))
    return placed.filter(F.length("value") >= F.col("least")).select(
        "row_key", (F.col("end") - F.length("m")).alias("start"), "rank", "kind", "end",
        (F.col("end") - F.length("value")).alias("value_start"), "value")


def row_key(id_col: str, text_col: str) -> Column:
    """The id as text and a hash of the text: equal for equal rows."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    return F.concat(ident, F.lit(":"), F.hex(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str | None = None, example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """One row per row of ``docs``: id, ``row_key``, ``base`` (spans of the three kinds by
    start, then kind: array of start, rank, kind, end, value_start, value) and
    ``judged`` (the same with owners, repositories and verdict).

    ``owners`` counts the distinct values of ``owner_col`` (a null owner counts
    as one) among all rows that hold the span's value, ``repositories`` those
    of ``repository_col`` (default: the id). The verdict is ``example`` from
    ``example_owners`` owners or ``example_repositories`` repositories on,
    else ``live`` when the value mixes digits and letters and uses at least
    eight different characters, else ``weak``.

    A null text is empty and has no spans. Equal rows (id and text) get equal
    results and count once; an empty table gives an empty result. Columns not
    named are not read.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
                      F.col(f"`{repository_col or id_col}`").cast("string").alias("repo"),
                      row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    each = stored(spans(src.select("row_key", "t")).withColumn("h", F.sha2(F.col("value").cast("binary"), 256)), "secrets")
    have = each.select("row_key").distinct()
    held = (src.select("row_key", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
            .join(have, "row_key").distinct().join(each.select("row_key", "h").distinct(), "row_key")
            .select("h", "owner", "repo").distinct())
    owners = held.select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("owners"))
    repos = held.select("h", "repo").distinct().groupBy("h").agg(F.count("*").alias("repositories"))
    value = F.col("value")
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    verdict = F.when(copied, "example").when(random, "live").otherwise("weak")
    judged = (each.join(owners.join(repos, "h"), "h")
              .select("row_key", F.struct("start", "rank", "kind", "end", "value_start", "value", "owners", "repositories",
                                          verdict.alias("verdict")).alias("s"))
              .groupBy("row_key").agg(F.array_sort(F.collect_list("s")).alias("judged")))
    kind = dict(judged.dtypes)["judged"]
    base = F.transform("judged", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end", "value_start", "value")]))
    return (src.select("id", "row_key").join(judged, "row_key", "left")
            .withColumn("judged", F.coalesce("judged", F.array().cast(kind)))
            .select(F.col("id").alias(id_col), "row_key", base.alias("base"), "judged"))


def all_spans(judged: Column) -> Column:
    """The base spans and, for each live-looking value, its own span of kind
    ``live``; by start, then kind."""
    own = F.transform(F.filter(judged, lambda s: s["verdict"] == "live"),
                      lambda s: F.struct(s["value_start"].alias("start"), F.lit(len(KINDS)).alias("rank"),
                                         F.lit("live").alias("kind"), s["end"].alias("end")))
    base = F.transform(judged, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                  s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.array_distinct(F.concat(base, own)))


def redact(text: Column, judged: Column) -> Column:
    """Text whose secret values are replaced: ``[example]`` where the value is
    a copied example, ``[secret]`` elsewhere. Overlapping values are one."""
    by_value = F.array_sort(F.transform(judged, lambda s: F.struct(
        s["value_start"].alias("a"), s["end"].alias("b"),
        F.when(s["verdict"] == "example", "[example]").otherwise("[secret]").alias("mark"))))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["pos"].cast("int") + 1, (s["a"] - acc["pos"]).cast("int"))
        out = F.when(s["a"] >= acc["pos"], F.concat(acc["out"], gap, s["mark"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["b"]).alias("pos"), out.alias("out"))

    done = F.aggregate(by_value, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["pos"].cast("int") + 1, F.length(text))))
    return F.when(F.size(judged) > 0, done).otherwise(text)
