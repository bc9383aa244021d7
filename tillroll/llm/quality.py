"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of a text (shares of character classes, word lengths, repeats)
   are computed by byte kernels in Arrow tasks.
2. On a bounded sample of labelled documents, small regression trees are
   boosted on the statistics; every path from a root to a node is a rule, a
   conjunction of comparisons.
3. A lasso-penalised logistic regression over the rules keeps few of them.
4. The kept rules and weights become one Spark column expression.

The sample holds at most ``SAMPLE`` labelled rows, those with the smallest
hashes of their ids; statistics and scores cover all documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import crc_mod, of_text
from .fingerprints import ANCHORS

SAMPLE = 12_000
TREES, DEPTH, BINS, LEAF, SHRINK = 40, 3, 48, 25, 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "line": b"\n\r", "sign": b"#$%&*@^~", "bar": b"|", "shout": b"!?", "stop": b".,;:",
    "code": b"<>{}[]()=+/\\_\"'`", "wide": bytes(range(128, 256)),
}
STATISTICS = ["log_bytes", "log_words", *[f"share_{c}" for c in _CLASSES if c != "lower"], "upper_of_letters",
              "word_bytes", "long_words", "plain_words", "common_words", "distinct_words", "same_as_before",
              "top_word", "words_per_line", "distinct_lines", "distinct_triples"]


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, STATISTICS) of the rows' texts."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    some = np.maximum(size, 1)
    share = {}
    for name, chars in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        total = np.append(0, np.cumsum(table[buf], dtype=np.int64))
        share[name] = (total[offs[1:]] - total[offs[:-1]]) / some
    h, rows, starts, ends = K.words(buf, offs, K.NON_SPACE)
    words = np.bincount(rows, minlength=n)
    per = np.maximum(words, 1)
    plain, prow, _, _ = K.words(buf, offs, K.ALNUM)
    at = np.minimum(np.searchsorted(ANCHORS, plain), len(ANCHORS) - 1)
    common = np.bincount(prow, ANCHORS[at] == plain, n) / np.maximum(np.bincount(prow, minlength=n), 1)
    low = K.LOWER[buf]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    letters = np.append(0, np.cumsum(letter, dtype=np.int64))
    inner = (letters[ends] - letters[starts]) >= (ends - starts) - (~letter[ends - 1] if len(ends) else 0)
    same = np.append(False, (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) if len(h) else np.zeros(0, bool)
    triple = K.chain_hash(h, 3)
    cut = np.searchsorted(rows, np.arange(n + 1))
    line_end = np.flatnonzero(np.isin(buf, [10]))
    distinct, top, triples, lines, per_line = (np.ones(n) for _ in range(5))
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if a == b:
            continue
        _, c = np.unique(h[a:b], return_counts=True)
        distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
        if b - a >= 3:
            triples[i] = len(np.unique(triple[a:b - 2])) / (b - a - 2)
    line_of = np.searchsorted(line_end, starts)  # line number of each word
    first = np.flatnonzero(np.append(True, (line_of[1:] != line_of[:-1]) | (rows[1:] != rows[:-1]))) if len(h) else np.zeros(0, int)
    if len(first):
        lh = np.add.reduceat(K.mix(h + np.uint64(1)) * (np.arange(len(h)) - np.repeat(
            first, np.diff(np.append(first, len(h)))) + 1).astype(np.uint64), first)
        lrow = rows[first]
        n_lines = np.bincount(lrow, minlength=n)
        u = np.unique(np.column_stack([lrow.astype(np.uint64), lh]), axis=0)[:, 0].astype(np.int64)
        has = n_lines > 0
        lines[has] = (np.bincount(u, minlength=n) / np.maximum(n_lines, 1))[has]
        per_line = words / np.maximum(n_lines, 1)
    cols = [np.log1p(size), np.log1p(words), *[share[c] for c in _CLASSES if c != "lower"],
            share["upper"] / np.maximum(share["upper"] + share["lower"], 1e-9),
            np.bincount(rows, ends - starts, n) / per, np.bincount(rows, ends - starts >= 15, n) / per,
            np.bincount(rows, inner, n) / per, common, distinct, np.bincount(rows, same, n) / per, top,
            per_line, lines, triples]
    return np.round(np.column_stack(cols), 9)


_STATISTICS = T.StructType([T.StructField(f"__s{k}", T.DoubleType()) for k in range(len(STATISTICS))])


def text_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the statistics as doubles ``__s0``, ..."""
    def rows(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [pa.array(c) for c in statistics(buf, offs).T.copy()]

    # one row each; what reads the statistics reads plain columns
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(of_text(F.col(f"`{text_col}`"), rows, _STATISTICS))))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold), ...


def _trees(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """Distinct rules from boosted trees: paths to all nodes."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(f)]
    edges = [np.unique(np.append(e, (e[1:] + e[:-1]) / 2)) for e in edges]
    width = max(len(e) for e in edges) + 1
    code = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)])
    code += np.arange(f) * width
    margin, rules = np.zeros(n), {}
    for _ in range(TREES):
        grad = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(n) < 0.6)
        use = rng.random(f) < 0.6
        stack: list[tuple[np.ndarray, Rule]] = [(rows, ())]
        while stack:
            idx, path = stack.pop()
            if path:
                rules[path] = None
            best = None
            if len(path) < DEPTH and len(idx) >= 2 * LEAF:
                flat = code[idx].ravel()
                c = np.bincount(flat, minlength=f * width).reshape(f, width).cumsum(1)
                g = np.bincount(flat, np.repeat(grad[idx], f), f * width).reshape(f, width).cumsum(1)
                all_g, m = g[:, -1:], len(idx)
                ok = (c >= LEAF) & (m - c >= LEAF) & use[:, None]
                gain = np.where(ok, g ** 2 / np.maximum(c, 1) + (all_g - g) ** 2 / np.maximum(m - c, 1) - all_g ** 2 / m, -1)
                k = int(gain.argmax())
                if gain.flat[k] > 1e-6:
                    best = divmod(k, width)
            if best is None:
                where = np.ones(n, bool)
                for s, above, t in path:
                    where &= (x[:, s] > t) == above
                p = 1 / (1 + np.exp(-margin[idx]))
                step = grad[idx].sum() / max((p * (1 - p)).sum(), 1e-3)
                margin[where] += SHRINK * np.clip(step, -4, 4)
                continue
            s, cell = best
            if cell >= len(edges[s]):
                continue
            t = float(edges[s][cell])
            # codes up to ``cell`` hold the values <= t
            left = x[idx, s] <= t
            stack.append((idx[left], (*path, (s, False, t))))
            stack.append((idx[~left], (*path, (s, True, t))))
    return list(rules)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, s] > t) == above for s, above, t in rule])


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic lasso by accelerated proximal gradient; the last weight is
    the free intercept."""
    n, back = len(y), a.T  # in 32 bits, as the vectors they meet
    f32 = np.float32
    v = np.full(a.shape[1], 1 / np.sqrt(a.shape[1]), f32)
    for _ in range(12):  # largest singular value
        v = back @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(np.linalg.norm(a @ v) ** 2), 1e-9) / 1.1
    w, z, k = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z.astype(f32), -30, 30)))
        g = (back @ (p - y).astype(f32)).astype(np.float64) / n
        new = z - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z = new + (k - 1) / nk * (new - w)
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w, k = new, nk
    return w


class RuleModel:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights):
            m += w * _holds(r, x)
        return 1 / (1 + np.exp(-m))

    def column(self) -> Column:
        """The score as a Spark expression over ``__s0``, ... Rules that begin
        with the same comparisons share them, as they did in their tree.

        It is made of columns and not of SQL text: Spark's parser keeps what it
        learned of each text for the life of the session, tens of MB for a model."""
        root: dict = {}
        for r, w in zip(self.rules, self.weights):
            at = root
            for test in r:
                at = at.setdefault(test, {})
            at["weight"] = at.get("weight", 0.0) + float(w)
        of = [F.col(f"__s{k}") for k in range(len(STATISTICS))]

        def total(at: dict) -> Column:
            """The sum of the weights of the rules that hold, of those that
            begin with the comparisons above ``at``."""
            terms = [F.lit(at["weight"])] if "weight" in at else []
            for s, t in dict.fromkeys((x[0], x[2]) for x in at if x != "weight"):
                yes, no = (total(at[s, above, t]) if (s, above, t) in at else F.lit(0.0) for above in (True, False))
                terms.append(F.when(of[s] > t, yes).otherwise(no))
            while len(terms) > 1:  # a flat tree of sums
                terms = [reduce(Column.__add__, terms[i:i + 2]) for i in range(0, len(terms), 2)]
            return terms[0]

        margin = F.lit(float(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin + total(root) if root else margin)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """The rule model of a sample. Without rows all scores are 1; with one
    class only they are that class's smoothed share."""
    if len(y) == 0:
        return RuleModel([], [], 40.0)
    if y.min() == y.max() or len(y) < 4 * LEAF:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    rules = _trees(x, y, rng)
    bits = np.stack([np.packbits(_holds(r, x)) for r in rules])
    _, keep = np.unique(bits, axis=0, return_index=True)  # of rules that say the same on the sample one
    rules = [rules[k] for k in np.sort(keep)]
    a = np.ones((len(x), len(rules) + 1), np.float32)
    for k, r in enumerate(rules):
        a[:, k] = _holds(r, x)
    test = rng.random(len(y)) < 0.2
    start, best = np.zeros(a.shape[1]), (np.inf, 1e-3)
    for penalty in (3e-2, 1e-2, 4e-3, 2e-3, 1e-3, 5e-4, 2e-4):
        start = _lasso(a[~test], y[~test], penalty, start, 150)
        p = np.clip(1 / (1 + np.exp(-(a[test] @ start.astype(np.float32)))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        best = min(best, (loss, penalty))
    w = _lasso(a, y, best[1], np.zeros(a.shape[1]))
    on = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
    return RuleModel([rules[k] for k in on], [float(w[k]) for k in on], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", folds: int = 4, held_out_fold: int = 2, sample: int = SAMPLE) -> RuleModel:
    """Fits on at most ``sample`` labelled documents outside the held-out fold.

    An id with several labels counts with their mean rounded, ties 0; null ids
    and labels are not learned from. Of rows that repeat an id one is used.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isNotNull())
             .withColumn("f", crc_mod("id", folds)).filter(F.col("f") != held_out_fold)
             .groupBy("id").agg(F.avg("y").alias("y")))
    # one fixed-size row per id, ``sample`` of them: small enough to broadcast
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    some = docs.join(F.broadcast(chosen.select(F.col("id").alias("__id"), "y")), F.col(f"`{id_col}`") == F.col("__id"))
    some = some.select("__id", F.col("y").alias("__y"), F.col(f"`{text_col}`").alias("text"))
    rows = (text_statistics(some, "text", ["__id", "__y"]).groupBy("__id")
            .agg(F.min(F.struct("__y", *[f"__s{k}" for k in range(len(STATISTICS))])).alias("r"))
            .select("__id", "r.*").toArrow())
    rows = rows.sort_by("__id")
    x = np.empty((rows.num_rows, len(STATISTICS)))
    for k in range(len(STATISTICS)):
        x[:, k] = rows.column(k + 2).to_numpy()
    return fit(x, (rows.column(1).to_numpy() > 0.5).astype(np.float64))


def quality_scores(docs: DataFrame, model: RuleModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``score`` (0 to 1)
    and ``predicted`` (1 from 0.7 on).

    A null text is scored as an empty one. Repeated rows score alike; an empty
    table gives an empty result. Kept columns with the name of a new one are
    replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    out = text_statistics(docs, text_col, keep).withColumn("score", model.column())
    return out.select(*[F.col(f"`{c}`") for c in keep], "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
