"""Quality classifier: a sparse rule ensemble over text statistics.

Trees are grown on a bounded sample of labelled rows; every path from a root is a rule,
a conjunction of thresholds. A lasso logistic regression keeps few rules, which are
compiled to one Spark column expression, so that scoring stays in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Labelled rows that the rules are fitted on, at most (those with the smallest hashes).
SAMPLE = 20_000
TREES = 40
DEPTH = 3
LEAF = 10
PENALTY = 0.002

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SYMBOLS = "#$%&*@^~=+<>{}[]|\\/_"


def _share(text: Column, n: Column, chars: str) -> Column:
    return (n - F.length(F.translate(text, chars, ""))) / n


def _prepared(docs: DataFrame, *keep) -> DataFrame:
    """The columns to keep, and __t (text, nulls as empty), __chars and __w (lower-case words)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, t.alias("__t"), F.length(t).alias("__chars"), F.filter(F.split(F.lower(t), r"[\s]+"), lambda w: w != "").alias("__w"))


def _statistics() -> list[Column]:
    t, chars, w = F.col("__t"), F.col("__chars"), F.col("__w")
    n, words = F.greatest(chars, F.lit(1)), F.greatest(F.size(w), F.lit(1))
    return [
        F.log1p(chars).alias("log_chars"),
        F.log1p(F.size(w)).alias("log_words"),
        (chars / words).alias("word_length"),
        (F.size(F.array_distinct(w)) / words).alias("distinct_words"),
        (F.size(F.array_distinct(F.transform(w, lambda x: F.substring(x, 1, 2)))) / words).alias("distinct_heads"),
        _share(t, n, LETTERS_UPPER).alias("upper"),
        _share(t, n, DIGITS).alias("digits"),
        _share(t, n, SYMBOLS).alias("symbols"),
        _share(t, n, "!?").alias("shouts"),
        _share(t, n, ".,;:").alias("stops"),
        _share(t, n, "\n").alias("lines"),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    return _prepared(docs, "doc_id").select("doc_id", *_statistics())


def accepted(docs: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """The rows of ``docs`` (all columns) with a score of 0.5 or more; rows without doc_id go. Each row is judged by its own text, a null one as an empty one."""
    model = model or train(docs, labels)
    rows = docs.where("doc_id is not null")
    return _prepared(rows, F.struct("*").alias("__row")).select("__row", *_statistics()).where(compiled(model) >= 0.5).select("__row.*")


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> list[tuple[tuple, ...]]:
    """Paths of a gradient tree; each is a tuple of (feature, is_above, threshold). A cut leaves over ``least`` rows on both sides, of four times as many at least."""
    paths = []

    def grow(at, path):
        if path:
            paths.append(path)
        if len(path) == depth or len(at) < 4 * least:
            return
        g, h = grad[at], hess[at]
        base = g.sum() ** 2 / (h.sum() + 1)
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[at, f], kind="stable")
            v = x[at[order], f]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[(v[1:] == v[:-1])] = -1
            gain[:least] = gain[-least:] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, float((v[i] + v[i + 1]) / 2))
        if best[1] is not None:
            above = x[at, best[1]] > best[2]
            grow(at[~above], (*path, (best[1], False, best[2])))
            grow(at[above], (*path, (best[1], True, best[2])))

    grow(np.arange(len(x)), ())
    return paths


def _matches(x: np.ndarray, rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, t in rule:
        ok &= (x[:, f] > t) == above
    return ok


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 9) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept, and weighted rules. Without both labels: the (smoothed) share of label 1 and no rules. A cut leaves over LEAF rows on both sides, or over an eighth of all where there are few."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return start, []
    least = max(1, min(LEAF, len(y) // 8))
    rng = np.random.default_rng(seed)
    score, rules = np.full(len(y), start), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        at = rng.random(len(y)) < 0.5
        for rule in _tree(x[at], (y - p)[at], (p * (1 - p))[at], int(rng.integers(1, DEPTH + 1)), least):
            rules[rule] = True
            hit = _matches(x, rule)
            score[hit] += 0.1 * (y - p)[hit].sum() / ((p * (1 - p))[hit].sum() + 1)
    if not rules:  # statistics that don't vary
        return start, []
    rules = list(rules)
    z = np.stack([_matches(x, r) for r in rules], 1).astype(float)
    _, one = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in one], z[:, one]
    w, b = np.zeros(len(rules)), start
    step = 4 / (1 + np.linalg.norm(z, 2) ** 2 / len(y))
    v, vb, momentum = w.copy(), b, 1.0
    for _ in range(600):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        nb = vb - step * r.mean()
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / m * (new - w), nb + (momentum - 1) / m * (nb - b)
        w, b, momentum = new, nb, m
    return float(b), [(float(w[i]), rules[i]) for i in np.flatnonzero(w)]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def known(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y of the usable labels, one row each: those that are null or neither 0 nor 1 are ignored, and so are documents whose labels clash."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fits on at most ``sample`` labelled rows outside the held-out fold (see ``known`` for those that count)."""
    mine = known(labels, "quality").where(~held_out(F.col("doc_id"), 3, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(texts(docs).join(F.broadcast(mine.select("doc_id")), "doc_id")).join(mine, "doc_id").toPandas()
    names = [c for c in rows.columns if c not in ("doc_id", "y")]
    rows = rows.sort_values(["doc_id", *names])
    bias, rules = fit_rules(rows[names].to_numpy(float), rows["y"].to_numpy(float))
    return bias, [(w, tuple((names[f], above, t) for f, above, t in rule)) for w, rule in rules]


def compiled(model) -> Column:
    """The model's score as a column expression over the statistics."""
    bias, rules = model
    total = F.lit(bias)
    for w, rule in rules:
        cond = None
        for name, above, t in rule:
            c = F.col(name) > F.lit(t)
            c = c if above else ~c
            cond = c if cond is None else cond & c
        total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Null and empty texts get the score of an empty text; equal rows give equal rows;
    rows without doc_id are dropped; without labels all scores are 0.5; an empty table
    gives an empty one. Language, source, ids and labels are no inputs of a score.
    """
    model = model or train(docs, labels)
    out = statistics(texts(docs)).select("doc_id", compiled(model).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
