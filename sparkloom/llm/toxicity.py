"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training texts, without regard
to labels, is the unlabelled set. A linear model over the words and word heads that a
text holds is trained in numpy on the risk
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])
with logistic losses. The class prior is the toxic share of the labelled training rows.
Features are counted over all confirmed positives and all training texts in Spark; only
those chosen reach the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored, texts, trimmed
from .quality import held_out
from .quality import known as labelled

#: Texts that the model is fitted on, at most (those with the smallest hashes).
POSITIVES = 4_000
UNLABELLED = 8_000
#: A feature must be in more positives than its share of all texts lets expect, with this log-likelihood ratio.
EVIDENCE = 3.0
#: Features that a task counts before it passes the counts on.
HELD = 200_000
#: Ids of positives are broadcast up to this many (16 MB), else joined by shuffle.
BROADCAST_IDS = 1_000_000
HEADS = (4, 5, 6)
FEATURES = 20_000
STEPS = 300

_WORD = regex.compile(r"\w+")


def features(text: str) -> set[str]:
    """The lower-case words of a text, and heads of longer words (marked by a trailing star)."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:n] + "*" for w in found if len(w) > 3 for n in HEADS if len(w) >= n}


def fit(names: list[str], positive: list, unlabelled: list, prior: float) -> tuple[float, dict[str, float]]:
    """Bias and weights; texts are given as indices into ``names``. Without positives or names: the prior, and no weights."""
    start = float(np.log(max(prior, 1e-3) / (1 - min(max(prior, 1e-3), 0.999))))
    if not positive or not names:
        return start, {}

    def matrix(rows):
        at = [np.asarray(r, np.int64) for r in rows]
        ptr = np.repeat(np.arange(len(at)), [len(a) for a in at])
        return ptr, (np.concatenate(at) if at else np.zeros(0, np.int64)), len(at)

    p, u = matrix(positive), matrix(unlabelled)
    times = lambda m, w, b: np.bincount(m[0], w[m[1]], minlength=m[2]) + b
    back = lambda m, g: (np.bincount(m[1], g[m[0]], minlength=len(names)), g.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    w = np.zeros(len(names) + 1)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    w[-1] = start
    for step in range(1, STEPS + 1):
        zp, zu = times(p, w[:-1], w[-1]), times(u, w[:-1], w[-1])
        negative = np.logaddexp(0, zu).mean() if len(zu) else 0.0
        part = negative - prior * np.logaddexp(0, zp).mean()
        gp = prior * (sigmoid(zp) - 1) / len(zp)  # of the positives as positives
        gn = -prior * sigmoid(zp) / len(zp)  # of the positives taken off the unlabelled
        gu = sigmoid(zu) / max(len(zu), 1)
        sign = 1.0 if part >= 0 else -1.0  # a negative part is climbed out of
        a, ab = back(p, (gp if part >= 0 else 0 * gp) + sign * gn)
        c, cb = back(u, sign * gu)
        g = np.append(a + c + 1e-4 * w[:-1], ab + cb)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        w = w - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return float(w[-1]), {f: float(w[i]) for i, f in enumerate(names)}


def _counted(rows: DataFrame) -> DataFrame:
    """(f, n): in how many texts of ``rows`` each feature is."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["f", "n"])
            held.clear()
            return out

        for _, batch in by_bytes(batches):
            for t in batch:
                held.update(features(t))
            if len(held) > HELD:
                yield flush()
        yield flush()

    return rows.select("text").mapInArrow(trimmed(run), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """Fits outside the held-out fold, on labels as ``quality.known`` has them.

    The fit takes ``positives`` confirmed texts and ``unlabelled`` others at most, and
    the FEATURES features that tell positives best, by EVIDENCE.
    """
    known = labelled(labels, "toxic").where(~held_out(F.col("doc_id"), 5, 0))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = float(toxic) / n if n else 0.0
    mine = texts(docs).where(~held_out(F.col("doc_id"), 5, 0))
    confirmed = known.where("y = 1").select("doc_id")
    sent = F.broadcast(confirmed) if toxic <= BROADCAST_IDS else confirmed
    mine_toxic = mine.join(sent, "doc_id", "left_semi")
    in_positives = stored(_counted(mine_toxic))
    counts = _counted(mine).withColumnRenamed("n", "u").join(in_positives, "f")
    expected = F.col("u") * (float(mine_toxic.count()) / max(mine.count(), 1))
    ratio = F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
    told = counts.select("f", ratio.alias("ratio"), (F.col("n") > expected).alias("more")).where(F.col("more") & (F.col("ratio") >= EVIDENCE))
    names = [r.f for r in told.orderBy(F.desc("ratio"), "f").limit(FEATURES).select("f").collect()]
    index = {f: i for i, f in enumerate(names)}

    pos = confirmed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    rest = mine.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    chosen = pos.withColumn("y", F.lit(1)).union(rest.withColumn("y", F.lit(0)))

    def indexed(batches):
        for rows, batch in by_bytes(batches):
            found = [sorted(index[f] for f in features(t) if f in index) for t in batch]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "f"])

    sample = mine.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(trimmed(indexed), "doc_id long, y int, f array<int>")
    found = sorted((r.doc_id, r.y, r.f) for r in sample.collect())
    return fit(names, [f for _, y, f in found if y], [f for _, y, f in found if not y], prior)


def scored(docs: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Null and empty texts get the bias's score; equal rows give equal rows; rows without
    doc_id are dropped; without toxic labels every score is the (least) prior; an empty
    table gives an empty one. Language, source, ids and labels are no inputs of a score.
    """
    bias, weights = model or train(docs, labels)
    heads = {f[:-1]: w for f, w in weights.items() if f.endswith("*")}
    whole = {f: w for f, w in weights.items() if not f.endswith("*")}

    def run(batches):
        for rows, batch in by_bytes(batches):
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                found = set(_WORD.findall(t.lower()))
                z = sum(whole[w] for w in found & whole.keys())
                if heads:
                    z += sum(heads[h] for h in {w[:n] for w in found if len(w) > 3 for n in HEADS if len(w) >= n} & heads.keys())
                out[i] = bias + z
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
