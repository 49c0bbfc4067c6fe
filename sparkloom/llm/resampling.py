"""Importance resampling towards a target distribution, with hashed n-gram features.

Two Arrow passes. The first gives one vector of bucket counts for each partition
(``np.bincount``), and ``treeReduce`` adds them up, so the driver gets a few vectors of a
fixed length. From them come the gains of the buckets, a broadcast of a fixed size; the
second pass sums the gains of each document's features, by ``bincount`` with weights.
The draw orders the documents by range partitions: a row's rank is its place in its
partition and the sizes of those before, so no task sees all of them.

Words are runs of ASCII letters and digits and of all other letters beyond ASCII; A to Z
are lowered. A feature's CRC is carried on from that of its first words, a byte of all
words at a time.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_SETTING, LOWER, chunks, stored, trimmed, width

BUCKETS = 10_000
#: Words in a feature at most.
GRAMS = 3
CHUNK_BYTES = 1 << 18
#: Letters of a word that are hashed side by side with those of others; the rest of a longer one follows alone.
SIDE_BY_SIDE = 64
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_rest = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _rest = np.where(_rest & 1, (_rest >> np.uint32(1)) ^ np.uint32(0xEDB88320), _rest >> np.uint32(1))
CRC_STEP = _rest.astype(np.uint32)
EIGHT = np.uint32(8)


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word of lowered bytes, and each document's first word."""
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = IN_WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends - starts, np.searchsorted(starts, off)


class _Words:
    """The words of some documents, longest first, so that the k-th letters of those that have one are a prefix."""

    def __init__(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.b = b
        self.by = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[self.by], sizes[self.by]
        most = min(SIDE_BY_SIDE, int(self.sizes[0])) if len(sizes) else 0
        self.having = [int(np.searchsorted(-self.sizes, -k, "left")) for k in range(most)]

    def after(self, crc: np.ndarray, blank: bool) -> np.ndarray:
        """CRC-32 of what crc stands for, a blank if wanted, and the word."""
        state = ~crc[self.by]
        if blank:
            state = CRC_STEP[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> EIGHT)
        for k, n in enumerate(self.having):
            x = state[:n]
            state[:n] = CRC_STEP[(x ^ self.b[self.starts[:n] + k]) & np.uint32(255)] ^ (x >> EIGHT)
        state = ~state
        for i in range(int(np.searchsorted(-self.sizes, -SIDE_BY_SIDE, "left"))):
            rest = self.b[self.starts[i] + SIDE_BY_SIDE : self.starts[i] + self.sizes[i]]
            state[i] = zlib.crc32(rest.tobytes(), int(state[i]))
        out = np.empty_like(state)
        out[self.by] = state
        return out


def features(b: np.ndarray, off: np.ndarray):
    """Number of words of each document, and for each length of feature: the documents and buckets of all of them."""
    b = LOWER[b]
    starts, sizes, first = words(b, off)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(len(starts)) - first[:-1][doc]
    them = _Words(b, starts, sizes)
    crc = np.zeros(len(starts), np.uint32)
    found = []
    for k in range(GRAMS):
        if k:
            crc = np.concatenate([crc[:1], crc[:-1]])
        crc = them.after(crc, k > 0)
        whole = at >= k
        found.append((doc[whole], (crc[whole] % np.uint32(BUCKETS)).astype(np.int64)))
    return n_words, found


def _held(df: DataFrame) -> DataFrame:
    if not df.sparkSession.conf.get(BATCH_SETTING, None):
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def bucket_counts(texts: DataFrame, column: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, b, off in chunks(batches, CHUNK_BYTES, column):
            for _, bucket in features(b, off)[1]:
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = _held(texts).select(column).mapInArrow(trimmed(count), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions() + 1, 64)))
    return vectors.union(none).treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket adds to a document's weight: thousandths of the log ratio of its smoothed shares, rounded down."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each text."""
    spread = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        for rows, b, off in chunks(batches, CHUNK_BYTES):
            n_words, found = features(b, off)
            n = np.zeros(len(n_words), np.int64)
            weight = np.zeros(len(n_words))
            for doc, bucket in found:
                n += np.bincount(doc, minlength=len(n))
                weight += np.bincount(doc, spread.value[bucket].astype(float), len(n))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    held = _held(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return held.mapInArrow(trimmed(weigh), "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document of ``docs``; the rank says which ``percent`` of those with ``min_words`` words are drawn, null the rest.

    A score is the weight and Gumbel noise from a hash of seed and doc_id, so the highest
    scores are a draw without replacement by weight. Ties go to the smaller doc_id; rows
    that share doc_id and score are drawn in no order of their own. Null and empty texts
    have no features and a weight of 0; rows without doc_id count nowhere; equal rows
    count each; a target without features gives gains from the smoothing alone; an empty
    table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighed(docs, gain).select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")))
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    # Eligible ones first; the row number parts equal rows, of which a task could get too many else.
    order = [F.col("n_words") < min_words, F.desc("score"), F.col("doc_id"), F.col("row")]
    dealt = scored.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    placed = stored(dealt.drop("row").select("*", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    before, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect()):  # one for each partition
        rows.append((p, before))
        before += n
    starts = spark.createDataFrame(rows, "p long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("p", part).join(F.broadcast(starts), "p", "left")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
