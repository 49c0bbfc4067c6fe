"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some positions, so that seeds survive substituted tokens: wherever
the substitutions of an overlap lie, one of the masks hits it. Benchmark seeds are
joined with the seeds of all training windows; a Bloom filter of a fixed size, made from
the benchmark, keeps windows without a chance from the join. Only hashes and places go
through it, and hits of one document and item that lie on one diagonal near each other
become one candidate. Around each candidate the two texts are laid side by side: a
stretch of WINDOW tokens (a shorter benchmark text: all of it) with at least SHARE of
them equal is an overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, chunks, keyed, mix, seeds, stored

# The masks, 1 for a token that counts, 0 for one that may differ.
# Together they hit each pattern of SHARE equal in LEAST to WINDOW tokens.
MASKS = ("11111", "110111", "101111", "1101011", "1001111", "1110011", "11100101", "10011011")
#: Texts of fewer tokens overlap with nothing.
LEAST = 8
#: Overlaps are judged on so many tokens, and this share of them must be equal.
WINDOW = 20
SHARE = 0.75
#: Bits of the Bloom filter, whatever the size of the benchmark (4 MB).
BLOOM_BITS = 1 << 25

#: Hits on a diagonal are one candidate within so many tokens.
BLOCK = 16
#: Tokens on each side of a candidate's place; any overlap that holds one of its hits lies within.
REACH = WINDOW + BLOCK
#: Ids of candidate documents are broadcast up to this many (16 MB), else joined by shuffle.
BROADCAST_IDS = 1_000_000

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Beyond ASCII, what is no letter, mark or number separates: quotes, dashes, blanks.
_SIGNS = regex.compile(r"[^\x00-\x7F\p{L}\p{M}\p{N}]+")


def tokens(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters (with their marks) and numbers, and each text's first one."""
    raw = [("" if t is None else t if t.isascii() else _SIGNS.sub(" ", t)).lower().encode() for t in batch]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    if not len(b):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    full = ~_SEPARATOR[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[off] = True
    before, after = np.ones(len(b), bool), np.ones(len(b), bool)
    before[1:], after[:-1] = ~full[:-1], ~full[1:]
    s, e = np.flatnonzero(full & (before | cut[:-1])), np.flatnonzero(full & (after | cut[1:])) + 1
    return Rolling(b).spans(s, e) if len(s) else np.zeros(0, U64), np.searchsorted(s, off)


def spaced(h: np.ndarray, ptr: np.ndarray):
    """(mask number, token position, seed) of all windows inside a text. A text of fewer tokens than a mask spans has none of it."""
    doc_end = np.repeat(ptr[1:], np.diff(ptr))
    for m, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        mult = seeds(len(mask), 400 + m)
        x = np.zeros(n, U64)
        for j, bit in enumerate(mask):
            if bit == "1":
                x += h[j : j + n] * mult[j]
        at = np.flatnonzero(np.arange(n) + len(mask) <= doc_end[:n])
        yield m, at, mix(x[at])


def _bits(seed: np.ndarray) -> np.ndarray:
    return (seed & U64(BLOOM_BITS - 1)).astype(np.int64)


def _more_bits(seed: np.ndarray) -> np.ndarray:
    return ((seed >> U64(30)) & U64(BLOOM_BITS - 1)).astype(np.int64)


def _seed_rows(ids, h, ptr, bloom=None):
    """Columns key, id and at (place of the seed), a batch a mask."""
    n = np.repeat(np.diff(ptr), np.diff(ptr))
    which = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    for _, at, seed in spaced(h, ptr):
        long = n[at] >= LEAST
        at, seed = at[long], seed[long]
        if bloom is not None and len(at):
            ok = (bloom[_bits(seed) >> 3] >> (_bits(seed) & 7) & 1).astype(bool)
            ok[ok] = (bloom[_more_bits(seed[ok]) >> 3] >> (_more_bits(seed[ok]) & 7) & 1).astype(bool)
            at, seed = at[ok], seed[ok]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids[which[at]]), pa.array((at - ptr[which[at]]).astype(np.int32))], ["key", "id", "at"])


_SEEDS = "key long, id long, at int"


def _around(batches):
    """The tokens around the given places of each text: rows of id, at, first (place of the first token that is there), tokens, n (of the text)."""
    for rows, _, _ in chunks(batches):
        h, ptr = tokens(rows.column("text").to_pylist())
        small = h.astype(np.uint32)
        ids, places = rows.column("id").to_pylist(), rows.column("places").to_pylist()
        out: list = []
        for d, (i, own) in enumerate(zip(ids, places)):
            for at in own:
                lo, hi = max(ptr[d], ptr[d] + at - REACH), min(ptr[d + 1], ptr[d] + at + REACH + max(map(len, MASKS)))
                out.append((i, at, int(lo - ptr[d]), small[lo:hi].tobytes(), int(ptr[d + 1] - ptr[d])))
        for k in range(0, len(out), 5_000):
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 5_000]), kinds)], ["id", "at", "first", "tokens", "n"])


def _read(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``_around`` for (id, at) of ``places``; rows have id and text, and equal ids equal texts."""
    listed = stored(places.distinct().groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("places")))
    few = listed.count() <= BROADCAST_IDS
    wanted = rows.join(F.broadcast(listed.select("id")) if few else listed.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return wanted.join(listed, "id").select("id", "text", "places").mapInArrow(_around, "id long, at int, first int, tokens binary, n long")


def overlapping(x: np.ndarray, i: int, y: np.ndarray, j: int, n: int) -> bool:
    """Whether x and y, with x[i] beside y[j], have a stretch of min(WINDOW, n) tokens with SHARE of them equal."""
    lo, hi = min(i, j), min(len(x) - i, len(y) - j)
    same = np.concatenate([[0], np.cumsum(x[i - lo : i + hi] == y[j - lo : j + hi])])
    w = min(WINDOW, n)
    return len(same) > w and bool((same[w:] - same[:-w]).max() >= np.ceil(SHARE * w))


def _checked(batches):
    for batch in batches:
        n = batch.num_rows
        keep = np.zeros(n, bool)
        cols = [batch.column(c).to_pylist() for c in ("tokens", "at", "first", "b_tokens", "b_at", "b_first", "b_n")]
        for r, (x, i, s, y, j, t, m) in enumerate(zip(*cols)):
            keep[r] = overlapping(np.frombuffer(x, np.uint32), i - s, np.frombuffer(y, np.uint32), j - t, m)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("b_id").filter(keep)], ["row", "item_id"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, item_id: each row of ``docs`` (by the hash that ``keyed`` gives) and the benchmark items of which it holds an overlap, once.

    Null, empty and short texts (under LEAST tokens) overlap with nothing; repeated rows
    change nothing; rows that share a doc_id are judged by their own texts, benchmark
    rows that share an item_id count as texts of that item; rows without an id are
    dropped; an empty table on either side gives an empty one; other columns,
    alike-named ones too, are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").withColumn("id", F.xxhash64("item_id", "text"))

    def bench(batches):
        for rows, _, _ in chunks(batches):
            h, ptr = tokens(rows.column("text").to_pylist())
            yield from _seed_rows(rows.column("id").to_numpy(), h, ptr)

    seeds_ = stored(items.select("id", "text").mapInArrow(bench, _SEEDS).distinct())

    def filled(batches):
        bloom = np.zeros(BLOOM_BITS >> 3, np.uint8)
        for batch in batches:
            key = batch.column("key").to_numpy().view(U64)
            for bit in (_bits(key), _more_bits(key)):
                np.bitwise_or.at(bloom, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.tobytes()])], ["bloom"])

    bloom = np.zeros(BLOOM_BITS >> 3, np.uint8)
    for row in seeds_.select("key").coalesce(8).mapInArrow(filled, "bloom binary").toLocalIterator():
        bloom |= np.frombuffer(row.bloom, np.uint8)
    sent = spark.sparkContext.broadcast(bloom)
    plain = keyed(docs).select(F.col("row").alias("id"), "text")

    def train(batches):
        held = sent.value
        for rows, _, _ in chunks(batches):
            h, ptr = tokens(rows.column("text").to_pylist())
            yield from _seed_rows(rows.column("id").to_numpy(), h, ptr, held)

    hits = plain.mapInArrow(train, _SEEDS)
    other = seeds_.select("key", F.col("id").alias("b_id"), F.col("at").alias("b_at"))
    joined = hits.join(other, "key")
    # hits of a document and item on one diagonal, near each other, are one candidate
    near = joined.groupBy("id", "b_id", (F.col("at") - F.col("b_at")).alias("diagonal"), F.floor(F.col("at") / BLOCK).alias("block")).agg(F.min("at").alias("at"))
    near = stored(near.select("id", "at", "b_id", (F.col("at") - F.col("diagonal")).alias("b_at")))
    here = _read(plain, near.select("id", "at")).drop("n")
    there = _read(items.select("id", "text"), near.select(F.col("b_id").alias("id"), F.col("b_at").alias("at")))
    there = there.select(*(F.col(c).alias(f"b_{c}") for c in there.columns))
    found = near.join(here, ["id", "at"]).join(there, ["b_id", "b_at"]).mapInArrow(_checked, "row long, item_id long")
    names = items.select("item_id", F.col("id").alias("b_id")).distinct()
    return found.withColumnRenamed("item_id", "b_id").join(names, "b_id").select("row", "item_id").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, all their columns kept; rows without doc_id go. Repeated rows stay or go together."""
    bad = stored(contamination(docs, benchmark).select(F.col("row").alias("__row")).distinct())
    known = docs.where("doc_id is not null")
    return known.join(bad, F.xxhash64(known["doc_id"].cast("long"), known["text"]) == bad["__row"], "left_anti")


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, and item_ids (sorted) for every row of ``docs`` with a doc_id."""
    found = contamination(docs, benchmark).groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    out = keyed(docs).select("doc_id", "row").join(found, "row", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))
