"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles. Documents with equal sets collapse
into one class before anything is joined. Each class is posted under its coordinate
values; a pair at or above the similarity almost surely agrees in MATCHES of
COORDINATES, so it must meet in one of the first COORDINATES - MATCHES + 1 coordinates
(prefix), and only those are posted. In a posting list, collisions are counted between
a leader and the members left; members that pass leave the list (skip), so a list of n
near copies gives n pairs, not n * n. Pairs are confirmed on full sets. A second pass
compares members of different components with central leaders, and a third, by an exact
prefix filter on the shingles that components share, finds what is left among those that
agree in MATCHES coordinates, so that no link is lost to a leader that failed. A pair at
the similarity is missed if it agrees in fewer (about 1e-5 of pairs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binaries, chunks, keyed, mix, seeds, shingles, stored, trimmed, width, word_hashes
from .components import components

COORDINATES = 32
#: P(Binomial(32, 0.75) < 13) is about 1e-5.
MATCHES = 13
PREFIX = COORDINATES - MATCHES + 1
#: Ids of candidate documents are broadcast up to this many (16 MB), else joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Posting lists beyond this are dealt anew inside their task.
LONG = 256
#: Stretch of a list that is searched at once for unsettled members.
EARLY = 8192
#: Pairs that a task holds before it passes them on.
PAIRS = 100_000


def _sets(b, off, k):
    """Each document's sorted distinct shingle hashes."""
    h, ptr = shingles(*word_hashes(b, off), k)
    out = []
    for i in range(len(ptr) - 1):
        x = np.sort(h[ptr[i] : ptr[i + 1]])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def _signatures(k: int):
    mult = seeds(COORDINATES, 8)

    def run(batches):
        for rows, b, off in chunks(batches):
            sets = _sets(b, off, k)
            n = np.array([len(x) for x in sets], np.int64)
            ptr = np.concatenate([[0], np.cumsum(n)])
            h = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), COORDINATES), U64)
            s1, s2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(full):
                at = ptr[full]
                for j in range(COORDINATES):
                    sig[full, j] = np.minimum.reduceat(h * mult[j], at)
                s1[full] = np.add.reduceat(h, at)
                s2[full] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("row"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), binaries(sig.reshape(-1), np.arange(len(n) + 1) * COORDINATES)],
                ["doc_id", "row", "n_shingles", "s1", "s2", "sig"],
            )

    return run


def _postings(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), U64).reshape(-1, COORDINATES)
        n = len(sig)
        key = mix(sig[:, :PREFIX] + np.arange(PREFIX, dtype=U64) * U64(0xA0761D6478BD642F)).view(np.int64)
        small = (mix(sig) >> U64(56)).astype(np.uint8)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        comp = batch.column("component").to_numpy(zero_copy_only=False)
        for j in range(PREFIX):
            yield pa.RecordBatch.from_arrays([pa.array(key[:, j]), pa.array(ids), pa.array(comp), binaries(small.reshape(-1), np.arange(n + 1) * COORDINATES)], ["key", "doc_id", "component", "bytes"])


def _runs(batches, first: bool, final: bool = True):
    """Candidate pairs of each posting list; rows come sorted by key.

    Not ``final`` is the combiner that runs before the shuffle: it gives the pairs of a
    list's local members as rows without bytes, and passes on the members left.
    """
    key, ids, comp, sig = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, COORDINATES), np.uint8)]
    seen: set[tuple[int, int]] = set()
    found: list[tuple[int, int]] = []

    def note(i, hits):
        for j in hits.tolist():
            p = (int(ids[i]), int(ids[j]))
            if p not in seen:
                if len(seen) > PAIRS:
                    seen.clear()
                seen.add(p)
                found.append(p)

    def alike(i, rest):
        return rest[(sig[rest] == sig[i]).sum(1, dtype=np.int64) >= MATCHES]

    def leaders(at, stay):
        """Members that pass against a leader leave the list; the most central lead first."""
        best = np.zeros(len(at), np.int64)
        for j in range(COORDINATES):
            c = sig[at, j]
            best += c == np.bincount(c, minlength=256).argmax()
        left = at[np.argsort(-best, kind="stable")]
        while len(left) > 1:
            i, left = left[0], left[1:]
            hits = alike(i, left)
            if len(hits):
                if not first:
                    other = hits[comp[hits] != comp[i]]
                    note(i, other)
                else:
                    note(i, hits)
                stay[hits] = False
                left = left[stay[left]]

    def pairs(lo, hi, stay):
        """A long list is dealt anew by two more coordinates at a time, of which a similar pair shares one pair almost surely."""
        if hi - lo <= LONG:
            leaders(np.arange(lo, hi), stay)
            return
        for j in range(0, COORDINATES, 2):
            at = np.arange(lo, hi)[stay[lo:hi]]
            two = sig[at, j].astype(np.int64) << 8 | sig[at, j + 1]
            order = np.argsort(two, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], two[order][1:] != two[order][:-1], [True]]))
            for x, y in zip(cut[:-1][np.diff(cut) > 1].tolist(), cut[1:][np.diff(cut) > 1].tolist()):
                leaders(at[order[x:y]], stay)

    def flush(end):
        stay = np.ones(end, bool)
        if end:
            starts = np.flatnonzero(np.concatenate([[True], key[1:end] != key[: end - 1]]))
            ends = np.concatenate([starts[1:], [end]])
            many = ends - starts > 1
            for lo, hi in zip(starts[many].tolist(), ends[many].tolist()):
                if first or (comp[lo:hi] != comp[lo]).any():
                    pairs(lo, hi, stay)
        a = np.array(found, np.int64).reshape(-1, 2)
        found.clear()
        if final:
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])
        n = int(stay.sum())
        off = np.concatenate([np.arange(n + 1) * COORDINATES, np.full(len(a), n * COORDINATES)])
        spread = mix(mix(a[:, 0].view(U64)) + a[:, 1].view(U64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[:end][stay], spread])), pa.array(np.concatenate([ids[:end][stay], a[:, 0]])), pa.array(np.concatenate([comp[:end][stay], a[:, 1]])), binaries(sig[:end][stay].reshape(-1), off)],
            ["key", "doc_id", "component", "bytes"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column("bytes")).to_numpy() if final else None
        if final and not size.all():
            linked = batch.filter(pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([linked.column("doc_id"), linked.column("component")], ["a", "b"])
            batch = batch.filter(pa.array(size > 0))
            if not batch.num_rows:
                continue
        key = np.concatenate([key, batch.column("key").to_numpy()])
        ids = np.concatenate([ids, batch.column("doc_id").to_numpy()])
        comp = np.concatenate([comp, batch.column("component").to_numpy()])
        sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, COORDINATES)])
        end = int(np.searchsorted(key, key[-1]))  # the last list may go on
        yield flush(end)
        key, ids, comp, sig = key[end:], ids[end:], comp[end:], sig[end:]
    yield flush(len(key))


_POSTING = "key long, doc_id long, component long, bytes binary"


def _unsettled(batches):
    """Members of posting lists (sorted by key) that may be similar to a member of another component."""
    rows: list = []

    def mark(ids, comp, sig):
        hit = np.zeros(len(ids), bool)
        _, which, n = np.unique(comp, return_inverse=True, return_counts=True)
        if len(n) < 2:
            return hit
        most = n.argmax()
        for x in np.flatnonzero(which != most).tolist():
            for lo in range(0, len(ids), EARLY):  # a very long list stops at the first stretch with a hit, and takes part as a whole
                y = lo + np.flatnonzero((which[lo : lo + EARLY] != which[x]) & ((sig[lo : lo + EARLY] == sig[x]).sum(1, dtype=np.int64) >= MATCHES))
                if len(y):
                    hit[x] = True
                    hit[y] = True
                    if len(ids) > EARLY:
                        hit[which == most] = True
                        break
        return hit

    def flush(end):
        key, ids, comp, sig = (x[:end] for x in rows)
        hit = np.zeros(end, bool)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if end else np.zeros(0, np.int64)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if hi - lo < 2:
                continue
            if hi - lo <= LONG:
                hit[lo:hi] |= mark(ids[lo:hi], comp[lo:hi], sig[lo:hi])
                continue
            for j in range(0, COORDINATES, 2):
                two = sig[lo:hi, j].astype(np.int64) << 8 | sig[lo:hi, j + 1]
                order = lo + np.argsort(two, kind="stable")
                sub = np.flatnonzero(np.concatenate([[True], np.diff(two[order - lo]) != 0, [True]]))
                for x, y in zip(sub[:-1][np.diff(sub) > 1].tolist(), sub[1:][np.diff(sub) > 1].tolist()):
                    at = order[x:y]
                    hit[at] |= mark(ids[at], comp[at], sig[at])
        a = np.unique(np.stack([ids[hit], comp[hit]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["doc_id", "component"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy() for c in ("key", "doc_id", "component")]
        new.append(np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, COORDINATES))
        rows = [np.concatenate(x) for x in zip(rows, new)] if rows else new
        end = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on
        yield flush(end)
        rows = [x[end:] for x in rows]
    if rows:
        yield flush(len(rows[0]))


def _mixed(posted: DataFrame) -> DataFrame:
    """Keys that hold more than one component."""
    return posted.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")


def _candidates(classes: DataFrame, first: bool) -> DataFrame:
    n = width(classes.sparkSession)
    posted = classes.mapInArrow(_postings, _POSTING)
    if first:
        posted = posted.sortWithinPartitions("key", "doc_id").mapInArrow(lambda it: _runs(it, True, False), _POSTING)
    else:
        posted = posted.join(_mixed(posted), "key")
    lists = posted.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    return stored(lists.mapInArrow(trimmed(lambda it: _runs(it, first)), "a long, b long").distinct())


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    few = ids.count() <= BROADCAST_IDS

    def full(batches):
        for rows, b, off in chunks(batches):
            sets = _sets(b, off, k)
            ptr = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), binaries(np.concatenate(sets), ptr)], ["doc_id", "items"])

    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = wanted.mapInArrow(full, "doc_id long, items binary")

    def check(batches):
        for batch in batches:
            a, b = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    x = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(trimmed(check), "a long, b long")


def _rest(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs of different components that may still be similar, by an exact prefix filter.

    Only documents that agree with another component's in MATCHES coordinates take part. Of a
    document's shingles, only those that another component holds too can count, so it
    needs percent of its size among them, and any partner meets it in one of the rarest
    (shared - needed + 1). Where a pair meets first, both must still hold the overlap that
    their sizes need (``most`` bounds the other's size).
    """
    posted = classes.mapInArrow(_postings, _POSTING)
    lists = posted.join(_mixed(posted), "key").repartition(width(docs.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    ids = stored(lists.mapInArrow(trimmed(_unsettled), "doc_id long, component long").distinct())
    few = ids.count() <= BROADCAST_IDS

    def items(batches):
        for rows, b, off in chunks(batches):
            sets = _sets(b, off, k)
            n = np.array([len(x) for x in sets], np.int64)
            h = np.concatenate(sets).view(np.int64)
            cols = [rows.column("doc_id").to_numpy(), rows.column("component").to_numpy(), n]
            yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.repeat(c, n)) for c in cols)], ["item", "doc_id", "component", "size"])

    sets = docs.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text", "component").mapInArrow(items, "item long, doc_id long, component long, size long")
    sets = stored(sets)
    shared = sets.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("item", "df")
    needed = F.ceil(F.col("size") * percent / 100)
    own = sets.join(shared, "item").groupBy("doc_id", "component", "size").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    kept = own.where(F.col("n") >= needed).withColumn("items", F.expr("slice(items, 1, cast(n as int) - cast(ceil(size * %d / 100) as int) + 1)" % percent))
    lists = kept.select(F.posexplode("items").alias("at", "i"), "doc_id", "component", "size", "n").select(F.col("i.item").alias("key"), "doc_id", "component", "size", F.expr(f"floor((n - at) * {100 + percent} / {percent}) - size").alias("most"))

    def meet(batches):
        held = None
        names = ("key", "doc_id", "component", "size", "most")

        def lists_of(rows, end):
            key = rows[0]
            found: set = set()
            cut = np.flatnonzero(np.concatenate([[True], key[1:end] != key[: end - 1], [True]])) if end else []
            for lo, hi in zip(cut[:-1], cut[1:]):
                _, ids, comp, size, most = (x[lo:hi] for x in rows)
                if hi - lo < 2 or (comp == comp[0]).all():
                    continue
                _, which, n = np.unique(comp, return_inverse=True, return_counts=True)
                for x in np.flatnonzero((which != n.argmax()) & (most >= size.min())).tolist():
                    y = np.flatnonzero((comp != comp[x]) & (size <= most[x]) & (most >= size[x]))
                    for j in ids[y].tolist():
                        found.add((min(j, int(ids[x])), max(j, int(ids[x]))))
                    if len(found) > PAIRS:
                        yield pairs_of(found)
                        found.clear()
            yield pairs_of(found)

        def pairs_of(found):
            a = np.array(sorted(found), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                rows = [batch.column(c).to_numpy() for c in names]
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
                end = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
                yield from lists_of(held, end)
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield from lists_of(held, len(held[0]))

    n = width(docs.sparkSession)
    return stored(lists.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(trimmed(meet), "a long, b long").distinct())


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates' columns, with the row (the hash of ``keyed``) that stands for each doc_id."""
    docs = keyed(docs)
    every = stored(docs.mapInArrow(_signatures(k), "doc_id long, row long, n_shingles long, s1 long, s2 long, sig binary").dropDuplicates(["doc_id", "row"]))
    # of rows that share a doc_id the one with the least hash counts
    signed = stored(every.groupBy("doc_id").agg(F.min("row").alias("row"))).join(every, ["doc_id", "row"])
    chosen = signed.select("doc_id", "row")
    if every.count() > chosen.count():
        docs = docs.join(chosen, ["doc_id", "row"], "left_semi")
    of = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    of = stored(of)
    classes = signed.join(of.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sig", F.col("doc_id").alias("component"))
    comp = stored(components(stored(_confirmed(docs, _candidates(classes, True), k, percent))))

    def labelled():
        return classes.drop("component").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "sig", F.coalesce("component", "doc_id").alias("component"))

    for more in (lambda: _candidates(labelled(), False), lambda: _rest(docs, labelled(), k, percent)):
        pairs = more()
        if not pairs.isEmpty():
            new = stored(_confirmed(docs, pairs, k, percent))
            if not new.isEmpty():
                known = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                comp = stored(components(known.union(new)))
    rep = signed.select("doc_id", "row", "n_shingles", "s1", "s2").join(of, ["s1", "s2", "n_shingles"], "left").select("doc_id", "row", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = rep.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "row", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document of ``docs`` (doc_id, text).

    Null and blank texts have no shingles and link with nothing; texts of under k words
    have one; rows that repeat a doc_id count once (of different texts, that with the
    least hash); rows without doc_id are dropped; an empty table gives an empty one.
    Other columns are ignored.
    """
    return _labelled(docs, k, percent).drop("row")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of ``docs`` (all columns) for each group, that with the smallest doc_id; rows without doc_id go.

    Documents with null or blank texts are groups of their own, and stay; of rows that
    share a doc_id one stays, as near_duplicates has it.
    """
    kept = stored(_labelled(docs, k, percent).where("kept").select(F.col("row").alias("__kept")))
    return docs.join(kept, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == kept["__kept"], "left_semi").dropDuplicates(["doc_id"])
