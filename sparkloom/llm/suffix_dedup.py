"""Substring dedup by a common-prefix interval tree over enhanced suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is found, in
the same document or another. Suffix arrays are only built where strings can repeat:

1. Each LENGTH-byte window has a minimum among the hashes of its GRAM-byte grams; grams
   that are a minimum somewhere are anchors. Equal windows have equal anchors at equal
   places, so a repeated window has an anchor whose gram repeats. Anchors whose gram
   doesn't repeat go no further: all that hashes decide.
2. Anchors of one gram with equal surroundings (LENGTH - GRAM bytes to the left, LENGTH
   to the right of the start) are a class. A member of each class goes, as a segment of
   text, to a suffix array shared by the segments of many grams, and stands there twice
   if the class has more members, so a group of copies of any size is as cheap as a pair.
3. A scan with a stack over the array's common-prefix lengths gives the interval tree;
   an interval whose occurrences have different left neighbours is a maximal repeat,
   with all its occurrences. What is repeated in a class's segments is so, at the same
   distance from the anchor, around all its members.
   The segments of one gram are cut into lots of LOT classes; windows of lots of the
   same gram are then matched across lots by a 128-bit hash, so that no gram fills one
   task.

Rows of a document are told by a hash of doc_id and text, so rows that share a doc_id
keep their own spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX64, U64, Rolling, binaries, chunks, forget, keyed, mix, settle, stored, trimmed, width

LENGTH = 200
GRAM = 64
LOT = 2048
#: Text of the segments that share a suffix array.
ARRAY_BYTES = 1 << 20


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each w values in a row, by start; len(x) - w + 1 of them."""
    op, fill = (np.minimum, MAX64) if least else (np.maximum, U64(0))
    n = len(x)
    m = -(-n // w) * w
    p = np.full(m, fill, U64)
    p[:n] = x
    p = p.reshape(-1, w)
    head = op.accumulate(p, axis=1).reshape(-1)
    tail = op.accumulate(p[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(b: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Anchors of the documents: position, document, gram hash, hash of the surroundings."""
    w = length - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    if len(b) < length:
        return none
    roll = Rolling(b)
    h = roll.grams(gram)
    least = _sliding(h, w, True)  # by window start
    size = np.diff(off)
    ok = np.zeros(len(b) + 1, np.int32)
    long = size >= length
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - length + 1, -1)
    least[np.cumsum(ok[: len(least)]) == 0] = 0
    # a gram is an anchor if it is the least of one of the windows that hold it
    most = _sliding(np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)]), w, False)
    at = np.flatnonzero((most[: len(h)] == h) & (h > 0))
    doc = np.searchsorted(off, at, "right") - 1
    lo, hi = np.maximum(off[doc], at - (length - gram)), np.minimum(off[doc + 1], at + length)
    around = mix(roll.spans(lo, hi) ^ ((at - lo).astype(U64) << U64(32)) ^ (hi - at).astype(U64))
    return at, doc, h[at], around


def _anchors(length: int, gram: int):
    def run(batches):
        for rows, b, off in chunks(batches):
            at, doc, h, around = anchors(b, off, length, gram)
            if not len(at):
                continue
            # the same surroundings again in the same document are counted here, and go along as a list
            order = np.lexsort((at, around, h, doc))
            at, doc, h, around = at[order], doc[order], h[order], around[order]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (around[1:] != around[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            pos = (at - off[doc]).astype(np.int32)
            rest = pos[~new]
            cut = np.concatenate([[0], np.cumsum(n - 1)])
            ids = rows.column("doc_id").to_numpy()
            for i in range(0, len(first), 50_000):
                f, z = first[i : i + 50_000], min(i + 50_000, len(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[f].view(np.int64)), pa.array(around[f].view(np.int64)), pa.array(ids[doc[f]]), pa.array(pos[f]), pa.array(n[i:z].astype(np.int32)), binaries(rest[cut[i] : cut[z]], cut[i : z + 1] - cut[i])],
                    ["h", "c", "doc_id", "pos", "n", "more"],
                )

    return run


def maximal_repeats(t: np.ndarray, starts: np.ndarray, room: np.ndarray, left: np.ndarray, least: int):
    """Maximal repeats of at least ``least`` bytes among the given suffixes of t.

    ``room``: how far each suffix may go (at least ``least``); ``left``: the byte before
    it, or a number of its own (negative) where it has none. Yields (length, suffix
    indices): all occurrences of a string that can't be extended to the left.

    No interval of a shorter prefix is wanted, so suffixes are dealt into buckets by a
    hash of ``least`` bytes, in any order; a bucket with one left neighbour holds no
    maximal repeat; the others are sorted as text and scanned.
    """
    if len(starts) < 2:
        return
    key = Rolling(t).spans(starts, starts + least)
    order = np.argsort(key)
    key, lf = key[order], left[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    begin = cut[:-1]
    diverse = np.minimum.reduceat(lf, begin) != np.maximum.reduceat(lf, begin)
    raw = t.tobytes()
    place, reach = starts.tolist(), (starts + room).tolist()
    sorted_: list[int] = []
    ends = [0]
    for lo, hi in zip(begin[diverse].tolist(), cut[1:][diverse].tolist()):
        sorted_ += sorted(order[lo:hi].tolist(), key=lambda i: raw[place[i] : reach[i]])
        ends.append(len(sorted_))
    if not sorted_:
        return
    sa = np.array(sorted_)
    common = np.zeros(len(sa) - 1, np.int64)
    for lo in range(0, len(common), 4096):  # common prefixes of neighbours, from the bytes
        x, y = sa[lo : lo + 4096][: len(common) - lo], sa[lo + 1 : lo + 4097]
        most = np.minimum(room[x], room[y])
        step = np.arange(int(most.max()))
        other = t[np.minimum(starts[x][:, None] + step, len(t) - 1)] != t[np.minimum(starts[y][:, None] + step, len(t) - 1)]
        other = np.concatenate([other, np.ones((len(x), 1), bool)], 1)
        common[lo : lo + 4096] = np.minimum(other.argmax(1), most)
    lf = left[sa]
    for lo, hi in zip(ends, ends[1:]):
        # changes[i]: left neighbours up to suffix lo + i that differ from the one before; an interval is diverse if it has any within
        changes = np.concatenate([[0], np.cumsum(lf[lo + 1 : hi] != lf[lo : hi - 1])]).tolist()
        stack: list[tuple[int, int]] = []  # (common prefix, left end)
        for i, v in enumerate([*common[lo : hi - 1].tolist(), 0]):
            at = i
            while stack and stack[-1][0] > v:
                size, at = stack.pop()
                if size >= least and changes[i] != changes[at]:
                    yield size, sa[lo + at : lo + i + 1]
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, at))


def owned(text: np.ndarray, seg: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (in text) of the windows of each segment of which its anchor (at) is the leftmost minimum."""
    h = Rolling(text).grams(gram)
    h = np.concatenate([h, np.full(gram, MAX64)])
    first = np.maximum(seg[:-1], at - (length - gram))
    last = np.minimum(at, seg[1:] - length)
    step = np.arange(1, length - gram + 1)
    for lo in range(0, len(at), 4096):
        a, f, z = at[lo : lo + 4096], first[lo : lo + 4096], seg[1:][lo : lo + 4096]
        x = a[:, None] - step
        less = (h[np.maximum(x, 0)] <= h[a][:, None]) & (x >= f[:, None])
        first[lo : lo + 4096] = np.where(less.any(1), a - less.argmax(1), f)
        x = a[:, None] + step
        less = (h[np.minimum(x, len(h) - 1)] < h[a][:, None]) & (x + gram <= z[:, None])
        last[lo : lo + 4096] = np.where(less.any(1), np.minimum(last[lo : lo + 4096], a + less.argmax(1) - (length - gram)), last[lo : lo + 4096])
    return first, last


def _arrays(length: int):
    def solve(h, c, pos, base, text, seg, lots):
        """Repeats among segments, as places relative to the anchor: (kind, x, y, h, c, start, end); x and y tell windows that other lots may hold."""
        first = seg[:-1]  # all windows of a segment are its anchor's
        n = np.diff(seg) - length + 1
        which = np.repeat(np.arange(len(n)), n)
        before = np.concatenate([[0], np.cumsum(n)])[:-1]
        at = np.arange(len(which)) - before[which] + first[which]
        place = base[which] + at - seg[which] - pos[which]
        left = np.where(at == first[which], -1 - np.arange(len(at)), text[np.maximum(at - 1, 0)].astype(np.int64)) if len(at) else at
        reach = np.zeros(len(at), np.int64)
        for size, found in maximal_repeats(text, at, seg[which + 1] - at, left, length):
            reach[found] = np.maximum(reach[found], size)
        hit = np.flatnonzero(reach)
        z = np.zeros(len(hit), np.int64)
        # both standings of a class say the same, and what lies within the stretch before it says nothing
        key = np.lexsort((-reach[hit], place[hit], c[which[hit]], h[which[hit]]))
        hit = hit[key]
        one, two, s, e = h[which[hit]], c[which[hit]], place[hit], place[hit] + reach[hit]
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            group = np.cumsum(new)
            far = np.maximum.accumulate(e + group * (8 * length)) - group * (8 * length)
            new[1:] |= e[1:] > far[:-1]
            one, two, s, e, z = one[new], two[new], s[new], e[new], z[new]
        out = [(z, z, z, one, two, s, e)]
        w = np.flatnonzero(lots[which])
        if len(w):
            end = len(text)
            x = Rolling(text).spans(at[w], at[w] + length).view(np.int64)
            y = Rolling(text[::-1]).spans(end - at[w] - length, end - at[w]).view(np.int64)
            _, one = np.unique(x, return_index=True)  # what two classes of a lot share is found in the lot
            out.append((np.ones(len(one), np.int64), x[one], y[one], h[which[w[one]]], c[which[w[one]]], place[w[one]], place[w[one]] + length))
        return out

    def run(batches):
        held: list = []
        size = 0

        def flush():
            h, c, pos, base, lots = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 3, 5))
            raw = b"".join(t for x in held for t in x[4])
            seg = np.concatenate([[0], np.cumsum([len(t) for x in held for t in x[4]])]).astype(np.int64)
            out = solve(h, c, pos, base, np.frombuffer(raw, np.uint8), seg, lots)
            cols = [np.concatenate([x[i] for x in out]) for i in range(7)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "x", "y", "h", "c", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            lot = batch.column("lot").to_numpy()
            texts = batch.column("segment").to_pylist()
            c, pos, base = (batch.column(x).to_numpy() for x in ("c", "pos", "base"))
            lots = batch.column("lots").to_numpy() > 1
            times = 1 + batch.column("twice").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t for t, n in zip(texts, times.tolist()) for _ in range(n)]
            h, lot, c, pos, base, lots = (np.repeat(x, times) for x in (h, lot, c, pos, base, lots))
            cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lot[1:] != lot[:-1])])).tolist() + [len(h)]
            for i, (a, z) in enumerate(zip(cut, cut[1:])):
                if size > ARRAY_BYTES and not (i == 0 and held and held[-1][0][-1] == h[a] and held[-1][6] == lot[a]):
                    yield flush()
                    held, size = [], 0
                held.append((h[a:z], c[a:z], pos[a:z], base[a:z], texts[a:z], lots[a:z], lot[a]))
                size += sum(map(len, texts[a:z]))
        if held:
            yield flush()

    return run


def _segments(length: int, gram: int):
    """Of each marked anchor the text of the windows that are its own."""

    def run(batches):
        for batch in batches:
            out: list = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                raw = (text or "").encode()
                for m in marks:
                    lo = max(0, m["pos"] - (length - gram))
                    out.append((m["h"], m["c"], m["lot"], m["lots"], m["twice"], m["pos"], lo, raw[lo : m["pos"] + length]))
            if not out:
                continue
            *cols, base, parts = zip(*out)
            base = np.array(base)
            seg = np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int64)
            first, last = owned(np.frombuffer(b"".join(parts), np.uint8), seg, seg[:-1] + np.array(cols[-1]) - base, length, gram)
            s, e = first - seg[:-1], last - seg[:-1] + length
            keep = pa.array(last >= first)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
            cols = [*cols, base + s, [t[i:j] for t, i, j in zip(parts, s.tolist(), e.tolist())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k).filter(keep) for c, k in zip(cols, kinds)], ["h", "c", "lot", "lots", "twice", "pos", "base", "segment"])

    return run


def _placed(batches):
    """The spans of a class around each place of a member: its first, and those in ``more``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        more = batch.column("more").to_pylist()
        n = np.array([1 + len(m) // 4 for m in more])
        pos = np.concatenate([batch.column("pos").to_numpy().astype(np.int64), np.frombuffer(b"".join(more), np.int32).astype(np.int64)])
        at = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n - 1)])
        start, end = (pos + batch.column(x).to_numpy()[at] for x in ("start", "end"))
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[at]), pa.array(start), pa.array(end)], ["doc_id", "start", "end"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end): byte spans, overlapping, that together cover every ``length``-byte string that also starts elsewhere; doc_id must tell texts apart."""
    n = width(docs.sparkSession)
    found = docs.mapInArrow(_anchors(length, gram), "h long, c long, doc_id long, pos int, n int, more binary")
    # a table of its own, so that the join deals it anew and a hot gram can be split
    grams = stored(found.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h"))
    again = stored(found.join(grams, "h"))
    forget(grams)
    settle(docs.sparkSession)
    kinds = again.groupBy("h", "c").agg(F.sum("n").alias("times"), F.min(F.struct("doc_id", "pos")).alias("one"))
    kinds = stored(kinds)
    lots = stored(kinds.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")).where("lots > 1"))
    marks = kinds.join(lots, "h", "left").withColumn("lots", F.coalesce("lots", F.lit(1))).select("h", "c", F.pmod(F.xxhash64("c"), F.col("lots")).cast("int").alias("lot"), "lots", (F.col("times") > 1).alias("twice"), "one.doc_id", "one.pos")
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "lot", "lots", "twice", "pos")).alias("marks"))
    placed = docs.repartition(n, "doc_id").join(marks, "doc_id").select("text", "marks")
    segments = placed.mapInArrow(trimmed(_segments(length, gram)), "h long, c long, lot int, lots int, twice boolean, pos int, base long, segment binary")
    solved = segments.repartition(n, "h", "lot").sortWithinPartitions("h", "lot").mapInArrow(trimmed(_arrays(length)), "kind long, x long, y long, h long, c long, start long, end long")
    solved = stored(solved)
    forget(kinds, lots)
    settle(docs.sparkSession)
    windows = solved.where("kind = 1")
    shared = windows.groupBy("x", "y").agg(F.min(F.struct("h", "c", "start")).alias("lo"), F.max(F.struct("h", "c", "start")).alias("hi")).where("lo <> hi").select("x", "y")
    across = windows.join(shared, ["x", "y"], "left_semi")
    spans = solved.where("kind = 0").union(across).select("h", "c", "start", "end")
    return again.select("h", "c", "doc_id", "pos", "more").join(spans, ["h", "c"]).mapInArrow(trimmed(_placed), "doc_id long, start long, end long")


def merged_arrays(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) rows of one span or more, touching ones joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], 1)


def merged(spans: list, n: int) -> np.ndarray:
    """The spans as sorted disjoint rows, cut at n."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    a = np.minimum(np.array([(s["start"], s["end"]) for s in spans], np.int64), n)
    return merged_arrays(a[:, 0], a[:, 1])


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, row, text and the spans of each row."""
    plain = keyed(docs)
    spans = repeated_spans(plain.select(F.col("row").alias("doc_id"), "text"), length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return plain.repartition(width(docs.sparkSession), "row").join(spans.withColumnRenamed("doc_id", "row"), "row", "left")


def removal(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (array of start, end) of each document.

    Null texts are empty and lose nothing, as do texts of under ``length`` bytes; equal
    rows count as copies, so that each loses all; rows with one doc_id but other texts
    are documents of their own; rows without doc_id are dropped; an empty table gives an
    empty one; other columns are ignored. Strings in the same document count; matches never cross documents.
    """

    def run(batches):
        for batch in batches:
            out: list = []
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = (text or "").encode()
                gone = merged(spans, len(raw))
                kept, at = hashlib.sha256(), 0
                for s, e in gone.tolist():
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((i, len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest(), [{"start": s, "end": e} for s, e in gone.tolist()]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return _with_spans(docs, length, gram).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (all columns) without the repeated bytes of its texts; n_chars, if there, is counted again.

    Runs shrink to whole characters. A text that loses all stays as an empty one, as a
    null one does. Rows without doc_id go; rows that share a doc_id stay, each with what
    is left of its own text.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode()
                kept, at = [], 0
                for s, e in merged(spans or [], len(raw)).tolist():
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(raw[at:s])
                    at = e
                out.append(b"".join([*kept, raw[at:]]).decode())
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["__row", "__text"])

    cut = _with_spans(docs, length, gram).dropDuplicates(["row"]).select("row", "text", "spans").mapInArrow(trimmed(run), "__row long, __text string")
    # all that goes along is one struct, so that no name of a column clashes with ours
    rest = docs.where("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__rest"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__own"))
    both = rest.join(cut, rest["__own"] == cut["__row"])
    cols = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return both.select(*(cols[c].alias(c) if c in cols else F.col("__rest").getField(c).alias(c) for c in docs.columns))
