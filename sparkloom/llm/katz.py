"""Katz backoff scoring of whole texts with trigrams.

Tokens are the A-Z-lowered words and one end per text. Training counts are discounted
by Good-Turing (counts up to CUT), and what is left goes
to the lower order with weights that normalise exactly; below the unigrams, the mass left
goes to one class of unknown words.

N-grams are dealt into shards by the word before the last one: a shard has all bigrams
and trigrams in which that word comes next to last, so both orders of a token are at
one place. A map task sends each shard one packed message per block of texts, so neither
counts nor scores pass through single rows. Two tables are stored in
buckets by shard, so neither is shuffled when it is read:

* ``counted``: the n-gram counts. As a history each word is counted in its own shard,
  which makes the unigram counts.
* ``weighted``: the same with the backoff weights, and the unigram counts of all words
  that may follow, asked of the shards that own them.

A text's tokens then go to the shards of their histories, in ROUNDS of texts; each is looked up from the
trigram down, and scores come back as sums per text and shard. The number of shards
follows the bytes of text, so a shard's size doesn't.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bucketed, chunks, forget, mix, packed, settle, stored, texts, trim, trimmed, unpacked, width, word_hashes

FOLDS, FOLD = 7, 2
#: Counts above this are not discounted.
CUT = 5
#: A block ends at about so many tokens, or this many texts.
BLOCK_TOKENS, BLOCK_TEXTS = 1_500_000, 30_000
#: Text for each shard: larger ones repeat fewer words in messages and tables, smaller ones take less memory.
SHARD_BYTES = 10 << 20
#: Trigrams whose weights are worked out at a time.
SLICE = 1_000_000
#: Texts are scored in so many rounds, by a hash of doc_id: the messages of one are there at a time.
ROUNDS = 4
#: Stand for the start of a text (a history only) and its end (a word only).
START, END = U64(0x5354415254), U64(0x454E44)


def is_held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == FOLD


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h ^ U64(0xABCDEF)) % U64(shards)).astype(np.int64)


def _indices(x: np.ndarray, n: int) -> bytes:
    return packed(x.astype(np.uint16 if n < 65536 else np.uint32))


def _unindexed(raw: bytes, n: int) -> np.ndarray:
    return unpacked(raw, np.uint16 if n < 65536 else np.uint32).astype(np.int64)


def _blocks(batches):
    """Blocks of texts: ids, and by token the history word, the one before it, the word, and the text's number."""
    held: list = []
    tokens = texts_ = 0

    def block():
        ids = np.concatenate([x[0] for x in held])
        cols: list = [[], [], [], []]
        base = 0
        for own, wh, ptr in held:
            n = np.diff(ptr)
            which = np.repeat(np.arange(len(n)), n + 1)
            spot = np.arange(len(wh)) + np.repeat(np.arange(len(n)), n)
            h, u, w = (np.full(len(which), x, U64) for x in (START, START, END))
            w[spot] = wh
            h[spot + 1] = wh
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else spot
            u[1:] = h[:-1]
            u[first] = START
            for c, x in zip(cols, (h, u, w, which + base)):
                c.append(x)
            base += len(n)
        return ids, *map(np.concatenate, cols)

    for rows, b, off in chunks(batches):
        wh, ptr = word_hashes(b, off)
        ids = rows.column("doc_id").to_numpy()
        for i in range(0, len(ids), BLOCK_TEXTS):
            j = min(i + BLOCK_TEXTS, len(ids))
            if held and (texts_ + j - i > BLOCK_TEXTS or tokens > BLOCK_TOKENS):
                yield block()
                held, tokens, texts_ = [], 0, 0
            held.append((ids[i:j], wh[ptr[i] : ptr[j]], ptr[i : j + 1] - ptr[i]))
            tokens += int(ptr[j] - ptr[i])
            texts_ += j - i
    if held:
        yield block()


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


#: kind 0: n-grams and their counts; 1: tokens to score; 2: words to ask for; 3: the ids of a block.
_MESSAGE = "shard int, kind int, block long, heads binary, runs binary, names binary, before binary, word binary, rest binary"


def _messages(shards: int, score: bool, order: int):
    """To count: the training texts' n-grams, and of the others the words that follow. To score: each token with its text."""

    def run(batches):
        number = 0
        for ids, h, u, w, text in _blocks(batches):
            block = (TaskContext.get().partitionId() << 20) + number
            number += 1
            shard = _shard(h, shards)
            if order < 3:
                u = np.full(len(u), START, U64)
            train = ~np.array([is_held(i) for i in ids.tolist()], bool)[text]
            rows = [(block % shards, 3, block, None, None, None, None, None, ids.tobytes())] if score else []
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            for s in range(shards):
                at = by[cut[s] : cut[s + 1]]
                if not score:
                    asked = np.unique(w[at[~train[at]]])
                    if len(asked):
                        rows.append((s, 2, block, None, None, packed(asked, True), None, None, None))
                    at = at[train[at]]
                if not len(at):
                    continue
                heads, hi = np.unique(h[at], return_inverse=True)
                names, both = np.unique(np.concatenate([u[at], w[at]]), return_inverse=True)
                ui, wi = both[: len(at)], both[len(at) :]
                if score:
                    order_ = np.argsort(hi, kind="stable")
                    hi, ui, wi, rest = hi[order_], ui[order_], wi[order_], packed(text[at][order_].astype(np.uint16))
                else:
                    key, times = np.unique((hi * len(names) + ui) * len(names) + wi, return_counts=True)
                    hi, ui, wi, rest = key // len(names) ** 2, key // len(names) % len(names), key % len(names), packed(times.astype(np.uint32))
                runs = packed(np.bincount(hi, minlength=len(heads)).astype(np.uint32))
                rows.append((s, 0 if not score else 1, block, packed(heads, True), runs, packed(names, True), _indices(ui, len(names)), _indices(wi, len(names)), rest))
            yield _batch(rows, _MESSAGE)

    return run


def _lean(f):
    """f for a grouped table, giving free memory back before and after."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        out = f(key, rows)
        trim()
        return out

    return run


def _lean_pair(f):
    """As ``_lean``, for two tables grouped alike."""

    def run(key: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        trim()
        out = f(key, rows, others)
        trim()
        return out

    return run


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


#: Where the numbers of a shard's trigrams end.
KEYS = 2**63

_COUNTS = "kind int, shard int, data binary, heads binary, total binary, names binary, asked binary, pairs binary, pair_times binary, contexts binary, context_total binary, grams binary, gram_times binary"


def _counts(order: int):
    """A shard's counts: n-grams as keys of indices. Kind 0: how many items have each count; kind 1: the table."""

    def run(key: tuple, messages: pd.DataFrame) -> pd.DataFrame:
        m = messages[messages["kind"] == 0]
        heads = [unpacked(x, U64, True) for x in m["heads"]]
        names = [unpacked(x, U64, True) for x in m["names"]]
        asked = [unpacked(x, U64, True) for x in messages.loc[messages["kind"] == 2, "names"]]
        none = [np.zeros(0, U64)]
        all_heads, all_names = np.unique(np.concatenate(heads or none)), np.unique(np.concatenate(names or none))
        n = max(len(all_names), 1)
        narrow = len(all_heads) * n * n < KEYS  # else a gram doesn't fit one number, and is sorted as two
        keys, words_, times = [], [], []
        for hs, ns, runs, before, word, rest in zip(heads, names, m["runs"], m["before"], m["word"], m["rest"]):
            to = np.searchsorted(all_names, ns)
            ctx = np.repeat(np.searchsorted(all_heads, hs), unpacked(runs, np.uint32)) * n + to[_unindexed(before, len(ns))]
            keys.append(ctx * n + to[_unindexed(word, len(ns))] if narrow else ctx)
            if not narrow:
                words_.append(to[_unindexed(word, len(ns))])
            times.append(unpacked(rest, np.uint32))
        del m, messages, heads, names
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        words_ = np.concatenate(words_) if words_ else np.zeros(0, np.int64)
        times = np.concatenate(times) if times else np.zeros(0, np.uint32)
        # one sort serves all orders: the head leads, then the word before it
        by = np.argsort(keys) if narrow else np.lexsort((words_, keys))
        keys, times = keys[by], times[by]
        if narrow:
            first = _runs(keys)
            ctx, word_ = keys[first] // n, keys[first] % n
        else:
            words_ = words_[by]
            first = np.union1d(_runs(keys), _runs(words_))
            ctx, word_ = keys[first], words_[first]
        gram_times = _sums(times, first)
        del times, first, by, keys, words_
        pairs, at = np.unique(ctx // n * n + word_, return_inverse=True)
        pair_times = np.bincount(at, gram_times, len(pairs)).astype(np.int64)
        del at
        total = np.bincount(pairs // n, pair_times, len(all_heads)).astype(np.int64)
        if order > 2:
            first = _runs(ctx)
            contexts, context_total = ctx[first], _sums(gram_times, first)
            grams = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(ctx)))) * n + word_
            del first
        else:
            contexts = context_total = grams = gram_times = np.zeros(0, np.int64)
        del ctx, word_
        real = all_heads != START
        one = total[real]
        stats = [int(one.sum()), int(real.sum()), int(total[~real].sum())]
        for x in (one, pair_times, gram_times):
            stats += [int((x == r).sum()) for r in range(1, CUT + 2)]
        # of the words that come before only those of contexts that are left have a name
        to = np.zeros(n, np.int64)
        to[pairs % n] = to[contexts % n] = 1
        all_names = all_names[to[: len(all_names)] > 0]
        k = max(len(all_names), 1)
        to = np.cumsum(to) - 1
        pairs, contexts, grams = pairs // n * k + to[pairs % n], contexts // n * k + to[contexts % n], grams // n * k + to[grams % n]
        table = [packed(all_heads, True), packed(total), packed(all_names, True), packed(np.setdiff1d(np.concatenate(asked or none), all_names), True)]
        table += [packed(pairs, True), packed(pair_times.astype(np.uint32)), packed(contexts, True), packed(context_total), packed(grams, True), packed(gram_times.astype(np.uint32))]
        rows = [(0, key[0], np.array(stats, np.int64).tobytes(), *[None] * 10), (1, key[0], None, *table)]
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _COUNTS.split(", ")])

    return run


_ASKED = "to int, shard int, names binary"


def _asked(shards: int):
    """Of each shard the words that may follow there, to the shards that own them."""

    def run(batches):
        for batch in batches:
            rows = []
            for s, names, asked in zip(*(batch.column(c).to_pylist() for c in ("shard", "names", "asked"))):
                all_ = np.union1d(unpacked(names, U64, True), unpacked(asked, U64, True))
                to = _shard(all_, shards)
                rows += [(d, s, packed(all_[to == d], True)) for d in np.unique(to).tolist()]
            yield _batch(rows, _ASKED)

    return run


def _answers(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    names = np.concatenate([np.zeros(0, U64), *(unpacked(x, U64, True) for x in own["heads"])])
    times = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, np.int64) for x in own["total"])])
    out = []
    for s, raw in zip(asked["shard"], asked["names"]):
        want = unpacked(raw, U64, True)
        got = np.zeros(len(want), np.int64)
        at = _find(names, want)
        got[at >= 0] = times[at[at >= 0]]
        out.append((s, key[0], packed(got)))
    return pd.DataFrame(out, columns=["shard", "owner", "times"])


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in a sorted array, -1 where it isn't there."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount ratios of the counts 0..CUT, given how many items have the counts 1..CUT+1.

    Where they are no ratios between 0 and 1 (too few data), an absolute discount stands in.
    """
    d = np.ones(CUT + 1)
    fixed = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        x = (star - common) / (1 - common) if common < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - fixed) / r
    return d


class Model:
    """The constants that all shards share."""

    def __init__(self, stats: np.ndarray, order: int = 3):
        words, kinds, texts_ = (int(x) for x in stats[:3])
        one, *more = np.asarray(stats[3:], np.int64).reshape(-1, CUT + 1).tolist()
        if texts_:
            if texts_ <= CUT + 1:
                one[texts_ - 1] += 1  # the end is a token too
            kinds += 1
        self.order = order
        self.ends = texts_
        self.n, self.v = words + texts_, kinds
        self.one = discounts(one)
        self.more = [discounts(x) for x in more]
        lost = sum((1 - self.one[r]) * r * one[r - 1] for r in range(1, CUT + 1))
        self.unknown = lost / self.n if self.n and lost > 0 else 1 / (self.n + 1)
        self.scale = 1.0 if self.n and lost > 0 else self.n / (self.n + 1)

    def unigram(self, times: np.ndarray) -> np.ndarray:
        d = self.one[np.minimum(times, CUT)]
        d = np.where(times > CUT, 1.0, d)
        return np.where(times > 0, self.scale * d * times / max(self.n, 1), self.unknown)


def backed_off(d: np.ndarray, history: np.ndarray, times: np.ndarray, total: np.ndarray, lower: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram its probability; of each history its backoff weight.

    ``history`` numbers the history of each n-gram, ``times`` counts it (all above 0),
    ``total`` counts each history (with n-grams that are left out), ``lower`` is the lower order's probability of its word, and ``least`` by history
    what the lower order gives unknown words, which are never among those seen.
    """
    kept_times = np.where(times > CUT, 1.0, d[np.minimum(times, CUT)]) * times
    kept = np.bincount(history, kept_times, len(least))
    # where nothing would be left for other words, one more count stands for them
    total = total + (total - kept < total / (total + 1.0) * 0.999999)
    seen = np.bincount(history, lower, len(least))
    return kept_times / total[history], (1 - kept / total) / np.maximum(1 - seen, least)


class Shard:
    """A shard of the weighted table."""

    def __init__(self, m: Model, row):
        get = lambda c, t, up=False: unpacked(row[c], t, up)
        self.heads, self.names = get("heads", U64, True), get("names", U64, True)
        self.total = get("total", np.int64)
        times = get("times", np.int64)
        self.p1 = m.unigram(np.where(self.names == END, m.ends, times))
        self.unknown = m.unknown
        self.n = max(len(self.names), 1)
        self.pairs, self.contexts, self.grams = (get(c, np.int64, True) for c in ("pairs", "contexts", "grams"))
        self.p2, self.p3 = get("p2", np.float32), get("p3", np.float32)
        self.alpha1, self.alpha2 = get("alpha1", np.float64), get("alpha2", np.float32)

    def scores(self, head: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probabilities, from the trigram down; each argument gives places in heads or names, -1 for none."""
        p = np.where(word >= 0, self.p1[word] if len(self.p1) else self.unknown, self.unknown)
        if len(self.heads):
            at = np.where((head >= 0) & (word >= 0), _find(self.pairs, head * self.n + word), -1)
            p = np.where(at >= 0, self.p2[at] if len(self.p2) else p, np.where(head >= 0, self.alpha1[head] * p, p))
        if len(self.contexts):
            ctx = np.where((head >= 0) & (before >= 0), _find(self.contexts, head * self.n + before), -1)
            at = np.where((ctx >= 0) & (word >= 0), _find(self.grams, ctx * self.n + word), -1)
            p = np.where(at >= 0, self.p3[at], np.where(ctx >= 0, self.alpha2[ctx] * p, p))
        return np.log10(p)


_WEIGHTS = "shard int, heads binary, total binary, names binary, times binary, pairs binary, p2 binary, alpha1 binary, contexts binary, grams binary, p3 binary, alpha2 binary"


def _weights(m: Model, shards: int):
    """A shard's table with probabilities and weights; its names are all that may follow or come before."""

    def run(key: tuple, counted: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in counted.iterrows():
            own = unpacked(r["names"], U64, True)
            names = np.union1d(own, unpacked(r["asked"], U64, True))
            n = max(len(names), 1)
            times, owner = np.zeros(len(names), np.int64), _shard(names, shards)
            for d, raw in zip(answers["owner"], answers["times"]):
                times[owner == d] = unpacked(raw, np.int64)
            k = max(len(own), 1)
            to = np.searchsorted(names, own)
            heads, total = unpacked(r["heads"], U64, True), unpacked(r["total"], np.int64)
            pairs, contexts, grams = (unpacked(r[c], np.int64, True) for c in ("pairs", "contexts", "grams"))
            p1 = m.unigram(np.where(names == END, m.ends, times))
            head, word = pairs // k, to[pairs % k] if len(pairs) else pairs
            p2, alpha1 = backed_off(m.more[0], head, unpacked(r["pair_times"], np.uint32).astype(np.int64), total, p1[word], np.full(len(heads), m.unknown))
            p3, alpha2 = np.zeros(0), np.zeros(0)
            if len(contexts):
                gram_times, context_total = unpacked(r["gram_times"], np.uint32), unpacked(r["context_total"], np.int64)
                p3, alpha2 = np.zeros(len(grams), np.float32), np.zeros(len(contexts), np.float32)
                first = np.searchsorted(grams, np.arange(len(contexts) + 1) * k)
                i = 0
                while i < len(contexts):  # whole contexts, about SLICE trigrams at a time
                    j = max(i + 1, int(np.searchsorted(first, first[i] + SLICE, "right")) - 1)
                    own_ = slice(first[i], first[j])
                    ctx, word_ = grams[own_] // k - i, grams[own_] % k
                    lower = p2[np.searchsorted(pairs, contexts[i:j][ctx] // k * k + word_)]
                    p3[own_], alpha2[i:j] = backed_off(m.more[1], ctx, gram_times[own_].astype(np.int64), context_total[i:j], lower, alpha1[contexts[i:j] // k] * m.unknown)
                    grams[own_] = (ctx + i) * n + to[word_]
                    i = j
                del gram_times, context_total, first
                contexts = contexts // k * n + to[contexts % k]
            pairs = head * n + word
            table = [packed(heads, True), packed(total), packed(names, True), packed(times), packed(pairs, True), packed(p2.astype(np.float32)), packed(alpha1)]
            rows.append((key[0], *table, packed(contexts, True), packed(grams, True), packed(p3.astype(np.float32)), packed(alpha2.astype(np.float32))))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _WEIGHTS.split(", ")])

    return run


_PARTS = "block long, ids binary, text binary, n binary, known binary, base binary, score binary"


def _partials(m: Model):
    def run(key: tuple, messages: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        empty = {c: packed(np.zeros(0, np.int64)) for c in ("heads", "total", "names", "times", "pairs", "p2", "alpha1", "contexts", "grams", "p3", "alpha2")}
        s = Shard(m, table.iloc[0] if len(table) else empty)
        rows = []
        for r in messages.itertuples():
            if r.kind == 3:
                rows.append((r.block, r.rest, *[None] * 5))
                continue
            heads, names = unpacked(r.heads, U64, True), unpacked(r.names, U64, True)
            times = unpacked(r.runs, np.uint32)
            hi, to = _find(s.heads, heads), _find(s.names, names)
            score = s.scores(np.repeat(hi, times), to[_unindexed(r.before, len(names))], to[_unindexed(r.word, len(names))])
            total = np.where(hi >= 0, s.total[hi] if len(s.total) else 0, 0)
            real = heads != START
            text, at = np.unique(unpacked(r.rest, np.uint16), return_inverse=True)
            each = (real, real & (total > 0), np.where(real, np.log10(total + 1.0), 0.0))
            n, known, base = (np.bincount(at, np.repeat(x, times), len(text)) for x in each)
            score = np.bincount(at, score, len(text))
            rows.append((r.block, None, packed(text, True), packed(n.astype(np.uint32)), packed(known.astype(np.uint32)), packed(base), packed(score.astype(np.float32))))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _PARTS.split(", ")])

    return run


def _gathered(m: Model):
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(rows.loc[rows["ids"].notna(), "ids"].iloc[0], np.int64)
        n, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        base, score = np.zeros(len(ids)), np.zeros(len(ids))
        for r in rows[rows["text"].notna()].itertuples():
            t = unpacked(r.text, np.uint16, True)
            n[t] += unpacked(r.n, np.uint32)
            known[t] += unpacked(r.known, np.uint32)
            base[t] += unpacked(r.base, np.float64)
            score[t] += unpacked(r.score, np.float32)
        n += 1  # the end
        known += m.ends > 0
        base += np.log10(m.ends + 1.0) - n * np.log10(m.n + m.v + 1.0)
        return pd.DataFrame({"doc_id": ids, "held_out": [is_held(i) for i in ids.tolist()], "n_tokens": n, "n_known": known, "train_tokens": m.n, "base_score": base, "score": score})

    return run, schema


def trained(docs: DataFrame, order: int = 3) -> tuple[Model, DataFrame, int]:
    """The model's constants, its stored table by shard (n-grams, probabilities, backoff weights), and the number of shards.

    It can score the texts of ``docs``, training and held-out ones; ``order`` is 2 or 3.
    """
    docs = texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-int(size) // SHARD_BYTES))
    sent = docs.mapInArrow(trimmed(_messages(shards, False, order)), _MESSAGE)
    counted = bucketed(sent.repartition(shards, "shard").groupBy("shard").applyInPandas(_lean(_counts(order)), _COUNTS), "shard", shards)
    settle(docs.sparkSession)
    stats = np.zeros(3 + 3 * (CUT + 1), np.int64)
    for row in counted.where("kind = 0").select("data").toLocalIterator():
        stats += np.frombuffer(row.data, np.int64)
    m = Model(stats, order)
    table = counted.where("kind = 1").drop("kind", "data")
    asked = table.select("shard", "names", "asked").mapInArrow(_asked(shards), _ASKED)
    owned = table.select(F.col("shard").alias("to"), "heads", "total")
    answers = owned.groupBy("to").cogroup(asked.groupBy("to")).applyInPandas(_answers, "shard int, owner int, times binary")
    answers = answers.repartition(shards, "shard")
    weighted = table.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(_lean_pair(_weights(m, shards)), _WEIGHTS)
    weighted = bucketed(weighted, "shard", shards)
    forget(counted)
    settle(docs.sparkSession)
    return m, weighted, shards


def scored(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text.

    Null and empty texts hold only an end; equal rows give equal rows (and count in
    training each), as do rows that share a doc_id, each by its own text; rows without
    doc_id are dropped; without training rows every token is unknown; an empty table
    gives an empty one; other columns are ignored.
    """
    m, table, shards = trained(docs, order)
    docs = texts(docs)
    run, schema = _gathered(m)
    out = []
    for i in range(ROUNDS):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == i)
        sent = own.mapInArrow(trimmed(_messages(shards, True, order)), _MESSAGE)
        parts = sent.repartition(shards, "shard").groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(_lean_pair(_partials(m)), _PARTS)
        out.append(stored(parts.repartition(width(docs.sparkSession), "block").groupBy("block").applyInPandas(run, schema)))
        settle(docs.sparkSession)
    forget(table)
    return reduce(DataFrame.unionByName, out)
