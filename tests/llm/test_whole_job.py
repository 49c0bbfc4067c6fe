"""The operators against brute force where substitutions, frequent values and large groups could lose results."""

import itertools
import random

import numpy as np

from sparkloom.llm import decontamination, passages

from .test_operators import frame


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(6))


def test_masks_hit_every_pattern():
    masks = [[i for i, bit in enumerate(m) if bit == "1"] for m in decontamination.MASKS]
    for n in range(decontamination.LEAST, decontamination.WINDOW + 1):
        other = n - int(np.ceil(decontamination.SHARE * n))
        for apart in itertools.combinations(range(n), other):
            equal = set(range(n)).difference(apart)
            assert any(all(p + i in equal for i in m) for m in masks for p in range(n - m[-1])), (n, apart)


def test_decontamination_of_substituted_items(spark):
    r = random.Random(8)
    items = [[word(r) for _ in range(n)] for n in (8, 12, 15, 17, 20, 20, 31, 40)]
    docs = []
    for item in items:
        apart = [range(k, len(item), step) for step in (3, 4, 5) for k in range(step)]
        apart += [r.sample(range(len(item)), min(len(item), len(item) // 4 + k % 2)) for k in range(20)]
        for out in apart:
            part = [word(r) if p in out else t for p, t in enumerate(item)]
            docs.append([word(r) for _ in range(25)] + part + [word(r) for _ in range(25)])
    want = {}
    for d, x in enumerate(docs):
        want[d] = []
        for i, y in enumerate(items):
            n = min(decontamination.WINDOW, len(y))
            starts = itertools.product(range(len(x) - n + 1), range(len(y) - n + 1))
            if any(sum(a == b for a, b in zip(x[p : p + n], y[q : q + n])) >= decontamination.SHARE * n for p, q in starts):
                want[d].append(i)
    assert 0 < sum(map(bool, want.values())) < len(docs)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {x.doc_id: x.item_ids for x in decontamination.marked(frame(spark, [" ".join(w) for w in docs]), bench).collect()} == want


def found(spark, docs):
    return {x.doc_id for x in passages.marked(frame(spark, [" ".join(w) for w in docs])).collect() if x.n_passages}


def near_pairs(r, pairs, words, places, around):
    """Documents in pairs that share a passage but for substituted words, in other surroundings."""
    docs = []
    for _ in range(pairs):
        part = [word(r) for _ in range(words)]
        other = list(part)
        for p in places:
            other[p] = word(r)
        docs += [[word(r) for _ in range(around)] + x + [word(r) for _ in range(around)] for x in (part, other)]
    return docs


def test_passages_of_hot_values(spark, monkeypatch):
    """Each value in lots of one class, without links inside: all comes from the exact join."""
    docs = near_pairs(random.Random(11), 60, 60, [30], 60)
    monkeypatch.setattr(passages, "LOT", 1)
    monkeypatch.setattr(passages, "FEW", 1)
    monkeypatch.setattr(passages, "PARTS", 1)
    assert found(spark, docs) == set(range(len(docs)))


def jaccard(x, y):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
    return len(a & b) / len(a | b)


def test_recall_and_false_passages(spark):
    """Pairs at similarities from 0.75 to 0.9, and documents that share nothing, or too little: 30 words, or 50 words at 0.5."""
    r = random.Random(21)
    near, rates = [], []
    for places in ([25], [24, 25], [0, 49], [0, 25], [4]):
        docs = near_pairs(r, 100, 50, places, 70)
        rates.append(jaccard(docs[0][70:120], docs[1][70:120]))
        near += docs
    assert 0.75 <= min(rates) and max(rates) <= 0.93
    apart = near_pairs(r, 60, 30, [], 60) + near_pairs(r, 60, 50, [10, 20, 30, 40], 60) + [[word(r) for _ in range(200)] for _ in range(100)]
    got = {x.doc_id: x for x in passages.marked(frame(spark, [" ".join(w) for w in near + apart])).collect()}
    hit = [bool(got[i].n_passages) for i in range(len(near))]
    assert np.mean(hit) >= 0.98, np.mean(hit)
    assert not any(got[i].n_passages for i in range(len(near), len(near) + len(apart)))
    for i in np.flatnonzero(hit).tolist():  # the spans found lie about the planted ones
        assert got[i].n_passages == 1 and 70 - 17 <= got[i].passages[0].start and got[i].passages[0].end <= 120 + 17


def test_near_passages_are_all_found(spark):
    """300 pairs of near passages at similarity 0.78 over all, 0.8 in the best 50 words."""
    r = random.Random(12)
    docs = []
    for _ in range(300):
        part = [word(r) for _ in range(60)]
        other = list(part)
        other[30], other[58] = word(r), word(r)
        docs += [[word(r) for _ in range(60)] + x + [word(r) for _ in range(60)] for x in (part, other)]
    assert found(spark, docs) == set(range(len(docs)))


def test_repetitive_passages(spark):
    """A passage of ten words said six times, in other surroundings."""
    r = random.Random(13)
    docs = []
    for _ in range(40):
        part = [word(r) for _ in range(10)] * 6
        docs += [[word(r) for _ in range(70)] + part + [word(r) for _ in range(70)] for _ in range(2)]
    assert found(spark, docs) == set(range(len(docs)))


def test_passages_without_a_common_leader(spark, monkeypatch):
    """Of three passages the middle one resembles both others, which don't resemble each other."""
    docs = []
    for k in range(40):
        line = [f"w{k}x{i}" for i in range(62)]
        docs += [line[a : a + 50] for a in (0, 6, 12)]
    assert found(spark, docs) == set(range(len(docs)))
    monkeypatch.setattr(passages, "LOT", 1)
    monkeypatch.setattr(passages, "FEW", 1)
    monkeypatch.setattr(passages, "PARTS", 1)
    assert found(spark, docs) == set(range(len(docs)))


def test_a_large_group_of_near_passages(spark):
    """300 documents with one passage, each with a word of its own in it, in other surroundings."""
    r = random.Random(14)
    part = [word(r) for _ in range(70)]
    docs = [[word(r) for _ in range(60)] + part[:k] + [word(r)] + part[k + 1 :] + [word(r) for _ in range(60)] for k in (r.randrange(70) for _ in range(300))]
    assert found(spark, docs) == set(range(len(docs)))


def test_other_signs_separate(spark):
    """Quotes, dashes and blanks beyond ASCII separate words as those within it do; letters with marks stay whole."""
    item = "he said it was not the end of the long road that we took"
    docs = ["x y z \u201che said\u00a0it was\u2014not the end of the \u2018long\u2019 road that we took\u201d a b", "e\u0301t\u00e9 " * 30]
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    assert [x.item_ids for x in sorted(decontamination.marked(frame(spark, docs), bench).collect(), key=lambda x: x.doc_id)] == [[1], []]
