import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import quality
from sparkloom.llm.common import stored

from .test_operators import library, tokens

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SMALL)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= before and docs.select("doc_id").distinct().count() == now
        before = now
    last = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))


def corpus():
    """Good texts with copies, near copies, shared passages and benchmark passages; shouted ones are bad."""
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(14), text(25)]
    shared = text(60)
    good = [text(80) for _ in range(120)]
    good += [good[0], good[1] + " more", good[2].replace(good[2].split()[40], "zzz")]
    good += [text(40) + " " + shared + " " + text(40) for _ in range(3)]
    good += [text(30) + " " + i + " " + text(30) for i in items]
    changed = items[1].split()
    changed[5] = changed[15] = "zzz"
    good.append(text(30) + " " + " ".join(changed) + " " + text(30))
    bad = ["!! ".join(text(60).split()).upper() for _ in range(60)]
    return good, bad, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    good, bad, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(good + bad)] + [(1000, None, "en", "web", 0), (1001, "", "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good + bad))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_against_brute_force(spark, folder):
    """Each stage anew from plain Python: rules, shingle sets, 200-byte strings, 15 equal of 20 tokens, the library's BPE."""
    docs = corpus_pipeline.documents(spark, folder)
    bias, rules = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {}
    texts = {x.doc_id: x.text for x in docs.collect()}
    for x in quality.statistics(docs).collect():
        total = bias + sum(w for w, rule in rules if all((x[f] > t) == above for f, above, t in rule))
        if 1 / (1 + np.exp(-total)) >= 0.5:
            kept[x.doc_id] = texts[x.doc_id]
    good, bad, items = corpus()
    assert len(rules) and len(good) <= len([i for i in kept if i < 1000]) <= len(good) + 2
    # near-duplicates
    sets = {}
    for i, t in kept.items():
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in kept}
    for i, j in itertools.combinations(sorted(kept), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    # substrings
    raw = {i: (t or "").encode() for i, t in kept.items()}
    times = collections.Counter(x[p : p + 200] for x in raw.values() for p in range(len(x) - 199))
    for i, x in raw.items():
        gone = [False] * len(x)
        for p in range(len(x) - 199):
            if times[x[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        for p in range(len(x)):  # runs shrink to whole characters
            if gone[p] and x[p] & 0xC0 != 0x80 and x[p] >= 0x80:
                size = 2 if x[p] < 0xE0 else 3 if x[p] < 0xF0 else 4
                if not all(gone[p : p + size]):
                    gone[p : p + size] = [False] * size
            elif gone[p] and x[p] & 0xC0 == 0x80 and not gone[p - 1]:
                gone[p] = False
        kept[i] = bytes(c for c, g in zip(x, gone) if not g).decode()
    # benchmark
    def overlap(x, y):
        n = min(20, len(y))
        return any(sum(a == b for a, b in zip(x[p : p + n], y[q : q + n])) >= 0.75 * n for p in range(len(x) - n + 1) for q in range(len(y) - n + 1))

    kept = {i: t for i, t in kept.items() if not any(overlap(t.split(), y.split()) for y in items)}
    _, tok = library("byte_bpe_50k.json")
    want = set()
    for i, t in kept.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got} == want and len(got) == len(want)
    assert 0 < len(want) < len(good)


def test_stages_with_odd_rows(spark, folder):
    """Nulls in every column, rows without an id, repeated ids, and no rows at all."""
    docs = corpus_pipeline.documents(spark, folder).limit(40)
    odd = docs.unionByName(spark.createDataFrame([(None, "some text of nobody", None, None, None), (2000, None, None, None, None), (2001, "a b c", None, None, None), (2001, "other words here", "en", "web", 16)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.where("doc_id is null").count() == 0, name
        assert stage(spark, docs.where("doc_id < 0"), folder).count() == 0, name
        if name in ("substrings", "decontamination", "bpe"):
            assert out.where("doc_id = 2001").count() == 2, name
        if name == "near_duplicates":
            assert out.where("doc_id = 2001").count() == 1 and out.where("doc_id = 2000").count() == 1
