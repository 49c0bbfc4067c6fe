"""Components by stars: right on any graph, and no more rounds and passes than they need."""

import random

from sparkloom.llm import components, minhash

from .test_operators import frame


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def found(spark, pairs):
    rows = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_any_graph(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    hot = [(r.choice((999, 100)), i) for i in range(100, 300)]
    some = [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(170)]
    odd = [(None, 5), (7, None), (2000, 2000), (2001, 2002), (2002, 2001), (2001, 2002)]
    pairs = chain + hot + some + odd
    r.shuffle(pairs)
    assert found(spark, pairs) == brute(pairs)
    assert found(spark, [(1, 1), (None, 2)]) == {}


def test_stars_take_no_round(spark, monkeypatch):
    written, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df: written.append(1) or stored(df))
    assert found(spark, [(5, 1), (1, 6), (9, 8), (7, 1)]) == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8}
    assert len(written) == 1


def test_passes_without_new_links_need_no_components(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [text, text + " more", "quite another text than the two before it"])
    called, whole = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: called.append(1) or whole(links))
    monkeypatch.setattr(minhash, "_rest", lambda *a: spark.createDataFrame([(0, 2)], "a long, b long"))
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 2}
    assert len(called) == 1
