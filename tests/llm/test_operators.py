"""The operators against brute force, the tokenizers library and held-out labels, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sparkloom.llm import bpe, decontamination, katz, kd_search, minhash, passages, quality, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, key long, h long, v long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5)))
    out = [None, "", " \n\t", "A b", "a B", "one two three four five", "x" * 5000]
    base = [word() for _ in range(120)]
    for e in range(30):
        w = list(base)
        for _ in range(e // 2):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    shared = " ".join(word() for _ in range(70))
    for _ in range(12):
        out.append(" ".join(word() for _ in range(40)) + " " + shared + " " + " ".join(word() for _ in range(40)))
    out += [out[10]] * 5 + ["Nton " * 200, "ab " * 400]
    return out


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_minhash(spark, texts):
    got = {x.doc_id: x for x in minhash.near_duplicates(frame(spark, texts)).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = tokens(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("lot", [2048, 2])
def test_suffix_dedup(spark, texts, lot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    got = {x.doc_id: x for x in suffix_dedup.removal(frame(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    times = collections.Counter(x[p : p + 200] for x in raw for p in range(len(x) - 199))
    for i, x in enumerate(raw):
        cover = bytearray(len(x))
        for p in range(len(x) - 199):
            if times[x[p : p + 200]] > 1:
                cover[p : p + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(cover)))
        kept = bytes(b for b, c in zip(x, cover) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), sum(cover), runs, hashlib.sha256(kept).hexdigest())


def test_maximal_repeats():
    t = np.frombuffer(b"xabcdeyabcdezabcdq", np.uint8)
    n = len(t)
    at = np.arange(n - 3)
    left = np.where(at == 0, -1, t[np.maximum(at - 1, 0)].astype(int))
    found = sorted((size, sorted(at[i].tolist())) for size, i in suffix_dedup.maximal_repeats(t, at, n - at, left, 4))
    assert found == [(4, [1, 7, 13]), (5, [1, 7])]


@pytest.fixture(scope="module")
def tricky():
    r = random.Random(5)
    letters = list("aabest'''rvlmdSTRE  \n\t!?#&.1239éßıΣσİñ中🎉²Ⅷ́​\x1c\x85\xa0　") + ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "<|"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["", None, "x" * 20000, "'" * 300, "'r", "a'l", "'v"]


def library(name):
    public = pytest.importorskip("public_tokenizers")
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path(name))
    return public.path(name), tok


def test_bpe(spark, tricky):
    path, tok = library("byte_bpe_50k.json")
    got = {x.doc_id: x for x in bpe.digests(frame(spark, tricky), path, keep_ids=True).collect()}
    for i, t in enumerate(tricky):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark, tricky, monkeypatch):
    path, tok = library("word_bpe_49k.json")
    got = {x.doc_id: x for x in token_counts.token_counts(frame(spark, tricky), path, 100).collect()}
    for i, t in enumerate(tricky):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    monkeypatch.setattr(token_counts, "STATES", 10)
    one = token_counts.Counter(path)
    for _ in range(2):
        assert one.count(["" if t is None else t for t in tricky]).tolist() == [got[i].n_tokens for i in range(len(tricky))]


def test_kd_search(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 256], 0) for i in range(900)]  # many ties
    rows += [(900, None, 0), (901, [], 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (903, [float("nan")] + [0.0] * 5, 0), (904, [float("inf")] + [0.0] * 5, 0), (950, [1.0, 2.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in kd_search.top_k(v, v.where("vec_id % 50 = 0"), 5, shard=200).collect()}
    whole = {i: np.floor(256 * np.array(e, float)).astype(int) for i, e, _ in rows[:900]}
    want = {}
    for q in range(0, 900, 50):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert kd_search.top_k(v.where("vec_id < 0"), v, 5).count() == 0


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (15, 30, 40)]
    docs, want = [None, "", "short text"], {0: [], 1: [], 2: []}
    for k in range(30):
        w = [word() for _ in range(60)]
        hit = []
        if k % 3 == 0:
            j = k // 3 % 3
            part = list(items[j])
            for p in range(5, len(part), 9):
                part[p] = word()  # substitutions
            w[20:20] = [x.upper() + "," for x in part]
            hit = [j]
        want[len(docs)] = hit
        docs.append(" ".join(w))
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (10, "", 1)], "item_id long, text string, key int")
    d = frame(spark, docs)
    assert {x.doc_id: x.item_ids for x in decontamination.marked(d, bench).collect()} == want
    assert decontamination.decontaminated(d, bench).columns == d.columns
    assert not any(x.contaminated for x in decontamination.marked(d, bench.where("item_id < 0")).collect())


def test_passages(spark, texts):
    got = {x.doc_id: x for x in passages.marked(frame(spark, texts)).collect()}
    w = [(t or "").lower().split() for t in texts]
    times = collections.Counter(tuple(x[k : k + 60]) for x in w for k in range(len(x) - 59))
    for i, x in enumerate(w):
        repeats = any(times[tuple(x[k : k + 60])] > 1 for k in range(len(x) - 59))
        assert not repeats or got[i].n_passages > 0
        if len(x) < 50:
            assert got[i].n_passages == 0


def test_compact_windows():
    r = np.random.default_rng(0)
    h = r.permutation(200).astype(np.uint64) + np.uint64(1)
    ptr = np.array([0, 120, 120, 125, 200])
    got = {tuple(x) for x in passages.compact_windows(h, ptr, 10).tolist()}
    want = set()
    for d in range(4):
        for p in range(ptr[d], ptr[d + 1]):
            a = z = p
            while a > ptr[d] and h[a - 1] > h[p]:
                a -= 1
            while z + 1 < ptr[d + 1] and h[z + 1] > h[p]:
                z += 1
            if z - a + 1 >= 10:
                want.add((d, p, a, z))
    assert got == want


def katz_by_hand(w, held, cut=5):
    """score(text) by Katz trigrams from plain dictionaries: (log10 probability, base score)."""
    train = [x for x, h in zip(w, held) if not h]
    one = collections.Counter(t for x in train for t in x)
    two, three = collections.Counter(), collections.Counter()
    for x in train:
        y = ["<s>", "<s>", *x]
        for i in range(2, len(y)):
            two[y[i - 1], y[i]] += 1
            three[y[i - 2], y[i - 1], y[i]] += 1
    n = sum(one.values())
    d = [katz.discounts([sum(c == r for c in k.values()) for r in range(1, cut + 2)]) for k in (one, two, three)]
    disc = lambda k, c: c if c > cut else d[k][c] * c
    lost = sum(c - disc(0, c) for c in one.values())
    unknown = lost / n if n and lost > 0 else 1 / (n + 1)
    scale = 1 if n and lost > 0 else n / (n + 1)
    p1 = lambda t: scale * disc(0, one[t]) / n if one[t] else unknown

    def level(k, grams, lower):
        of = collections.defaultdict(dict)
        for g, c in grams.items():
            of[g[:-1]][g[-1]] = c

        def p(*g):
            seen = of.get(g[:-1])
            if not seen:
                return lower(*g[1:])
            total = sum(seen.values())
            kept = sum(disc(k, c) for c in seen.values())
            if total - kept < total / (total + 1) * 0.999999:
                total += 1
            if g[-1] in seen:
                return disc(k, seen[g[-1]]) / total
            rest = 1 - sum(lower(*g[1:-1], t) for t in seen)
            return (1 - kept / total) / max(rest, lower(*g[1:-1], None)) * lower(*g[1:])

        return p

    p2 = level(1, two, p1)
    p3 = level(2, three, p2)
    out = []
    for x in w:
        y = ["<s>", "<s>", *x]
        out.append((sum(np.log10(p3(*y[i - 2 : i + 1])) for i in range(2, len(y))), sum(np.log10((one[t] + 1) / (n + len(one) + 1)) for t in x)))
    vocabulary = [*one, None]  # with one unknown word
    for a, b in list({g[:2] for g in three})[:20] + [("<s>", "nothing")]:
        assert abs(sum(p3(a, b, t) for t in vocabulary) - 1) < 1e-6
    return out


@pytest.mark.parametrize("order", [3, 2])
@pytest.mark.parametrize("keys", [2**63, 1000])
def test_katz(spark, texts, order, keys, monkeypatch):
    """With a small KEYS, trigrams are sorted as two numbers, as where a shard's vocabulary is too large for one."""
    monkeypatch.setattr(katz, "KEYS", keys)
    monkeypatch.setattr(katz, "SHARD_BYTES", 3000)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(katz, "SLICE", 50)
    r = random.Random(6)
    more = [*texts, *(" ".join(r.choice("the a of cat dog sat on mat and ran".split()) for _ in range(r.randint(1, 60))) for _ in range(80))]
    got = {x.doc_id: x for x in katz.scored(frame(spark, more), order).collect()}
    w = [tokens(t) + ["</s>"] for t in more]
    held = [katz.is_held(i) for i in range(len(more))]
    c = collections.Counter(t for x, h in zip(w, held) if not h for t in x)
    n = sum(c.values())
    want = katz_by_hand(w, held)
    for i, x in enumerate(w):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(x), sum(c[t] > 0 for t in x), n, held[i])
        assert abs(got[i].base_score - want[i][1]) < 1e-6 and np.isfinite(got[i].score)
        if order == 3:
            assert abs(got[i].score - want[i][0]) < 1e-4 * max(1, abs(want[i][0])), i


def test_classifiers(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        w = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = "nastyword" + r.choice("abcdefgh")
        rows.append((i, "!! ".join(w).upper() if bad else " ".join(w), "en", 1, 2, 3))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, 1, 2, 3), (1001, "", "en", 1, 2, 3)]
    d = spark.createDataFrame(rows, SCHEMA)
    y = spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int")
    for f, column in ((quality.scored, 1), (toxicity.scored, 2)):
        got = {x.doc_id: x for x in f(d, y).collect()}
        assert len(got) == 602 and all(0 <= x.score <= 1 for x in got.values())
        held = [x for i, x in got.items() if x.held_out and i < 600]
        assert np.mean([x.predicted == labels[x.doc_id][column] for x in held]) > 0.95
        assert f(d.where("doc_id < 0"), y).count() == 0
        assert f(d, y.where("doc_id < 0")).count() == 602
    assert quality.accepted(d, y).columns == d.columns


def test_empty_tables(spark, texts):
    none = frame(spark, texts).where("doc_id < 0")
    for f in (minhash.near_duplicates, suffix_dedup.removal, passages.marked, katz.scored):
        assert f(none).count() == 0
    assert suffix_dedup.deduplicated(none).columns == none.columns


def repeated(spark):
    """Rows that share a doc_id, with equal and with other texts, and rows without one."""
    r = random.Random(9)
    long = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = long(80)
    rows = [(1, shared + " " + long(60)), (1, long(90)), (2, long(50) + " " + shared), (3, long(70)), (3, None), (4, long(70))]
    rows.append(rows[-1])
    rows += [(None, shared), (5, "")]
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], SCHEMA), rows, shared


def test_repeated_ids(spark):
    docs, rows, shared = repeated(spark)
    known = [(i, t) for i, t in rows if i is not None]
    by = lambda x: (x[0], *map(str, x[1:]))
    # substrings: each row by its own text; the equal rows lose all, and nothing fans out
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed > 0) for x in suffix_dedup.removal(docs).collect()), key=by)
    assert got == sorted(((i, len(t or ""), bool(t) and (shared in t or i == 4)) for i, t in known), key=by)
    left = suffix_dedup.deduplicated(docs).collect()
    assert sorted(x.doc_id for x in left) == sorted(i for i, _ in known)
    assert all(shared not in x.text for x in left) and sum(x.text == "" for x in left if x.doc_id == 4) == 2
    # passages
    got = sorted(((x.doc_id, x.n_passages > 0) for x in passages.marked(docs).collect()), key=by)
    assert got == sorted(((i, bool(t) and (shared in t or i == 4)) for i, t in known), key=by)
    # benchmark passages
    bench = spark.createDataFrame([(7, shared), (7, "one two three four five six seven eight nine"), (None, "x")], "item_id long, text string")
    got = sorted(((x.doc_id, x.contaminated) for x in decontamination.marked(docs, bench).collect()), key=by)
    assert got == sorted(((i, bool(t) and shared in t) for i, t in known), key=by)
    left = sorted(((x.doc_id, x.text) for x in decontamination.decontaminated(docs, bench).collect()), key=by)
    assert left == sorted(((i, t) for i, t in known if not (t and shared in t)), key=by)
    # near-duplicates: a document once
    got = {x.doc_id: x for x in minhash.near_duplicates(docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(x.kept for x in got.values())
    assert sorted(x.doc_id for x in minhash.deduplicated(docs).collect()) == [1, 2, 3, 4, 5]
    # tokens and scores: each row
    path, _ = library("byte_bpe_50k.json")
    assert bpe.digests(docs, path).count() == len(known) and katz.scored(docs).count() == len(known)


def test_empty_documents(spark, texts):
    none = frame(spark, texts).where("doc_id < 0")
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert bpe.digests(none, library("byte_bpe_50k.json")[0]).count() == 0
    assert token_counts.token_counts(none, library("word_bpe_49k.json")[0]).count() == 0
    assert decontamination.marked(none, bench).count() == 0
    assert minhash.deduplicated(none).count() == 0 and decontamination.decontaminated(none, bench).count() == 0


def test_clashing_labels(spark):
    y = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    assert [tuple(x) for x in quality.known(y, "quality").collect()] == [(2, 1)]
