"""Operators 11 to 13 against plain Python and the tokenizers' own libraries, on small fixtures and on whole small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkloom.llm import alignment, piece_bpe, queries, resampling

SCHEMA = "doc_id long, text string, rank long, weight long, block long, ids string, row long, at long"
SMALL = "/root/testdata/sf0.001"
BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def frame(spark, texts, ids=None):
    """With extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    letters = "aabbcde  \n\tABé▁🜁<s>0x'’ſﬁ中文字한국어\x00\x1c\x85​\xa0-_.,9"
    out = [None, "", " ", "  ", " \n\t", "x", " x", "x ", "▁", "a▁b", "the <s> and </s> <|endoftext|> <0x41> <unk>", "don't  we'll\n\n they're\n  so  ", "a\n b \n c"]
    out += ["".join(r.choice(letters) for _ in range(r.choice([3, 10, 60, 300]))) for _ in range(300)]
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(60)]
    out += [r.choice([" ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(100)]
    return out + [out[-1]] * 40 + ["y" * 70_000, "ab cd " * 30_000, " ".join(words) * 500]


def whole(spark, name="documents"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]


# 11: resampling


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(rows, target, percent=5, least=20):
    made = [(i, *plain_features(t)) for i, t in rows if i is not None]
    s, t = collections.Counter(b for _, _, f in made for b in f), collections.Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def drawn(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_of_whole_tables(spark):
    got = queries.op11_resampling(spark, SMALL)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    want = plain_resampling(whole(spark), [t for _, t in whole(spark, "benchmark")])
    assert drawn(got) == want and sum(x[4] is not None for x in want) > 3


def test_resampling_of_odd_texts(spark, texts):
    words = ["Ab", "é", "\x80x", "w" * 63, "w" * 64, "w" * 65, "w" * 200, "9", "ſ", "K"]
    odd = texts + [" ".join(words) * 3, "-".join(words), "a" * 300_000, None]
    ids = [*range(len(odd) - 3), 7, 7, None]  # repeated and missing ids
    target = frame(spark, [None, "", "Ab é the the", "ab cd ab"])
    for percent, least in ((5, 20), (100, 0), (0, 20)):
        got = resampling.resampled(frame(spark, odd, ids), target, percent, least)
        want = plain_resampling(zip(ids, odd), [None, "", "Ab é the the", "ab cd ab"], percent, least)
        strip = lambda rows: [r for r in rows if r[0] != 7]  # noqa: E731  those of one id may stand in any order
        assert strip(drawn(got)) == strip(want)
        assert sorted((r[4] or 0) for r in drawn(got)) == sorted((r[4] or 0) for r in want)


def test_resampling_of_nothing(spark, texts):
    none = frame(spark, ["x"]).where("false")
    assert resampling.resampled(none, frame(spark, texts[:20])).count() == 0
    assert drawn(resampling.resampled(frame(spark, texts[:20]), none)) == plain_resampling(enumerate(texts[:20]), [])
    assert drawn(resampling.resampled(frame(spark, ["a b c"] * 9, [3] * 9), none, 50, 1))[:4] == sorted([(3, 6, *drawn(resampling.resampled(frame(spark, ["a b c"] * 9, [3] * 9), none))[0][2:4], k) for k in range(1, 5)], key=str)


def test_long_words_hash_as_a_whole():
    r = random.Random(2)
    w = ["".join(r.choice("abcé9") for _ in range(n)) for n in (1, 5, 31, 63, 64, 65, 66, 500, 2, 64)]
    raw = " ".join(w).encode()
    n, found = resampling.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert sorted(b for _, bucket in found for b in bucket.tolist()) == sorted(plain_features(" ".join(w))[1]) and n.tolist() == [10]


# 12: SentencePiece


def test_pieces_as_the_library(spark, texts):
    lib = SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in piece_bpe.encoded(frame(spark, texts), PIECES).collect()}
    short = {r.doc_id: r for r in piece_bpe.digests(frame(spark, texts), PIECES).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids) and got[i].n_tokens == short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pieces_of_whole_documents(spark):
    lib = SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_piece_bpe(spark, SMALL).collect()}
    for i, t in whole(spark):
        ids = lib.encode(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_pieces_side_by_side():
    """Any sequence of pieces, and texts without a single blank, which are encoded as one unit."""
    lib, mine, r = SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceCodec(PIECES), random.Random(8)
    some = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(4000):
        t = "".join(r.choice(some) for _ in range(r.choice([2, 3, 8])))
        assert mine.run([t, t.replace(" ", "")]) == [(",".join(map(str, i)), len(i), lib.decode(i)) for i in (lib.encode(t), lib.encode(t.replace(" ", "")))]
    for i in range(259, 32000, 7):
        assert mine.decode([i]) == lib.decode([i])
    assert all(mine.trace(p) for p in mine.ids)
    mine.cuts = False  # whole texts without units are the same
    t = " ".join(some[:500])
    assert mine.run([t])[0][0] == ",".join(map(str, lib.encode(t)))


def test_pieces_with_full_tables(monkeypatch, texts):
    lib, mine = SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceCodec(PIECES)
    monkeypatch.setattr(piece_bpe, "TABLE_BYTES", 3000)
    monkeypatch.setattr(piece_bpe, "PAIRS", 10)
    monkeypatch.setattr(piece_bpe, "LONG", 5)
    assert [ids for ids, _, _ in mine.run([t or "" for t in texts[:380]])] == [",".join(map(str, lib.encode(t or ""))) for t in texts[:380]]


# 13: alignment


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    from sparkloom.llm.bpe import byte_letters

    back = {c: i for i, c in enumerate(byte_letters())}

    def encode(text):
        if not text:
            return [], []
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        same = b"".join(z for _, z in x) == b"".join(z for _, z in y) == (" " + text).encode()
        return (x, y) if same else ([], [])

    return encode


def plain_alignment(rows, encode):
    counts, made = collections.Counter(), []
    for i, text in rows:
        a, b = encode(text)
        spans = [], []
        for side, out in ((a, spans[0]), (b, spans[1])):
            at = 0
            for t, raw in side:
                out.append((t, at, at + len(raw)))
                at += len(raw)
        links, first = [], 0
        for t, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((t, spans[1][k][0]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, x, y = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while x < len(spans[0]) and spans[0][x][2] <= c:
                ga.append(str(spans[0][x][0]))
                x += 1
            while y < len(spans[1]) and spans[1][y][2] <= c:
                gb.append(str(spans[1][y][0]))
                y += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        made.append((i, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (i, a, b, len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for i, a, b, g, l in made
    )


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_whole_documents(spark, sides):
    got = queries.op13_alignment(spark, SMALL)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in NAMES}
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == plain_alignment(whole(spark), sides)


def test_alignment_of_odd_texts(spark, texts, sides, monkeypatch):
    want = plain_alignment(enumerate(texts), sides)
    assert sum(r[7] == "" for r in want) > 5 and sum(r[4] > r[3] for r in want) > 50
    got = alignment.aligned(frame(spark, texts).repartition(5), BYTES, PIECES)
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == want
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)  # many blocks
    got = alignment.aligned(frame(spark, texts), BYTES, PIECES)
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == want


def test_alignment_groups(spark, texts):
    some = texts[:200]
    ids = [*range(199), None]
    made = collections.defaultdict(list)
    for r in alignment.groups(frame(spark, some, ids), BYTES, PIECES).orderBy("doc_id", "group").collect():
        made[r.doc_id].append(",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b)))
    for r in alignment.aligned(frame(spark, some, ids), BYTES, PIECES).collect():
        assert r.n_groups == len(made[r.doc_id]) and r.groups_sha256 == (hashlib.sha256(";".join(made[r.doc_id]).encode()).hexdigest() if r.n_groups else "")


def test_alignment_of_nothing(spark):
    assert alignment.aligned(frame(spark, ["x"]).where("false"), BYTES, PIECES).count() == 0
    got = alignment.aligned(frame(spark, [None, "", "▁"]), BYTES, PIECES).select(*NAMES).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


def test_intervals_against_all_pairs():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 30)
        a, b = (sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, 9)))}) for _ in range(2))
        spans = lambda ends: list(zip([0, *ends[:-1]], ends))
        for (s, e), (lo, hi) in zip(spans(a), alignment.overlaps(a, b)):
            assert [k for k, (x, y) in enumerate(spans(b)) if x < e and s < y] == list(range(lo, hi))
        assert len(alignment.cut_groups(a, b)) == len(set(a) & set(b))
