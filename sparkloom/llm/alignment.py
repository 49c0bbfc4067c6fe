"""Alignment of the tokens of two tokenizers by the bytes that they cover.

A static interval index over the B tokens (their starts and ends in order) answers, by
bisection, which of them each A token overlaps; the gaps that no token of either side
spans cut both into groups. Both encodings are the same whatever stands before a blank
that a letter follows, so texts are cut there into units, each aligned once while a task
remembers it.

Texts are worked off in blocks. A block keeps its documents as numbers of its units, and
the id pairs that its units link with their numbers of links. A pair's corpus-wide count
is a plain grouped sum over the blocks' pairs, so a frequent pair is one row a block; the
counts come back to the blocks by a join, and each block sums them over its documents
without a second look at the texts.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .bpe import PIECES, Codec
from .common import by_bytes, packed, stored, texts, trim, trimmed, unpacked
from .piece_bpe import LATIN, PieceCodec

CHUNK_BYTES = 1 << 18
#: Text in a block, and what a block's units may take, about.
BLOCK_BYTES = 16 << 20
UNIT_BYTES = 48 << 20
#: Between anything but a blank and a blank before something that is no white space; and between a letter and a sign.
CUT = re.compile(r"(?<=[^ ])(?= \S)")
FINE = re.compile(rf"(?<=[{LATIN}])(?=[^\w\s])")
#: A blank that white space follows, or nothing.
ODD = re.compile(r" (?:\s|\Z)")


def overlaps(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """For each A token the first B token that it overlaps and the one after the last; tokens follow one another from 0, and ends are given."""
    b_starts = [0, *b_ends[:-1]]
    out, start = [], 0
    for end in a_ends:
        out.append((bisect_right(b_ends, start), bisect_left(b_starts, end)))
        start = end
    return out


def cut_groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """How many tokens of A and of B end at or before each gap that no token spans."""
    return [(bisect_right(a_ends, e), bisect_right(b_ends, e)) for e in sorted(set(a_ends).intersection(b_ends))]


#: Ends a model file so that no blank is added before a text: the field of normalisation (3) with its third member set to 0, which takes the place of what stood there.
NO_BLANK = b"\x1a\x02\x18\x00"


class Aligner:
    """Aligns texts. The tokens of a unit come from the tokenizers' libraries; ``bpe`` and ``piece_bpe`` know the files and what tokens stand for."""

    def __init__(self, path_a: str, path_b: str):
        a, self.b = Codec(path_a), PieceCodec(path_b)
        if (np.diff(a.made[:, 2]) <= 0).any():
            raise ValueError("the ids of A's merges must stand in the order of their ranks")
        self.raw_a = [a.raw(i) for i in range(len(a.cut) - 1)]
        ranks = {x: i for i, x in enumerate(self.raw_a) if x and i not in a.special.values()}
        self.encode_a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(path_b, "rb") as f:
            self.encode_b = SentencePieceProcessor(model_proto=f.read() + NO_BLANK).encode
        self.a_sizes, self.b_sizes = list(map(len, self.raw_a)), list(map(len, self.b.raw_of))
        self.names = list(map(str, range(max(len(self.a_sizes), len(self.b_sizes)))))
        trim()

    def units(self, new: list[str]) -> Iterator[tuple[int, int, int, str, list[int]]]:
        """Of each unit: its numbers of A tokens, B tokens and groups, the groups as text, and its links (A id and B id in one number). A unit whose bytes one side doesn't give back has -1 groups."""
        a_sizes, b_sizes, names = self.a_sizes, self.b_sizes, self.names
        for unit, b in zip(new, self.encode_b(new, num_threads=1)):
            a = self.encode_a(unit)
            a_ends = list(accumulate([a_sizes[i] for i in a]))
            b_ends = list(accumulate([b_sizes[i] for i in b]))
            n = len(unit) if unit.isascii() else len(unit.encode())
            # tokens spell the unit, but for U+2581, of which B makes a shorter blank
            if a_ends[-1] != n or b_ends[-1] != n:
                yield 0, 0, -1, "", []
                continue
            a_names, b_names = [names[i] for i in a], [names[i] for i in b]
            if a_ends == b_ends:  # each token has its like
                yield len(a), len(b), len(a), ";".join([f"{x}|{y}" for x, y in zip(a_names, b_names)]), [i << 32 | j for i, j in zip(a, b)]
                continue
            links = [i << 32 | j for i, (lo, hi) in zip(a, overlaps(a_ends, b_ends)) for j in b[lo:hi]]
            groups, x, y = [], 0, 0
            for p, q in cut_groups(a_ends, b_ends):
                groups.append(f"{a_names[x] if p == x + 1 else ','.join(a_names[x:p])}|{b_names[y] if q == y + 1 else ','.join(b_names[y:q])}")
                x, y = p, q
            yield len(a), len(b), len(groups), ";".join(groups), links

    def cut(self, text: str) -> list[str]:
        """The units of a text, with the blank before it. A side's tokens never reach over the borders of units."""
        if not text:
            return []
        if not self.b.cuts:
            return [" " + text]
        if ODD.search(text) or text[0].isspace():
            parts = CUT.split(" " + text)
        else:
            parts = (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else [" " + p for p in text.split(" ")]
        if not self.b.fine:
            return parts
        out: list[str] = []
        for p in parts:
            if p[1:].isalpha():
                out.append(p)
            else:
                out.extend(FINE.split(p))
        return out


class _Block:
    """Documents of some megabytes of text, with the units they are made of."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = array("q")  # A tokens, B tokens, groups and links of each unit
        self.links = array("q")
        self.ids: list[int] = []
        self.digests: list[str] = []
        self.made: list[np.ndarray] = []
        self.bytes = self.held = 0

    def add(self, one: Aligner, ids: list[int], batch: list[str]) -> None:
        cut = [one.cut(t) for t in batch]
        number = self.number
        new = list({u for units in cut for u in units if u not in number})
        for u, (n_a, n_b, n_groups, text, links) in zip(new, one.units(new)):
            number[u] = len(self.texts)
            self.texts.append(text)
            self.counts.extend((n_a, n_b, n_groups, len(links)))
            self.links.extend(links)
            self.held += 250 + 2 * len(u) + len(text) + 8 * len(links)
        texts = self.texts
        for units in cut:
            at = [number[u] for u in units]
            self.digests.append(hashlib.sha256(";".join([texts[k] for k in at]).encode()).hexdigest())
            self.made.append(np.array(at, np.int32))
        self.ids.extend(ids)
        self.bytes += sum(map(len, batch))

    def row(self, block: int) -> dict:
        """The block as one row: documents, their units, the units' links as slots of the block's pairs, and the pairs with their numbers of links here."""
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 4) if len(self.counts) else np.zeros((0, 4), np.int64)
        sizes = np.array([len(x) for x in self.made], np.int32)
        made = np.concatenate(self.made)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bad = _sums((counts[:, 2] < 0).astype(np.int64)[made], ends) > 0
        made = made[np.repeat(~bad, sizes)]  # texts that have no tokens link nothing
        sizes[bad] = 0
        ends = np.concatenate([[0], np.cumsum(sizes)])
        of_docs = [_sums(counts[made, k], ends).tolist() for k in range(4)]
        times = np.bincount(made, minlength=len(counts))
        links = np.frombuffer(self.links, np.int64) if len(self.links) else np.zeros(0, np.int64)
        pairs, slots = np.unique(links, return_inverse=True)
        n = np.bincount(slots, np.repeat(times, counts[:, 3]).astype(float), len(pairs)).astype(np.int64)
        digests = [d if k else "" for d, k in zip(self.digests, sizes.tolist())]
        return {
            "block": block,
            "docs": [dict(zip(_NAMES, d)) for d in zip(self.ids, *of_docs, digests)],
            "made": packed(made),
            "sizes": packed(sizes),
            "unit_sizes": packed(counts[:, 3].astype(np.int32)),
            "slots": packed(slots.astype(np.int32)),
            "pairs": [{"key": k, "n": m} for k, m in zip(pairs.tolist(), n.tolist())],
        }


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring ends."""
    total = np.concatenate([[0], np.cumsum(x)])[ends]
    return total[1:] - total[:-1]


_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = f"block long, docs array<struct<{_DOC.replace(' ', ': ').replace(',:', ',')}>>, made binary, sizes binary, unit_sizes binary, slots binary, pairs array<struct<key: long, n: long>>"
_doc_type = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _DOC.split(", ")])
_block_type = pa.schema([("block", pa.int64()), ("docs", pa.list_(_doc_type)), *((c, pa.binary()) for c in ("made", "sizes", "unit_sizes", "slots")), ("pairs", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))])


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches):
        one, block, n = Aligner(path_a, path_b), _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for rows, batch in by_bytes(batches, max_bytes=CHUNK_BYTES):
            block.add(one, rows.column("doc_id").to_pylist(), batch)
            if block.bytes >= BLOCK_BYTES or block.held >= UNIT_BYTES:
                yield pa.RecordBatch.from_pylist([block.row(first + n)], _block_type)
                block, n = _Block(), n + 1
                trim()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(first + n)], _block_type)

    return stored(texts(docs).mapInArrow(trimmed(run), _BLOCK))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """key (A id and B id), count of each linked pair, and whether no other A id has more links with its B id. A B id has at most as many rows as A has ids."""
    counts = blocks.select(F.explode("pairs").alias("p")).groupBy("p.key").agg(F.sum("p.n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("key").bitwiseAND(0xFFFFFFFF)))
    return counts.select("key", "count", (F.col("count") == most).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``path_a`` is a byte-level vocabulary, which gets a blank and the text; ``path_b`` a
    model file of merge type, which adds the blank itself. Texts whose bytes the tokens
    of one side don't give back, null and empty ones have zeros and an empty digest, and
    link nothing. Equal rows give equal rows and count each; rows without doc_id are
    dropped; an empty table gives an empty one; other columns are ignored.
    """
    blocks = _blocks(docs, path_a, path_b)
    asked = blocks.select("block", F.posexplode("pairs").alias("slot", "p")).select("block", "slot", F.col("p.key").alias("key"))
    # a block asks for as many pairs as its few megabytes of text link
    answers = asked.join(pair_counts(blocks), "key").groupBy("block").agg(F.collect_list(F.struct("slot", "count", "best")).alias("answers"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                answers = batch.column("answers")[row].values
                made, sizes, unit_sizes, slots = (unpacked(batch.column(c)[row].as_py(), np.int32) for c in ("made", "sizes", "unit_sizes", "slots"))
                count, best = np.zeros((2, 0 if answers is None else len(answers)), np.int64)
                if answers is not None:
                    at = answers.field("slot").to_numpy()
                    count[at] = answers.field("count").to_numpy()
                    best[at] = answers.field("best").to_numpy(zero_copy_only=False)
                cut = np.concatenate([[0], np.cumsum(unit_sizes, dtype=np.int64)])
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

                columns = {c.name: docs.field(c.name) for c in _doc_type}
                columns |= {"n_best": pa.array(_sums(_sums(best[slots], cut)[made], ends), pa.int64()), "count_sum": pa.array(_sums(_sums(count[slots], cut)[made], ends), pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in _OUT], _OUT)

    return blocks.drop("pairs").join(answers, "block", "left").mapInArrow(trimmed(run), ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _OUT))


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups of each document in order: doc_id, group, the A ids and the B ids. Texts as in ``aligned``; those without tokens have no groups."""

    def run(batches):
        one = Aligner(path_a, path_b)
        names = ["doc_id", "group", "a", "b"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for rows, batch in by_bytes(batches, max_bytes=CHUNK_BYTES):
            out: list[tuple] = []
            for i, text in zip(rows.column("doc_id").to_pylist(), batch):
                units = list(one.units(one.cut(text)))
                if all(n >= 0 for _, _, n, _, _ in units):
                    found = [g.split("|") for *_, made, _ in units for g in made.split(";")]
                    out.extend((i, k, *(list(map(int, x.split(","))) for x in g)) for k, g in enumerate(found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names)

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, group long, a array<int>, b array<int>")
