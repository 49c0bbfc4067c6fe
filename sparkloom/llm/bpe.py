"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a batch stand in one symbol array with links to their
neighbours. An index maps each active pair to all its positions; ranks are applied in
ascending order from a heap, each at all its positions, and the lists of the pairs that
a merge makes are updated. Pieces seen before come from a table of bounded size.
Vocabulary and merges stand in arrays, and pieces are encoded a slice at a time, so a
task holds a bounded amount whatever the texts are.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_bytes, texts, trim, trimmed

# Fixed values of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the pieces that a task keeps, with their ids and the table's own size.
TABLE_BYTES = 80 << 20
#: Bytes of new pieces that are encoded at a time.
SLICE_BYTES = 1 << 17
#: Text that is cut into pieces at a time.
CHUNK_BYTES = 1 << 18
#: What a table entry takes beside its letters.
ENTRY_BYTES = 220


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes whole texts with a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters], np.int32)
        self.merge = {}
        made = np.zeros((len(spec["model"]["merges"]), 3), np.int32)
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a] << 20 | vocab[b]] = rank
            made[rank] = vocab[a], vocab[b], vocab[a + b]
        self.made = made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            if t not in self.special:
                raw[i] = b"".join(back[c] for c in t)
        for t, i in self.special.items():
            raw[i] = t.encode()
        self.bytes = b"".join(raw)
        self.cut = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}  # pieces that decode to something else than themselves
        self.size = 0
        del spec, vocab, raw
        trim()

    def raw(self, i: int) -> bytes:
        """What token i stands for."""
        return self.bytes[self.cut[i] : self.cut[i + 1]]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each (distinct) piece."""
        raw = [p.encode() for p in pieces]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        first = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(first)
        sym = first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in cut[1:].tolist():
            after[e - 1] = -1
        for s in cut[:-1].tolist():
            before[s] = -1
        rank_of = self.merge.get
        index: dict[int, list[int]] = {}
        if n > 1:
            key = first[:-1].astype(np.int64) << 20 | first[1:]
            inner = np.ones(n - 1, bool)
            inner[cut[1:-1] - 1] = False
            at = np.flatnonzero(inner)
            kinds, which = np.unique(key[at], return_inverse=True)
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which, minlength=len(kinds))).tolist()
            lo = 0
            for k, hi in zip(kinds.tolist(), ends):
                rank = rank_of(k)
                if rank is not None:
                    index[rank] = at[order[lo:hi]].tolist()
                lo = hi
        active = list(index)
        heapify(active)
        grown: set[int] = set()
        while active:
            rank = heappop(active)
            places = index.pop(rank)
            if rank in grown:
                places.sort()
                grown.discard(rank)
            left, right, new = self.made[rank].tolist()
            for p in places:
                q = after[p]
                if q < 0 or sym[p] != left or sym[q] != right:
                    continue
                sym[p], sym[q] = new, -1
                r = after[p] = after[q]
                if r >= 0:
                    before[r] = p
                    again = rank_of(new << 20 | sym[r])
                    if again is not None:
                        if again in index:
                            index[again].append(p)
                        else:
                            index[again] = [p]
                            heappush(active, again)
                        grown.add(again)
                l = before[p]
                if l >= 0:
                    again = rank_of(sym[l] << 20 | new)
                    if again is not None:
                        if again in index:
                            index[again].append(l)
                        else:
                            index[again] = [l]
                            heappush(active, again)
                        grown.add(again)
        out = np.array(sym, np.int64)
        live = out >= 0
        kept = np.concatenate([[0], np.cumsum(live)])[cut].tolist()
        out = out[live].tolist()
        return [out[a:b] for a, b in zip(kept, kept[1:])]

    def _learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size < SLICE_BYTES:
                size += len(new[end])
                end += 1
            part = new[at:end]
            for piece, ids in zip(part, self.encode_pieces(part)):
                self.ids[piece] = joined = ",".join(map(str, ids))
                self.size += ENTRY_BYTES + len(piece) + len(joined)
                back = b"".join(map(self.raw, ids))
                if back != piece.encode():
                    self.back[piece] = back
            at = end

    def run(self, batch: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, their number, decoded text) of each text."""
        cut: list[list[list[str] | str]] = []
        seen: set[str] = set()
        for text in batch:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            found = [x if x in self.special else self.pieces.findall(x) for x in parts if x]
            for x in found:
                if not isinstance(x, str):
                    seen.update(x)
            cut.append(found)
        if self.size > TABLE_BYTES:  # only what this batch needs stays
            self.ids = {x: self.ids[x] for x in seen if x in self.ids}
            self.back = {x: self.back[x] for x in seen if x in self.back}
            self.size = sum(ENTRY_BYTES + len(x) + len(i) for x, i in self.ids.items())
        self._learn([x for x in seen if x not in self.ids])
        ids_of = self.ids.__getitem__

        def back_of(found):
            return b"".join(self.back.get(x, x.encode()) for x in found) if self.back else "".join(found).encode()

        out = []
        for found in cut:
            ids = ",".join(str(self.special[x]) if isinstance(x, str) else ",".join(map(ids_of, x)) for x in found)
            back = b"".join(x.encode() if isinstance(x, str) else back_of(x) for x in found)
            out.append((ids, ids.count(",") + 1 if ids else 0, back.decode("utf-8", "replace")))
        return out


def digests(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves, of each text.

    Null and empty texts have no tokens and the hash of nothing; equal rows give equal
    rows; rows without doc_id are dropped; an empty table gives an empty one; other
    columns are ignored. Special strings in a text are the special tokens.
    """

    def run(batches):
        one = Codec(path)  # of this task alone: workers live on, and would else keep the tables beside later stages
        for rows, batch in by_bytes(batches, max_bytes=CHUNK_BYTES):
            done = one.run(batch)
            cols = [
                rows.column("doc_id"),
                pa.array([n for _, n, _ in done], pa.int64()),
                pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in done]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in done]),
            ]
            if keep_ids:
                cols.append(pa.array([np.array(i.split(","), np.int32) if i else np.zeros(0, np.int32) for i, _, _ in done], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""))
