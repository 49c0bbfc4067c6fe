"""SentencePiece BPE encoding and decoding by backtracking.

Merges of such a model are ranked by the score of the piece that they make, ties by
place. Whether a merge happens depends on the two symbols only, so a sequence of pieces
is the encoding of a text if and only if each piece is what its own letters merge to and
no merge crosses the border of two neighbours when both are merged again side by side.
The encoder takes the longest piece at each place (found by one Aho-Corasick pass), goes
on with the next shorter one where it doesn't get along with the piece before, and gives
a piece back where none does; a bit for each place says whether it failed already, so
each place is left for good at most once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, texts, trim, trimmed

SPACE = "▁"
#: Latin letters, as a class of signs.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
# Fixed values of the model file: kinds of pieces.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: Bytes of the units that a task keeps since the last turn, with what they encode to; as many of before may stay beside them.
TABLE_BYTES = 32 << 20
#: What a table entry takes beside its letters.
ENTRY_BYTES = 200
#: Pairs of pieces whose agreement is kept.
PAIRS = 100_000
#: Longer units are encoded anew each time.
LONG = 1 << 12
CHUNK_BYTES = 1 << 18
NEVER = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class _Units(dict):
    """What units encode to, worked out when first asked for. Those asked for lately stay when the table is full."""

    def __init__(self, work):
        self.work = work
        self.before: dict[str, str] = {}
        self.bytes = 0

    def __missing__(self, unit: str) -> str:
        value = self.before.get(unit)
        if value is None:
            value = self.work(unit)
        if len(unit) <= LONG:
            self[unit] = value
            self.bytes += ENTRY_BYTES + len(unit) + len(value)
        return value

    def turn(self) -> None:
        """Lets go of what wasn't asked for since the last turn."""
        self.before = dict(self)
        self.clear()
        self.bytes = 0


class PieceCodec:
    """Encodes and decodes whole texts with a model file of merge type, with byte fallback and without a table of normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[str] = []
        self.byte_of: dict[int, int] = {}
        self.byte_ids = [-1] * 256
        normaliser: dict[int, bytes | int] = {3: 1, 4: 1, 5: 1}
        trainer: dict[int, bytes | int] = {}
        for n, value in _fields(raw):
            if n == 1:
                piece = dict(_fields(value))
                name, kind, i = piece[1].decode(), piece.get(3, NORMAL), len(self.text)
                if kind == NORMAL:
                    self.ids[name] = i
                    self.score[name] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                elif kind == BYTE:
                    b = int(name[3:5], 16)
                    self.byte_ids[b], self.byte_of[i] = i, b
                elif kind == USER_DEFINED:
                    raise ValueError("pieces defined by the user are not supported")
                self.text.append(name)
            elif n == 2:
                trainer = dict(_fields(value))
            elif n == 3:
                normaliser |= dict(_fields(value))
        if trainer.get(3) != 2 or -1 in self.byte_ids:
            raise ValueError("the model must be of merge type, with byte fallback")
        if normaliser.get(2) or normaliser[4] or not normaliser[5] or not normaliser[3]:
            raise ValueError("the model must add a blank before a text, write blanks as U+2581, and change nothing else")
        #: Whether no piece has a blank after another letter; then nothing merges across the start of a run of blanks.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.ids)
        #: Whether no piece has a Latin letter beside another sign; then nothing merges across such a border.
        self.fine = self.cuts and not any(re.search(f"[{LATIN}][^{LATIN}{SPACE}]|[^{LATIN}{SPACE}][{LATIN}]", x) for x in self.ids)
        self.unit = re.compile(f" *(?:[{LATIN}]+|[^{LATIN} ]+)| +" if self.fine else " +[^ ]*")
        self.longest = ahocorasick.Automaton()
        for x in self.ids:
            self.longest.add_word(x, len(x))
        self.longest.make_automaton()
        self.raw_of = [bytes([self.byte_of[i]]) if i in self.byte_of else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]
        self.names = list(map(str, range(len(self.text))))
        self.traces: dict[str, tuple | None] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.units = _Units(self._learn)
        self.back: dict[str, str] = {}  # units that decode to something else than themselves
        trim()

    def _learn(self, unit: str) -> str:
        ids = self.encode_unit(unit)
        back = self.raw(ids).decode("utf-8", "replace")
        if back != unit:
            self.back[unit] = back
        names = self.names
        return ",".join([names[i] for i in ids])

    def trace(self, token: str) -> tuple | None:
        """How a piece's own letters merge: the scores of the merges in order, and the right and left end symbol before each and at the end; None if they don't merge to the piece."""
        if token not in self.traces:
            symbols = list(token)
            scores, right, left = [], [symbols[-1]], [symbols[0]]
            while len(symbols) > 1:
                best, at = NEVER, -1
                for k in range(len(symbols) - 1):
                    s = self.score.get(symbols[k] + symbols[k + 1])
                    if s is not None and s > best:
                        best, at = s, k
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                scores.append(best)
                right.append(symbols[-1])
                left.append(symbols[0])
            self.traces[token] = (scores + [NEVER], right, left) if len(symbols) == 1 else None
        return self.traces[token]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay two pieces when their letters are merged again side by side."""
        scores_a, right, _ = self.trace(a)
        scores_b, _, left = self.trace(b)
        i = j = 0
        while True:
            across = self.score.get(right[i] + left[j])
            x, y = scores_a[i], scores_b[j]
            if across is not None and across > x and across >= y:  # of equal scores the leftmost merges first
                return False
            if x == y == NEVER:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def _shorter(self, token: str) -> str | None:
        """The next shorter piece that a piece starts with; a single letter counts as one."""
        found = self.shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if k == 1 or token[:k] in self.ids), None)
        return found

    def split(self, s: str) -> list[str]:
        """The pieces of a text with its blanks written as U+2581; letters that no piece has stand for themselves."""
        n = len(s)
        size = [1] * n
        for end, k in self.longest.iter(s):
            size[end - k + 1] = k  # later ends are longer
        alive = bytearray(b"\xff") * (n // 8 + 1)
        agree, shorter = self.agree, self.shorter
        tokens: list[str] = []
        at, last = 0, ""
        token = s[: size[0]] if n else ""
        while at < n:
            end = at + len(token)
            if alive[end >> 3] >> (end & 7) & 1:
                good = agree.get((last, token))
                if good is None:
                    if len(agree) >= PAIRS:
                        agree.clear()
                    good = agree[last, token] = self.trace(token) is not None and (not last or self.compatible(last, token))
                if good:
                    tokens.append(token)
                    at, last = end, token
                    if at < n:
                        token = s[at : at + size[at]]
                    continue
            token = shorter[token] if token in shorter else self._shorter(token)
            while token is None:
                alive[at >> 3] &= ~(1 << (at & 7))
                last = tokens.pop()
                at -= len(last)
                token = shorter[last] if last in shorter else self._shorter(last)
                last = tokens[-1] if tokens else ""
        return tokens

    def encode_unit(self, unit: str) -> list[int]:
        """Token ids of a unit."""
        tokens = self.split(unit.replace(" ", SPACE))
        try:
            return [self.ids[t] for t in tokens]
        except KeyError:
            return [i for t in tokens for i in ([self.ids[t]] if t in self.ids else [self.byte_ids[b] for b in t.encode()])]

    def raw(self, ids: list[int]) -> bytes:
        """What token ids stand for, U+2581 as a blank."""
        return b"".join(map(self.raw_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, without the blank that stands before each text."""
        return self.raw(ids).decode("utf-8", "replace").removeprefix(" ")

    def cut(self, text: str) -> list[str]:
        """The units of a text, with the blank before it: runs of blanks and what follows them."""
        if not text:
            return []
        s = " " + text.replace(SPACE, " ")
        return self.unit.findall(s) if self.cuts else [s]

    def run(self, batch: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, their number, decoded text) of each text."""
        out = []
        for text in batch:
            if self.units.bytes > TABLE_BYTES:
                self.units.turn()
            if len(self.back) > PAIRS:
                self.back.clear()
                self.units.turn()
                self.units.before = {}
            units = self.cut(text)
            ids = ",".join(map(self.units.__getitem__, units))
            back = "".join([self.back.get(u, u) for u in units] if self.back else units)
            out.append((ids, ids.count(",") + 1 if ids else 0, back.removeprefix(" ")))
        return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the decoded text of each text.

    Null and empty texts have no tokens and decode to an empty text; equal rows give
    equal rows; rows without doc_id are dropped; an empty table gives an empty one;
    other columns are ignored. Strings of control pieces inside a text are plain text.
    """
    return _run(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded string", lambda ids, text: (np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32), text))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encoded``, with SHA-256 digests of the ids, joined by commas, and of the decoded text instead of both."""
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))


def _run(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.list_(pa.int32()) if "array" in c else pa.string() for c in schema.split(", ")[2:]]

    def run(batches):
        one = PieceCodec(path)  # of this task alone: workers live on
        for rows, batch in by_bytes(batches, max_bytes=CHUNK_BYTES):
            done = one.run(batch)
            made = list(zip(*(columns(ids, text) for ids, _, text in done)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([n for _, n, _ in done], pa.int64()), *(pa.array(list(c), k) for c, k in zip(made, kinds))], names)

    return texts(docs).mapInArrow(trimmed(run), schema)
