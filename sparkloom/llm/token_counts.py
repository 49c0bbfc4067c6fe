"""Token counts by a tokenizer compiled to finite-state transducers.

Two transducers run over whole batches as arrays:

1. Over characters: where pieces start (letters, single digits, other marks, and the
   contractions). Its few states allow the classical form: each chunk of the text gives
   a map from entry to exit state, the maps compose by a parallel prefix scan, and a
   second pass emits from the true entry states.
2. Over bytes, with a flag at each piece's last one: BPE itself. A token sequence is the
   encoding of its text exactly if all neighbours are, so the token automaton needs only
   the last token; made deterministic over bytes (as a set of last token, unfinished
   token, tokens still to count), its transitions carry the number of tokens emitted.
   States are built when first reached. A piece's end leads to the start state from any
   state, so a chunk cut there has a constant map, and all chunks run in step.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import chunks, texts

# Classes of characters.
BLANK, LETTER, DIGIT, MARK, QUOTE, ONE, R, V, L, E = range(10)
# States: nothing open, in letters, in marks, after a quote that may open a contraction, and after its first letter.
FREE, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
CHUNK = 256
LANE = 2048
#: States of the byte transducer that a worker keeps.
STATES = 120_000


def _piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and what is emitted: 1, a piece starts here; 2, one started a character ago."""
    to, emit = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    opens = {BLANK: FREE, DIGIT: FREE, MARK: MARKS, QUOTE: QUOTED} | dict.fromkeys((LETTER, ONE, R, V, L, E), WORD)
    for state in range(7):
        for kind in range(10):
            inside = (state == WORD and opens[kind] == WORD) or (state in (MARKS, QUOTED) and kind in (MARK, QUOTE))
            to[state, kind] = MARKS if inside and state != WORD else opens[kind]
            emit[state, kind] = 0 if inside or kind == BLANK else 1
    to[QUOTED, ONE], emit[QUOTED, ONE] = FREE, 0
    for kind, state, then in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        to[QUOTED, kind], emit[QUOTED, kind] = state, 0
        to[state], emit[state] = to[WORD], emit[WORD] | 2
        to[state, then], emit[state, then] = FREE, 0
    return to, emit


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The class of each code point."""
    if not _kinds:
        k = np.full(0x110000, MARK, np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))[0]
            if g == "L":
                k[c] = LETTER
            elif g == "N":
                k[c] = DIGIT
        k[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        k[ord("'")] = QUOTE
        for c, kind in (("s", ONE), ("t", ONE), ("m", ONE), ("d", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
            k[ord(c)] = kind
        _kinds.append(k)
    return _kinds[0]


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character, given their classes."""
    to, emit = _piece_transducer()
    n = len(kind)
    rows = -(-max(n, 1) // CHUNK)
    x = np.zeros(rows * CHUNK, np.uint8)
    x[:n] = kind
    x = np.ascontiguousarray(x.reshape(rows, CHUNK).T)
    to_flat, emit_flat = to.reshape(-1), emit.reshape(-1)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], rows, 1)
    # after a blank, or a few characters, all entry states lead to one: only chunks whose map isn't constant go on
    for j in range(CHUNK):
        maps = to_flat[maps * np.uint8(10) + x[j]]
        if j % 16 == 15 and (maps == maps[0]).all():
            state = maps[0]
            for i in range(j + 1, CHUNK):
                state = to_flat[state * np.uint8(10) + x[i]]
            maps = np.repeat(state[None], 7, 0)
            break
    # inclusive prefix scan of the maps, by doubling
    scan = maps.T.copy()
    d = 1
    while d < rows:
        scan[d:] = np.take_along_axis(scan[d:], scan[:-d].astype(np.int64), 1)
        d *= 2
    state = np.concatenate([[FREE], scan[:-1, FREE]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = state * np.uint8(10) + x[j]
        out[j] = emit_flat[at]
        state = to_flat[at]
    out = out.T.reshape(-1)[: n + 1]
    starts = (out[:n] & 1).astype(bool)
    starts[: n - 1] |= (out[1:n] & 2).astype(bool)
    if n and state_at_end(state, rows, n, to_flat, kind) >= QUOTED_R:
        starts[n - 1] = True
    return starts


def state_at_end(state, rows, n, to_flat, kind) -> int:
    """The state after the last character; where the text doesn't fill its chunk, blanks followed, which emit what was open."""
    return int(state[-1]) if n == rows * CHUNK else FREE


class ByteTransducer:
    """BPE with word ends, deterministic over bytes, built as it is used."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.rank = {}
        for i, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = i
        self.letters, self.suffix = letters, suffix
        self.names = {i: t for t, i in vocab.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token: dict[int, int] = {}
        self.last: dict[int, int] = {}  # node << 8 | byte: token that ends a piece
        nodes = 1
        for t, i in vocab.items():
            end = t.endswith(suffix) and t != suffix
            body = [byte[c] for c in (t[: -len(suffix)] if end else t)]
            node = 0
            for b in body[:-1] if end else body:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = nodes
                    nodes += 1
                node = nxt
            if end:
                self.last[node << 8 | body[-1]] = i
            else:
                self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.state = {((-1, 0, 0),): 0}
        self.items = [((-1, 0, 0),)]
        self.columns = np.full(512, -1, np.int32)
        self.n_columns = 0
        self.to = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)
        self.pairs.clear()

    def _grow(self, rows: int, columns: int) -> None:
        self.to = np.pad(self.to, ((0, rows), (0, columns)), constant_values=-1)
        self.emit = np.pad(self.emit, ((0, rows), (0, columns)))

    def symbols(self, t: str) -> list[str]:
        end = t.endswith(self.suffix) and t != self.suffix
        body = list(t[: -len(self.suffix)] if end else t)
        if end:
            body[-1] += self.suffix
        return body

    def encode(self, s: list[str]) -> list[str]:
        s = list(s)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 30))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def neighbours(self, a: int, t: int) -> bool:
        """Whether tokens a and t in a row are how their text is encoded."""
        key = (a + 1) << 20 | t
        if key not in self.pairs:
            want = ([self.names[a]] if a >= 0 else []) + [self.names[t]]
            self.pairs[key] = self.encode([c for w in want for c in self.symbols(w)]) == want
        return self.pairs[key]

    def column(self, symbol: int) -> int:
        if self.columns[symbol] < 0:
            if self.n_columns == self.to.shape[1]:
                self._grow(0, 16)
            self.columns[symbol] = self.n_columns
            self.n_columns += 1
        return int(self.columns[symbol])

    def build(self, state: int, symbol: int) -> None:
        b, end, column = symbol & 255, symbol >> 8, self.column(symbol)
        if end:
            counts = [r + 1 for a, node, r in self.items[state] if (t := self.last.get(node << 8 | b)) is not None and self.neighbours(a, t)]
            to, emit = 0, counts[0]
        else:
            found = {}
            for a, node, r in self.items[state]:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    continue
                found[a, nxt] = r
                t = self.token.get(nxt)
                if t is not None and self.neighbours(a, t):
                    found[t, 0] = r + 1
            emit = min(found.values())
            key = tuple(sorted((a, node, r - emit) for (a, node), r in found.items()))
            to = self.state.get(key)
            if to is None:
                to = self.state[key] = len(self.items)
                self.items.append(key)
                if to == len(self.to):
                    self._grow(to // 4, 0)
        self.to[state, column], self.emit[state, column] = to, emit

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = self.columns[symbol]
        to = self.to[state, col]
        new = np.flatnonzero((to < 0) | (col < 0))
        if len(new):
            for p in np.unique(state[new].astype(np.int64) << 9 | symbol[new]).tolist():
                self.build(p >> 9, p & 511)
            col = self.columns[symbol]
            to = self.to[state, col]
        return to, self.emit[state, col]

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte; the last byte ends a piece."""
        if len(self.items) > STATES:
            self.reset()
        n = len(symbols)
        out = np.zeros(n, np.int16)
        if not n:
            return out
        ends = np.flatnonzero(symbols >= 256) + 1
        cut = np.unique(np.concatenate([[0], ends[np.minimum(np.searchsorted(ends, np.arange(LANE, n, LANE)), len(ends) - 1)], [n]]))
        start, size = cut[:-1], np.diff(cut)
        for i in np.flatnonzero(size > 8 * LANE).tolist():  # a very long piece runs by itself
            state = np.zeros(1, np.int32)
            for p in range(start[i], start[i] + size[i]):
                state, out[p : p + 1] = self.step(state, symbols[p : p + 1])
        ok = size <= 8 * LANE
        start, size = start[ok], size[ok]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state = np.zeros(len(start), np.int32)
        live = len(start)
        for j in range(int(size[0]) if live else 0):
            while size[live - 1] <= j:
                live -= 1
            at = start[:live] + j
            state[:live], out[at] = self.step(state[:live], symbols[at])
        return out


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.bytes = ByteTransducer({t: i for t, i in model["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}, model["merges"], model["end_of_word_suffix"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def count(self, batch: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        extra = np.zeros(len(batch), np.int64)
        clean = []
        for i, t in enumerate(batch):
            if "<|" in t:
                t, extra[i] = self.split.subn("\n", t)
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            clean.append(t.lower())
        size = np.array([len(t) for t in clean], np.int64) + 1
        cut = np.concatenate([[0], np.cumsum(size)])
        cp = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le"), "<u4") if clean else np.zeros(0, np.uint32)
        kind = kinds()[cp]
        starts = piece_starts(kind)
        keep = kind != BLANK
        before = np.concatenate([[0], np.cumsum(keep)])[cut]  # kept characters before each text
        cp, starts = cp[keep], starts[keep]
        n = len(cp)
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        last = np.cumsum(width) - 1
        symbols = np.frombuffer(cp.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        ends = np.ones(n, bool)
        ends[:-1] = starts[1:]
        symbols[last[ends]] += 256
        total = np.concatenate([[0], np.cumsum(self.bytes.emitted(symbols), dtype=np.int64)])
        at = np.concatenate([[0], last + 1])[before]
        return total[at[1:]] - total[at[:-1]] + extra


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each text.

    Null and empty texts have no tokens; equal rows give equal rows; rows without
    doc_id are dropped; an empty table gives an empty one; other columns are ignored.
    Special strings in a text count as one token each.
    """

    def run(batches):
        one = counter(path)
        for rows, _, off in chunks(batches):
            n = one.count(["" if t is None else t for t in rows.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
