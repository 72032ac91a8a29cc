"""Byte-pair merge models as lattices.

A byte-pair encoding of a text is the one segmentation in which every two
neighbouring tokens, encoded as a text of their own, stay as they are: the
first merge across a boundary of the whole run would also be the next merge
of the run over these two tokens alone. So a prefix of a text has exactly one
possible last token, and one backpointer per boundary describes all
surviving paths. ``fits(a, b)`` answers whether two tokens may be
neighbours; operators 6 and 7 build on it.
"""

from __future__ import annotations

import json
import struct
from array import array

import numpy as np

INF = 1 << 60
LOW = (1 << 32) - 1
LIFE = struct.Struct("<qq")
FITS_KEPT = 500_000  # pairs remembered
MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Fixed map of keys from 0 on to numbers, asked for many keys at a time: open addressing in arrays."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # one of those that meet in a slot stays
            left = self.keys[slot] != keys
            self.values[slot[~left]] = values[~left]
            keys, values, slot = keys[left], values[left], slot[left] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key, -1 for those that are not there."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        bad = np.flatnonzero((found != keys) & (found >= 0))
        while len(bad):
            slot[bad] = slot[bad] + 1 & self.mask
            found = self.keys[slot[bad]]
            hit = found == keys[bad]
            out[bad[hit]] = self.values[slot[bad[hit]]]
            bad = bad[~hit & (found >= 0)]
        return out


class MergeModel:
    """Tokens, their merges by priority, and the lives of the symbols at
    their two ends.

    ``merges``: (left id, right id) -> (rank, merged id); lower ranks first,
    leftmost first among equals. ``symbols``: token id -> ids of its first
    symbols.
    """

    def __init__(self, merges: dict, symbols: dict):
        # One number for each pair and each merge: a worker holds tens of thousands of them.
        self.merges = {a << 32 | b: rank << 32 | new for (a, b), (rank, new) in merges.items()}
        born: dict[int, int] = {}
        for (_, _), (rank, new) in merges.items():
            born[new] = min(born.get(new, INF), rank)
        # Whether a symbol is always older than what it is merged into: then ranks tell the time.
        self.in_order = all(rank > max(born.get(a, -1), born.get(b, -1)) for (a, b), (rank, _) in merges.items())
        self.symbols = {} if self.in_order else {t: array("i", seq).tobytes() for t, seq in symbols.items()}
        self.left: dict[int, bytes] = {}    # token -> (symbol, rank that consumes it), ... at its left end, as LIFE
        self.right: dict[int, bytes] = {}
        for t, seq in symbols.items():
            end = self._run(seq)
            if end is not None and end[0] == t:
                self.left[t], self.right[t] = (b"".join([LIFE.pack(*pair) for pair in life]) for life in end[1:])
        self._fits: dict[int, bool] = {}
        self._arrays = None

    def _run(self, seq: list[int]):
        """Encode alone: (token, left life, right life) if one token is left."""
        seq, merges = list(seq), self.merges
        left, right = [], []
        while len(seq) > 1:
            best, at = None, -1
            for i in range(len(seq) - 1):
                m = merges.get(seq[i] << 32 | seq[i + 1])
                if m is not None and (best is None or m >> 32 < best >> 32):
                    best, at = m, i
            if best is None:
                return None
            if at == 0:
                left.append((seq[0], best >> 32))
            if at == len(seq) - 2:
                right.append((seq[-1], best >> 32))
            seq[at:at + 2] = [best & LOW]
        return seq[0], (*left, (seq[0], INF)), (*right, (seq[0], INF))

    def encode(self, seq: list[int]) -> list[int]:
        """Plain greedy merging, for tests."""
        seq = list(seq)
        while True:
            found = [(m >> 32, i, m & LOW) for i in range(len(seq) - 1)
                     if (m := self.merges.get(seq[i] << 32 | seq[i + 1])) is not None]
            if not found:
                return seq
            _, i, new = min(found)
            seq[i:i + 2] = [new]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge would ever join the end of ``a`` with the start of ``b``."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            starts, merges = [*LIFE.iter_unpack(self.left[b])], self.merges
            meet = [(m >> 32, gone_x, gone_y) for x, gone_x in LIFE.iter_unpack(self.right[a]) for y, gone_y in starts
                    if (m := merges.get(x << 32 | y)) is not None]
            if self.in_order:
                known = not any(rank < gone_x and rank <= gone_y for rank, gone_x, gone_y in meet)
            else:
                known = not meet or self._apart(a, b)
            if len(self._fits) > FITS_KEPT:
                self._fits.clear()
            self._fits[key] = known
        return known

    def fits_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for every two neighbours in two arrays."""
        if self._arrays is None:
            ranks = np.fromiter(self.merges.values(), np.int64, len(self.merges)) >> 32
            self._arrays = (Table(np.fromiter(self.merges, np.int64, len(self.merges)), ranks),
                            self._lives(self.right), self._lives(self.left))
        ranks, (x_at, x_life), (y_at, y_life) = self._arrays
        n_y = y_at[b + 1] - y_at[b]
        size = (x_at[a + 1] - x_at[a]) * n_y
        row = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        x, gone_x = x_life[x_at[a][row] + k // n_y[row]].T
        y, gone_y = y_life[y_at[b][row] + k % n_y[row]].T
        rank = ranks.get(x << 32 | y)
        out = np.ones(len(a), bool)
        if self.in_order:
            out[row[(rank >= 0) & (rank < gone_x) & (rank <= gone_y)]] = False
        else:
            out[row[rank >= 0]] = False
            meet = np.flatnonzero(~out)
            out[meet] = [self._apart(*pair) for pair in zip(a[meet].tolist(), b[meet].tolist())]
        return out

    @staticmethod
    def _lives(of: dict) -> tuple[np.ndarray, np.ndarray]:
        """Lives by token: where each token's begin, and all of them one after another."""
        sizes = np.zeros(max(of, default=-1) + 2, np.int64)
        for t, life in of.items():
            sizes[t + 1] = len(life) // LIFE.size
        raw = b"".join([of[t] for t in sorted(of)])
        return np.cumsum(sizes), np.frombuffer(raw, "<i8").astype(np.int64).reshape(-1, 2)

    def _apart(self, a: int, b: int) -> bool:
        """Run both tokens together until a merge crosses from one to the other."""
        first, merges = array("i", self.symbols[a]), self.merges
        seq, cut = [*first, *array("i", self.symbols[b])], len(first)
        while True:
            best, at = None, -1
            for i in range(len(seq) - 1):
                m = merges.get(seq[i] << 32 | seq[i + 1])
                if m is not None and (best is None or m >> 32 < best >> 32):
                    best, at = m, i
            if best is None:
                return True
            if at == cut - 1:
                return False
            seq[at:at + 2] = [best & LOW]
            cut -= at < cut

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_fits", "_arrays")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fits, self._arrays = {}, None


class Trie:
    """Children by symbol; the token, and the token that must end a word, at each node."""

    def __init__(self):
        self.child: list[dict] = [{}]
        self.token: list[int] = [-1]
        self.final: list[int] = [-1]

    def add(self, path, token: int, final: bool = False) -> None:
        node = 0
        for s in path:
            nxt = self.child[node].get(s)
            if nxt is None:
                nxt = len(self.child)
                self.child[node][s] = nxt
                self.child.append({})
                self.token.append(-1)
                self.final.append(-1)
            node = nxt
        (self.final if final else self.token)[node] = token


def from_word_bpe(tokenizer_json: str) -> tuple[MergeModel, Trie]:
    """Byte-level merges with an end-of-word suffix on a word's last symbol."""
    model = json.loads(tokenizer_json)["model"]
    suffix = model["end_of_word_suffix"] or ""
    vocab, letters = model["vocab"], byte_letters()
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    merges = {}
    for rank, (a, b) in enumerate(pairs):
        whole = (a[: -len(suffix)] if suffix and a.endswith(suffix) else a) + b
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[whole]))
    symbols, trie, paths = {}, Trie(), {}
    for text, t in vocab.items():
        final = bool(suffix) and text.endswith(suffix) and len(text) > len(suffix)
        body = text[: -len(suffix)] if final else text
        if not body or any(c not in letters for c in body):
            continue
        seq = list(body)
        if final:
            seq[-1] += suffix
        symbols[t] = [vocab[s] for s in seq]
        paths[t] = ([letters[c] for c in body], final)
    merge_model = MergeModel(merges, symbols)
    for t, (path, final) in paths.items():
        if t in merge_model.left:  # a token that its own text never yields is in no encoding
            trie.add(path, t, final)
    return merge_model, trie


def from_piece_scores(pieces: list[tuple[str, float]]) -> tuple[MergeModel, Trie]:
    """Merges of a piece vocabulary: two neighbours merge if their
    concatenation is a piece, best score first. ``pieces``: (text, score) by
    id, text None for control, unknown and byte pieces."""
    ids = {p: i for i, (p, _) in enumerate(pieces) if p is not None}
    order = {s: r for r, s in enumerate(sorted({s for p, s in pieces if p is not None}, reverse=True))}
    merges = {}
    for p, i in ids.items():
        for cut in range(1, len(p)):
            a, b = ids.get(p[:cut]), ids.get(p[cut:])
            if a is not None and b is not None:
                merges[a, b] = (order[pieces[i][1]], i)
    model = MergeModel(merges, {i: [ids[c] for c in p] for p, i in ids.items() if all(c in ids for c in p)})
    trie = Trie()
    for p, i in ids.items():
        if i in model.left:
            trie.add(p, i)
    return model, trie
