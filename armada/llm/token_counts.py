"""Token counts by a compiled finite-state transducer (operator 7).

The tokenizer is compiled into a deterministic transducer over the bytes of
its normalised text. A state holds what the next byte can depend on: for
every boundary of the current word that a token may still reach back to,
the trie node of the bytes since then, the last token before it, and how
many tokens fewer were there. Every transition carries the change of the
token count, every state the tokens still due at the end of a word. States
are made the first time they are met and the table is emptied when it holds
``MAX_STATES``, so memory is bounded and the counts do not depend on it.

A batch of texts becomes one symbol stream, cut into chunks of equal length
that run in lockstep. A chunk's state map is found without its start state:
from its first word start on it is constant, and the few bytes before run
once the state is known. The maps compose from left to right by a prefix
scan; only a chunk inside a single longer word waits for its neighbour.

Defined results: NULL and empty texts have no tokens; the tokenizer's
special strings inside a text count as the one token the library makes of
them; rows that share a document id are counted one by one; very long texts are
counted whole, chunk by chunk; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import merges
from armada.llm.token_files import slices

MAX_STATES = 250_000
CHUNK = 1024               # symbols per lane
BATCH_BYTES = 4 << 20
ROOT, DEAD = 0, 1
SPACE, LETTER, NUMBER, OTHER, HARD, UNSEEN = 0, 1, 2, 3, 4, 255
#: The pre-tokeniser this front end implements, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


class Transducer:
    """Lazily built transducer; open-addressing table of (state, byte)."""

    def __init__(self, model: merges.MergeModel, trie: merges.Trie):
        self.model, self.trie = model, trie
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.due = np.zeros(1 << 12, np.int32)     # tokens added if a word ends here
        self.keys = np.full(1 << 14, -1, np.int64)
        self.next = np.zeros(1 << 14, np.int32)
        self.change = np.zeros(1 << 14, np.int16)
        self.used = 0
        self._state(array("i", [0, -1, 0]).tobytes())      # ROOT
        self._state(b"dead")                               # DEAD: start not known yet
        for b in range(256):
            self._insert(DEAD << 8 | b, DEAD, 0)

    def _state(self, key: bytes) -> int:
        s = self.ids.get(key)
        if s is None:
            s = self.ids[key] = len(self.states)
            self.states.append(key)
            if s == len(self.due):
                self.due = np.concatenate([self.due, np.zeros(s, np.int32)])
            if key != b"dead":
                self.due[s] = self._due(key)
        return s

    def _due(self, key: bytes) -> int:
        a = array("i", key)
        for i in range(0, len(a), 3):
            t = self.trie.final[a[i]]
            if t >= 0 and (a[i + 1] < 0 or self.model.fits(a[i + 1], t)):
                return a[i + 2] + 1
        return 0

    def _step(self, key: int) -> tuple[int, int]:
        state, b = array("i", self.states[key >> 8]), key & 255
        child, token, final, fits = self.trie.child, self.trie.token, self.trie.final, self.model.fits
        opened, best = [], None
        for i in range(0, len(state), 3):
            node = child[state[i]].get(b)
            if node is None:
                continue
            last, n = state[i + 1], state[i + 2]
            t = token[node]
            if best is None and t >= 0 and (last < 0 or fits(last, t)):
                best = (t, n + 1)
            if child[node] or final[node] >= 0:
                opened.append((node, last, n))
        t, n = best
        out = array("i")
        for node, last, c in opened:
            out.extend((node, last, c - n))
        out.extend((0, t, 0))
        return self._state(out.tobytes()), n

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        size = len(self.keys)
        shift = np.uint64(64 - size.bit_length() + 1)
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _insert(self, key: int, state: int, change: int) -> None:
        if 2 * self.used >= len(self.keys):
            old = self.keys >= 0
            ks, ns, cs = self.keys[old], self.next[old], self.change[old]
            size = 2 * len(self.keys)
            self.keys = np.full(size, -1, np.int64)
            self.next, self.change = np.zeros(size, np.int32), np.zeros(size, np.int16)
            self.used = 0
            for k, n, c in zip(ks.tolist(), ns.tolist(), cs.tolist()):
                self._put(k, n, c)
        self._put(key, state, change)

    def _put(self, key: int, state: int, change: int) -> None:
        size = len(self.keys)
        i = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - size.bit_length() + 1)
        while self.keys[i] >= 0:
            i = i + 1 & size - 1
        self.keys[i], self.next[i], self.change[i] = key, state, change
        self.used += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Table slots of (state << 8 | byte) keys; missing ones are made."""
        slot = self._slots(keys)
        found = self.keys[slot]
        bad = np.flatnonzero(found != keys)
        while len(bad):
            empty = found[bad] < 0
            if empty.any():
                for k in np.unique(keys[bad[empty]]).tolist():
                    self._insert(k, *self._step(k))
                return self.find(keys)
            slot[bad] = (slot[bad] + 1) & (len(self.keys) - 1)
            found[bad] = self.keys[slot[bad]]
            bad = bad[found[bad] != keys[bad]]
        return slot

    def _run(self, state, symbols, starts, ends, out, lanes) -> np.ndarray:
        """Lockstep over the rows of ``symbols`` (time by lane)."""
        for t in range(len(symbols)):
            state = np.where(starts[t], ROOT, state)
            slot = self.find(state << 8 | symbols[t])
            state = self.next[slot].astype(np.int64)
            out[t, lanes] += self.change[slot] + np.where(ends[t], self.due[state], 0)
        return state

    def counts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens by symbol. ``starts``: whether a word starts at the symbol."""
        if len(self.states) > MAX_STATES:
            self.clear()
        n = len(symbols)
        if n == 0:
            return np.zeros(0, np.int64)
        lanes = -(-n // CHUNK)
        pad = lanes * CHUNK - n
        ends = np.append(starts[1:], True)

        def laid(x, fill):
            return np.ascontiguousarray(np.append(x, np.full(pad, fill, x.dtype)).reshape(lanes, CHUNK).T)

        sym, beg, end = laid(symbols.astype(np.int64), 0), laid(starts, False), laid(ends, False)
        if pad:  # the padding is a word of its own that is not counted
            beg[CHUNK - pad, lanes - 1] = True
        out = np.zeros((CHUNK, lanes), np.int64)
        state = np.full(lanes, DEAD, np.int64)
        state[0] = ROOT
        leave = self._run(state, sym, beg, end, out, slice(None))
        # Scan of the chunk maps: constant ones give their state to the right at once.
        first = np.where(beg.any(0), beg.argmax(0), CHUNK)
        first[0] = 0
        waiting = np.flatnonzero(first > 0)
        while len(waiting):
            ready = waiting[leave[waiting - 1] != DEAD]
            span = int(first[ready].max())
            come = leave[ready - 1].copy()
            for t in range(span):
                live = np.flatnonzero(t < first[ready])
                slot = self.find(come[live] << 8 | sym[t, ready[live]])
                come[live] = self.next[slot]
                out[t, ready[live]] += self.change[slot] + np.where(end[t, ready[live]], self.due[come[live]], 0)
            whole = first[ready] == CHUNK
            leave[ready[whole]] = come[whole]
            waiting = np.setdiff1d(waiting, ready, assume_unique=True)
        flat = out.T.reshape(-1)
        return flat[:n]


class Front:
    """Normalised code points, classes and word starts, as the library makes
    them: what it does to a character is asked from it the first time."""

    def __init__(self, tok, specials: list[str]):
        self.tok, self.specials = tok, specials
        self.low = np.zeros(sys.maxunicode + 1, np.uint32)
        self.kind = np.full(sys.maxunicode + 1, UNSEEN, np.uint8)
        second = set(range(0x1160, 0x1200))  # conjoining vowels and finals
        for c in range(sys.maxunicode + 1):
            d = unicodedata.decomposition(chr(c))
            if d and d[0] != "<" and " " in d:
                second.add(int(d.split()[-1], 16))
        self.second = second

    def learn(self, points: np.ndarray) -> None:
        for c in np.unique(points[self.kind[points] == UNSEEN]).tolist():
            ch = chr(c)
            low = self.tok.normalizer.normalize_str(ch)
            if len(low) != 1 or unicodedata.combining(ch) or c in self.second:
                self.kind[c], self.low[c] = HARD, c
            else:
                self.kind[c], self.low[c] = self.kind_of(low), ord(low)

    def kind_of(self, low: str) -> int:
        words = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s))
        if low.isspace() and words(low) == 0:
            return SPACE
        if words(f"a{low}a") == 1:
            return LETTER
        return OTHER if words(f"!{low}!") == 1 else NUMBER if words(low) else SPACE

    def points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised code points, kinds, first index of each text); each text
        ends with a line feed."""
        def decode(ts):
            return np.frombuffer("".join(t + "\n" for t in ts).encode("utf-32-le"), "<u4").astype(np.int64)

        cps = decode(texts)
        self.learn(cps)
        kind = self.kind[cps]
        if (kind == HARD).any():  # texts with combining characters go through the library's normaliser whole
            at = np.cumsum([0, *(len(t) + 1 for t in texts)])
            hard = set((np.searchsorted(at, np.flatnonzero(kind == HARD), side="right") - 1).tolist())
            texts = [self.tok.normalizer.normalize_str(t) if i in hard else t for i, t in enumerate(texts)]
            cps = decode(texts)
            self.learn(cps)
            kind = self.kind[cps].copy()
            for c in np.unique(cps[kind == HARD]).tolist():
                kind[cps == c] = self.kind_of(chr(c))
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        return self.low[cps], kind, first

    def stream(self, texts: list[str]):
        """(symbols, word starts, first symbol of each text)."""
        cps, kind, first = self.points(texts)
        n = len(cps)
        before = np.append(np.uint8(SPACE), kind[:-1])
        start = (kind != before) | (kind == NUMBER)
        quote = np.flatnonzero((cps == 0x27) & (before != OTHER))
        padded = np.append(cps, [0, 0, 0, 0])
        taken = np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            hit = ~taken
            for k, ch in enumerate(c, 1):
                hit &= padded[quote + k] == ord(ch)
            taken |= hit
            q = quote[hit]
            for k in range(1, len(c) + 1):
                start[q + k] = False
            after = q + len(c) + 1
            after = after[after < n]
            start[after] = True
        keep = kind != SPACE
        cps, start, index = cps[keep], start[keep], np.cumsum(keep) - keep
        raw = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.append(0, np.cumsum(width))
        begins = np.zeros(len(raw), bool)
        begins[at[:-1][start]] = True
        return raw, begins, at[index[first]]


class Counter:
    """Compiled tokenizer: token counts of texts."""

    def __init__(self, tokenizer_json: str, model=None):
        from tokenizers import Tokenizer
        spec = json.loads(tokenizer_json)
        split = spec["pre_tokenizer"]["pretokenizers"]
        if split[0]["pattern"]["Regex"] != PATTERN or split[1]["type"] != "ByteLevel" or spec["model"]["unk_token"]:
            raise ValueError("this tokenizer's pre-tokeniser has no transducer here")
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.front = Front(Tokenizer.from_str(tokenizer_json), self.specials)
        self.machine = Transducer(*(model or merges.from_word_bpe(tokenizer_json)))

    def count(self, texts: list) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        clean = []
        for i, t in enumerate(texts):
            t = t or ""
            if "<" in t or any(s[:1] != "<" for s in self.specials):
                for s in self.specials:
                    if s in t:
                        extra[i] += t.count(s)
                        t = t.replace(s, "\n")
            clean.append(t)
        symbols, starts, first = self.front.stream(clean)
        total = np.append(0, np.cumsum(self.machine.counts(symbols, starts)))
        return np.diff(total[np.append(first, len(symbols))]) + extra


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. No shuffle;
    the compiled merges (as large as the vocabulary) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, merges.from_word_bpe(tokenizer_json)))

    def run(batches):
        text, model = shared.value
        key = hash(text)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(text, model)
        counter = _COUNTERS[key]
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column, BATCH_BYTES):
                part = column.slice(a, b - a)
                tokens = counter.count(part.to_pylist())
                size = np.asarray(pc.fill_null(pc.binary_length(part), 0)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(tokens),
                                                  pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
