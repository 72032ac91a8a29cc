"""SentencePiece encoding and decoding by streaming Viterbi (operator 6).

The lattice has a node per character boundary and an arc per vocabulary
piece. For a merge-type model a path is feasible if every two neighbouring
pieces fit (see ``merges``), which leaves one surviving backpointer per
boundary and gives the library's own ids; for a unigram model the survivor
is the path with the best sum of scores. Either way the encoder keeps only
the boundaries that a piece can still reach back to, at most the longest
piece's length, and commits ids as soon as the backpointer paths of all of
them meet in one boundary, so memory does not grow with the text.

White space becomes U+2581, with one in front of a non-empty text.
Characters outside the vocabulary become byte pieces. No piece crosses the
start of a run of U+2581, an unknown character or two neighbours that no
piece holds, so all paths meet there; what lies between is encoded once per
bounded cache. Words are cut from the marks behind them where that holds.
With a merge-type model the new chunks of a slice that fit the open window
run through the lattice many at a time, in lockstep.

Defined results: NULL and empty texts have no ids; decoding gives back the
text (a literal U+2581 comes back as a space, as in the library); repeated rows
are encoded one by one; very long texts are encoded whole, with an open window of
bounded length; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import merges, workers
from armada.llm.token_files import ChunkCache, slices

SPACE = "▁"
CACHE_CHUNKS = 120_000        # distinct chunks held in each of two generations
BATCH_BYTES = 1 << 20         # text split at a time
LANES = 8192                  # chunks in lockstep
FEW = 50                      # chunks that are sooner done one by one
PAIRS = 21                    # bits of the number of neighbours remembered in lockstep
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"   # often behind words
_CACHES: dict = {}
_MODELS: dict = {}
workers.holds(_CACHES, _MODELS)


class PieceModel:
    """A SentencePiece model file: pieces, scores, lattice, byte pieces."""

    def __init__(self, pieces: list, byte_ids: dict, unk: int, kind: str, dummy_prefix: bool = True):
        self.text = [p for p, _ in pieces]
        self.byte_ids, self.unk, self.kind, self.dummy_prefix = byte_ids, unk, kind, dummy_prefix
        self.id_bytes = {i: b for b, i in byte_ids.items()}
        if kind == "bpe":
            self.model, self.trie = merges.from_piece_scores(pieces)
        else:
            self.model, self.trie = None, merges.Trie()
            for i, (p, _) in enumerate(pieces):
                if p is not None:
                    self.trie.add(p, i)
        self.score = [s for _, s in pieces]
        self.reach = max((len(p) for p in self.text if p), default=1)
        whole = (pieces, sorted(byte_ids.items()), unk, kind, dummy_prefix)
        self.key = hashlib.sha256(repr(whole).encode("utf-8", "surrogatepass")).hexdigest()  # tells models apart

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        with open(path, "rb") as f:
            raw = f.read()
        m = proto.ModelProto()
        m.ParseFromString(raw)
        norm, kind = m.normalizer_spec, m.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or kind not in (1, 2):
            raise ValueError("only unigram and merge models without a character map are supported")
        s = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = s.get_piece_size()
        plain = [None if s.is_control(i) or s.is_unknown(i) or s.is_byte(i) else s.id_to_piece(i) for i in range(n)]
        byte_ids = {int(s.id_to_piece(i)[1:-1], 16): i for i in range(n) if s.is_byte(i)}
        return cls([(p, s.get_score(i)) for i, p in enumerate(plain)], byte_ids, s.unk_id(),
                   "bpe" if kind == 2 else "unigram", norm.add_dummy_prefix)

    @property
    def cut_at_spaces(self) -> bool:
        """Whether no piece goes on behind a space after something else."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.text if p)

    @functools.cached_property
    def pairs(self) -> set[str]:
        """All neighbouring characters in pieces. Between two others no piece lies, so all paths meet there."""
        return {p[i:i + 2] for p in self.text if p for i in range(len(p) - 1)}

    def unknown(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if len(self.byte_ids) == 256 else [self.unk]

    def cutter(self) -> re.Pattern:
        """Cuts escaped text where all paths must meet: in front of a run of
        spaces, and around the common unknown characters."""
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.trie.child[0])
        if not self.cut_at_spaces:
            return re.compile(f"[^{lone}]+|[{lone}]" if lone else "(?s:.+)")
        return re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.id_bytes.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(" ⁇ " if i == self.unk else (self.text[i] or ""))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class StreamEncoder:
    """Streaming Viterbi over characters pushed in any portions."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.most_open = 0
        self._begin()

    def _begin(self) -> None:
        self.chars: list[str] = []      # from the last commit on
        self.back: list = [0]           # boundary -> boundary before its last piece
        self.piece: list = [-1]         # boundary -> its last piece (-1: where all paths met)
        self.total: list = [0.0]        # boundary -> best score (unigram)
        self.nodes: list = [[(0, 0)]]   # boundary -> open (start boundary, trie node) pairs

    def push(self, text: str):
        """Ids that became certain."""
        out = []
        for c in text:
            out += self._step(c)
        return out

    def _step(self, c: str) -> list[int]:
        m, trie = self.m, self.m.trie
        if c not in trie.child[0]:
            return self.finish() + m.unknown(c)
        self.chars.append(c)
        here = len(self.chars)
        open_pairs, best = [], None
        for start, node in self.nodes[-1]:
            node = trie.child[node].get(c)
            if node is None:
                continue
            open_pairs.append((start, node))
            t = trie.token[node]
            if t < 0:
                continue
            last = self.piece[start]
            if m.model is None:
                score = self.total[start] + m.score[t]
                if best is None or score > best[2]:
                    best = (start, t, score)
            elif best is None and (last < 0 or m.model.fits(last, t)):
                best = (start, t, 0.0)
        open_pairs.append((here, 0))
        self.back.append(best[0])
        self.piece.append(best[1])
        self.total.append(best[2])
        self.nodes[-1] = None
        self.nodes.append(open_pairs)
        self.most_open = max(self.most_open, here)
        return self._commit(False) if here >= 2 * m.reach else []

    def _commit(self, done: bool) -> list[int]:
        """Walk back from every boundary that can still be built on until they meet."""
        live = {len(self.chars)} if done else {s for s, _ in self.nodes[-1]}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        meet = live.pop()
        ids, b = [], meet
        while b > 0:
            ids.append(self.piece[b])
            b = self.back[b]
        if meet and not done:
            keep = self.piece[meet]
            self.chars = self.chars[meet:]
            self.back = [0, *(x - meet for x in self.back[meet + 1:])]
            self.piece = [keep, *self.piece[meet + 1:]]
            base = self.total[meet]
            self.total = [x - base for x in self.total[meet:]]
            self.nodes = [None] * len(self.chars) + [[(s - meet, n) for s, n in self.nodes[-1]]]
        return ids[::-1]

    def finish(self) -> list[int]:
        """All remaining ids; the next text starts afresh."""
        ids = self._commit(True) if self.chars else []
        self._begin()
        return ids


def encode_window(model: PieceModel, text: str) -> list[int] | None:
    """Viterbi over a text that fits into the open window as a whole, so
    that nothing needs to be committed on the way; None if it holds a
    character outside the vocabulary or has no path."""
    n, child, token = len(text), model.trie.child, model.trie.token
    merge, score = model.model, model.score
    known = merge._fits if merge else {}
    back, piece = [0] * (n + 1), [-1] * (n + 1)
    if merge is None:
        total = [0.0] * (n + 1)
        for start in range(n):  # all arcs into this boundary are drawn by now
            if start and piece[start] < 0:
                continue
            node, end = 0, start
            for c in text[start:]:
                node = child[node].get(c)
                if node is None:
                    break
                end += 1
                t = token[node]
                if t >= 0 and (piece[end] < 0 or total[start] + score[t] > total[end]):
                    piece[end], back[end], total[end] = t, start, total[start] + score[t]
    else:
        for start in range(n):
            last = piece[start]
            if start and last < 0:
                continue
            if piece[n] >= 0:  # the first arc into a boundary is its only one
                break
            node, end, pair = 0, start, last << 32
            for c in text[start:]:
                node = child[node].get(c)
                if node is None:
                    break
                end += 1
                if piece[end] >= 0:
                    continue
                t = token[node]
                if t < 0:
                    continue
                if start:
                    fit = known.get(pair | t)
                    if not (merge.fits(last, t) if fit is None else fit):
                        continue
                piece[end], back[end] = t, start
    if piece[n] < 0:
        return None
    out = []
    while n:
        out.append(piece[n])
        n = back[n]
    return out[::-1]


class Lockstep:
    """``encode_window`` for many texts at a time and a merge-type model. Every text has a cell per
    boundary; the arcs of all cells are drawn first, then all texts take the step from their first
    boundary, from their second one, and so on."""

    def __init__(self, model: PieceModel):
        trie, self.merge = model.trie, model.model
        letters = sorted(set().union(*trie.child))
        self.code = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)  # 0: no letter of a piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        code = dict(zip(letters, range(1, self.width)))
        arcs = [(n * self.width + code[c], to) for n, child in enumerate(trie.child) for c, to in child.items()]
        self.next = merges.Table(*np.array(arcs, np.int64).reshape(-1, 2).T)
        self.token = np.array(trie.token, np.int64)
        self.inner = np.array([len(c) > 0 for c in trie.child])
        self.pairs = np.full(1 << PAIRS, -1, np.int64)  # neighbours << 1 | whether they fit; the last that came to a place

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 31 | b
        slot = (key.view(np.uint64) * merges.MIX >> np.uint64(64 - PAIRS)).view(np.int64)
        known = self.pairs[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            _, one, every = np.unique(key[new], return_index=True, return_inverse=True)
            out[new] = self.merge.fits_many(a[new[one]], b[new[one]])[every]
            self.pairs[slot[new]] = key[new] << 1 | out[new]
        return out

    def arcs(self, codes: np.ndarray):
        """(start, end, token) of all pieces in the cells."""
        start = np.flatnonzero(codes)
        node, end, found = np.zeros(len(start), np.int64), start, []
        while len(start):
            node = self.next.get(node * self.width + codes[end])
            on = np.flatnonzero(node >= 0)
            start, node, end = start[on], node[on], end[on] + 1
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            found.append((start[hit], end[hit], token[hit]))
            on = np.flatnonzero(self.inner[node] & (codes[end] > 0))
            start, node, end = start[on], node[on], end[on]
        return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, which is not empty, as little-endian 32-bit bytes; None as in ``encode_window``."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.cumsum(size + 1) - 1
        first = last - size
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        codes[last] = 0
        start, end, token = self.arcs(codes)
        at = (start - np.repeat(first, size + 1)[start]).astype(np.uint16)
        order = np.argsort(at, kind="stable")
        start, end, token = start[order], end[order], token[order]
        ends = np.cumsum(np.bincount(at, minlength=1)).tolist()
        back, piece = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            s, e, t = start[a:b], end[a:b], token[a:b]
            if k:  # the first arc into a boundary is its only one
                on = np.flatnonzero((piece[e] < 0) & (piece[s] >= 0))
                s, e, t = s[on], e[on], t[on]
                on = np.flatnonzero(self.fits(piece[s], t))
                s, e, t = s[on], e[on], t[on]
            piece[e], back[e] = t, s
        solved = piece[last] >= 0
        taken = np.zeros(len(codes), bool)
        here, begin = last[solved], first[solved]
        while len(here):
            taken[here] = True
            here = back[here]
            on = np.flatnonzero(here > begin)
            here, begin = here[on], begin[on]
        ids = piece[taken].astype("<i4").tobytes()
        ends = (4 * np.cumsum(taken)[last]).tolist()
        return [ids[a:b] if b > a else None for a, b in zip([0, *ends], ends)]


def encode_text(model: PieceModel, text: str) -> list[int]:
    """One text through the stream encoder, without any cache."""
    if not text:
        return []
    enc = StreamEncoder(model)
    escaped = (" " if model.dummy_prefix else "") + text
    return enc.push(escaped.replace(" ", SPACE)) + enc.finish()


def packed_ids(ids: list) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def parts_of(part: str, model: PieceModel, cut: re.Pattern) -> list[str]:
    """A chunk's parts if it is a word with marks behind or has unknown characters inside: they are
    common, the whole seldom is."""
    inner = [part] if part.isprintable() and part.rfind(SPACE) < 1 else cut.findall(part)  # none of \n\t\r is printable
    if len(inner) < 2:
        word = part.rstrip(MARKS)
        if word and len(word) < len(part) and part[len(word) - 1:len(word) + 1] not in model.pairs:
            return [word, part[len(word):]]
    return inner


def joined(part: str, inner: dict, young: dict) -> bytes:
    """The ids of a chunk from those of its parts. Not a closure: one that calls itself is garbage
    only a full collection finds, and holds the generations dropped meanwhile."""
    ids = young.get(part)
    if ids is None:
        ids = young[part] = b"".join([joined(x, inner, young) for x in inner[part]])
    return ids


def learn_chunks(parts: set, model: PieceModel, cut: re.Pattern, lockstep: Lockstep | None, young: dict, old: dict) -> None:
    """Brings chunks that are not among the young ones there: from the old ones, from their parts or
    through the lattice."""
    windows, inner = set(), {}
    while parts:
        below = set()
        for part in parts:
            ids = old.get(part)
            if ids is not None:
                young[part] = ids
                continue
            found = parts_of(part, model, cut)
            if len(found) > 1:
                inner[part] = found
                below.update(found)
            else:
                windows.add(part)
        parts = below.difference(young, windows, inner)
    enc = StreamEncoder(model)
    short = [p for p in windows if len(p) <= 2 * model.reach]
    for i in range(0, len(short), LANES):
        some = short[i:i + LANES]
        if lockstep is not None and len(some) > FEW:
            young.update((p, ids) for p, ids in zip(some, lockstep.encode(some)) if ids is not None)
        else:
            young.update((p, packed_ids(ids)) for p in some if (ids := encode_window(model, p)) is not None)
    for part in windows:
        if part not in young:
            young[part] = packed_ids(enc.push(part) + enc.finish())
    for part in inner:
        joined(part, inner, young)


def encode_texts(model: PieceModel, texts: list) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes."""
    if model.key not in _CACHES:
        _CACHES.clear()  # a worker keeps the chunks of one model
        _CACHES[model.key] = ChunkCache(CACHE_CHUNKS), (model.cutter(), Lockstep(model) if model.model else None)
    cache, (cut, lockstep) = _CACHES[model.key]
    prefix = " " if model.dummy_prefix else ""
    young, old = cache.young, cache.old

    # With single spaces only and no literal U+2581, every word starts where all paths meet.
    by_word = model.dummy_prefix and model.cut_at_spaces
    split = []
    for t in texts:
        if not t:
            split.append([])
        elif by_word and "  " not in t and SPACE not in t and t[0] != " ":
            split.append((SPACE + t.replace(" ", f" {SPACE}")).split(" "))
        else:
            split.append(cut.findall((prefix + t).replace(" ", SPACE)))
    learn_chunks(set(itertools.chain.from_iterable(split)).difference(young), model, cut, lockstep, young, old)
    get = young.__getitem__
    out = [b"".join(map(get, parts)) for parts in split]
    cache.turn()
    return out


def packed(model: PieceModel) -> tuple[str, bytes]:
    """A model as it is broadcast: its key and its bytes, which a worker keeps as long as the broadcast."""
    return model.key, zlib.compress(pickle.dumps(model), 1)


def unpacked(key: str, raw: bytes) -> PieceModel:
    """The model of ``packed``. A worker keeps one, whichever job brought it."""
    if key not in _MODELS:
        _MODELS.clear()
        _CACHES.clear()
        _MODELS[key] = pickle.loads(zlib.decompress(raw))
    return _MODELS[key]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>, n_tokens, round_trip
    (whether decoding the ids gives back the text, U+2581 read as a space).
    No shuffle; the compiled model (its size is the vocabulary's) is
    broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(packed(PieceModel.load(model_path)))

    def run(batches):
        m = unpacked(*model.value)
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                enc = encode_texts(m, texts)
                sizes = np.fromiter((len(e) // 4 for e in enc), np.int32, len(enc))
                flat = np.frombuffer(b"".join(enc), "<i4")
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                same = [decode_fast(m, flat[i:j]) == (t or "").replace(SPACE, " ")
                        for t, i, j in zip(texts, ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode_fast(model: PieceModel, ids: np.ndarray) -> str:
    """``decode`` by joining the UTF-8 of every id in one go."""
    table = model.__dict__.get("_utf8")
    if table is None:
        table = [(p or "").replace(SPACE, " ").encode() for p in model.text]
        for b, i in model.byte_ids.items():
            table[i] = bytes([b])
        if len(model.byte_ids) < 256:
            table[model.unk] = " ⁇ ".encode()
        model._utf8 = table
    raw = b"".join(map(table.__getitem__, ids.tolist()))
    return raw[1 if model.dummy_prefix and raw[:1] == b" " else 0:].decode("utf-8", "replace")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a ``text`` column decoded from its ids (NULL ids: NULL)."""
    model = encoded.sparkSession.sparkContext.broadcast(packed(PieceModel.load(model_path)))

    @F.pandas_udf("string")
    def decode(ids):
        m = unpacked(*model.value)
        return ids.map(lambda x: None if x is None else decode_fast(m, np.asarray(x, np.int64)))

    return encoded.withColumn("text", decode(F.col(ids_col)))
