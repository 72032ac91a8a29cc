"""Personal data by a skip-chain conditional random field (operator 10).

Patterns with checks give the base spans (email, ip, card, phone). The nodes
of a document's random field are its words with a digit or an at sign; every
other word is outside by definition and cuts the chain. Words of base spans
are observed. A node has a trained unary potential over shape features,
neighbouring words share a chain potential, and all words of one normalised
value (the digits of a number, the folded form of anything else), however
far apart, share skip potentials through a common hub, so a value that is
repeated m times costs m edges. The words of one number share a hub as well,
told by its last digits, so other groupings and prefixes are tied. Loopy sum-product messages spread what is
known of one mention to the others; words whose label becomes likely enough
are added to the spans.

Training is piecewise, on a bounded sample of documents labelled by the base
patterns: multinomial regression for the unary part, smoothed log ratios of
label pairs for chain and skip potentials. Everything else covers all rows.

Defined results: NULL and empty texts have no spans; offsets are code
points, ends exclusive; repeated rows are judged one by one; without
anything to train on no span is added; very long texts are judged whole; an empty
table gives no rows; ``masked`` passes other columns through unchanged, ``find``
doesn't read them.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import workers
from armada.llm.token_files import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)             # 0: outside
SAMPLE_DOCS = 20_000                # documents (expected) to train on
SAMPLE_WORDS = 200                  # training words of one document
FEATURES = 1 << 12
STEPS = 300
ROUNDS = 20                         # of messages at most; they stop earlier when nothing moves
DAMPING = 0.5
LIKELY = 0.9
CLIP = 4.0

#: The base patterns, in the one order that also sorts spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
NODE = re.compile(r"[0-9@]")
TAIL, MOST = 7, 19                  # last digits that tell a number, and digits of the longest


def luhn(digits: str) -> bool:
    even, odd = digits[-2::-2], digits[-1::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if NUMBER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


NUMBER = re.compile(r"[0-9]")


def _shape(word: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", word))


def _outer(runs: set) -> set:
    """The runs (first, one past the last) that lie inside no other one, in one sweep."""
    out, reach = set(), -1
    for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
        if b > reach:
            out.add((a, b))
            reach = b
    return out


def _size(n: int) -> int:
    return sum(n >= k for k in (1, 3, 4, 5, 8, 9, 12, 16, 17, 20))


class Field:
    """The nodes of one document: words, labels known from base spans, features, edges."""

    def __init__(self, text: str, base: list):
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        at = [i for i, (a, b) in enumerate(words) if NODE.search(text, a, b)]
        self.span = [words[i] for i in at]
        self.word = [text[a:b] for a, b in self.span]
        n = len(at)
        self.known = np.zeros(n, np.int64)
        j = 0
        by_start = sorted((a, b, k) for a, k, b in base)
        for i, (a, b) in enumerate(self.span):
            while j < len(by_start) and by_start[j][1] <= a:
                j += 1
            for x, y, k in itertools.islice(by_start, j, None):
                if x >= b:
                    break
                if y > a:
                    self.known[i] = k + 1
                    break
        linked = np.array([at[i + 1] == at[i] + 1 for i in range(n - 1)], bool) if n else np.zeros(0, bool)
        self.chain = np.flatnonzero(linked)
        # Runs of neighbouring nodes, for features of the whole number.
        self.features = np.zeros((n, 8), np.int64)
        start = 0
        for i in range(n):
            if i == n - 1 or not linked[i]:
                self._run(start, i + 1)
                start = i + 1
        values: dict = {}
        self.value = np.full(n, -1, np.int64)
        for i, w in enumerate(self.word):
            digits = re.sub(r"[^0-9]", "", w)
            plain = not any(c.isalpha() for c in w)
            key = digits if plain else w.strip("\"'.,;:!?()[]<>{}#*$%&|").casefold()
            if "@" in w or not plain or len(digits) >= 4:
                self.value[i] = values.setdefault(key, len(values))
        # (node, hub) pairs: the words of one value, and all words of one number however it is grouped.
        pairs = [(i, v) for i, v in enumerate(self.value.tolist()) if v >= 0]
        for tail, mentions in self._numbers(linked, base, text).items():
            if len(mentions) > 1:
                hub = values.setdefault((tail,), len(values))
                pairs += [(i, hub) for i in sorted({i for a, b in mentions for i in range(a, b)})]
        self.member, self.hub = np.array(pairs, np.int64).reshape(-1, 2).T

    def _numbers(self, linked: np.ndarray, base: list, text: str) -> dict:
        """Last ``TAIL`` digits of a number -> the runs of words (first, one past the last) that
        write it: base spans, what repeats a base span's number or its end, and whole runs."""
        out: dict[str, set] = {}
        digits = [re.sub(r"[^0-9]", "", w) for w in self.word]
        plain = [bool(d) and "@" not in w and not any(c.isalpha() for c in w) for d, w in zip(digits, self.word)]
        starts = [a for a, _ in self.span]
        ends, spans = [b for _, b in self.span], []
        for a, k, b in base:
            number = re.sub(r"[^0-9]", "", text[a:b])
            if KINDS[k] in ("card", "phone") and len(number) >= TAIL:
                i, j = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
                out.setdefault(number[-TAIL:], set()).add((i, j))
                spans.append(number)
        known = {n[i:] for n in spans for i in range(len(n) - TAIL + 1)}
        at, n = 0, len(digits)
        while at < n:
            end = at + 1
            while end < n and linked[end - 1] and plain[end - 1] and plain[end]:
                end += 1
            if plain[at]:
                whole = "".join(digits[at:min(end, at + MOST + 1)])
                if TAIL <= len(whole) <= MOST and end - at <= MOST:
                    out.setdefault(whole[-TAIL:], set()).add((at, end))
                for i in range(at, end) if known else ():
                    window = ""
                    for j in range(i, end):
                        window += digits[j]
                        if len(window) > MOST + 1:
                            break
                        if window in known or window.lstrip("0") in known:  # a trunk 0 or 00 in front
                            out.setdefault(window[-TAIL:], set()).add((i, j + 1))
            at = end
        # A window inside another one is the same mention.
        return {t: _outer(m) for t, m in out.items()}

    def _run(self, a: int, b: int) -> None:
        shapes = [_shape(w) for w in self.word[a:b]]
        digits = re.sub(r"[^0-9]", "", "".join(self.word[a:b]))
        check = luhn(digits) if 12 <= len(digits) <= 19 else -1
        for i in range(a, b):
            w, s = self.word[i], shapes[i - a]
            own = sum(c.isdigit() for c in w)
            found = (f"shape {s}", f"own {_size(own)}", f"first {s[:1]} {w.count('.')} {'@' in w}",
                     f"run {_size(len(digits))} {check}", f"all {s} {_size(own)} {_size(len(digits))} {check}",
                     f"left {shapes[i - a - 1] if i > a else 'plain'}", f"right {shapes[i - a + 1] if i + 1 < b else 'plain'}",
                     f"start {shapes[0][:2]} {i - a}")
            self.features[i] = [zlib.crc32(f.encode()) % FEATURES for f in found]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _norm(x: np.ndarray) -> np.ndarray:
    return x - _log_sum(x, 1)[:, None]


class Model:
    """Unary weights (features by labels), chain and skip potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, field: Field) -> np.ndarray:
        """Loopy sum-product over chain edges and value hubs."""
        n = len(field.word)
        unary = _norm(self.weights[field.features].sum(1))
        seen = field.known > 0
        unary[seen] = -30.0
        unary[seen, field.known[seen]] = 0.0
        left, right = field.chain, field.chain + 1
        to_right, to_left = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS))
        member, hub = field.member, field.hub
        hubs = int(hub.max()) + 1 if len(hub) else 0
        many = np.bincount(hub, minlength=hubs)[hub] > 1 if hubs else np.zeros(0, bool)
        member, hub = member[many], hub[many]
        up, down = np.zeros((len(member), LABELS)), np.zeros((len(member), LABELS))
        belief = unary
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, right, to_right)
            np.add.at(belief, left, to_left)
            np.add.at(belief, member, down)
            was = belief
            new_right = _norm(_log_sum((belief[left] - to_left)[:, :, None] + self.chain, 1))
            new_left = _norm(_log_sum((belief[right] - to_right)[:, None, :] + self.chain, 2))
            new_up = _norm(_log_sum((belief[member] - down)[:, :, None] + self.skip, 1))
            total = np.zeros((hubs, LABELS))
            np.add.at(total, hub, new_up)
            new_down = _norm(_log_sum((total[hub] - new_up)[:, None, :] + self.skip, 2))
            moved = 0.0
            for old, new in ((to_right, new_right), (to_left, new_left), (up, new_up), (down, new_down)):
                if len(old):
                    moved = max(moved, float(np.abs(new - old).max()))
                    old += (1 - DAMPING) * (new - old)
            if moved < 1e-3:
                break
            belief = was
        return np.exp(_norm(belief)) if n else np.zeros((0, LABELS))

    def added(self, text: str, base: list) -> list[tuple[int, int, int]]:
        """Spans beyond the base ones: runs of words with one likely label."""
        field = Field(text, base)
        if not len(field.word):
            return []
        p = self.marginals(field)
        label = np.where((p.max(1) >= LIKELY) & (field.known == 0), p.argmax(1), 0)
        joined = set(field.chain.tolist())
        out, i = [], 0
        while i < len(label):
            j = i
            while j in joined and label[j + 1] == label[i]:
                j += 1
            if label[i]:
                a, b = field.span[i][0], field.span[j][1]
                m = re.search(r"[A-Za-z0-9+(].*[A-Za-z0-9]|[A-Za-z0-9]", text[a:b], re.S)
                if m and not any(x < a + m.end() and y > a + m.start() for x, _, y in base):
                    out.append((a + m.start(), int(label[i]) - 1, a + m.end()))
            i = j + 1
        return out


def fit(features: np.ndarray, labels: np.ndarray, pairs: np.ndarray, twins: np.ndarray) -> Model:
    """Piecewise training: regression on (features, labels), log ratios of
    the label pair counts of chain edges and of equal values."""
    weights = np.zeros((FEATURES, LABELS))
    if len(labels):
        goal = np.eye(LABELS)[labels]
        seen = np.full_like(weights, 1e-8)
        for _ in range(STEPS):
            off = np.exp(_norm(weights[features].sum(1))) - goal
            slope = np.zeros_like(weights)
            np.add.at(slope, features.ravel(), np.repeat(off, features.shape[1], 0))
            slope = slope / len(labels) + 1e-5 * weights
            seen += slope * slope
            weights -= 0.5 * slope / np.sqrt(seen)

    def ratios(counts):
        expected = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / max(1.0, counts.sum())
        return np.clip(np.log((counts + 0.5) / (expected + 0.5)), -CLIP, CLIP)

    return Model(weights, ratios(pairs), ratios(twins))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit on a sample of about ``SAMPLE_DOCS`` documents; one row per sampled
    document with nodes reaches the driver, its words bounded. The texts' hashes decide which
    ones, and equal texts count once, so the model depends on the rows and not on their files."""
    total = docs.count()

    def learn(batches):
        workers.release()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and NODE.search(t):
                    f = Field(t, base_spans(t))
                    pairs, twins = np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
                    np.add.at(pairs, (f.known[f.chain], f.known[f.chain + 1]), 1)
                    order = np.argsort(f.value, kind="stable")
                    a, b = order[:-1], order[1:]  # neighbours among the words of a value, not all pairs
                    same = (f.value[a] == f.value[b]) & (f.value[a] >= 0)
                    np.add.at(twins, (f.known[a[same]], f.known[b[same]]), 0.5)
                    np.add.at(twins, (f.known[b[same]], f.known[a[same]]), 0.5)
                    yield pa.RecordBatch.from_pydict({
                        "features": [f.features[:SAMPLE_WORDS].astype(np.int32).tobytes()],
                        "labels": [f.known[:SAMPLE_WORDS].astype(np.int8).tobytes()],
                        "pairs": [pairs.ravel().tolist()], "twins": [twins.ravel().tolist()]})

    hashed = docs.select(F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    some = hashed.where((F.pmod("h", F.lit(max(1, total))) < SAMPLE_DOCS) & F.col("t").rlike("[0-9@]"))
    some = some.dropDuplicates(["h"]).select("t")
    got = some.mapInArrow(learn, "features binary, labels binary, pairs array<double>, twins array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["features"], r["labels"]))
    features = np.frombuffer(b"".join(r["features"] for r in got), np.int32).reshape(-1, 8)
    labels = np.frombuffer(b"".join(r["labels"] for r in got), np.int8).astype(np.int64)
    square = lambda k: np.sum([r[k] for r in got], axis=0).reshape(LABELS, LABELS) if got else np.zeros((LABELS, LABELS))
    # The identity is the prior of the skip potentials: equal values mostly agree.
    return fit(features, labels, square("pairs"), square("twins") + np.eye(LABELS))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; overlapping spans are one."""
    out, end, at = [], 0, 0
    spans = sorted(spans)
    while at < len(spans):
        start, kind, stop = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < stop:
            stop = max(stop, spans[at][2])
            at += 1
        out += [text[end:start], f"<{KINDS[kind].upper()}>"]
        end = stop
    return "".join(out) + text[end:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256 and spans (all)."""
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        workers.release()
        m = model.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                counts, sha, spans = [], [], []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    if not t or not NODE.search(t):
                        counts.append((0, 0, 0, 0))
                        sha.append(empty)
                        spans.append("")
                        continue
                    base = base_spans(t)
                    counts.append(tuple(sum(k == i for _, k, _ in base) for i in range(4)))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + m.added(t, base))))
                by_kind = np.array(counts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(by_kind[:, i]) for i in range(4)], pa.array(sha, pa.string()),
                     pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; NULL stays NULL."""
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))

    @F.pandas_udf("string")
    def clean(texts):
        m = model.value

        def one(t):
            if not t or not NODE.search(t):
                return t
            base = base_spans(t)
            spans = base + m.added(t, base)
            return mask(t, spans) if spans else t
        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
