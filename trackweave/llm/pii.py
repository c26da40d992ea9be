"""Personal data in texts: exact base patterns, and spans added by a character-level bidirectional LSTM with CRF
transitions, trained in numpy on the base spans of a bounded sample.

Long texts are decoded in overlapping windows; each character takes its tag from the window in whose middle
it stands. Every span must hold a digit or an at sign, so a window without any can add none and is not decoded.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, first_in_hash_order, read, short_batches

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
#: What an added span of a kind may consist of; each form holds a digit or an at sign.
PLAUSIBLE = {"email": re.compile(r"[^\s@]+@[^\s@]+"), "ip": re.compile(r"[A-Fa-f.:]*[0-9][0-9A-Fa-f.:]*"), "card": re.compile(r"[0-9][0-9 .-]+"), "phone": re.compile(r"[+(]?[0-9][0-9 ().+/-]+")}
WINDOW, STRIDE = 96, 64
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 2_000, 800
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches found from each at sign, so a long run of name characters costs its length once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; matches are leftmost and do not overlap within a kind, failing ones are dropped."""
    if not text or not TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


SIGNS = "@.+-_()%/:, "
CLASSES = 6 + len(SIGNS)


def char_class(c: str) -> int:
    """0 pads; digits, small, capital and other letters, line breaks and controls, each sign of its own, and the rest."""
    if c in SIGNS:
        return 6 + SIGNS.index(c)
    if "0" <= c <= "9":
        return 1
    return 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isalpha() else 5


_ASCII = np.array([char_class(chr(i)) for i in range(128)], dtype=np.int8)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(codes), 4, dtype=np.int8)
    plain = codes < 128
    out[plain] = _ASCII[codes[plain]]
    for i in np.flatnonzero(~plain):
        out[i] = char_class(text[i])
    return out


def window_starts(length: int) -> list[int]:
    """Windows of WINDOW characters every STRIDE, the last one ending the text."""
    if length <= WINDOW:
        return [0]
    starts = list(range(0, length - WINDOW, STRIDE))
    return starts + [length - WINDOW]


def owned_windows(length: int) -> list[tuple[int, int, int]]:
    """(start, first, end): a window owns the characters nearer to its middle than to its neighbours' middles."""
    starts = window_starts(length)
    cuts = [0, *[(a + WINDOW + b) // 2 for a, b in zip(starts, starts[1:])], length]
    return list(zip(starts, cuts, cuts[1:]))


@dataclass
class Tagger:
    """Weights of both directions stacked: x (2, classes, 4h), w (2, h, 4h), and out (2h, tags), bias, transitions (tags, tags)."""

    p: dict[str, np.ndarray]

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (T, B, 2h) of class windows (B, T); with ``keep`` also what the gradient needs."""
        p, (n, t) = self.p, x.shape
        h = p["w"].shape[1]
        both = np.stack((x, x[:, ::-1])).transpose(2, 0, 1)  # T, 2, B
        live = (both > 0).astype(np.float32)[..., None]
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, memo = np.zeros((t, 2, n, h), np.float32), []
        side = np.arange(2)[:, None]
        for k in range(t):
            z = p["x"][side, both[k]] + state @ p["w"]
            gates = 1 / (1 + np.exp(-z[..., : 3 * h]))
            g = np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            before = cell
            cell = (f * cell + i * g) * live[k]
            squashed = np.tanh(cell)
            if keep:
                memo.append((both[k], state, before, i, f, o, g, squashed, live[k]))
            state = o * squashed * live[k]
            out[k] = state
        joined = np.concatenate((out[:, 0], out[::-1, 1]), axis=2)
        return (joined, memo) if keep else joined

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (B, T) under emissions and transitions; padding is tagged O."""
        scores = self.states(x) @ self.p["out"] + self.p["bias"]
        move, t = self.p["move"], scores.shape[0]
        best, back = scores[0].copy(), np.zeros(scores.shape, np.int8)
        for k in range(1, t):
            paths = best[:, :, None] + move
            back[k] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[k]
        tags = np.zeros((t, scores.shape[1]), np.int8)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(scores.shape[1])
        for k in range(t - 1, 0, -1):
            tags[k - 1] = back[k][rows, tags[k]]
        return np.where(x > 0, tags.T, 0)

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative CRF log likelihood of tags y (B, T), and its gradient through time."""
        p, (n, t) = self.p, x.shape
        states, memo = self.states(x, keep=True)
        h = p["w"].shape[1]
        e = (states @ p["out"] + p["bias"]).astype(np.float64)
        move = p["move"].astype(np.float64)

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, after = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for k in range(1, t):
            ahead[k] = lse(ahead[k - 1][:, :, None] + move, 1) + e[k]
        for k in range(t - 2, -1, -1):
            after[k] = lse(move + (e[k + 1] + after[k + 1])[:, None, :], 2)
        whole = lse(ahead[-1], 1)
        tags, rows = y.T, np.arange(n)
        gold = sum(e[k][rows, tags[k]] for k in range(t)) + sum(move[tags[k - 1], tags[k]] for k in range(1, t))
        d = np.exp(ahead + after - whole[:, None])
        d_move = np.zeros_like(move)
        for k in range(1, t):
            d_move += np.exp(ahead[k - 1][:, :, None] + move + (e[k] + after[k])[:, None, :] - whole[:, None, None]).sum(axis=0)
            np.subtract.at(d_move, (tags[k - 1], tags[k]), 1)
        for k in range(t):
            d[k][rows, tags[k]] -= 1
        d = (d / n).astype(np.float32)
        grad = {"out": np.einsum("tbh,tbg->hg", states, d), "bias": d.sum(axis=(0, 1)), "move": (d_move / n).astype(np.float32), "x": np.zeros_like(p["x"]), "w": np.zeros_like(p["w"])}
        d_states = d @ p["out"].T
        d_out = np.stack((d_states[..., :h], d_states[::-1, :, h:]), axis=1)
        d_h, d_c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for k in range(t - 1, -1, -1):
            ids, state, before, i, f, o, g, squashed, live = memo[k]
            d_state = (d_out[k] + d_h) * live
            d_c = (d_c + d_state * o * (1 - squashed**2)) * live
            dz = np.concatenate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_state * squashed * o * (1 - o), d_c * i * (1 - g**2)), axis=2)
            for side in range(2):
                np.add.at(grad["x"][side], ids[side], dz[side])
            grad["w"] += state.transpose(0, 2, 1) @ dz
            d_h = dz @ p["w"].transpose(0, 2, 1)
            d_c = d_c * f
        return float((whole - gold).mean()), grad


def train(x: np.ndarray, y: np.ndarray, hidden: int = 16, passes: int = 6, batch: int = 16, rate: float = 0.03, seed: int = 42) -> Tagger:
    """Fit on class windows (N, T) and tags; with no window the tagger says O throughout."""
    rng = np.random.default_rng(seed)
    p = {"x": rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)), "w": rng.normal(0, 0.2, (2, hidden, 4 * hidden)), "out": rng.normal(0, 0.1, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
    p["bias"][0] = 2.0
    p["x"][:, :, hidden : 2 * hidden] += 1.0  # remember at first
    tagger = Tagger({k: v.astype(np.float32) for k, v in p.items()})
    m1, m2 = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    step, total = 0, passes * -(-len(x) // batch)
    for _ in range(passes):
        turn = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = turn[at : at + batch]
            _, grad = tagger.loss_and_gradient(x[own], y[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                tagger.p[k] -= (rate * (1 - step / (total + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the tags: from a B, or an I that follows another kind, as far as its kind's I goes."""
    out, at = [], 0
    for at_ in np.flatnonzero(tags):
        if at_ < at:
            continue
        kind, at = (int(tags[at_]) - 1) // 2, int(at_) + 1
        while at < len(tags) and tags[at] == 2 + 2 * kind:
            at += 1
        out.append((KINDS[kind], int(at_), at))
    return out


def labelled_windows(text: str) -> list[tuple[bytes, bytes]]:
    """Classes and base tags of the text's windows that could hold a span, padded to WINDOW."""
    x, y = classes(text), tags_of(len(text), base_spans(text))
    out = []
    for s in window_starts(len(text)):
        if TRIGGER.search(text, s, s + WINDOW):
            pad = WINDOW - len(x[s : s + WINDOW])
            out.append((np.pad(x[s : s + WINDOW], (0, pad)).tobytes(), np.pad(y[s : s + WINDOW], (0, pad)).tobytes()))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> Tagger:
    """Train on at most ``windows`` labelled windows, two thirds of them with spans, from at most ``documents`` documents, all first in hash order."""
    short_batches(docs.sparkSession)
    rows = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    drawn = first_in_hash_order(rows, documents, "id", seed=5).select("turn", "text")

    def cut(batches):
        for b in batches:
            found = []
            for turn, text in zip(b.column("turn").to_pylist(), b.column("text").to_pylist()):
                own = labelled_windows(text)
                own = [w for w in own if any(w[1])][:8] + [w for w in own if not any(w[1])][:4]
                found += [(turn, k, *w) for k, w in enumerate(own)]
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["turn", "k", "x", "y"])

    found = sorted(tuple(r) for r in drawn.mapInArrow(cut, "turn long, k int, x binary, y binary").collect())
    with_spans, without = [r for r in found if any(r[3])], [r for r in found if not any(r[3])]
    chosen = with_spans[: windows * 2 // 3]
    chosen += without[: windows - len(chosen)]
    x = np.array([np.frombuffer(r[2], np.int8) for r in chosen], dtype=np.int64).reshape(-1, WINDOW)
    y = np.array([np.frombuffer(r[3], np.int8) for r in chosen], dtype=np.int64).reshape(-1, WINDOW)
    return train(x, y)


def added_spans(texts: list[str | None], base: list[list], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans the tagger adds to the base spans of each text: they have five characters, those of their kind, and touch no base span."""
    places = [(i, *w) for i, t in enumerate(texts) if t for w in owned_windows(len(t)) if TRIGGER.search(t, w[0], w[0] + WINDOW)]
    tags: dict[int, np.ndarray] = {}
    for at in range(0, len(places), batch):
        own = places[at : at + batch]
        x = np.zeros((len(own), WINDOW), np.int64)
        for row, (i, s, _, _) in enumerate(own):
            piece = texts[i][s : s + WINDOW]
            x[row, : len(piece)] = classes(piece)
        decoded = tagger.decode(x)
        for row, (i, s, lo, hi) in enumerate(own):
            tags.setdefault(i, np.zeros(len(texts[i]), np.int8))[lo:hi] = decoded[row, lo - s : hi - s]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, whole in tags.items():
        taken = np.zeros(len(whole) + 1, bool)
        for _, a, b in base[i]:
            taken[a:b] = True
        for kind, a, b in spans_of(whole):
            if b - a >= 5 and not taken[a:b].any() and PLAUSIBLE[kind].fullmatch(texts[i], a, b):
                out[i].append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document row; no shuffle.

    The counts and the digest are of the base spans; ``spans`` holds those and the tagger's, as
    kind:start:end in code points, end exclusive. A null or empty text has none; repeated rows are each returned.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, shared.value)
            counts = [pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string())
            spans = pa.array([joined(own + add) for own, add in zip(base, more)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, spans, pa.array([len(x) for x in more], pa.int64())], names=[c.split()[0] for c in FOUND.split(", ")])

    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, FOUND)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))
