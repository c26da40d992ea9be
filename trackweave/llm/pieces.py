"""SentencePiece vocabulary: merge encoding with seeded dropout, lossless decoding, and count-only Viterbi.

No piece has a word mark after another character, so a text falls into units (marks, then what
follows) that are segmented apart; a unit's result is kept for its next occurrence in the worker.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, read, short_batches

MODEL = os.environ.get("TRACKWEAVE_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stands for a word mark that the text itself holds: a lone surrogate, which no valid text has, so it falls back to the mark's bytes.
OWN_MARK = "\ud800"
#: Bytes of path scores a worker keeps, about; then it starts afresh.
KEPT_BYTES = 64 << 20
#: Characters of a unit up to which its agenda is a row among many; rows that take turns together; units of text taken at a time.
SHORT, ROWS, UNITS = 32, 1 << 15, 1 << 18
M64 = (1 << 64) - 1


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []  # bytes that a piece decodes to
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.raw), np.uint8)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark after another character")

    def units(self, text: str) -> Iterator[str]:
        """The text's units; joined, they are the text after one mark, marks for spaces."""
        return (m[0] for m in UNIT.finditer(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))) if text else iter(())

    def decode(self, ids) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text's bytes: those of the pieces one after another, without the first mark's."""
        return self.bytes[spread(self.starts[ids], self.sizes[ids])].tobytes()[1:]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if char == OWN_MARK else char).encode("utf-8", "surrogatepass")]


def mixed(key: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` 64-bit hashes of (key, first), (key, first + 1) ..., by the splitmix finaliser."""
    x = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors of a place in the unit, of a piece's turn in the order of scores, and of the two with the occurrence's key.
PLACE, PIECE, DRAW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
NONE = 1 << 30


class PairTable:
    """(left, right) -> rank of the piece the two make, by open addressing; ranks name pieces, NONE no piece."""

    def __init__(self, rank: dict[str, int]):
        pairs = [(rank[p[:i]] << 32 | rank[p[i:]], k) for p, k in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, made = np.array([x for x, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int32)
        at = self.slot(left)
        while len(left):  # of those that want a slot one gets it, and the others move on
            free = self.keys[at] == -1
            got, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[got], self.values[got] = left[own], made[own]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, made, at = left[rest], made[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(PLACE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self.slot(key)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            met = self.keys[at[open_]]
            hit = met == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        return out


class Merges:
    """The segmentations of many units: ids one after another in ``flat``, those of unit u from ``first[u]`` to ``first[u + 1]``; and likewise the codes of all turns."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray | None = None, turns: np.ndarray | None = None):
        self.flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
        self.first = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.codes, self.turns = codes, turns


class MergeEncoder:
    """Merge segmentation by an agenda of candidates, best score first, leftmost of equals, with seeded dropout.

    A candidate whose turn it is is skipped if the hash of (seed, text name, the unit's number in the text, place, merged piece)
    falls under ``dropout``; so every occurrence of a word draws its own. The agendas of many units take their turns together: in
    numpy, a row for each unit. The distinct units of a slice of text are merged plainly once, the draws of all occurrences'
    turns are made at once, and only the occurrences with a skipped turn go through their agenda again.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        self.v, self.seed = vocabulary, seed
        self.below = min(int(dropout * (1 << 64)), M64)
        ordered = sorted(vocabulary.score, key=lambda p: (-vocabulary.score[p], vocabulary.ids[p]))
        self.rank = {p: k for k, p in enumerate(ordered)}
        self.ids = np.array([vocabulary.ids[p] for p in ordered], "<i4")
        self.pairs = PairTable(self.rank)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, k in self.rank.items():
            if len(p) == 1:
                self.chars[ord(p)] = k

    def merge_all(self, units: list[str], keys: np.ndarray | None = None) -> Merges:
        """Segmentations of units; with ``keys``, one for each unit, turns are drawn, else the codes of the turns are returned too."""
        sizes = np.array([len(u) for u in units], np.int64)
        flat = self.chars[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        odd = np.minimum.reduceat(flat, starts) < 0 if len(units) else np.zeros(0, bool)
        slow = np.flatnonzero(odd | (sizes > SHORT))
        lengths, found, codes = np.zeros(len(units), np.int64), [], []
        for width in (6, 8, 11, 16, SHORT):
            rows = np.flatnonzero(~odd & (sizes <= width) & (sizes > {6: 0, 8: 6, 11: 8, 16: 11, SHORT: 16}[width]))
            for at in range(0, len(rows), ROWS):
                own = rows[at : at + ROWS]
                spot = starts[own, None] + np.arange(width)
                inside = np.arange(width) < sizes[own, None]
                symbols = np.where(inside, flat[np.minimum(spot, len(flat) - 1)], -1)
                live, turned = self._agenda(symbols, None if keys is None else keys[own])
                lengths[own] = (live >= 0).sum(axis=1)
                found.append((own, self.ids[live[live >= 0]]))
                codes += [(own[r], c) for r, c in turned]
        for u in slow.tolist():
            turns: list[int] = []
            ids = self._merge_one(units[u], turns, None if keys is None else int(keys[u]))
            lengths[u] = len(ids)
            found.append((np.array([u]), ids))
            codes.append((np.full(len(turns), u), np.array(turns, np.uint64)))
        first = np.concatenate(([0], np.cumsum(lengths)))
        flat_ids = np.zeros(first[-1], "<i4")
        for own, ids in found:
            flat_ids[spread(first[own], lengths[own])] = ids
        if keys is not None:
            return Merges([flat_ids], lengths)
        row, code = (np.concatenate(c) if codes else np.zeros(0, t) for c, t in zip(list(zip(*codes)) or ((), ()), (np.int64, np.uint64)))
        order = np.argsort(row, kind="stable")  # of one unit the turns stay in order
        return Merges([flat_ids], lengths, code[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(units))))))

    def _agenda(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Symbols (rows, width; -1 pads) after all turns, dead places -1, and (rows, codes) of each turn; a row takes one turn a round."""
        n, width = symbols.shape
        s, out, codes = symbols.astype(np.int64), np.full_like(symbols, -1), []
        size = (s >= 0).sum(axis=1)
        after = np.minimum(np.arange(1, width + 1), size[:, None])
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        pair = np.full((n, width), NONE, np.int64)
        both = (s[:, :-1] >= 0) & (s[:, 1:] >= 0)
        pair[:, :-1][both] = self.pairs.find(s[:, :-1][both], s[:, 1:][both])
        rows = np.arange(n)
        while len(rows):
            i = pair.argmin(axis=1)
            at = np.arange(len(rows))
            best = pair[at, i]
            on = best < NONE
            if not on.all():
                out[rows[~on]] = s[~on]
                rows, s, after, before, pair, i, best, size = (x[on] for x in (rows, s, after, before, pair, i, best, size))
                at = np.arange(len(rows))
                if not len(rows):
                    break
            code = i.astype(np.uint64) * np.uint64(PLACE) ^ best.astype(np.uint64) * np.uint64(PIECE)
            go = at
            if keys is None:
                codes.append((rows, code))
            else:
                skip = (keys[rows] ^ code) * np.uint64(DRAW) < np.uint64(self.below)
                pair[at[skip], i[skip]] = NONE
                go, i, best = at[~skip], i[~skip], best[~skip]
            j = after[go, i]
            k = after[go, j]
            s[go, i], s[go, j], pair[go, j], pair[go, i], after[go, i] = best, -1, NONE, NONE, k
            right = np.flatnonzero(k < size[go])
            before[go[right], k[right]] = i[right]
            pair[go[right], i[right]] = self.pairs.find(best[right], s[go[right], k[right]])
            h = before[go, i]
            left = np.flatnonzero(h >= 0)
            pair[go[left], h[left]] = self.pairs.find(s[go[left], h[left]], best[left])
        return out, codes

    def _merge_one(self, unit: str, codes: list[int], key: int | None) -> np.ndarray:
        """The same for one unit of any length and any characters, in a heap."""
        parts: list = list(unit)
        rank, n = self.rank.get, len(parts)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def add(i: int, j: int) -> None:
            r = rank(parts[i] + parts[j])
            if r is not None:
                heapq.heappush(agenda, (r, i, parts[i] + parts[j]))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            r, i, piece = heapq.heappop(agenda)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != piece:
                continue
            code = (i * PLACE ^ r * PIECE) & M64
            codes.append(code)
            if key is not None and (key ^ code) * DRAW & M64 < self.below:
                continue
            parts[i], parts[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                add(i, k)
            if before[i] >= 0:
                add(before[i], i)
        ids = self.v.ids
        return np.array([x for p in parts if p is not None for x in ([ids[p]] if p in ids else self.v.fallback(p))], "<i4")

    def encode_all(self, texts: list[str | None], names: list[str]) -> list[np.ndarray]:
        """Piece ids of texts; the names key their draws. About ``UNITS`` units are taken at a time, of long texts a part."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        units: list[str] = []
        spans: list[tuple[int, np.ndarray]] = []  # text and keys of each run of units
        for d, (text, name) in enumerate(zip(texts, names)):
            key, done, walk = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), self.seed & M64), 0, self.v.units(text or "")
            while own := list(itertools.islice(walk, UNITS - len(units))):
                units += own
                spans.append((d, mixed(key, len(own), done)))
                done += len(own)
                if len(units) >= UNITS:
                    self._flush(units, spans, out)
                    units, spans = [], []
        self._flush(units, spans, out)
        return [np.concatenate(x) if x else np.zeros(0, "<i4") for x in out]

    def _flush(self, units: list[str], spans: list[tuple[int, np.ndarray]], out: list[list[np.ndarray]]) -> None:
        if not units:
            return
        index: dict[str, int] = {}
        numbers = np.array([index.setdefault(u, len(index)) for u in units], np.int64)
        plain = self.merge_all(list(index))
        start, length, flat = plain.first[numbers], np.diff(plain.first)[numbers], plain.flat
        if self.below:
            keys = np.concatenate([k for _, k in spans])
            turns = np.diff(plain.turns)[numbers]
            occurrence = np.repeat(np.arange(len(units)), turns)
            drawn = (keys[occurrence] ^ plain.codes[spread(plain.turns[numbers], turns)]) * np.uint64(DRAW)
            again = np.unique(occurrence[drawn < np.uint64(self.below)])
            other = self.merge_all([units[u] for u in again.tolist()], keys[again])
            start[again], length[again] = other.first[:-1] + len(flat), np.diff(other.first)
            flat = np.concatenate((flat, other.flat))
        ids = flat[spread(start, length)]
        ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum([0] + [len(k) for _, k in spans])]
        for (d, _), lo, hi in zip(spans, ends, ends[1:]):
            out[d].append(ids[lo:hi])

    def encode(self, text: str | None, name: str = "") -> np.ndarray:
        return self.encode_all([text], [name])[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for lengths[0] numbers, then those of the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class ViterbiCounter(dict):
    """Unit -> (best path score, its piece count), over the pieces as a unigram vocabulary.

    Aho-Corasick enumerates the pieces that end at each character; the best score wins, and of equal
    scores the longest last piece (the earliest start), as unigram tokenizers do. A character
    without a piece of its own costs the least score less 10 and counts its UTF-8 bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.held, self.unknown = 0, min(vocabulary.score.values()) - 10
        self.find = ahocorasick.Automaton()
        for p, s in vocabulary.score.items():
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()

    def __missing__(self, unit: str) -> tuple[float, int]:
        found = self[unit] = self.best(unit)
        self.held += len(unit) + 250
        return found

    def best(self, unit: str) -> tuple[float, int]:
        n = len(unit)
        score, pieces, size = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        at = 0  # characters whose end has been settled
        for end, (length, s) in self.find.iter(unit):
            while at < end:
                at += 1
                self._unknown(unit, at, score, pieces, size)
            own = score[end + 1 - length] + s
            if own > score[end + 1] or own == score[end + 1] and length > size[end + 1]:
                score[end + 1], pieces[end + 1], size[end + 1] = own, pieces[end + 1 - length] + 1, length
        while at < n:
            at += 1
            self._unknown(unit, at, score, pieces, size)
        return score[n], pieces[n]

    def _unknown(self, unit: str, end: int, score: list, pieces: list, size: list) -> None:
        char = unit[end - 1]
        if char not in self.v.score and score[end - 1] + self.unknown > score[end]:
            score[end], pieces[end], size[end] = score[end - 1] + self.unknown, pieces[end - 1] + len(self.v.fallback(char)), 1

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, best path score) of a whole text; the units' scores are added in text order."""
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 0
        score, pieces = 0.0, 0
        for own, n in map(self.__getitem__, self.v.units(text or "")):
            score += own
            pieces += n
        return pieces, score


def encode_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 42, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, ids_sha256, lossless) of every document row; no shuffle.

    ``seed`` gives one segmentation of the corpus; another seed varies it. The draws are keyed by doc_id and the unit's
    number in the text, so every occurrence of a word has its own; rows of equal doc_id and text are segmented alike.
    ids_sha256 is the hex digest of the ids as little-endian int32; lossless says that decoding the ids gives the text
    back, checked on every row. A null or empty text has no tokens and decodes to the empty text. A very long text is
    encoded whole, in one row.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches):
        encoder = MergeEncoder(Vocabulary(shared.value), dropout, seed)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encoder.encode_all(texts, [str(key) for key in b.column(0).to_pylist()])
            lossless = [encoder.v.decoded(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32()))
            digests = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), tokens, pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(lossless, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "ids_sha256", "lossless"])

    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, ids_sha256 string, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with a column ``text`` decoded from the piece ids; null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = Vocabulary(shared.value)
        return ids.map(lambda x: None if x is None else v.decode(x.tolist()))

    return encoded.withColumn("text", decode(ids_col))


def count_tokens(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, path_score) of every document row, by count-only Viterbi; no shuffle.

    A null or empty text has no tokens and score 0; repeated rows are each returned.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches):
        counter = ViterbiCounter(Vocabulary(shared.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_chars", "n_tokens", "path_score"]
            )

    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, path_score double")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents")).drop("token_ids")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
