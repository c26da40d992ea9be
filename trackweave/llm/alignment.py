"""Cross-tokenizer alignment over labelled bytes.

Two tokenizers cut the same bytes at different places. Every byte gets a label: 0 if no token ends there, 1 if one of A
does, 2 if one of B does, 3 if both do. A regular expression scans the label string for spans up to each 3; the labels
counted in a span say how many tokens of A and of B make the group. Tokens of one group are linked, and the links are
counted over the corpus by id pair.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, read, short_batches, table
from .pieces import MODEL, Vocabulary, spread

BYTE_BPE = os.environ.get("TRACKWEAVE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
SPAN = re.compile(rb"[^\x03]*\x03")
#: Characters that may count as white space for a tokenizer: a space after one of them is no place to cut.
WHITE = "\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
UNIT = re.compile(f" [^ ]*(?:(?<=[{WHITE}]) [^ ]*)*")
#: Units a task keeps, characters of the longest of these, and units that are encoded at a time.
KNOWN, SHORT, BATCH = 300_000, 48, 4096
#: Distinct pairs of documents that one chunk holds, about; links of a unit that are kept one by one, links of a longer one that are spelled
#: out at a time; tokens of a group from which it is counted by distinct ids.
CHUNK, FEW, LINKS, WIDE = 1 << 20, 1024, 1 << 20, 64
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Names:
    """The ids of a tokenizer in decimal, each with a comma after it, then each with ``end``: as bytes one after another."""

    def __init__(self, n: int, end: str):
        names = [f"{i}{x}" for x in ("," + end) for i in range(n)]
        self.n, self.sizes = n, np.array([len(x) for x in names], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer("".join(names).encode(), np.uint8)


class Encoded(NamedTuple):
    """Tokens and groups of several texts, flat: ids of A and of B, how many of each make a group; and of each text its tokens, groups, and whether it has any."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    valid: np.ndarray
    ends: np.ndarray


class Unit(NamedTuple):
    """Tokens, groups and links of a unit, its groups as text, its linked id pairs, and how often each stands there if not once a link."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    digits: bytes
    pairs: bytes
    times: bytes


class Aligner:
    """Encodes texts with both tokenizers and groups their tokens.

    A text is cut before each space that follows a character that is no white space: no token of either kind crosses such a place, and
    what stands after it has no bearing on the tokens before. So a unit, most often a word, is encoded once and kept.
    """

    def __init__(self, byte_bpe: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet, vocab = byte_alphabet(), json.loads(byte_bpe)["model"]["vocab"]
        self.a_raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_raw[i] = bytes(alphabet[c] for c in token)
        self.b_raw = Vocabulary(pieces).raw
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in raw], np.int64) for raw in (self.a_raw, self.b_raw))
        self.a_names, self.b_names = Names(len(self.a_raw), "|"), Names(len(self.b_raw), ";")
        self.names = np.concatenate((self.a_names.bytes, self.b_names.bytes))
        self.before = len(self.b.encode("x"))
        self.known: dict[str, Unit | None] = {}

    def encode(self, texts: list[str]) -> Encoded:
        """Of texts that begin with a space. One that either tokenizer does not give back byte for byte is not valid and has no tokens."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [x[self.before :] for x in self.b.encode(["x" + t for t in texts], num_threads=1)]  # the tokenizer's own space goes before the x
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        valid, chain = [True] * len(texts), itertools.chain.from_iterable
        if not b"".join(map(self.a_raw.__getitem__, chain(a))) == b"".join(raw) == b"".join(map(self.b_raw.__getitem__, chain(b))):
            valid = [b"".join([self.a_raw[i] for i in x]) == r == b"".join([self.b_raw[i] for i in y]) for x, y, r in zip(a, b, raw)]
            a, b, raw = [[x if ok else type(x)() for x, ok in zip(side, valid)] for side in (a, b, raw)]
        n_a, n_b, n_raw = (np.array([len(x) for x in side], np.int64) for side in (a, b, raw))
        a, b = (np.fromiter(chain(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        labels = np.zeros(n_raw.sum(), np.uint8)
        labels[np.cumsum(self.a_sizes[a]) - 1] = 1
        labels[np.cumsum(self.b_sizes[b]) - 1] += 2
        sizes = np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64)
        ends = np.cumsum(sizes)
        in_a, in_b = (np.add.reduceat(x, ends - sizes, dtype=np.int64) if len(ends) else sizes for x in (labels & 1, labels >> 1))
        n_groups = np.diff(np.searchsorted(ends, np.cumsum(n_raw), "right"), prepend=0)
        return Encoded(a, b, in_a, in_b, n_a, n_b, n_groups, np.array(valid, bool), ends - np.repeat(np.cumsum(n_raw) - n_raw, n_groups))

    def digits(self, e: Encoded) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all texts, taken from the tables of names, and where each text's ends."""
        last_a, last_b = np.zeros(len(e.a), np.int64), np.zeros(len(e.b), np.int64)
        last_a[np.cumsum(e.in_a) - 1], last_b[np.cumsum(e.in_b) - 1] = self.a_names.n, self.b_names.n
        at_a = np.arange(len(e.a)) + np.repeat(np.cumsum(e.in_b) - e.in_b, e.in_a)  # places among all tokens, a group's A before its B
        at_b = np.arange(len(e.b)) + np.repeat(np.cumsum(e.in_a), e.in_b)
        starts, sizes = np.empty(len(e.a) + len(e.b), np.int64), np.empty(len(e.a) + len(e.b), np.int64)
        starts[at_a], sizes[at_a] = self.a_names.starts[e.a + last_a], self.a_names.sizes[e.a + last_a]
        starts[at_b], sizes[at_b] = self.b_names.starts[e.b + last_b] + len(self.a_names.bytes), self.b_names.sizes[e.b + last_b]
        out = b"".join([self.names[spread(starts[k : k + LINKS], sizes[k : k + LINKS])].tobytes() for k in range(0, len(starts), LINKS)])
        return out, np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(e.n_a + e.n_b)]

    def units(self, units: list[str]) -> list[Unit | None]:
        found: list[Unit | None] = []
        for at in range(0, len(units), BATCH):
            e = self.encode(units[at : at + BATCH])
            digits, to = self.digits(e)
            groups, a_to, b_to = np.cumsum(e.n_groups), np.cumsum(e.n_a), np.cumsum(e.n_b)
            links = np.concatenate(([0], np.cumsum(e.in_a * e.in_b)))[groups]
            n_links = np.diff(links, prepend=0)
            few = n_links <= FEW
            kept = np.repeat(few, e.n_groups)
            first_b, group = np.cumsum(e.in_b) - e.in_b, np.repeat(np.arange(len(e.in_a)), e.in_a)
            token = np.flatnonzero(kept[group])  # tokens of A in units of few links, each with all of B in its group
            partners = e.in_b[group[token]]
            pairs = (np.repeat(e.a[token] << 32, partners) | e.b[spread(first_b[group[token]], partners)]).tobytes()
            pairs_to = 8 * np.cumsum(np.where(few, n_links, 0))
            lo = [0] * 5
            for k, hi in enumerate(zip(to.tolist(), pairs_to.tolist(), groups.tolist(), a_to.tolist(), b_to.tolist())):
                if not e.valid[k]:
                    found.append(None)
                    continue
                own, times = pairs[lo[1] : hi[1]], b""
                if not few[k]:
                    keys, n = linked(e.a[lo[3] : hi[3]], e.b[lo[4] : hi[4]], e.in_a[lo[2] : hi[2]], e.in_b[lo[2] : hi[2]])
                    own, times = keys.tobytes(), n.tobytes()
                found.append(Unit(hi[3] - lo[3], hi[4] - lo[4], hi[2] - lo[2], int(n_links[k]), digits[lo[0] : hi[0]], own, times))
                lo = hi
        return found

    def texts(self, texts: list[str | None]) -> list[list[Unit] | None]:
        """The units of each text; None where a text has no tokens."""
        if len(self.known) > KNOWN:
            self.known.clear()
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        new = list({u for units in cut for u in units if u not in self.known})
        self.known.update(zip(new, self.units(new)))
        out = []
        for units in cut:
            own = list(map(self.known.__getitem__, units))
            out.append(None if not own or None in own else own)
        for u in new:
            if len(u) > SHORT:
                del self.known[u]
        return out


def pairs_of(units: list[Unit]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct id pairs, ascending; links of each) of a text."""
    keys, times = np.unique(np.frombuffer(b"".join([u.pairs for u in units if not u.times]), np.int64), return_counts=True)
    counted = [u for u in units if u.times]
    if not counted:
        return keys, times
    keys, at = np.unique(np.concatenate((keys, np.frombuffer(b"".join([u.pairs for u in counted]), np.int64))), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate((times, np.frombuffer(b"".join([u.times for u in counted]), np.int64))))
    return keys, total


def linked(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct id pairs, ascending; links of each): a pair is A's id << 32 | B's id. Links are spelled out some at a time."""
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    keys, times = [], []
    wide = (in_a > WIDE) & (in_b > WIDE)
    for g in np.flatnonzero(wide):  # a group of very many tokens: by its distinct ids
        own_a, n_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        own_b, n_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        keys.append(((own_a << 32)[:, None] | own_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
    group = np.repeat(np.arange(len(in_a)), in_a)
    token = np.flatnonzero(~wide[group])
    partners = in_b[group[token]]
    ends = np.cumsum(partners)
    cuts = np.searchsorted(ends, np.arange(LINKS, (ends[-1] if len(ends) else 0) + LINKS, LINKS), "right")
    for lo, hi in zip(np.concatenate(([0], cuts[:-1])), cuts):
        t, n = token[lo:hi], partners[lo:hi]
        own, many = np.unique(np.repeat(a[t] << 32, n) | b[spread(first_b[group[t]], n)], return_counts=True)
        keys.append(own)
        times.append(many)
    if len(keys) == 1:
        return keys[0], times[0]
    own, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, np.concatenate(times) if times else np.zeros(0, np.int64))
    return own, total


def _shared(spark: SparkSession, byte_bpe: str, pieces: str):
    with open(byte_bpe, encoding="utf-8") as a, open(pieces, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _lists(values: list, kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind, safe=False))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    short_batches(docs.sparkSession)
    return columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def align_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, in_a, in_b, ends) of every document row, where the text lies: no shuffle.

    a_ids and b_ids are the tokens of a space and the text; in_a and in_b say how many of each make group after group, ends where in
    the bytes each group ends. A text that is null, empty, or that either tokenizer does not give back byte for byte has empty
    lists; repeated rows are each returned; further columns are ignored; a very long text is one row.
    """
    shared = _shared(docs.sparkSession, byte_bpe, pieces)

    def run(batches):
        aligner = Aligner(*shared.value)
        for b in batches:
            own = [k for k, t in enumerate(b.column(1).to_pylist()) if t]
            e = aligner.encode([" " + t for t in b.column(1).take(pa.array(own, pa.int64())).to_pylist()])
            columns = []
            for values, n in ((e.a, e.n_a), (e.b, e.n_b), (e.in_a, e.n_groups), (e.in_b, e.n_groups), (e.ends, e.n_groups)):
                sizes = np.zeros(len(b), np.int64)
                sizes[own] = n
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32(), safe=False)))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "a_ids", "b_ids", "in_a", "in_b", "ends"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, in_a array<int>, in_b array<int>, ends array<int>")


CODED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pairs array<long>, held array<int>"


def coded_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links of every document in the terms of its chunk.

    A chunk is a run of documents that one task met, of bounded size. It has a row of its own with its distinct id pairs (``pairs``, most
    held first) and how many of its documents hold each (``held``); its documents name their pairs by place in that list, as ascending
    ``steps``, with ``times`` the links of each. So what is counted over the corpus and sent back is a pair once a chunk, not once a document.
    """
    shared = _shared(docs.sparkSession, byte_bpe, pieces)
    names = [x.split()[0] for x in CODED.split(", ")]
    none = np.zeros(0, np.int64)

    def chunk_rows(chunk: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys = [r[6] for r in rows]
        sizes = np.array([len(k) for k in keys])
        pairs, at, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        order = np.argsort(-held, kind="stable")
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        at, steps, times = slot[at], [], []
        for r, lo, hi in zip(rows, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            turn = np.argsort(at[lo:hi])
            steps.append(np.diff(at[lo:hi][turn], prepend=0))
            times.append(r[7][turn])
        ids, *numbers, digests = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:6], [pa.int64()] * 5 + [pa.string()])]
        n = len(rows)
        documents = [pa.array([chunk] * n, pa.int64()), ids, *numbers, digests, _lists(steps, pa.int32()), _lists(times, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(documents, names=names)
        nothing = [pa.nulls(1, x.type) for x in documents[1:9]]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *nothing, _lists([pairs[order]], pa.int64()), _lists([held[order]], pa.int32())], names=names)

    def run(batches):
        aligner = Aligner(*shared.value)
        chunk, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for doc_id, units in zip(b.column(0).to_pylist(), aligner.texts(b.column(1).to_pylist())):
                if units is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", none, none))
                    continue
                keys, times = pairs_of(units)
                digest = hashlib.sha256(b"".join([u.digits for u in units])[:-1]).hexdigest()
                rows.append((doc_id, *[sum([u[k] for u in units]) for k in range(4)], digest, keys, times))
                size += len(keys)
                if size >= CHUNK:
                    yield from chunk_rows(chunk, rows)
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield from chunk_rows(chunk, rows)

    return _texts(docs, id_col, text_col).mapInArrow(run, CODED)


def pair_counts(coded: DataFrame) -> DataFrame:
    """(pair, docs, best) of :func:`coded_links`: how many documents hold each id pair, and whether no pair of its A id is held by more."""
    known = coded.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("slot", "p"))
    counts = table(known.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("docs")), "align-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row for each id of A at most: bounded by its vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document row.

    A pair's count is the number of document rows that hold it linked. n_best counts the links whose pair is held by as many
    documents as any pair of its A id; count_sum adds the counts over all links. A text without tokens (see
    :func:`align_documents`) has zeros and no digest; rows that repeat each count; an empty table gives none; further
    columns are ignored. Documents are met again by chunk, one group of bounded size each.
    """
    coded = table(coded_links(docs, byte_bpe, pieces, id_col, text_col), "align-coded")
    counts = pair_counts(coded)
    known = coded.where("pairs is not null").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("slot", "pair"))
    back = known.join(counts, "pair").select("of", "slot", "docs", "best")
    kept = ["doc_id", *NUMBERS, "groups_sha256"]

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        slots = found.column("slot").to_numpy()
        docs_of, best_of = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        docs_of[slots], best_of[slots] = found.column("docs").to_numpy(), found.column("best").to_numpy()
        best, total = [], []
        for steps, times in zip(rows.column("steps"), rows.column("times")):
            at, n = np.cumsum(steps.values.to_numpy()), times.values.to_numpy().astype(np.int64)
            best.append(int((best_of[at] * n).sum()))
            total.append(int((docs_of[at] * n).sum()))
        return pa.table([*[rows.column(c) for c in kept], pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    own = coded.where("pairs is null").select("chunk", *kept, "steps", "times")
    summed = own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return summed.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(read(spark, sf_dir, "documents"))
