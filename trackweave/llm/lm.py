"""Language-model scoring: exact corpus unigram counts, and a log-bilinear model trained with noise-contrastive estimation.

Texts are read and cut into words once, in chunks of some megabytes where they lie; what crosses the network is one
row for each distinct word of a chunk, counted by grouping and joined back. The model learns from every training token:
each task passes over its own chunks, and the tasks' parameters are averaged between rounds. Its vocabulary grows
with the root of the corpus; all further words belong to frequency classes, by powers of two of their counts.
Words are predicted in two steps, block of the vocabulary and word within it, so a token costs about the root of
the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_words, read, short_batches, table

#: The token after each text; no word holds a space.
END = b" "
CHUNK_BYTES, WARM = 4 << 20, 16
#: Words known by name: half the root of the number of training tokens, within these bounds; the others share frequency classes.
LEAST_WORDS, MOST_WORDS, OCTAVES = 512, 1 << 17, 40
#: Embedding width, noise to data, tokens a step, and rate of the model; chunks that a task learns from; parameters averaged at a time, and parts of one sum.
WIDTH, NOISE, STEP, RATE, SHARE, BLOCK, FAN = 16, 10, 32_768, 0.1, 16, 1 << 16, 64


class Numbers(dict):
    """Word -> its number, in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    out = byte_words(text)
    out.append(END)
    return out


def hash_words(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Small whole numbers as compressed int32."""
    return zstandard.compress(numbers.astype("<i4").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<i4")


CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, counts binary, ids binary"


def chunked(docs: DataFrame, held_out: F.Column, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of texts: its documents, the hashes and training counts of its distinct words, and the tokens as numbers of these."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def made(docs_, held, texts):
            index = Numbers()
            ids, lengths = [], []
            for t in texts:
                own = tokens(t)
                lengths.append(len(own))
                ids.append(np.fromiter(map(index.__getitem__, own), dtype="<i4", count=len(own)))
            flat = np.concatenate(ids)
            learnt = flat[np.repeat(~np.array(held), lengths)]
            counts = np.bincount(learnt, minlength=len(index)).astype("<u4")
            cols = ([number], [docs_], [held], [lengths], [hash_words(index).tobytes()], [counts.tobytes()], [packed(flat)])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        docs_, held, texts, size = [], [], [], 0
        for b in batches:
            for d, t, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held"))):
                docs_.append(d), held.append(h), texts.append(t)
                size += len(t) + 64
                if size >= chunk_bytes:
                    yield made(docs_, held, texts)
                    docs_, held, texts, size = [], [], [], 0
                    number += 1
        if docs_:
            yield made(docs_, held, texts)

    return table(rows.mapInArrow(run, CHUNK), "lm-chunks")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(chunk, slot, h, n): the distinct words of each chunk with their training counts there."""

    def run(batches):
        for b in batches:
            for chunk, words, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "counts"))):
                h, n = np.frombuffer(words, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
                for at in range(0, len(h), 50_000):
                    cut = slice(at, at + 50_000)
                    own = len(h[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own, chunk), pa.int64()), pa.array(np.arange(at, at + own, dtype=np.int32)), pa.array(h[cut]), pa.array(n[cut])], names=["chunk", "slot", "h", "n"])

    return chunks.select("chunk", "words", "counts").mapInArrow(run, "chunk long, slot int, h long, n long")


@dataclass
class Vocabulary:
    """Classes: the words known by name, most frequent first, then the frequency classes. ``shares``: count + 1 of all words of a frequency class, with one unknown word in the first."""

    hashes: np.ndarray  # ascending
    number: np.ndarray  # class of each
    counts: np.ndarray  # training tokens of each class
    shares: np.ndarray
    size: int  # training tokens
    kinds: int

    @property
    def named(self) -> int:
        return len(self.hashes)

    def classes_of(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and log10 of its share of the class."""
        octave = np.log2(np.maximum(counts, 1)).astype(np.int64)
        classes, share = self.named + octave, np.log10((counts + 1) / np.maximum(self.shares[octave], 1))
        if self.named:
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.named - 1)
            known = self.hashes[at] == hashes
            classes, share = np.where(known, self.number[at], classes), np.where(known, 0.0, share)
        return classes, share


def counted(words: DataFrame) -> DataFrame:
    """(chunk, slot, c, h): the words of each chunk with their counts in all chunks; h stands in one row of each word alone.

    A word has at most a row a chunk, so no word has more than a small share of the rows.
    """
    word = Window.partitionBy("h")
    rows = words.select("chunk", "slot", F.sum("n").over(word).alias("c"), F.when(F.row_number().over(word.orderBy("chunk", "slot")) == 1, F.col("h")).alias("h"))
    return table(rows, "lm-counted")


def vocabulary(totals: DataFrame, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> Vocabulary:
    """The words and frequency classes of totals (h, c); only words known by name and one row for each class come to the driver."""
    octave = F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)).cast("double"))).cast("int")
    by = totals.where("c > 0").groupBy(octave.alias("octave")).agg(F.count("*").alias("kinds"), F.sum("c").alias("c")).collect()
    kinds, tokens_ = np.zeros(OCTAVES + 1, np.int64), np.zeros(OCTAVES + 1, np.int64)
    for r in by:
        kinds[r["octave"]], tokens_[r["octave"]] = r["kinds"], r["c"]
    size = int(tokens_.sum())
    k = min(most, max(least, int(size**0.5 / 2)))
    top = totals.where("c > 0").orderBy(F.desc("c"), "h").limit(k).collect()
    h, c = np.array([r["h"] for r in top], dtype=np.int64), np.array([r["c"] for r in top], dtype=np.int64)
    own = np.log2(np.maximum(c, 1)).astype(np.int64)
    kinds_left = kinds - np.bincount(own, minlength=OCTAVES + 1)
    left = tokens_ - np.bincount(own, weights=c, minlength=OCTAVES + 1).astype(np.int64)
    shares = left + kinds_left
    shares[0] += 1
    order = np.argsort(h)
    return Vocabulary(h[order], order, np.concatenate((c, left)), shares, size, int(kinds.sum()))


CODED = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, known array<long>, base array<double>, within array<double>, classes binary"


def coded(chunks: DataFrame, answers: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The chunks with each token's class, and each document's known tokens, base score and shares within classes (log10)."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocab)

    def run(key, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        v, r = shared.value, frame.iloc[0]
        counts = np.zeros(len(r["words"]) // 8, np.int64)
        counts[answers["slot"].to_numpy()] = answers["c"].to_numpy()
        ids, lengths = unpacked(r["ids"]), np.asarray(r["lengths"])
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        classes, share = v.classes_of(np.frombuffer(r["words"], "<i8"), counts)
        base = np.log10((counts + 1) / (v.size + (v.kinds + 1)))
        sums = [np.add.reduceat(x[ids], first) for x in ((counts > 0).astype(np.int64), base, share)]
        return pd.DataFrame({"chunk": [r["chunk"]], "doc_ids": [r["doc_ids"]], "held": [r["held"]], "lengths": [r["lengths"]], "known": [sums[0]], "base": [sums[1]], "within": [sums[2]], "classes": [packed(classes[ids])]})

    return table(chunks.drop("counts").groupBy("chunk").cogroup(answers.select("chunk", "slot", "c").groupBy("chunk")).applyInPandas(run, CODED), "lm-coded")


def contexts(ids: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; texts start at ``starts``."""
    second = np.concatenate(([begin], ids[:-1]))
    second[starts] = begin
    first = np.concatenate(([begin], second[:-1]))
    first[starts] = begin
    return first, second


@dataclass
class LogBilinear:
    """P(class | two classes before) = softmax over blocks of (g U' + bu) times softmax within the block of (g Q' + bq), g = r1 C1 + r2 C2.

    Blocks hold ``width`` classes in order of frequency. A context may also be the text's beginning, numbered after the classes.
    """

    p: dict[str, np.ndarray]
    width: int

    @classmethod
    def start(cls, counts: np.ndarray, dims: int = WIDTH, seed: int = 42) -> LogBilinear:
        """A model that gives every class its share of the counts (one is added to each)."""
        rng, n = np.random.default_rng(seed), len(counts)
        width = max(1, int(np.ceil(np.sqrt(n))))
        blocks = -(-n // width)
        own = np.concatenate((counts + 1.0, np.zeros(blocks * width - n))).reshape(blocks, width)
        with np.errstate(divide="ignore"):
            bu, bq = np.log(own.sum(axis=1) / own.sum()), np.log(own / own.sum(axis=1, keepdims=True)).ravel()[:n]
        p = {"r": rng.normal(0, 0.3, (n + 1, dims)), "c1": np.eye(dims) * 0.5, "c2": np.eye(dims), "u": np.zeros((blocks, dims)), "bu": bu, "q": np.zeros((n, dims)), "bq": bq}
        return cls({k: x.astype(np.float32) for k, x in p.items()}, width)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        ends = np.cumsum([x.size for x in self.p.values()])
        return LogBilinear({k: flat[e - x.size : e].reshape(x.shape).copy() for (k, x), e in zip(self.p.items(), ends)}, self.width)

    def guess(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.p["r"][first] @ self.p["c1"] + self.p["r"][second] @ self.p["c2"]

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Normalised natural log probability of each target class, by matrix products over batches."""
        p, out = self.p, np.zeros(len(target))

        def pick(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            logits -= logits.max(axis=1, keepdims=True)
            own = logits[np.arange(len(at)), at]
            return own - np.log(np.exp(logits, out=logits).sum(axis=1))

        for lo in range(0, len(target), step):
            cut = slice(lo, lo + step)
            g, block, place = self.guess(first[cut], second[cut]), target[cut] // self.width, target[cut] % self.width
            logs = pick(g @ p["u"].T + p["bu"], block)
            for rows in grouped(block):
                k = slice(block[rows[0]] * self.width, (block[rows[0]] + 1) * self.width)
                logs[rows] += pick(g[rows] @ p["q"][k].T + p["bq"][k], place[rows])
            out[cut] = logs
        return out


def grouped(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each key."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []


class Learner:
    """Noise-contrastive estimation by Adagrad: each step tells a batch's classes from noise of the unigram shares, ``NOISE`` to one, whose expectation is taken whole, first among blocks and then within the block."""

    def __init__(self, model: LogBilinear, start: LogBilinear, rate: float = RATE):
        self.m, self.rate = model, rate
        self.sums = {k: np.full_like(x, 1e-6) for k, x in model.p.items()}
        self.noise = {k: start.p[k] for k in ("bu", "bq")}  # the start's biases are the log shares of the noise

    def move(self, name: str, rows, grad: np.ndarray) -> None:
        self.sums[name][rows] += grad * grad
        self.m.p[name][rows] -= self.rate * grad / np.sqrt(self.sums[name][rows])

    def part(self, g: np.ndarray, at: np.ndarray, rows: slice, weights: str, bias: str, n: int) -> np.ndarray:
        """Move the weights of one choice, and return the gradient of its guesses."""
        q, share = self.m.p[weights][rows], self.noise[bias][rows]
        err = g @ -q.T
        err -= self.m.p[bias][rows] - share - np.float32(np.log(NOISE))
        np.exp(err, out=err)
        err += 1
        np.reciprocal(err, out=err)
        own = err[np.arange(len(at)), at]
        err *= NOISE * np.exp(share)
        err[np.arange(len(at)), at] += own - 1
        err /= np.float32(n)
        d_g = err @ q
        self.move(weights, rows, err.T @ g)
        self.move(bias, rows, err.sum(axis=0))
        return d_g

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        p, n, width = self.m.p, len(target), self.m.width
        r1, r2 = p["r"][first], p["r"][second]
        g = r1 @ p["c1"] + r2 @ p["c2"]
        block, place = target // width, target % width
        d_g = self.part(g, block, slice(0, len(p["u"])), "u", "bu", n)
        for rows in grouped(block):
            k = int(block[rows[0]])
            d_g[rows] += self.part(g[rows], place[rows], slice(k * width, min((k + 1) * width, len(p["q"]))), "q", "bq", n)
        both, d_r = np.concatenate((first, second)), np.concatenate((d_g @ p["c1"].T, d_g @ p["c2"].T))
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) > 0)))
        self.move("c1", slice(None), r1.T @ d_g)
        self.move("c2", slice(None), r2.T @ d_g)
        self.move("r", both[order][starts], np.add.reduceat(d_r[order], starts))


def learn(model: LogBilinear, start: LogBilinear, chunks, step: int = STEP) -> tuple[LogBilinear, int]:
    """A pass over (lengths, held, classes) of chunks, held-out texts left out; the model and its number of tokens."""
    learner, seen, begin = Learner(model, start), 0, len(start.p["q"])
    for lengths, held, classes in chunks:
        ids = unpacked(classes)[np.repeat(~np.asarray(held, bool), lengths)].astype(np.int64)
        if not len(ids):
            continue
        own = np.asarray(lengths)[~np.asarray(held, bool)]
        first, second = contexts(ids, np.concatenate(([0], np.cumsum(own)[:-1])), begin)
        turn = np.random.default_rng(len(ids)).permutation(len(ids))
        for at in range(0, len(turn), step):
            rows = turn[at : at + step]
            learner.step(first[rows], second[rows], ids[rows])
        seen += len(ids)
    return learner.m, seen


def train(coded_: DataFrame, counts: np.ndarray, chunks: int, share: int = SHARE) -> LogBilinear:
    """Two rounds of parameter averaging, the first over one in ``WARM`` of the chunks; each task passes over about ``share`` chunks, as they lie."""
    spark, start = coded_.sparkSession, LogBilinear.start(counts)
    model = start
    for part in (WARM, 1):
        rows = coded_ if part == 1 or chunks < 2 * part else coded_.where(F.pmod(F.xxhash64("chunk"), F.lit(part)) == 0)
        workers = max(1, -(-chunks // (share * part)))
        shared = spark.sparkContext.broadcast((model, start))

        def run(batches):
            now, first = shared.value

            def each():
                for b in batches:
                    yield from zip(*(b.column(c).to_pylist() for c in ("lengths", "held", "classes")))

            got, seen = learn(now.filled(now.flat()), first, each())
            if seen:
                flat, own = got.flat(), TaskContext.get().partitionId()
                for k, at in enumerate(range(0, len(flat), BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([seen], pa.int64()), pa.array([(flat[at : at + BLOCK].astype("<f8") * seen).tobytes()], pa.binary())], names=["block", "worker", "seen", "sums"])

        schema = "block int, worker int, seen long, sums binary"
        sums = table(rows.select("lengths", "held", "classes").coalesce(workers).mapInArrow(run, schema), "lm-learnt")

        def add(key, frame: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, "<f8") for x in frame.sort_values("worker")["sums"]], axis=0)
            return pd.DataFrame({"block": [key[0]], "worker": [key[1]], "seen": [frame["seen"].sum()], "sums": [total.tobytes()]})

        while True:  # sums of at most FAN parts at a time
            sums = table(sums.withColumn("worker", F.floor(F.col("worker") / FAN).cast("int")).groupBy("block", "worker").applyInPandas(add, schema), "lm-sums")
            if workers <= FAN:
                break
            workers = -(-workers // FAN)
        found = sorted((r["block"], np.frombuffer(r["sums"], "<f8") / r["seen"]) for r in sums.collect())
        if found:
            model = start.filled(np.concatenate([x for _, x in found]).astype(np.float32))
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row.

    Counts and model come from all rows for which ``held_out`` is false (null counts as false). score: log10 probability of
    the text; the model names half as many words as the root of the training tokens, from ``least_words`` to ``most_words``, and
    a word of a frequency class has its class's probability times its add-one share of the class, so token probabilities
    sum to one. A null or empty text is the end token alone. Repeated rows are each counted and returned; an empty table gives
    none; without training tokens all words are unknown. A very long text is a chunk of its own.
    """
    spark = docs.sparkSession
    short_batches(spark)
    chunks = chunked(docs, held_out, id_col, text_col, chunk_bytes)
    answers = counted(chunk_words(chunks))
    vocab = vocabulary(answers.where("h is not null"), least_words, most_words)
    rows = coded(chunks, answers, vocab)
    model = train(rows, vocab.counts, rows.count())
    shared = spark.sparkContext.broadcast((model, vocab.size))

    def score(batches):
        lbl, size = shared.value
        names = [c.split()[0] for c in SCORES.split(", ")]
        for b in batches:
            for docs_, held, lengths, known, base, within, classes in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "held", "lengths", "known", "base", "within", "classes"))):
                ids = unpacked(classes).astype(np.int64)
                first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                logs = lbl.log_probabilities(*contexts(ids, first, len(lbl.p["q"])), ids) / np.log(10)
                scores = np.add.reduceat(logs, first) + np.array(within)
                cols = (docs_, held, lengths, known, [size] * len(docs_), base, scores)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    return rows.drop("chunk").mapInArrow(score, SCORES)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(read(spark, sf_dir, "documents"), held)
