"""Operator 2, LM scoring: masked pseudo-likelihood under a bidirectional window network that is trained in numpy.

Tokens: a text's words (runs without white space), each of which has a class and an id in its class. The most frequent words of the whole
corpus are classes by themselves; all others share a class by their shape (length, first letter, last sign) and have one of 65 536 ids there,
by hash. The network predicts each token's class from the classes of WINDOW tokens on either side: an embedding for each place and class,
summed, tanh, softmax. The id's probability within its class comes from Spark's counts of all words of all documents, smoothed. So a token is
one of 4.2 million ids, the probabilities of which add up to one, and what the model knows of words grows with the corpus.

Tokens are written once, as a byte each, and documents are dealt to trainers by a hash of id and text, a trainer for each TRAINER_TOKENS tokens.
Training masks one of MASK parts of the tokens at a time; the parts are dealt over the rounds, so that every token is a target once. In a
round, each trainer goes through its documents in the order of their hashes, starting from the shared weights, and then weights are averaged
by tokens seen. So weights don't depend on files or partitions. A document's score is the sum of log-probabilities of all its tokens, each
predicted from both sides.

The driver holds the classes' words, the counts of ids (4.2 million at most) and one set of weights (about 20 000 numbers).

Defined cases: null and wordless texts have no tokens, a sum of 0 and a null mean; equal texts get equal scores; rows with equal doc_ids are
rows of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mixed, per_row, runs, span_hashes, staged

VOCABULARY = 256
SHAPES = 64
WINDOW = 2
WIDTH = 16
ROUNDS = 4
MASK = 24
BATCH = 1024
#: Tokens of a trainer, and how many of them train at once at most.
TRAINER_TOKENS, TRAINERS = 1 << 22, 4096
#: Ids of a class that words share, as a power of two, and what is added to their counts.
ID_BITS = 16
SMOOTH = 0.5
#: Tokens that are looked at together.
PIECE = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of every word."""
    starts, ends = runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    return span_hashes(data, starts, ends).view(np.int64), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 to 63: length in bytes up to 16, whether the first byte is a capital, whether the last is a sign."""
    last, first = data[ends - 1], data[starts]
    sign = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57)))
    return np.minimum(ends - starts, 16) - 1 + 16 * ((first >= 65) & (first <= 90)) + 32 * sign


def count_words(docs: DataFrame) -> DataFrame:
    """word (its hash), shape, n over all documents."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                word, _, starts, ends = word_hashes(data, offsets)
                words, first, n = np.unique(word, return_index=True, return_counts=True)
                held.append((words, shapes(data, starts[first], ends[first]) if len(first) else first, n))
                size += len(words)
                if size > 1 << 20:
                    yield _added(held)
                    held, size = [], 0
        if held:
            yield _added(held)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, shape long, n long")
    return parts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _added(held: list) -> pa.RecordBatch:
    words, first, where = np.unique(np.concatenate([w for w, _, _ in held]), return_index=True, return_inverse=True)
    n = np.bincount(where, np.concatenate([n for _, _, n in held]), len(words)).astype(np.int64)
    return pa.record_batch([pa.array(words), pa.array(np.concatenate([s for _, s, _ in held]).astype(np.int64)[first]), pa.array(n)], names=["word", "shape", "n"])


class Tokens:
    """Classes of words: 0 is beyond the text, then the known words, then the shapes. within: log-probabilities of ids in the shapes' classes, by shape and id."""

    def __init__(self, known: np.ndarray, within: np.ndarray):
        self.known, self.within = np.sort(known), within

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, log-probabilities within them, offsets of the documents in them)."""
        word, doc, starts, ends = word_hashes(data, offsets)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))]).astype(np.int64)
        if not len(word):
            return np.zeros(0, np.uint8), np.zeros(0, np.float32), bounds
        shape = shapes(data, starts, ends)
        ids, logs = 1 + len(self.known) + shape, self.within[(shape << ID_BITS) + (word & ((1 << ID_BITS) - 1))]
        if len(self.known):
            spot = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
            own = self.known[spot] == word
            ids, logs = np.where(own, 1 + spot, ids), np.where(own, np.float32(0), logs)
        return ids.astype(np.uint8), logs, bounds


def contexts(ids: np.ndarray, offsets: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The 2 * window tokens around each place, left ones first; 0 beyond the document."""
    doc = np.searchsorted(offsets, at, "right") - 1
    low, high = offsets[doc], offsets[doc + 1]
    out = np.zeros((len(at), 2 * window), np.int32)
    for j, d in enumerate([*range(-window, 0), *range(1, window + 1)]):
        there = at + d
        ok = (there >= low) & (there < high)
        out[ok, j] = ids[there[ok]]
    return out


def targets(ids: np.ndarray, offsets: np.ndarray, turn: int, rounds: int, mask: int) -> list[np.ndarray]:
    """The places that a round predicts, part by part; over all rounds each place comes once."""
    n = np.diff(offsets)
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], n)
    salt = np.repeat(np.bincount(np.repeat(np.arange(len(n)), n), ids, len(n)).astype(np.uint64), n)
    part = mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(mask)
    return [np.flatnonzero(part == k) for k in range(turn, mask, rounds)]


class Network:
    """Place-wise embeddings, tanh, softmax; trained by AdaGrad on cross-entropy."""

    def __init__(self, vocabulary: int, window: int, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.parts = [rng.normal(0, 0.3, (2 * window, vocabulary, width)).astype(np.float32), np.zeros(width, np.float32), rng.normal(0, 0.3, (width, vocabulary)).astype(np.float32), np.zeros(vocabulary, np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, p in enumerate(self.parts):
            self.parts[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        e, b, _, _ = self.parts
        h = b + e[0][context[:, 0]]
        for j in range(1, context.shape[1]):
            h += e[j][context[:, j]]
        return np.tanh(h, out=h)

    def bounded(self) -> bool:
        """Whether no exponent can overflow; hidden values are between -1 and 1."""
        _, _, w, c = self.parts
        return float(np.abs(w).sum(axis=0).max() + np.abs(c).max()) < 80

    def logs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        out = np.empty(len(target), np.float32)
        _, _, w, c = self.parts
        bounded = self.bounded()
        for a in range(0, len(target), 8192):
            z = self.hidden(context[a : a + 8192]) @ w
            z += c
            t = z[np.arange(len(z)), target[a : a + 8192]]
            if not bounded:
                top = z.max(axis=1, keepdims=True)
                z -= top
                t = t - top[:, 0]
            out[a : a + 8192] = t - np.log(np.exp(z, out=z).sum(axis=1))
        return out

    def train(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        e, b, w, c = self.parts
        width, places = e.shape[2], np.arange(e.shape[0]) * e.shape[1]
        for a in range(0, len(target), BATCH):
            x, y = context[a : a + BATCH], target[a : a + BATCH]
            h = self.hidden(x)
            z = h @ w
            z += c
            if not self.bounded():
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= len(y) * z.sum(axis=1, keepdims=True)
            z[np.arange(len(y)), y] -= np.float32(1 / len(y))
            back = (z @ w.T) * (1 - h * h)
            # a place's embedding of a class gets the sum of what comes back to it
            at = (x + places)[:, :, None] * width + np.arange(width)
            to_e = np.bincount(at.ravel(), np.broadcast_to(back[:, None, :], at.shape).ravel(), e.size).reshape(e.shape).astype(np.float32)
            for part, grad, m in zip((e, b, w, c), (to_e, back.sum(axis=0), h.T @ z, z.sum(axis=0)), memory, strict=True):
                m += grad * grad
                part -= rate * grad / (np.sqrt(m) + 1e-8)


@dataclass
class Model:
    """What scoring needs: the words that are classes, log-probabilities of ids within the others, and the network's weights."""

    known: np.ndarray
    within: np.ndarray
    weights: np.ndarray


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(known words, log-probabilities within the shapes' classes), from the counts of all words."""
    counts = staged(count_words(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - SHAPES - 1)
    known = np.array(sorted(r.word for r in top.select("word").collect()), np.int64)
    ids = F.shiftleft("shape", ID_BITS) + F.col("word").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti")  # VOCABULARY words at most
    found = rest.groupBy(ids.alias("id")).agg(F.sum("n").alias("n")).toArrow()  # SHAPES << ID_BITS rows at most
    n = np.zeros(SHAPES << ID_BITS)
    n[found.column("id").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(SHAPES, -1) + SMOOTH
    return known, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def tokenised(docs: DataFrame, known: np.ndarray, within: np.ndarray) -> DataFrame:
    """doc_id, deal (a hash of the row), n_tokens, within (sum of the log-probabilities within classes), ids (a byte for each token) of every row, written once."""
    shared = docs.sparkSession.sparkContext.broadcast((known, within))  # SHAPES << ID_BITS numbers

    def run(batches):
        tokens = Tokens(*shared.value)
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                ids, logs, bounds = tokens(data, offsets)
                n, raw, cut = np.diff(bounds), ids.tobytes(), bounds.tolist()
                packed = pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.record_batch([batch.column("doc_id").slice(at, len(n)), batch.column("deal").slice(at, len(n)), pa.array(n), pa.array(per_row(logs.astype(np.float64), bounds)), packed], names=["doc_id", "deal", "n_tokens", "within", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("deal", F.xxhash64("doc_id", "text"))
    return staged(own.mapInArrow(run, "doc_id long, deal long, n_tokens long, within double, ids binary"), "lm-tokens")


def train(tokens: DataFrame, rounds: int = ROUNDS, mask: int = MASK) -> np.ndarray:
    """The averaged weights after all rounds. tokens: what `tokenised` returns."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    trainers = int(min(max(1, -(-total // TRAINER_TOKENS)), TRAINERS))
    weights = Network(VOCABULARY, WINDOW, WIDTH).flat()
    dealt = tokens.where("n_tokens > 0").select("deal", "ids").repartition(trainers, "deal").sortWithinPartitions("deal")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, shared=shared, turn=turn):
            net = Network(VOCABULARY, WINDOW, WIDTH).load(shared.value)
            memory, seen = [np.full_like(p, 1e-4) for p in net.parts], 0
            for batch in batches:
                for _, ids, bounds in chunks(batch.column("ids"), PIECE):
                    for chosen in targets(ids, bounds, turn, rounds, mask):
                        net.train(contexts(ids, bounds, chosen, WINDOW), ids[chosen], memory, 0.1 / (1 + turn))
                        seen += len(chosen)
            flat = net.flat().astype(np.float64) * seen
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), seen))], names=["i", "v", "n"])

        rows = dealt.mapInArrow(run, "i long, v double, n long").groupBy("i").agg((F.sum("v") / F.greatest(F.sum("n"), F.lit(1))).alias("v"), F.sum("n").alias("n")).where("n > 0").collect()  # a row for each weight
        if rows:
            weights = np.array([r.v for r in sorted(rows, key=lambda r: r.i)], np.float32)
        shared.unpersist()
    return weights


def _scored(tokens: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        net = Network(VOCABULARY, WINDOW, WIDTH).load(shared.value)
        for batch in batches:
            for at, ids, bounds in chunks(batch.column("ids"), PIECE):
                logs = net.logs(contexts(ids, bounds, np.arange(len(ids)), WINDOW), ids) if len(ids) else np.zeros(0, np.float32)
                n, classes = np.diff(bounds), per_row(logs.astype(np.float64), bounds)
                total = classes + batch.column("within").slice(at, len(n)).to_numpy()
                yield pa.record_batch([batch.column("doc_id").slice(at, len(n)), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0), pa.array(classes)], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood", "class_log_likelihood"])

    return tokens.select("doc_id", "within", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double, class_log_likelihood double")


def fit(docs: DataFrame) -> Model:
    known, within = vocabulary(docs)
    return Model(known, within, train(tokenised(docs, known, within)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """What pseudo_likelihood returns, under a model of other documents."""
    return _scored(tokenised(docs, model.known, model.within), model.weights)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood, class_log_likelihood (the network's part of it) of every row, under a model of docs."""
    known, within = vocabulary(docs)
    tokens = tokenised(docs, known, within)
    return _scored(tokens, train(tokens))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
