"""Masked pseudo-likelihood: a bidirectional window network in numpy scores every token from both sides."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import most_frequent, token_counts

TOKEN = r"\w+"
#: Two-step softmax: 64 classes of 64 tokens. The last class holds hash buckets of all rarer words.
CLASSES, MEMBERS, DIM = 64, 64, 16
WORDS = (CLASSES - 1) * MEMBERS
TOKENS = CLASSES * MEMBERS
#: Neighbours a token is predicted from; id TOKENS stands for the edge of a text.
WINDOW = (-2, -1, 1, 2)
REACH = max(WINDOW)
#: Training: every STRIDE-th position of every text in a round, so that the rounds see every position
#: once; positions per step, learning rate, rounds.
STRIDE, STEP, RATE, ROUNDS = 2, 8192, 0.2, 2
#: Positions that are scored together: the more, the longer the runs of targets of one class.
SCORED = 65_536
#: Rows of logits at a time, so that they stay in a core's cache, and logits that need no shift before exp, in either sign.
BLOCK, SAFE = 2048, 60.0
#: Floats per row when parameters are averaged.
CHUNK = 4096


class Vocabulary(dict):
    """Token ids: frequent words by rank, the others by hash."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.fixed = len(self)

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            for w in list(self)[self.fixed :]:
                del self[w]
        self[word] = i = bucket_of(word)
        return i


def bucket_of(word: str) -> int:
    """Id of the hash bucket that a rare word belongs to."""
    return WORDS + xxhash.xxh64_intdigest(word) % MEMBERS


class Network:
    """Context embeddings by position, tanh, class softmax, softmax within the class."""

    def __init__(self, flat: np.ndarray):
        sizes = [(len(WINDOW), TOKENS + 1, DIM), (DIM,), (DIM, CLASSES), (CLASSES,), (TOKENS, DIM), (TOKENS,)]
        parts, at = [], 0
        for s in sizes:
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s))
            at += n
        self.flat = flat
        self.embed, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias = parts

    @staticmethod
    def start(counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; biases are the log frequencies of all texts, so it starts as a unigram model."""
        total = len(WINDOW) * (TOKENS + 1) * DIM + DIM + DIM * CLASSES + CLASSES + TOKENS * DIM + TOKENS
        net = Network(np.random.default_rng(seed).normal(0, 0.1, total).astype(np.float32))
        by_class = (counts + 0.5).reshape(CLASSES, MEMBERS)
        net.bias[:] = 0
        net.class_bias[:] = np.log(by_class.sum(axis=1) / by_class.sum())
        net.word_bias[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).ravel()
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = np.take(self.embed[0], around[:, 0], axis=0)
        z += self.bias
        for i in range(1, len(WINDOW)):
            z += np.take(self.embed[i], around[:, i], axis=0)
        return np.tanh(z, out=z)

    def large(self) -> tuple[bool, np.ndarray]:
        """Whether logits of classes, and of the tokens of each class, may be too large to exponentiate as they are: |h| is at most 1."""
        every = np.ones(DIM, dtype=self.flat.dtype)
        classes = every @ np.abs(self.to_class) + np.abs(self.class_bias)
        words = np.abs(self.to_word) @ every + np.abs(self.word_bias)
        return bool((classes > SAFE).any()), (words.reshape(CLASSES, MEMBERS) > SAFE).any(axis=1)

    @staticmethod
    def logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, large: bool) -> np.ndarray:
        """Logits up to a constant a row, such that none overflows."""
        x = h @ weights
        x += bias
        if large:
            x -= x.max(axis=1, keepdims=True)
        return x

    @staticmethod
    def exponentials(x: np.ndarray) -> np.ndarray:
        """Exponentials in place of ``x``; returns their sums."""
        np.exp(x, out=x)
        return x @ np.ones(x.shape[1], dtype=x.dtype)

    @staticmethod
    def blocks(rows: slice) -> list[slice]:
        return [slice(i, min(i + BLOCK, rows.stop)) for i in range(rows.start, rows.stop, BLOCK)]

    @staticmethod
    def by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Order that puts targets of a class together, and the class and place of every run."""
        kind = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        return order, [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]

    def log_prob(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of every target given its neighbours."""
        order, runs = self.by_class(target)
        h, target = self.hidden(around[order]), target[order]
        large, large_of = self.large()
        sorted_out, at = np.empty(len(h), dtype=h.dtype), np.arange(BLOCK)

        def picked(rows: slice, weights: np.ndarray, bias: np.ndarray, entry: np.ndarray, large: bool) -> np.ndarray:
            x = self.logits(h[rows], weights, bias, large)
            own = x[at[: len(x)], entry]
            own -= np.log(self.exponentials(x))
            return own

        for rows in self.blocks(slice(0, len(h))):
            sorted_out[rows] = picked(rows, self.to_class, self.class_bias, target[rows] // MEMBERS, large)
        for c, run in runs:
            own = slice(c * MEMBERS, (c + 1) * MEMBERS)
            for rows in self.blocks(run):
                sorted_out[rows] += picked(rows, self.to_word[own].T, self.word_bias[own], target[rows] - c * MEMBERS, large_of[c])
        out = np.empty_like(sorted_out)
        out[order] = sorted_out
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, memory: Network, rate: float) -> None:
        """One Adagrad step on the mean log-loss; ``memory`` holds the squared gradients so far."""
        n = len(target)
        order, runs = self.by_class(target)
        around, target = around[order], target[order]
        h = self.hidden(around)
        large, large_of = self.large()
        dh, at, ones = np.empty_like(h), np.arange(BLOCK), np.ones(BLOCK, dtype=h.dtype)
        change = Network(np.zeros_like(self.flat))

        def error(rows: slice, weights: np.ndarray, bias: np.ndarray, entry: np.ndarray, large: bool) -> np.ndarray:
            x = self.logits(h[rows], weights, bias, large)
            x *= (1 / (n * self.exponentials(x)))[:, None]
            x[at[: len(x)], entry] -= 1 / n
            return x

        for rows in self.blocks(slice(0, n)):
            g = error(rows, self.to_class, self.class_bias, target[rows] // MEMBERS, large)
            np.matmul(g, self.to_class.T, out=dh[rows])
            change.to_class += h[rows].T @ g
            change.class_bias += ones[: len(g)] @ g
        for c, run in runs:
            own = slice(c * MEMBERS, (c + 1) * MEMBERS)
            for rows in self.blocks(run):
                p = error(rows, self.to_word[own].T, self.word_bias[own], target[rows] - c * MEMBERS, large_of[c])
                dh[rows] += p @ self.to_word[own]
                change.to_word[own] += p.T @ h[rows]
                change.word_bias[own] += ones[: len(p)] @ p
        dz = dh * (1 - h * h)
        change.bias[:] = dz.sum(axis=0)
        # Entries without a gradient stay as they are. Those of the embeddings, the most, follow by rows.
        rest = slice(self.embed.size, None)
        self.step(self.flat, memory.flat, rest, change.flat[rest], rate)
        # All places of the window as one table: one sort of 16-bit rows, one sum per row.
        places = np.arange(len(WINDOW), dtype=np.uint16) * (TOKENS + 1)
        rows = (around.astype(np.uint16) + places).T.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        self.step(self.embed.reshape(-1, DIM), memory.embed.reshape(-1, DIM), rows[first], np.add.reduceat(np.take(dz, order % n, axis=0), first, axis=0), rate)

    @staticmethod
    def step(weights: np.ndarray, memory: np.ndarray, at, gradient: np.ndarray, rate: float) -> None:
        seen = memory[at]
        seen += gradient * gradient
        memory[at] = seen
        weights[at] -= rate * gradient / (np.sqrt(seen) + 1e-6)


def encoder(words: list[str], rare: bool):
    """Task function: rows (doc_id, text) to (doc_id, ids): 16 bits a token.

    With ``rare`` also the distinct words in hash buckets of every text, with their counts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, find = Vocabulary(words), re.compile(TOKEN).findall
        for batch in batches:
            coded, rare_words, rare_times, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                tokens = find(text.lower())
                ids = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.uint16, count=len(tokens))
                coded.append(ids.tobytes())
                if rare:
                    times = Counter(compress(tokens, (ids >= WORDS).tobytes()))
                    rare_words.extend(times)
                    rare_times.extend(times.values())
                    ends.append(len(rare_words))
            columns = {"doc_id": batch.column(0), "ids": pa.array(coded, type=pa.binary())}
            if rare:
                pairs = pa.StructArray.from_arrays([pa.array(rare_words, type=pa.string()), pa.array(rare_times, type=pa.int64())], names=["word", "times"])
                columns["rare"] = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return encode


def encoded(docs: DataFrame, words: list[str], rare: bool = False) -> DataFrame:
    """Token ids of every document: doc_id, ids and, on request, its rare words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", rare array<struct<word: string, times: long>>" if rare else ""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(encoder(words, rare), f"doc_id {kind}, ids binary{more}")


def positions(texts: Iterator, vocabulary: Vocabulary | None = None, find=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts, or their ids as bytes, as ids with edges between them, in pieces of some 200 000 ids: (ids, number of the text or -1)."""
    ids, owner, held = [], [], 0
    edge = np.full(REACH, TOKENS, dtype=np.int32)
    for i, text in enumerate(texts):
        words = text.as_py()
        if isinstance(words, bytes):
            words = np.frombuffer(words, dtype=np.uint16).astype(np.int32)
        else:
            words = np.array([vocabulary[w] for w in find(words.lower())], dtype=np.int32)
        ids += [edge, words]
        owner += [np.full(REACH, -1, dtype=np.int64), np.full(len(words), i, dtype=np.int64)]
        held += len(words)
        if held > 200_000:
            yield np.concatenate([*ids, edge]), np.concatenate([*owner, edge * 0 - 1])
            ids, owner, held = [], [], 0
    if ids:
        yield np.concatenate([*ids, edge]), np.concatenate([*owner, edge * 0 - 1])


def in_phase(owner: np.ndarray, stride: int, phase: int) -> np.ndarray:
    """Places of the tokens whose position in their own text is ``phase`` modulo ``stride``, however texts are batched."""
    at = np.arange(len(owner))
    edge = np.maximum.accumulate(np.where(owner < 0, at, 0))
    return np.flatnonzero((owner >= 0) & ((at - edge - 1) % stride == phase))


def around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + o] for o in WINDOW], axis=1)


def trainer(words: list[str], flat: np.ndarray, stride: int, phase: int, rate: float):
    """Task function: trains a copy of the network on the task's texts (or their ids) and returns it in chunks, with its weight."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, find = Vocabulary(words), re.compile(TOKEN).findall
        net, memory, seen = Network(flat.copy()), Network(np.full_like(flat, 1e-8)), 0
        for batch in batches:
            for ids, owner in positions(batch.column(0), vocabulary, find):
                at = in_phase(owner, stride, phase)
                np.random.default_rng(seen).shuffle(at)
                for i in range(0, len(at), STEP):
                    some = at[i : i + STEP]
                    net.learn(around(ids, some), ids[some], memory, rate)
                    seen += len(some)
        if seen:
            chunks = [net.flat[i : i + CHUNK].astype(np.float64) for i in range(0, len(net.flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), type=pa.int32()), pa.array([float(seen)] * len(chunks)), pa.array(chunks, type=pa.list_(pa.float64()))], names=["chunk", "weight", "part"])

    return train


def fit(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, rate: float = RATE, counts: DataFrame | None = None, ids: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """Vocabulary and parameters, trained on all documents; ``counts`` are their token counts, ``ids`` their ids, if at hand.

    Texts become ids once, all rounds read these. Word counts cover every token. In each round every task trains on every ``stride``-th position of
    all its texts, and the copies are averaged by the positions they saw, chunk by chunk in Spark.
    Every round starts one position later, and ``stride`` may not exceed ``rounds``, so that every
    position is trained on. The driver gets one network of fixed size per round, whatever the number of tasks.
    """
    if stride > rounds:
        raise ValueError(f"{rounds} rounds of every {stride}-th position leave positions out")
    counts = token_counts(docs, TOKEN, lower=True) if counts is None else counts
    top = most_frequent(counts, WORDS)
    rest = counts.agg(F.sum("n")).first()[0] or 0
    words = [w for w, _ in top]
    ids = written(encoded(docs, words)) if ids is None else ids
    n = np.zeros(TOKENS)
    n[: len(top)] = [c for _, c in top]
    n[WORDS:] = max(0, rest - n.sum()) / MEMBERS
    flat = Network.start(n).flat
    rows = ids.select("ids")
    for k in range(rounds):
        parts = rows.mapInArrow(trainer(words, flat, stride, k % stride, rate), "chunk int, weight double, part array<double>")
        mean = parts.groupBy("chunk").agg(Summarizer.mean(array_to_vector("part"), F.col("weight")).alias("mean"))
        got = mean.select("chunk", vector_to_array("mean").alias("mean")).orderBy("chunk").collect()
        if got:
            flat = np.concatenate([np.array(r["mean"], dtype=np.float32) for r in got])
    return words, flat


def scorer(flat: np.ndarray):
    """Task function: tokens and summed log-probability of every row (row, doc_id, ids)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for ids, owner in positions(batch.column(2)):
                every = np.flatnonzero(owner >= 0)
                for i in range(0, len(every), SCORED):
                    at = every[i : i + SCORED]
                    n += np.bincount(owner[at], minlength=len(n))
                    total += np.bincount(owner[at], weights=net.log_prob(around(ids, at), ids[at]), minlength=len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total)], names=["row", "doc_id", "n_tokens", "log_prob"])

    return score


def shares(counts: DataFrame, words: list[str]) -> DataFrame:
    """Log of the share of every rare word in its hash bucket: word, share. ``words`` are those with an id of their own."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(words)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            at = [i for i, t in enumerate(tokens) if t not in known]
            bucket = pa.array([bucket_of(tokens[i]) for i in at], type=pa.int32())
            at = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), bucket], names=["word", "n", "bucket"])

    rows = counts.select("token", "n").mapInArrow(placed, "word string, n long, bucket int")
    whole = rows.groupBy("bucket").agg(F.sum("n").alias("whole"))
    return rows.join(F.broadcast(whole), "bucket").select("word", (F.log("n") - F.log("whole")).alias("share"))


def score_table(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Pseudo-likelihood of every document: doc_id, n_tokens, log_prob, mean_log_prob.

    ``log_prob`` sums, over all tokens, the log-probability of the token given the two tokens on either
    side. For a word without an id of its own that is the network's for its hash bucket, plus the log
    of the word's share in all occurrences of the bucket; the distinct rare words of each document join
    the corpus' counts by a shuffle. A given ``model`` brings no counts: it scores rare words by their
    bucket alone. Null texts are empty; texts without tokens have log_prob 0 and a null mean. Repeated
    rows are scored each for itself; only ``doc_id`` and ``text`` are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = None if model else token_counts(docs, TOKEN, lower=True)
    words = model[0] if model else [w for w, _ in most_frequent(counts, WORDS)]
    ids = encoded(docs, words, rare=model is None).withColumn("row", F.monotonically_increasing_id())
    # The number of a row holds once the rows are written.
    ids = ids if model else written(ids)
    flat = model[1] if model else fit(docs, counts=counts, ids=ids)[1]
    scored = ids.select("row", "doc_id", "ids").mapInArrow(scorer(flat), f"row long, doc_id {kind}, n_tokens long, log_prob double")
    log_prob = F.col("log_prob")
    if counts is not None:
        pairs = ids.select("row", F.inline("rare"))
        # Distinct words are the smaller side by far: hashed, so that the pairs are not sorted by their words.
        inside = pairs.join(shares(counts, words).hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("inside"))
        scored = scored.join(inside.hint("merge"), "row", "left")
        log_prob = log_prob + F.coalesce("inside", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", log_prob.alias("log_prob")).withColumn("mean_log_prob", mean)
