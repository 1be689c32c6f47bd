"""A quality classifier: a convolutional network over the bytes of whole texts.

A text is cut into overlapping chunks of bytes that cover all of it. Learned
filters over a few neighbouring bytes run over every chunk, and a filter's
strongest response in the chunk goes on. A small layer judges each chunk by
these responses, its strongest judgements over all chunks are kept, and one
logistic unit combines them into the probability that the text is good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ship_package, whole_text

#: Bytes of a chunk, and from one chunk's start to the next one's.
CHUNK = 256
STRIDE = 192
#: Bytes a filter sees, filters, and judgements of a chunk.
WIDTH = 5
FILTERS = 24
HIDDEN = 16
#: Labelled rows the network is fitted on at most, and chunks of each of them.
SAMPLE_ROWS = 2_000
SAMPLE_CHUNKS = 16
STEPS = 400
BATCH = 32
#: Chunks that go through the network together.
BLOCK = 512
#: Score from which a text is taken as good.
THRESHOLD = 0.7
#: Rows whose label is held out: the remainder of their key's checksum.
HELD_OUT = (4, 2)

_SPAN = CHUNK - WIDTH + 1


@dataclass
class Network:
    """``taps`` holds, for each place in a filter and each byte, what it adds to the filters."""

    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    judge: np.ndarray  # FILTERS x HIDDEN
    judge_bias: np.ndarray
    weigh: np.ndarray  # HIDDEN
    prior: np.ndarray  # one number

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, field.name) for field in fields(self)]

    @classmethod
    def fresh(cls, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        f32 = np.float32
        return cls(
            draw.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(f32),
            np.zeros(FILTERS, f32),
            draw.normal(0, 1 / math.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(f32),
            np.zeros(HIDDEN, f32),
            draw.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN).astype(f32),
            np.zeros(1, f32),
        )

    @classmethod
    def constant(cls, probability: float) -> Network:
        """The network that knows nothing but how many labels are good."""
        network = cls(*map(np.zeros_like, cls.fresh(0).parts()))
        network.prior[:] = math.log(probability / (1 - probability))
        return network

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """What each filter gives at each place of each chunk."""
        out = np.take(self.taps[0], chunks[:, :_SPAN], axis=0)
        part = np.empty_like(out)
        for at in range(1, WIDTH):
            np.take(self.taps[at], chunks[:, at : at + _SPAN], axis=0, out=part)
            out += part
        return out

    def judged(self, chunks: np.ndarray) -> np.ndarray:
        """The judgements of chunks, in blocks of bounded size."""
        parts = [np.empty((0, HIDDEN), np.float32)]
        for start in range(0, len(chunks), BLOCK):
            strongest = self.responses(chunks[start : start + BLOCK]).max(axis=1) + self.bias
            parts.append(np.maximum(np.maximum(strongest, 0) @ self.judge + self.judge_bias, 0))
        return np.concatenate(parts)

    def scores(self, chunks: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """The probability of each of ``n`` texts from the chunks of all."""
        top = np.zeros((n, HIDDEN), np.float32)
        np.maximum.at(top, owners, self.judged(chunks))
        return _logistic(top @ self.weigh + self.prior[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x.astype(float), -30, 30)))


def chunk_bytes(data: bytes) -> np.ndarray:
    """All chunks of a text; the last is filled up with zeros, and an empty text is one."""
    n = max(1, 1 + -(-(len(data) - CHUNK) // STRIDE))
    filled = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(filled, CHUNK)[::STRIDE]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int) -> Network:
    """Fit a network to texts given as chunks, by descent on the log loss.

    Each step follows the strongest responses alone. Seeded, so that the same
    rows give the same network. Labels of one kind tell nothing apart: all texts
    then get the share of good ones (1 without any label).
    """
    labels = labels.astype(np.float32)
    share = float(np.clip((labels.sum() + 1) / (len(labels) + 1), 1e-6, 1 - 1e-6))
    if len(labels) == 0 or labels.min() == labels.max():
        return Network.constant(share)
    network = Network.fresh(seed)
    network.prior[:] = math.log(share / (1 - share))
    parts = network.parts()
    mean = [np.zeros_like(p) for p in parts]
    square = [np.zeros_like(p) for p in parts]
    draw = np.random.default_rng(seed)
    order = np.empty(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, draw.permutation(len(texts))])
        own, order = order[:BATCH], order[BATCH:]
        chunks = np.concatenate([texts[i] for i in own])
        owners = np.repeat(np.arange(len(own)), [len(texts[i]) for i in own])
        slopes = _slopes(network, chunks, owners, labels[own])
        rate = 0.01 * (1 - 0.9 * step / STEPS)
        for part, slope, m, v in zip(parts, slopes, mean, square, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return network


def _slopes(net: Network, chunks: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n, each = len(labels), np.arange(len(chunks))
    responses = net.responses(chunks)
    at = responses.argmax(axis=1)
    strongest = np.take_along_axis(responses, at[:, None, :], axis=1)[:, 0, :] + net.bias
    active = np.maximum(strongest, 0)
    judged = np.maximum(active @ net.judge + net.judge_bias, 0)
    # For each text and judgement, the chunk it is strongest in.
    bounds = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1], True])
    best = np.stack([low + judged[low:high].argmax(axis=0) for low, high in zip(bounds, bounds[1:])])
    columns = np.arange(HIDDEN)
    top = judged[best, columns]
    error = ((_logistic(top @ net.weigh + net.prior[0]) - labels) / n).astype(np.float32)
    to_judged = np.zeros_like(judged)
    to_judged[best, columns] = error[:, None] * net.weigh * (top > 0)
    to_active = (to_judged @ net.judge.T) * (strongest > 0)
    taps = np.zeros_like(net.taps)
    moved, filters = np.nonzero(to_active)
    place, size = at[moved, filters], to_active[moved, filters]
    for tap in range(WIDTH):
        np.add.at(taps[tap], (chunks[moved, place + tap], filters), size)
    return [
        taps,
        to_active.sum(axis=0),
        active.T @ to_judged,
        to_judged.sum(axis=0),
        top.T @ error,
        np.array([error.sum()], np.float32),
    ]


def is_held_out(key: str) -> Column:
    """Whether a row's label must not be learned from."""
    parts, own = HELD_OUT
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == own


def train(
    docs: DataFrame,
    labels: DataFrame,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
) -> Network:
    """A network fitted on a bounded sample of the labelled rows.

    The sample has ``rows`` labelled documents at most, the first in a random
    order of all whose label is not held out, and ``SAMPLE_CHUNKS`` chunks of
    each, spread over the whole text: that much reaches the driver, whatever the
    size of the tables. Null keys and labels, labels other than 0 and 1 and keys
    with both labels are left out; of rows with equal keys one is taken.
    """
    ship_package(docs.sparkSession)
    value = F.col(label).cast("int")
    usable = (
        labels.where(F.col(key).isNotNull() & value.isin(0, 1) & ~is_held_out(key))
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(value).alias("label"), F.max(value).alias("other"))
        .where(F.col("label") == F.col("other"))
    )
    own = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    ids = own.select("id").distinct()
    order = [F.xxhash64("id", F.lit(seed)), "id"]
    sample = usable.join(ids, "id", "left_semi").orderBy(*order).limit(rows).select("id", "label")

    def sampled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for text_ in batch:
                chunks = chunk_bytes(text_.as_py().encode())
                if len(chunks) > SAMPLE_CHUNKS:
                    chunks = chunks[np.linspace(0, len(chunks) - 1, SAMPLE_CHUNKS).astype(int)]
                found.append(chunks.tobytes())
            yield pa.array(found, pa.binary())

    # The sample is bounded by ``rows``.
    chunks = F.arrow_udf(sampled, "binary")("text")
    found = (
        own.join(F.broadcast(sample), "id")
        .select("id", "label", chunks.alias("chunks"))
        .groupBy("id", "label")
        .agg(F.min("chunks").alias("chunks"))
        .orderBy("id")
        .collect()
    )
    texts = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in found]
    return fit(texts, np.array([r["label"] for r in found], np.float32), seed)


def score_texts(network: Network, texts: pa.Array) -> np.ndarray:
    """The score of each text; chunks of several short ones go through together."""
    scores = np.empty(len(texts))
    held: list[np.ndarray] = []
    first = held_chunks = 0
    for at, text in enumerate(texts):
        held.append(chunk_bytes(text.as_py().encode()))
        held_chunks += len(held[-1])
        if held_chunks < BLOCK and at + 1 < len(texts):
            continue
        # A long text is not copied into its overlapping chunks.
        chunks = held[0] if len(held) == 1 else np.concatenate(held)
        owners = np.repeat(np.arange(len(held)), [len(c) for c in held])
        scores[first : at + 1] = network.scores(chunks, owners, len(held))
        first, held, held_chunks = at + 1, [], 0
    return scores


def score(network: Network, text: Column) -> Column:
    """The probability, 0 to 1, that a text is good; a null text counts as empty."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_texts(network, batch), pa.float64())

    return F.arrow_udf(scores, "double")(F.coalesce(text, F.lit("")))


def classify(
    docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, held_out, score, predicted)`` of every row.

    Scores depend on the text alone, all of it. A null text counts as empty and
    has the empty text's score; a null key is not held out; equal texts have
    equal scores; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    scored = docs.select(
        F.col(key),
        F.coalesce(is_held_out(key), F.lit(False)).alias("held_out"),
        score(network, F.col(text)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` the network takes as good, in their own columns."""
    ship_package(docs.sparkSession)
    return docs.where(score(network, F.col(text)) >= THRESHOLD)
