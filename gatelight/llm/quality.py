"""Text quality by a convolutional network over bytes, in NumPy.

A text is cut into overlapping chunks that cover it whole. Learned filters, eight bytes
wide, slide over each chunk byte by byte; each filter's strongest answer in the chunk is kept, the
answers of all chunks are averaged, and one logistic unit turns them into a probability.

``train`` learns from at most ``max_documents`` labelled rows (those with the smallest hash
of the id; an id that documents repeat gives one row) and at most ``max_chunks`` evenly spaced chunks of each; both bounds limit what
one task holds. Scoring reads every byte of every text in one pass without a shuffle.

Null and empty texts are one chunk of padding and get a score like any other. Labels that
are null are left out; without labels of both kinds the score is the share of label 1 (0.5
without any). Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm.word_ids import forget_words

CHUNK, STEP, WIDE, STRIDE = 256, 192, 8, 1
_EMBED, _FILTERS = 6, 16
_WINDOWS = (CHUNK - WIDE) // STRIDE + 1

#: A score from here on predicts label 1.
THRESHOLD = 0.3


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks (rows of ``CHUNK`` bytes) over all of ``data``, the last filled up with zeros."""
    count = 1 if len(data) <= CHUNK else -(-(len(data) - CHUNK) // STEP) + 1
    padded = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """Weights of the network, and its two passes."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights
        self._fold()

    @classmethod
    def fresh(cls, seed: int, prior: float) -> Network:
        rng = np.random.default_rng(seed)
        weights = {
            "embed": rng.normal(0, 0.5, (256, _EMBED)), "filters": rng.normal(0, 0.3, (WIDE, _EMBED, _FILTERS)), "bias": np.zeros(_FILTERS),
            "out": rng.normal(0, 0.1, _FILTERS), "prior": np.array([prior]),
        }
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def _fold(self) -> None:
        # A filter over embedded bytes is a sum of one table row per place.
        self.tables = np.einsum("be,wef->wbf", self.weights["embed"], self.weights["filters"]).astype(np.float32)

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The strongest answer of each filter in each chunk, and the window that gave it."""
        out, at = np.empty((len(chunks), _FILTERS), np.float32), np.empty((len(chunks), _FILTERS), np.int64) if where else None
        for a in range(0, len(chunks), 256):
            part = chunks[a : a + 256]
            answer = np.take(self.tables[0], part[:, 0 : CHUNK - WIDE + 1 : STRIDE], axis=0)
            for w in range(1, WIDE):
                answer += np.take(self.tables[w], part[:, w : CHUNK - WIDE + 1 + w : STRIDE], axis=0)
            if where:
                at[a : a + 256] = answer.argmax(axis=1)
            out[a : a + 256] = answer.max(axis=1)
        return np.maximum(out + self.weights["bias"], 0), at

    def logits(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One number per text, for the chunks of several texts one after another."""
        features, _ = self.pooled(chunks)
        return _mean(features, counts) @ self.weights["out"] + self.weights["prior"][0]

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        features, at = self.pooled(chunks, where=True)
        mean = _mean(features, counts)
        wrong = (_logistic(mean @ w["out"] + w["prior"][0]) - labels) / len(labels)
        back = np.repeat(wrong[:, None] * w["out"] / counts[:, None], counts, axis=0) * (features > 0)
        # Only the window that won passes the error on.
        place = at[:, :, None] * STRIDE + np.arange(WIDE)
        letters = chunks[np.arange(len(chunks))[:, None, None], place]
        embedded = w["embed"][letters]
        to_letters = np.einsum("cf,wef->cfwe", back, w["filters"], optimize=True)
        flat = letters.ravel()
        embed = np.stack([np.bincount(flat, to_letters[..., e].ravel(), 256) for e in range(_EMBED)], axis=1)
        return {
            "embed": embed, "filters": np.einsum("cf,cfwe->wef", back, embedded, optimize=True), "bias": back.sum(axis=0),
            "out": mean.T @ wrong, "prior": np.array([wrong.sum()]),
        }

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as stored:
            return cls({k: stored[k] for k in stored.files})


def _mean(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(features, np.cumsum(counts) - counts, axis=0) / counts[:, None]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, steps: int = 700, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Learns from the chunks and the label of each text, by Adam on the logistic loss; few texts are gone over until ``steps`` are made."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return _constant(share)
    network = Network.fresh(seed, np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step = 0
    epochs = max(epochs, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            step += 1
            slope = network.gradients(np.concatenate([texts[i] for i in some]), np.array([len(texts[i]) for i in some]), labels[some])
            for k, g in slope.items():
                g = g + decay * network.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                network.weights[k] = (network.weights[k] - rate * (1 - epoch / epochs) * change).astype(np.float32)
            network._fold()
    return network


def _constant(share: float) -> Network:
    network = Network.fresh(0, 0.0)
    network.weights["out"][:] = 0
    network.weights["prior"][0] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    return network


def is_held_out(key: Column) -> Column:
    """Rows kept away from learning: every fifth by checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 2_000, max_chunks: int = 64) -> bytes:
    """Fits the network in one task on a bounded sample of labelled rows; returns its weights."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"))).distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_documents)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most ``max_documents`` rows of two numbers are broadcast.
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for data in batch.column("text").to_pylist():
                all_chunks = chunks_of(data)
                pick = np.unique(np.linspace(0, len(all_chunks) - 1, min(max_chunks, len(all_chunks))).astype(int))
                parts.append(all_chunks[pick].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(parts, pa.binary())], ["doc_id", "label", "chunks"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, y, c) for b in batches for d, y, c in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("chunks").to_pylist()))
        chunks = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for _, _, c in rows]
        network = fit(chunks, np.array([y for _, y, _ in rows], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([network.to_bytes()], pa.binary())], ["weights"])

    # Rows that repeat an id count once, with the text of the smallest hash.
    one = joined.mapInArrow(cut, "doc_id long, label int, chunks binary").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("chunks").alias("h"), "chunks")).alias("p")).select("doc_id", "label", "p.chunks")
    made = one.repartition(1).mapInArrow(learn, "weights binary").collect()
    return bytes(made[0].weights) if made else _constant(0.5).to_bytes()


def scorer(weights: bytes):
    """A column function: the probability of label 1 of a text, between 0 and 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_words()
        network = Network.from_bytes(weights)
        for series in texts:
            out, held, size = [], [], 0
            for text in series:
                held.append(chunks_of(("" if text is None else text).encode()))
                size += len(held[-1])
                if size >= 4096:
                    out.append(_scores(network, held))
                    held, size = [], 0
            if held:
                out.append(_scores(network, held))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def _scores(network: Network, held: list[np.ndarray]) -> np.ndarray:
    counts = np.array([len(h) for h in held])
    return _logistic(network.logits(np.concatenate(held), counts).astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by a network trained on the labelled rows that are not held out."""
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
