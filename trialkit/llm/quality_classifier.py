"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from what its bytes and words look like; a gated
attention network weighs the passages, and the weighted sum is scored. Only documents have labels: which
passages speak for or against one is learned. The network is small and is fitted on a bounded sample of
labelled documents; scoring reads every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialkit.llm.common import fresh, text_chunks
from trialkit.llm.hashing import SOLID, Words, mix
from trialkit.llm.language_id import held_out

PASSAGE_BYTES = 512
#: Labelled documents that the network is fitted on: those whose ids hash lowest.
SAMPLE_DOCS = 6000
#: Passages of the sampled documents in all. A document is used with all its passages or not at all.
SAMPLE_PASSAGES = 100_000
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE = 30, 128, 0.01
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20] = 4
_CLASS[0x0A] = 5
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 7
_MARKS = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_CLASS[_MARKS] = np.arange(8, 8 + len(_MARKS))
_CLASSES = 8 + len(_MARKS)
N_FEATURES = _CLASSES + 5


def passage_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the passages of some texts (float32), and where each text's passages begin and end.

    An empty or NULL text has one passage, of zeros.
    """
    for _, data, offsets in text_chunks(texts):
        sizes = np.diff(offsets)
        passages = np.maximum(-(-sizes // PASSAGE_BYTES), 1)
        bounds = np.concatenate([[0], np.cumsum(passages)])
        n = int(bounds[-1])
        owner = np.repeat(bounds[:-1], sizes) + (np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) // PASSAGE_BYTES
        counts = np.bincount(owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
        out = np.zeros((n, N_FEATURES), np.float32)
        length = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, :_CLASSES] = counts / length
        words = Words(data, offsets, SOLID)
        if len(words.starts):
            at = owner[words.starts]
            n_words = np.bincount(at, minlength=n)
            some = np.maximum(n_words, 1)
            again = np.zeros(len(at), bool)
            again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (at[1:] == at[:-1])
            with np.errstate(over="ignore"):
                _, firsts = np.unique(mix(words.hashes + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 7], 1)
            out[:, _CLASSES] = n_words / length[:, 0]
            out[:, _CLASSES + 1] = np.bincount(at, weights=words.ends - words.starts, minlength=n) / some / 10
            out[:, _CLASSES + 2] = np.bincount(at, weights=again, minlength=n) / some
            out[:, _CLASSES + 3] = np.bincount(at[firsts], minlength=n) / some
            out[:, _CLASSES + 4] = counts[:, 2] / letters
        yield out, bounds


@dataclass
class AttentionModel:
    """Encoder, gated attention and score of a bag; ``constant`` where there was nothing to learn from."""

    constant: float | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    center: np.ndarray | None = None
    scale: np.ndarray | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["focus"]
        e -= np.repeat(np.maximum.reduceat(e, starts), sizes)
        a = np.exp(e)
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["score"] + w["score0"])))}

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag."""
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        x = (x - self.center) / self.scale
        return self.forward(x, bounds[:-1], np.diff(bounds))["p"].astype(float)


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> AttentionModel:
    """Adam over small batches of bags. With one class or no bags the share of label 1 is the score."""
    if not len(bags) or labels.min() == labels.max():
        return AttentionModel(constant=float(labels.mean()) if len(bags) else 0.5)
    every = np.concatenate(bags).astype(np.float64)
    center, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 0.01)
    bags = [(b - center) / scale for b in bags]
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda n, m: rng.normal(0, 1 / np.sqrt(n), (n, m))
    w = {
        "encode": draw(every.shape[1], HIDDEN), "encode0": np.zeros(HIDDEN),
        "attend": draw(HIDDEN, ATTENTION), "gate": draw(HIDDEN, ATTENTION), "focus": rng.normal(0, 0.1, ATTENTION),
        "score": np.zeros(HIDDEN), "score0": np.log(labels.mean() / (1 - labels.mean())) * np.ones(1),
    }
    model = AttentionModel(weights=w, center=center, scale=scale)
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for first in range(0, len(order), BATCH):
            some = order[first : first + BATCH]
            x, y = np.concatenate([bags[i] for i in some]), labels[some]
            sizes = np.array([len(bags[i]) for i in some])
            starts = np.cumsum(sizes) - sizes
            grads = _gradients(model, x, y, starts, sizes)
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            for k, g in grads.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: AttentionModel, x, y, starts, sizes) -> dict[str, np.ndarray]:
    w, s = model.weights, model.forward(x, starts, sizes)
    d = (s["p"] - y) / len(y)
    each = np.repeat(d, sizes)
    dz = each[:, None] * w["score"]
    da = (dz * s["h"]).sum(axis=1)
    de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, starts), sizes))
    gated = s["t"] * s["g"]
    dgated = de[:, None] * w["focus"]
    dt = dgated * s["g"] * (1 - s["t"] ** 2)
    dg = dgated * s["t"] * s["g"] * (1 - s["g"])
    dh = s["a"][:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T
    du = dh * (1 - s["h"] ** 2)
    return {
        "encode": x.T @ du, "encode0": du.sum(axis=0), "attend": s["h"].T @ dt, "gate": s["h"].T @ dg,
        "focus": gated.T @ de, "score": s["z"].T @ d, "score0": d.sum(keepdims=True),
    }


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    most: int = SAMPLE_DOCS,
    most_passages: int = SAMPLE_PASSAGES,
) -> AttentionModel:
    """Fit on at most ``most`` labelled documents, which have at most ``most_passages`` passages together.

    Ids with several labels take the largest; NULL ids and labels are left out. The sample is chosen by a hash of the id, so it
    is the same on every run: documents come in its order, each with all its passages, and one that would go beyond
    the bound is left out. NULL and empty texts are bags of one empty passage. Of repeated rows one is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    # labels of documents that are not here take no place in the sample
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for x, bounds in passage_features(batch.column(2)):
                for i in range(len(bounds) - 1):
                    bags.append(np.ascontiguousarray(x[bounds[i] : bounds[i + 1]]).tobytes())
            if bags:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # repeated rows of a document are one bag, and the order of the bags is fixed
    bags = rows.mapInArrow(encode, f"doc_id {kind}, label double, bag binary").dropDuplicates(["doc_id"])
    found, left = [], most_passages
    for row in bags.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").toLocalIterator():
        n = len(row["bag"]) // (4 * N_FEATURES)
        if n <= left:
            found.append(row)
            left -= n
    found.sort(key=lambda r: r["doc_id"])
    arrays = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found]
    return fit_attention(arrays, np.array([r["label"] for r in found]))


def score_quality(docs: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, and last ``score``, the probability of label 1 of the whole text.

    The column has another name (one more ``_``) where ``docs`` has one of that name.
    """
    (name,) = fresh(docs.drop(text), "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        parts = [sent.value.scores(x, bounds) for x, bounds in passage_features(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], score(F.col(f"`{text}`")).alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: the digest of the query.

    A quarter of the rows, by the crc32 of their id, is never learned from. Every row has a score, also with a NULL or
    empty text; repeated rows have the same. Without any label all scores are 0.5.
    """
    model = learn_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = score_quality(rows, model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
