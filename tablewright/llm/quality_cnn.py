"""Text quality by a byte-level convolutional network over overlapping chunks of the whole document.

Each chunk gives max-pooled filter features; a document is the mean and the maximum of them over all its chunks, which a
logistic layer turns into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.batches import hashed_sample, importable, pieces, utf8_values
from tablewright.llm.bytecnn import Adam, ByteFilters, sample_windows

WIDTHS, STRIDE = {4: 12, 8: 12}, 128
#: Bounds of the training sample: documents of each label, and chunks of one document.
MAX_DOCUMENTS, MAX_CHUNKS = 1500, 8


class QualityModel:
    def __init__(self, filters: ByteFilters, dense: np.ndarray, offset: np.ndarray):
        self.filters, self.dense, self.offset = filters, dense, offset

    @staticmethod
    def constant(probability: float) -> "QualityModel":
        filters = ByteFilters.create(WIDTHS, STRIDE, 0)
        odds = np.log(max(probability, 1e-6) / max(1 - probability, 1e-6))
        return QualityModel(filters, np.zeros(2 * len(filters.bias), np.float32), np.array([odds], np.float32))

    @staticmethod
    def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, share: float, epochs: int = 8, seed: int = 11) -> "QualityModel":
        """``owner`` gives the document of each chunk, in ascending order; ``share`` is the share of label 1 overall.

        Both labels weigh the same in training. Every fifth document is left out of it and serves to calibrate the scores
        to the real share.
        """
        fold = np.arange(len(labels)) % 5 == 4
        held = (chunks[fold[owner]], owner[fold[owner]], labels[fold])
        if len(set(labels[~fold])) == 2:
            chunks, owner, labels = chunks[~fold[owner]], owner[~fold[owner]], labels[~fold]
            owner = np.unique(owner, return_inverse=True)[1]
        rng = np.random.default_rng(seed)
        filters = ByteFilters.create(WIDTHS, STRIDE, seed)
        n = len(filters.bias)
        dense = (rng.standard_normal(2 * n) * 0.1).astype(np.float32)
        offset = np.zeros(1, np.float32)
        adam = Adam([*filters.weights, filters.bias, dense, offset], 0.01)
        counts = np.bincount(owner, minlength=len(labels))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        for epoch in range(epochs):
            adam.rate = 0.01 if epoch < epochs // 2 else 0.003
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 32):
                docs = order[at : at + 32]
                own = counts[docs]
                rows = np.repeat(starts[docs] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
                features, places, padded = filters.trained(chunks[rows])
                begin = np.concatenate([[0], np.cumsum(own)[:-1]])
                mean = np.add.reduceat(features, begin, axis=0) / own[:, None]
                top = np.maximum.reduceat(features, begin, axis=0)
                pooled = np.concatenate([mean, top], axis=1)
                grad = 1 / (1 + np.exp(-(pooled @ dense + offset))) - labels[docs]
                grad = (grad * weight[docs] / len(docs)).astype(np.float32)
                back = grad[:, None] * dense[None, :]
                spread = np.repeat(back[:, :n] / own[:, None], own, axis=0)
                at_top = features == np.repeat(top, own, axis=0)
                spread += np.repeat(back[:, n:], own, axis=0) * at_top
                grads, bias = filters.gradients(places, padded, (spread * (features > 0)).astype(np.float32))
                adam.update([*grads, bias, pooled.T @ grad + 1e-4 * dense, grad.sum(keepdims=True)])
        filters._pairs = []
        model = QualityModel(filters, dense, offset)
        if len(held[2]):
            starts = np.flatnonzero(np.diff(held[1], prepend=-1))
            model.calibrate(model.logits([c.tobytes() for c in held[0]], starts), held[2], share)
        return model

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, share: float) -> None:
        """Scale and shift logits by weighted logistic regression (Newton steps, held near no change)."""
        weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
        weight = weight * len(labels)
        x = np.stack([logits, np.ones(len(logits))], axis=1)
        start = at = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ at))
            gradient = x.T @ (weight * (p - labels)) + (at - start)
            curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
            at = at - np.linalg.solve(curvature, gradient)
        if np.isfinite(at).all() and at[0] > 0:
            self.dense = (self.dense * at[0]).astype(np.float32)
            self.offset = (self.offset * at[0] + at[1]).astype(np.float32)

    def logits(self, texts: list[bytes], starts: np.ndarray | None = None) -> np.ndarray:
        """One number per text, or per group of texts beginning at ``starts``."""
        features, counts = self.filters.windows(texts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        begin = begin if starts is None else begin[starts]
        sizes = np.diff(begin, append=len(features))
        mean = np.add.reduceat(features, begin, axis=0) / sizes[:, None]
        pooled = np.concatenate([mean, np.maximum.reduceat(features, begin, axis=0)], axis=1)
        return (pooled @ self.dense + self.offset).astype(np.float64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))


def fit_quality_model(
    documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chunks: int = MAX_CHUNKS
) -> QualityModel:
    """Train on ``documents`` (doc_id, text) with ``labels`` (doc_id, quality 0 or 1).

    Of each label the ``max_documents`` rows with the smallest hash of their id are taken; only these, a bounded number,
    are joined to texts, by broadcast, so no text is shuffled. A document gives at most ``max_chunks`` chunks, spread over
    its whole length. Null texts, null ids and other labels are left out. With one label only, or none, every score is the
    share of label 1 (0.5 without rows).
    """
    importable(documents.sparkSession)
    length = 2 * STRIDE
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.5
    if len(shares) < 2:
        return QualityModel.constant(share)
    chosen = reduce(
        DataFrame.unionByName,
        [hashed_sample(usable.where(F.col("quality") == label), ["doc_id"], max_documents).limit(max_documents) for label in (0, 1)],
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = []
            for text, draw in zip(utf8_values(batch.column("text")), batch.column("draw").to_pylist()):
                found.append(sample_windows(text, length, max_chunks, draw & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("quality"), pa.array(found, pa.list_(pa.binary()))], ["draw", "quality", "chunks"]
            )

    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sample = texts.mapInArrow(cut, "draw long, quality int, chunks array<binary>").limit(4 * max_documents).toArrow()
    rows = sorted(zip(*(sample.column(c).to_pylist() for c in ("draw", "quality", "chunks"))))
    if len({quality for _, quality, _ in rows}) < 2:
        return QualityModel.constant(share)
    owner = np.repeat(np.arange(len(rows)), [len(chunks) for _, _, chunks in rows])
    chunks = np.frombuffer(b"".join(c for _, _, own in rows for c in own), np.uint8).reshape(-1, length)
    return QualityModel.train(chunks, owner, np.array([quality for _, quality, _ in rows]), share)


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``documents`` (doc_id, text); other columns are ignored.

    A null text is scored like an empty one. Repeated rows give repeated results.
    """
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            scores = model.score([t or b"" for t in utf8_values(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
