"""Language identification by a byte convolutional network with filters of several widths and a softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.batches import hashed_sample, importable, pieces, sample_limit, utf8_values
from tablewright.llm.bytecnn import Adam, ByteFilters, sample_windows
from tablewright.operators.quantiles import exact_quantiles

#: Filters by width, bytes of half a window.
WIDTHS, STRIDE = {2: 8, 4: 12, 6: 12}, 128
#: Bounds of the training sample: documents, and windows of one document.
MAX_DOCUMENTS, MAX_WINDOWS = 3000, 4
UNKNOWN = "und"
#: Doubtful texts are told by scores of labelled rows outside the training sample: the share of rightly told ones below the
#: limit, and how far below them a score must lie.
DOUBTFUL, SLACK = 0.001, 0.9


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LanguageModel:
    def __init__(self, filters: ByteFilters, dense: np.ndarray, offset: np.ndarray, languages: list[str]):
        self.filters, self.dense, self.offset, self.languages = filters, dense, offset, languages
        #: The largest hash of a row that it learned from.
        self.learned: int | None = None

    @staticmethod
    def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 5) -> "LanguageModel":
        rng = np.random.default_rng(seed)
        filters = ByteFilters.create(WIDTHS, STRIDE, seed)
        n = len(filters.bias)
        dense = (rng.standard_normal((n, len(languages))) * 0.1).astype(np.float32)
        offset = np.zeros(len(languages), np.float32)
        adam = Adam([*filters.weights, filters.bias, dense, offset], 0.01)
        # Rare languages weigh as much as common ones.
        weight = (1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)).astype(np.float32)
        weight *= len(labels) / max(1, np.count_nonzero(np.bincount(labels)))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                features, places, padded = filters.trained(windows[rows])
                grad = softmax(features @ dense + offset)
                grad[np.arange(len(rows)), labels[rows]] -= 1
                grad *= (weight[labels[rows]] / len(rows))[:, None]
                back = (grad @ dense.T) * (features > 0)
                grads, bias = filters.gradients(places, padded, back)
                adam.update([*grads, bias, features.T @ grad, grad.sum(axis=0)])
        filters._pairs = []
        return LanguageModel(filters, dense, offset, languages)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language index and its share, averaged over all windows of each text."""
        features, counts = self.filters.windows(texts)
        shares = softmax((features @ self.dense + self.offset).astype(np.float64))
        sums = np.add.reduceat(shares, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        means = sums / counts[:, None]
        best = means.argmax(axis=1)
        return best, means[np.arange(len(best)), best]


def fit_language_model(labelled: DataFrame, max_documents: int = MAX_DOCUMENTS, max_windows: int = MAX_WINDOWS) -> LanguageModel | None:
    """Train on (doc_id, text, lang); rows without text or lang are left out.

    The sample is the ``max_documents`` rows with the smallest hash of their content, cut to ``max_windows`` windows each
    before it reaches the driver. Without any usable row there is no model.
    """
    importable(labelled.sparkSession)
    length = 2 * STRIDE
    usable = labelled.where("lang IS NOT NULL AND length(text) > 0").select("doc_id", "lang", "text")
    rows = hashed_sample(usable, ["doc_id", "text"], max_documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            langs, found = [], []
            draws = batch.column("draw").to_pylist()
            for lang, text, draw in zip(batch.column("lang").to_pylist(), utf8_values(batch.column("text")), draws):
                own = sample_windows(text, length, max_windows, draw & 0xFFFFFFFF)
                found += own
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    sample = rows.mapInArrow(cut, "lang string, window binary").limit(2 * max_documents * max_windows).toArrow()
    if not sample.num_rows:
        return None
    pairs = sorted(zip(sample.column("lang").to_pylist(), sample.column("window").to_pylist()))
    languages = sorted({lang for lang, _ in pairs})
    windows = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, length)
    labels = np.array([languages.index(lang) for lang, _ in pairs])
    model = LanguageModel.train(windows, labels, languages)
    model.learned = sample_limit(usable, ["doc_id", "text"], max_documents)
    return model


def _tell(model: LanguageModel | None, texts: list[str | None], piece: int = 1 << 20) -> pd.DataFrame:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    readable = [i for i, t in enumerate(texts) if model and t]
    while readable:
        # About ``piece`` characters at a time, one text at least.
        sizes = np.cumsum([len(texts[i]) for i in readable])
        now = readable[: max(1, int(np.searchsorted(sizes, piece, "right")))]
        readable = readable[len(now) :]
        best, share = model.predict([texts[i].encode() for i in now])
        for i, b, s in zip(now, best, share):
            names[i], scores[i] = model.languages[b], float(s)
    return pd.DataFrame({"lang_pred": names, "score": scores})


def language_of(model: LanguageModel | None, text: Column) -> Column:
    """Struct (lang_pred, score) for a text column; other columns of the rows stay where they are.

    Texts that are null or have no letter, and all texts without a model, give ``und`` with score 0.
    """

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return _tell(model, texts.tolist())

    # Letters are told apart by Spark, as in every filter of a query: digits, fractions and other numbers are none.
    return told(F.when(text.rlike(r"\p{L}"), text))


def least_share(
    labelled: DataFrame, model: LanguageModel, max_documents: int = MAX_DOCUMENTS, calibration: int | None = None, told: str | None = None
) -> float:
    """The score below which a text is in none of the languages that ``model`` learned from ``labelled``.

    It is set by the scores of all labelled rows that the training sample (as the model tells, else of ``max_documents``
    rows) did not hold, or of the sample itself where there are no others. So it fits any number of languages. Without a rightly told row there is no
    limit. ``told`` names a column with the result of :func:`language_of`, if rows have one already; with ``calibration``
    only so many rows that follow the sample in the order of their hashes are asked.
    """
    usable = labelled.where("lang IS NOT NULL AND length(text) > 0")
    usable = usable.select("doc_id", "lang", "text", *([F.col(f"`{told}`").alias("told")] if told else []))
    learned = sample_limit(usable, ["doc_id", "text"], max_documents) if model.learned is None else model.learned
    if learned is None:
        return 0.0
    rows = usable.withColumn("draw", F.xxhash64("doc_id", "text"))
    others = rows.where(F.col("draw") > learned)
    if calibration is not None:
        last = others.select("draw").orderBy("draw").limit(calibration).agg(F.max("draw")).first()[0]
        others = others.where(F.col("draw") <= F.lit(last))
    held = rows.where(F.col("draw") <= learned) if others.isEmpty() else others
    scored = held.select("lang", *(["told"] if told else [language_of(model, F.col("text")).alias("told")]))
    right = scored.where(F.col("lang") == F.col("told.lang_pred")).select(F.col("told.score").alias("score"))
    count = right.count()
    if not count:
        return 0.0
    # The score of that rank itself, not one between two rows.
    return SLACK * exact_quantiles(right, ["score"], [int(DOUBTFUL * count) / max(1, count - 1)])["score"][0]


def predict_languages(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``documents`` (doc_id, text); other columns are ignored.

    Repeated rows give repeated results; an empty table gives an empty one.
    """
    importable(documents.sparkSession)
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), language_of(model, F.col("text")).alias("told"))
    return told.select("doc_id", "told.lang_pred", "told.score")
