"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text. A text is compressed in blocks with
each of them; the difference of the two sizes, divided by their sum, says which dictionary knows
the text better. A logistic curve fitted on labelled texts that the dictionaries have not seen
makes it a score.

Defined results: null and empty texts are scored by the curve at no difference; repeated rows get
equal scores; labels of a repeated id count once, the smallest; labels without text or with null
quality teach nothing. If only one label occurs, every score is that label's share. Only the id,
the text and the label are read, the id for the folds and the label's join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.words import text_bytes
from apportion.session import cut, hinted

PER_LABEL = 3000  # labelled texts of each label, at most, by hash order; half build, half fit
PIECES, PIECE = 4, 2048  # of a text that builds a dictionary: so many stretches of so many bytes
DICTIONARY = 96 << 10
BLOCK = 4096  # bytes compressed at a time, so that long texts keep using the dictionary
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # logistic curve over the features

    def scorer(self) -> CompressionScorer:
        return CompressionScorer(self)


class CompressionScorer:
    def __init__(self, model: CompressionModel):
        self.weights = model.weights
        self.with_dictionary = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=self._ready(d), write_content_size=False) if d else None for d in (model.good, model.bad)
        ]

    @staticmethod
    def _ready(content: bytes) -> zstandard.ZstdCompressionDict:
        ready = zstandard.ZstdCompressionDict(content)
        ready.precompute_compress(level=LEVEL)
        return ready

    def sizes(self, text: bytes) -> tuple[int, int]:
        good = bad = 0
        if all(self.with_dictionary):
            a, b = self.with_dictionary
            for at in range(0, len(text), BLOCK):
                block = text[at : at + BLOCK]
                good += len(a.compress(block))
                bad += len(b.compress(block))
        return good, bad

    def features(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([self.sizes(t) for t in texts], dtype=float).reshape(-1, 2)
        difference = (sizes[:, 1] - sizes[:, 0]) / np.maximum(sizes.sum(axis=1), 1)
        return np.stack([np.ones(len(texts)), difference], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (label, building, text) to (label, building, piece): stretches spread over a text."""
    for batch in batches:
        rows, out = [], []
        for i, t in enumerate(text_bytes(batch.column(2))):
            step = max(PIECE, len(t) // PIECES)
            for at in range(0, len(t), step):
                if at // step < PIECES:
                    rows.append(i)
                    out.append(t[at : at + PIECE])
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(out, pa.binary())], names=["label", "building", "piece"])


def _dictionary(pieces: list[bytes]) -> bytes:
    """Dictionary content that zstandard chooses, or the pieces themselves if they are few."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return tuple(w / scale)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            x = scorer.features(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 1])], names=["label", "difference"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionModel:
    """Dictionaries and curve from at most PER_LABEL labelled rows of each label. What reaches
    the driver is bounded by that number: stretches of bytes and one difference for each row."""
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
    # The ids are chosen before any text is read, and a repeated id teaches once.
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(PER_LABEL) for v in (1, 0)]
    chosen = cut(chosen[0].union(chosen[1]))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.join(hinted(chosen, chosen.count(), 24), "_id").groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(rows.select("label", F.pmod(F.xxhash64("_id"), F.lit(2)).alias("building"), "text"))
    got = sample.filter("building = 1").mapInArrow(_pieces, "label int, building long, piece binary").toArrow()
    label = np.array(got["label"].to_pylist(), dtype=int)
    pieces = got["piece"].to_pylist()
    split = [[p for p, y in zip(pieces, label, strict=True) if y == v] for v in (1, 0)]
    if not all(split):
        counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
        odds = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)
        return CompressionModel(b"", b"", (float(np.log(odds)), 0.0))
    model = CompressionModel(_dictionary(split[0]), _dictionary(split[1]), (0.0, 10.0))
    shared = spark.sparkContext.broadcast(model)
    fitted = sample.filter("building = 0").select("label", "text").mapInArrow(_features(shared), "label int, difference double").toArrow()
    x = fitted["difference"].combine_chunks().to_numpy(zero_copy_only=False) if len(fitted) else np.empty(0)
    y = np.array(fitted["label"].to_pylist(), dtype=float)
    if len(set(y)) < 2:
        return model
    bend, slope = _logistic(np.stack([np.ones(len(x)), x], axis=1), y)
    # The sample may hold more of the rarer label than there is; the curve's height makes up.
    share = known.groupBy("label").count().collect()
    share = {r["label"]: r["count"] for r in share}
    model.weights = (bend + float(np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))), slope)
    return model


def score(text: Column, model: CompressionModel, spark) -> Column:
    """Score of a text: 0 to 1, higher for text like that labelled 1."""
    shared = spark.sparkContext.broadcast(model)
    kept: list[CompressionScorer] = []

    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(shared.value.scorer())
        return pa.array(kept[0].scores(text_bytes(column)), pa.float64())

    return quality(text.cast("string"))
