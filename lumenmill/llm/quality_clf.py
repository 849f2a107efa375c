"""Quality classifier by compression.

zstandard dictionaries of several sizes are trained on good and on bad labelled texts. A text is compressed with each; the
difference of the two sizes of a pair, normalised by the size without a dictionary, by that size's root, by the length
and by its own logarithm, says which class the text resembles. A logistic curve fitted on labelled texts that went into
none of the dictionaries turns these differences, and nothing else, into a score.

Training takes at most ``MAX_SAMPLE`` labelled rows of each class, those of the smallest hash, and fewer where their texts
are longer than ``SAMPLE_CHARS`` on average; they are few enough for the driver. Texts are trained on and scored whole.

Edge cases: null or empty text gets the share of good rows among the training rows as its score; labels that are null or
name no document teach nothing, of several labels of one document all count; with one class missing every score is
that share; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, table

MAX_SAMPLE = 3000
#: Characters a row that the rows of a class may have on average, to bound the driver's memory; no text is cut.
SAMPLE_CHARS = 20_000
#: Bytes of one sample of a dictionary; a longer text gives several.
PIECE = 8000
#: With fewer rows in a class the two halves of the sample take turns in other classifiers too.
FEW = 16
#: Small dictionaries hold what is typical of a class, large ones its passages.
DICT_BYTES, LEVEL = (8 << 10, 48 << 10, 256 << 10), 9


class Model:
    """Pairs of dictionaries (good, bad) and a logistic curve; picklable."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: tuple[float, ...], prior: float):
        self.pairs, self.weights, self.prior = pairs, weights, prior
        self._tools: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def gap(self, raw: bytes) -> list[float]:
        """The normalised size differences of the pairs."""
        if self._tools is None:
            self._tools = [_compressor(d) for d in (b"", *[d for pair in self.pairs for d in pair])]
        plain, *sizes = (len(t.compress(raw)) for t in self._tools)
        out = []
        for good, bad in zip(sizes[::2], sizes[1::2], strict=True):
            gap = bad - good
            out += [gap / plain, gap / np.sqrt(plain), gap / len(raw), np.sign(gap) * np.log1p(abs(gap))]
        return out

    def score(self, raw: bytes) -> float:
        """Likelihood that the text is good."""
        if not raw or not self.pairs:
            return self.prior
        odds = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.gap(raw), strict=True))
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a ridge logistic regression; columns are scaled inside."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0], w[1:] / scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> list[tuple[str, int]]:
    """Up to ``per_class`` training rows (text, label) of each class, the same on every run.

    Rows are bounded after labels have met documents, so that repeated ids add none. Texts are whole; rows end where
    those before have ``per_class * chars`` characters.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(label), "doc_id").alias("h"))
    picked = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy("h", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.length("text") > 0)
    rows = rows.select("text", "y", "h", F.length("text").alias("n"), F.xxhash64("text").alias("t"))
    last, room = {}, {0: per_class * chars, 1: per_class * chars}
    for y in (0, 1):
        order = rows.where(F.col("y") == y).select("h", "t", "n").orderBy("h", "t").limit(per_class)
        for h, t, n in map(tuple, order.collect()):
            if room[y] > 0:
                last[y] = h, t
                room[y] -= n
    inside = [F.when((F.col("y") == y) & ((F.col("h") < h) | ((F.col("h") == h) & (F.col("t") <= t))), True) for y, (h, t) in last.items()]
    found = rows.where(F.coalesce(*inside, F.lit(False))).select("text", "y", "h", "t")
    kept = {y: [] for y in (0, 1)}
    for r in sorted(found.limit(2 * per_class).collect(), key=lambda r: (r.h, r.y, r.t)):
        kept[r.y].append((r.h, r.y, r.text))
    return [(text, y) for _, y, text in sorted(x for own in kept.values() for x in own[:per_class])]


def samples_of(texts: list[bytes]) -> list[bytes]:
    """The texts as samples of a dictionary, long ones in pieces that cover all of them."""
    return [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]


def dictionaries(texts: list[bytes]) -> list[bytes]:
    """Dictionaries of the texts, one of each size."""
    samples = samples_of(texts)
    try:
        return [zstandard.train_dictionary(size, samples).as_bytes() for size in DICT_BYTES]
    except zstandard.ZstdError:  # too little to choose from: the texts themselves, the end of them, are the dictionary
        return [b"".join(dict.fromkeys(texts))[-size:] for size in DICT_BYTES]


def pairs_of(good: list[bytes], bad: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Dictionaries of both classes by size."""
    return list(zip(dictionaries(good), dictionaries(bad), strict=True))


def train(sample: list[tuple[str, int]]) -> Model:
    """The two halves of the sample take turns: each makes dictionaries for the other's part of the curve.

    Both make the last dictionaries; a lone row stands on both sides.
    """
    sets = {y: [t.encode() for t, k in sample if k == y] for y in (0, 1)}
    prior = len(sets[1]) / len(sample) if sample else 0.5
    if not min(map(len, sets.values())):
        return Model([], (), prior)
    rows = []
    for k in (0, 1):
        model = Model(pairs_of(*[sets[y][k::2] or sets[y] for y in (1, 0)]), (), prior)
        rows += [(*model.gap(t), y) for y in (0, 1) for t in (sets[y][1 - k :: 2] or (sets[y] if k == 0 else []))]
    x = np.array([r[:-1] for r in rows])
    return Model(pairs_of(sets[1], sets[0]), tuple(fit_logistic(x, np.array([r[-1] for r in rows], float))), prior)


def score_texts(docs: DataFrame, model: object, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, by ``model.scores(list of bytes)`` or, without it, ``model.score(bytes)``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"]]).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            scores = np.array(own.scores(texts) if hasattr(own, "scores") else [own.score(t) for t in texts], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", MAX_SAMPLE, SAMPLE_CHARS)
    return score_texts(docs, train(sample), 0.3)
