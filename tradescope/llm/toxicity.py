"""Toxicity by multiple-instance learning.

Only documents carry labels.  A sentence's score is a logistic function of the features of
its words; a document's score is the noisy-or of its sentences, 1 - prod(1 - p).  A sentence
without a known feature says nothing and has p = 0, so no text scores by its length.  Training
follows the likelihood of the document labels through the noisy-or, so the sentences that
explain a label earn the weight, and scoring can point at them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.llm.common import forget, kind, texts
from tradescope.operators.staging import stage

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
# Lengths of the word beginnings that serve as features beside whole words.
_BEGINNINGS = range(3, 8)
_FEATURES_AT_ONCE = 300_000


def word_features(word: str) -> list[str]:
    """The whole word and its beginnings, so that inflected forms share evidence."""
    return [word + "$", *(word[:k] for k in _BEGINNINGS if k < len(word))]


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % divisor


@dataclass
class ToxicityModel:
    """Weights of at most ``vocabulary`` features, and the bias of every sentence that has any."""

    feature: dict[str, int]
    weight: np.ndarray
    bias: float


def _sentence_features(text: str, known: dict[str, tuple[int, ...]], model_features: dict[str, int]) -> list[tuple[int, ...]]:
    """Per sentence the numbers of its known features, with repeats."""
    out = []
    for sentence in _SENTENCE.findall(text):
        found: list[int] = []
        for word in _WORD.findall(sentence.lower()):
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(model_features[f] for f in word_features(word) if f in model_features)
            found += got
        out.append(tuple(found))
    return out


def _feature_counts(labelled: DataFrame) -> DataFrame:
    """Documents of either label that hold each feature, added up in each task before the shuffle.

    Every document holds the empty feature.
    """

    def counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array([c[label] for c in seen.values()], pa.int64()) for label in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *columns], names=["feature", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                found = {""}
                for word in set(_WORD.findall(text.lower())):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = word_features(word)
                    found.update(got)
                for feature in found:
                    seen.setdefault(feature, [0, 0])[label] += 1
                forget(known, _FEATURES_AT_ONCE)
                if len(seen) > _FEATURES_AT_ONCE:
                    yield counted(seen)
                    seen = {}
        if seen:
            yield counted(seen)

    return (
        labelled.mapInArrow(run, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )


def _encoded(sample: DataFrame, features: dict[str, int]) -> DataFrame:
    """Per document its label, the sizes of its sentences with features, and these features.

    Sizes and features are packed as 32- and 16-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = [[s for s in _sentence_features(t, known, features) if s] for t in texts(part, "text")]
                forget(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("place"),
                        part.column("label"),
                        pa.array([sum(map(len, r)) for r in rows], pa.int64()),
                        pa.array([np.array([len(s) for s in r], "<i4").tobytes() for r in rows], pa.binary()),
                        pa.array([np.array([f for s in r for f in s], "<i2").tobytes() for r in rows], pa.binary()),
                    ],
                    names=["place", "label", "pairs", "sizes", "features"],
                )

    return sample.mapInArrow(run, "place double, label int, pairs long, sizes binary, features binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Bags:
    """Labelled documents as bags of sentences as bags of features, all in flat arrays."""

    label: np.ndarray  # of a document
    owner: np.ndarray  # document of a sentence
    place: np.ndarray  # sentence of a feature
    feature: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Bags:
        def flat(name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [np.frombuffer(b.as_py(), dtype) for b in rows.column(name)]
            return np.concatenate([np.empty(0, dtype), *parts]), np.array([len(p) for p in parts], np.int64)

        sizes, sentences = flat("sizes", "<i4")
        features, _ = flat("features", "<i2")
        return cls(
            rows.column("label").to_numpy().astype(float),
            np.repeat(np.arange(len(sentences)), sentences),
            np.repeat(np.arange(len(sizes)), sizes),
            features.astype(np.int64),
        )

    def loss(self, theta: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of the labels under a noisy-or of the sentences, and its gradient.

        ``theta`` holds the features' weights and the bias, which only sentences with a feature get.
        """
        n, width = len(self.label), len(theta) - 1
        z = theta[-1] + np.bincount(self.place, theta[self.feature], minlength=len(self.owner))
        # -log prod(1 - p) of each document.
        hazard = np.bincount(self.owner, np.logaddexp(0, z), minlength=n)
        clear = np.exp(-hazard)
        toxic = np.maximum(1 - clear, 1e-9)
        pull = np.where(self.label > 0, -clear / toxic, 1.0)
        slope = pull[self.owner] * _sigmoid(z)
        gradient = np.bincount(self.feature, slope[self.place], minlength=width + 1).astype(float)
        gradient[-1] = slope.sum()
        loss = np.where(self.label > 0, -np.log(toxic), hazard).sum() / n + decay * (theta[:-1] ** 2).sum() / 2
        return float(loss), gradient / n + decay * np.r_[theta[:-1], 0.0]

    def trained(self, width: int, steps: int, decay: float) -> tuple[np.ndarray, float]:
        """Weights and bias after ``steps`` steps of Adam on all documents."""
        theta, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
        theta[-1] = -6.0
        for step in range(1, steps + 1):
            _, gradient = self.loss(theta, decay)
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return theta[:-1], float(theta[-1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_on: Column | None = None,
    counted: int = 200_000,
    sample: int = 30_000,
    pairs: int = 3_000_000,
    vocabulary: int = 1_024,
    least_toxic: int = 5,
    least_z: float = 5.0,
    steps: int = 300,
    decay: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Choose the features on about ``counted`` labelled documents and fit their weights on about ``sample`` of them.

    Documents are chosen by the hash of their id; the ids, so many at most, are broadcast, and
    no text is moved.  The features are the ``vocabulary`` words and word beginnings that
    stand out most in toxic documents, by a z-value of at least ``least_z``, of those that at
    least ``least_toxic`` toxic documents hold.  What training holds in memory is bounded by
    ``pairs`` (feature, sentence) pairs: with more of them fewer documents are taken, and none
    that has over a hundredth of them by itself.  Rows without label or text are left out, an id
    labelled twice counts as toxic if any label says so.  Without labelled rows, or without a
    standing-out feature, every text scores 0.
    """
    labelled = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    if train_on is not None:
        labelled = labelled.where(train_on)
    # A hash between 0 and 1; a share of it is that share of the ids.
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    labelled = stage(labelled.withColumn("place", place), "label_ids")
    total = labelled.count()
    share = min(1.0, counted / max(1, total))
    written = docs.select(id_col, F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def chosen(part: float) -> DataFrame:
        return written.join(F.broadcast(labelled.where(F.col("place") < part)), id_col).select("place", "text", "label")

    found = stage(_feature_counts(chosen(share)).where(f"feature = '' OR toxic >= {least_toxic}"), "features")
    size = found.where("feature = ''").first()
    if size is None or not size.toxic:
        return ToxicityModel({}, np.zeros(0), -20.0)
    toxic, known = size.toxic, size.clean + size.toxic
    rate = (F.col("clean") + F.col("toxic")) / known
    expected = toxic * rate
    z = (F.col("toxic") - expected) / F.sqrt(expected * (1 - rate) + 1e-9)
    top = (
        found.where(f"toxic >= {least_toxic} AND feature <> ''")
        .select("feature", z.alias("z"))
        .where(F.col("z") >= least_z)
        .orderBy(F.desc("z"), "feature")
        .limit(vocabulary)
        .collect()
    )
    features = {r.feature: i for i, r in enumerate(top)}
    part = min(1.0, sample / max(1, total))
    encoded = stage(_encoded(chosen(part), features), "encoded")
    usual = encoded.where(F.col("pairs") <= pairs // 100)
    held = usual.agg(F.sum("pairs")).first()[0] or 0
    bags = Bags.of(usual.where(F.col("place") < part * min(1.0, pairs / max(1, held))).orderBy("place").toArrow())
    if not bags.label.any():
        return ToxicityModel({}, np.zeros(0), -20.0)
    weight, bias = bags.trained(len(features), steps, decay)
    return ToxicityModel(features, weight, bias)


def _scorer(model: ToxicityModel):  # noqa: ANN202
    """A function from a text to its score and the sentences' (begin, end, score)."""
    known: dict[str, tuple[int, ...]] = {}

    def features(word: str) -> tuple[int, ...]:
        got = known.get(word)
        if got is None:
            got = tuple(model.feature[f] for f in word_features(word) if f in model.feature)
            known[word] = got
        return got

    def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
        forget(known)
        if not any(map(features, set(_WORD.findall(text.lower())))):
            return 0.0, []
        hazard, parts = 0.0, []
        for m in _SENTENCE.finditer(text):
            own = [model.weight[f] for w in _WORD.findall(m[0].lower()) for f in features(w)]
            part = float(np.logaddexp(0, model.bias + sum(own))) if own else 0.0
            hazard += part
            parts.append((m.start(), m.end(), 1 - float(np.exp(-part))))
        return 1 - float(np.exp(-hazard)), parts

    return score


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id, score, prediction and the offending sentences of every whole text.

    ``offending`` lists the sentences that score ``threshold`` or more by themselves, as
    code point offsets with their score; a document can pass the threshold without one.
    One narrow pass.  Null and empty texts have no sentence and score 0.  Repeated rows
    score alike; other columns are not read; an empty table gives no row.
    """
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            got = [score(t) for t in texts(batch, text_col)]
            spans = [[dict(zip(("begin", "end", "score"), p, strict=True)) for p in ps if p[2] >= threshold] for _, ps in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([s for s, _ in got], pa.float64()),
                    pa.array([int(s >= threshold) for s, _ in got], pa.int32()),
                    pa.array(spans, span),
                ],
                names=[id_col, "score", "predicted", "offending"],
            )

    schema = (
        f"{id_col} {kind(docs, id_col)}, score double, predicted int, "
        "offending array<struct<begin: int, end: int, score: double>>"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``.

    The same scores and the same defined cases as ``score_toxicity``, without a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score(t)[0] < threshold for t in texts(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
