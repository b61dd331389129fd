"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts.  A text
is compressed with each, block by block; the difference of the two sizes, divided by
their sum, says which kind it resembles, and the smaller size, by the text's own, how
much it repeats.  A logistic curve, fitted on labelled texts that are in neither
dictionary, turns the two numbers into a probability.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, texts
from palimpsest.session import Workspace


@dataclass(frozen=True)
class Fit:
    """Bounds of what is brought to the driver for fitting, and how it is used."""

    #: Labelled texts of each kind that make its dictionary, at most.
    dictionary_texts: int = 1000
    #: Labelled texts of each kind for the calibration, at most.
    calibration_texts: int = 1000
    #: Bytes from the middle of a labelled text that go into a dictionary.
    excerpt_bytes: int = 400
    dictionary_bytes: int = 110_000
    #: Bytes compressed at a time, so that a dictionary counts as much late in a text.
    block_bytes: int = 2048
    level: int = 6
    seed: str = "quality"


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration curve; some 200 kB at the default bounds."""

    good: bytes
    bad: bytes
    level: int
    block_bytes: int
    #: Of the difference, of the logarithm of the ratio, and the constant.
    weights: tuple[float, float, float]

    @functools.cached_property
    def _compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = []
        for content in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=self.level)
            made.append(
                zstandard.ZstdCompressor(
                    dict_data=dictionary, level=self.level, write_content_size=False, write_dict_id=False
                )
            )
        return tuple(made)

    def features(self, text: str) -> tuple[float, float]:
        """Difference (over 0 if the good dictionary helps more) and log ratio; 0 and 0 for an empty text."""
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + self.block_bytes] for i in range(0, len(data), self.block_bytes)]
        good, bad = (sum(len(c.compress(block)) for block in blocks) for c in self._compressors)
        return (bad - good) / (bad + good + 1), math.log((min(good, bad) + 8) / (len(data) + 8))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = features @ np.array(self.weights[:2]) + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def __getstate__(self) -> dict:
        # Compressors are made where they are used.
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}


def _excerpt(text: Column, size: int) -> Column:
    """``size`` bytes from the middle of a text."""
    data = F.encode(text, "UTF-8")
    start = F.greatest(F.lit(0), F.floor(F.octet_length(text) / 2).cast("int") - size // 2)
    end = F.floor(F.octet_length(text) / 2).cast("int") + size // 2
    return F.substr(data, start + 1, end - start)


def _features(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("th"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["label", "th", "difference", "log_ratio"]
            )

    return work


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and constant by Newton's method with halved steps and a weak pull towards 0."""
    scale = np.append(np.maximum(x.std(axis=0), 1e-6), 1.0)
    design = np.column_stack([x, np.ones(len(x))]) / scale

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * (beta[:-1] ** 2).sum())

    beta, pull = np.zeros(design.shape[1]), np.append(np.full(x.shape[1], 0.1), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - pull * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(pull) + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta / scale


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    bounds: Fit = Fit(),
) -> Model:
    """Learn from the documents that ``labels`` marks 0 or 1.

    Of the labelled ids a sample of bounded size, chosen by a hash, is looked up among
    the documents.  Excerpts for the dictionaries and, for the curve, two numbers for each
    whole text come to the driver.  Equal texts are taken once; ids without a text, and
    labels other than 0 and 1, teach nothing.  Without texts of one kind the score is the
    same for all texts.
    """
    present = docs.filter(F.length(F.col(text_column)) > 0).select(F.col(id_column).alias("id"))
    marked = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
        .filter("label in (0, 1)")
        .join(present, "id", "left_semi")
        .distinct()
        .withColumn("order", F.sha2(F.concat(F.lit(bounds.seed), F.col("id").cast("string")), 256))
    )
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limit = bounds.dictionary_texts + bounds.calibration_texts
    # At most ``limit`` ids of each label: a bound that does not grow with the input.
    sample = reduce(
        DataFrame.union, (marked.filter(F.col("label") == k).orderBy("order", "id").limit(limit) for k in (0, 1))
    )
    # Repeated rows of an id are one; with several texts of an id, too, no more rows than ids are used.
    several = Workspace(docs.sparkSession).written(
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        .filter(F.length("text") > 0)
        .join(F.broadcast(sample), "id")
        .withColumn("th", F.xxhash64("text"))
        .dropDuplicates(["label", "id", "th"])
        .select("order", "label", "text", "th")
    )
    kinds: dict[int, tuple[list[int], list[int]]] = {}
    excerpts: dict[int, bytes] = {}
    for label in (0, 1):
        of_kind = several.filter(F.col("label") == label).select("order", "th", _excerpt(F.col("text"), bounds.excerpt_bytes).alias("excerpt"))
        found = of_kind.orderBy("order", "th").limit(limit).collect()
        excerpts |= {r["th"]: bytes(r["excerpt"]) for r in found}
        own = list(dict.fromkeys(r["th"] for r in sorted(found, key=lambda r: (r["order"], r["th"]))))
        half = (len(own) + 1) // 2
        kinds[label] = (own[:half][: bounds.dictionary_texts], own[half:][: bounds.calibration_texts])
    good, bad = (b"".join(excerpts[th] for th in kinds[label][0])[: bounds.dictionary_bytes] for label in (1, 0))
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    model = Model(good, bad, bounds.level, bounds.block_bytes, (0.0, 0.0, prior))
    if len(good) < 8 or len(bad) < 8 or not (kinds[0][1] and kinds[1][1]):
        return model
    held = docs.sparkSession.createDataFrame([(label, th) for label in (0, 1) for th in kinds[label][1]], "label int, th bigint")
    # At most ``calibration_texts`` of each label; whole texts, as they are scored later.
    texts_held = several.dropDuplicates(["label", "th"]).join(F.broadcast(held), ["label", "th"]).select("label", "th", "text")
    measured = sorted(map(tuple, texts_held.repartition(partitions(docs), "th").mapInArrow(_features(model), "label int, th bigint, difference double, log_ratio double").collect()))
    x = np.array([m[2:] for m in measured])
    y = np.array([float(m[0]) for m in measured])
    # The sample has as many of either kind as it may; in the corpus one is rarer.
    share = {label: counts[label] / sum(1 for k in y if k == label) for label in (0, 1)}
    weight = np.array([share[int(k)] for k in y])
    return Model(good, bad, bounds.level, bounds.block_bytes, tuple(_logistic(x, y, weight * len(y) / weight.sum())))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, difference, log_ratio, score and predicted for every whole text; one row in, one out, no shuffle.

    A null text is an empty one, whose score is the curve's at 0; a null id stays
    null; repeated rows give repeated results; other columns are not looked at.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 2)
            p = model.probability(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (found[:, 0], found[:, 1], p, (p >= 0.5).astype(np.int32)))],
                names=["doc_id", "difference", "log_ratio", "score", "predicted"],
            )

    plain = texts(docs, id_column, text_column)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(scored, f"doc_id {kind}, difference double, log_ratio double, score double, predicted int")


def held_out(id_column: str = "doc_id"):
    """True for ids whose label is never learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def probability(model: Model, text: Column) -> Column:
    """The score of a text column, a null text as an empty one."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([model.features(t) for t in texts], dtype=float).reshape(-1, 2)
        return pd.Series(model.probability(found))

    return of(F.coalesce(text, F.lit("")))
