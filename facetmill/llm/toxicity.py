"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words in lower case and their first 4, 5 and 6 characters (which catch inflected
forms); a feature's value is log(1 + occurrences). One weight vector w serves all ordered
thresholds t_1 < t_2 < ...: P(grade >= k) = sigmoid(w x - t_k). The expected severity is the sum of
these probabilities. A cut on P(grade >= 1), chosen on held-out documents, rejects.

It is trained on at most LABELLED labelled documents (those with the smallest hashes of their ids).
Executors count their features by exact name and send back only the chosen features of each document;
the driver fits on these numbers and never has a text. Labels may hold grades; where they only say
toxic or not, toxic documents get grades 1 to 3 by how much they hold of the features that toxic
documents have far more often than others.

Edge cases: null text has no features; rows with null label, and documents without text, don't
train; several labels of a document count as its largest; of several texts with one labelled doc_id
one trains; without documents of both kinds every document has severity 0 and none is rejected;
repeated rows are scored alike; equal probabilities are on one side of the cut; an empty table gives
an empty table; other columns are kept by ``without_rejected``, whatever their names, and ignored by
``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .worker import lean

#: Bounds of the training set and of the model.
LABELLED, FEATURES = 16_000, 4096
_PREFIXES = (4, 5, 6)
#: Text whose words are numbered at once, in training and in scoring.
_SLICE_BYTES, _SCORE_BYTES = 2 << 20, 8 << 20
#: One document in so many is held out for the cut.
_FOLDS = 5


def _coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and the text it is in."""
    plain = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " "))
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), np.diff(bounds))


def _features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}~" for n in _PREFIXES if len(word) >= n]] if word else []


def _slices(texts: pa.Array, at_once: int = _SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + at_once, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def _spread(own: list[list[int]], code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of each occurrence, from the features of each distinct word."""
    many = np.array([len(h) for h in own], np.int64)
    if not many.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(many)])
    flat = np.array([i for h in own for i in h], np.int64)
    at = np.flatnonzero(many[code] > 0)
    n = many[code[at]]
    return np.repeat(owner[at], n), flat[np.repeat(first[code[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


@dataclass
class OrdinalModel:
    """Numbers of features by name, their weights, the thresholds, and the cut on P(grade >= 1)."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.empty(0))
    cut: float = 2.0

    def matrix(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and value of every non-zero entry."""
        words, code, owner = _coded_words(texts)
        text, feature = _spread([[self.names[f] for f in _features(w) if f in self.names] for w in words], code, owner)
        stride = max(len(self.names), 1)
        cell, count = np.unique(text * stride + feature, return_counts=True)
        return cell // stride, cell % stride, np.log1p(count)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text for each k."""
        text, feature, value = self.matrix(texts)
        linear = np.bincount(text, weights=value * self.weights[feature], minlength=len(texts)) if len(self.names) else np.zeros(len(texts))
        return _sigmoid(linear[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """text, label and held (out) of the training documents, one row for each labelled doc_id, as a written table."""
    label = F.max(F.col(label_col).cast("int")).alias("label")
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    # At most `most` rows of 12 bytes are broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(_FOLDS)) == 0
    return written(rows.select("doc_id", "text", "label", held.alias("held")), "labelled")


def feature_counts(rows: DataFrame) -> DataFrame:
    """name, and how many documents have it: n0 and n1 not toxic and toxic ones that aren't held out, h0 and h1 those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (batch.column(1).to_numpy() > 0) + 2 * batch.column(2).to_numpy(zero_copy_only=False)
            for lo, part in _slices(batch.column(0)):
                words, code, owner = _coded_words(part)
                number: dict[str, int] = {}
                own = [[number.setdefault(f, len(number)) for f in _features(w)] for w in words]
                text, feature = _spread(own, code, owner)
                cell = np.unique(text.astype(np.int64) * max(len(number), 1) + feature)
                text, feature = cell // max(len(number), 1), cell % max(len(number), 1)
                counts = [np.bincount(feature[kind[lo + text] == k], minlength=len(number)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.array(c.astype(np.int64)) for c in counts)], names=["name", "n0", "n1", "h0", "h1"])

    made = rows.select("text", "label", "held").mapInArrow(lean(run), "name string, n0 long, n1 long, h0 long, h1 long")
    return made.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "h0", "h1")])


def choose_features(counts: DataFrame, clean: int, toxic: int, parts: str) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the features most associated with toxic texts, by log-likelihood ratio, and their log odds ratios.

    ``parts`` names the counts that are added up: n, h or both.
    """
    seen = [sum((F.col(f"{p}{k}") for p in parts), F.lit(0)).cast("double") for k in (0, 1)]
    total = [float(clean), float(toxic)]
    odds = F.log((seen[1] + 0.5) / (F.lit(total[1]) - seen[1] + 0.5)) - F.log((seen[0] + 0.5) / (F.lit(total[0]) - seen[0] + 0.5))
    ratio = F.lit(0.0)
    for k in (0, 1):
        for cell, row in ((seen[k], seen[0] + seen[1]), (F.lit(total[k]) - seen[k], F.lit(sum(total)) - seen[0] - seen[1])):
            ratio = ratio + F.when(cell > 0, 2 * cell * F.log(cell * F.lit(sum(total)) / (row * F.lit(total[k])))).otherwise(0.0)
    may = counts.filter(seen[1] >= max(4, 0.002 * total[1])).select("name", odds.alias("odds"), F.round(ratio, 6).alias("ratio")).filter("odds > 2 AND ratio > 15")
    best = may.orderBy(F.desc("ratio"), "name").limit(FEATURES).collect()
    return {r["name"]: i for i, r in enumerate(best)}, np.array([r["odds"] for r in best])


def encoded(rows: DataFrame, model: OrdinalModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of all entries of the training documents, their labels and whether they are held out.

    At most LABELLED rows of at most FEATURES numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in _slices(batch.column(1)):
                text, feature, value = model.matrix(part)
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(part)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(part)) for i in (0, 2, 3)), *lists], names=["doc_id", "label", "held", "features", "values"])

    got = rows.select("doc_id", "text", "label", "held").mapInArrow(lean(run), "doc_id long, label int, held boolean, features array<int>, values array<float>").toArrow()
    # One order whatever the partitions, so that the model is the same in every run.
    got = got.sort_by("doc_id").combine_chunks()
    many = pc.list_value_length(got["features"]).to_numpy().astype(np.int64)
    flat = [pc.list_flatten(got[c]).to_numpy() for c in ("features", "values")]
    return np.repeat(np.arange(len(many)), many), flat[0].astype(np.int64), flat[1].astype(float), got["label"].to_numpy().astype(np.int64), got["held"].to_numpy()


def derived_grades(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, odds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that aren't toxic; else 1 to 3 by thirds of the summed values of strongly associated features."""
    mass = np.bincount(rows, weights=values * (odds[cols] > 3), minlength=len(toxic))
    cuts = np.quantile(mass[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + np.searchsorted(cuts, mass, "left"), 0)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood of the grades.

    Thresholds are the first one and the logarithms of the gaps between them, so they stay in order.
    """
    top = int(grade.max())
    n = len(grade)
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    p = [np.zeros(n_features), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    at = np.arange(n)
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([p[1][:1], np.exp(p[1][1:])]))
        linear = np.bincount(rows, weights=values * p[0][cols], minlength=n)
        upper = np.concatenate([np.ones((n, 1)), _sigmoid(linear[:, None] - t[None, :]), np.zeros((n, 1))], 1)
        own = np.maximum(upper[at, grade] - upper[at, grade + 1], 1e-12)
        slope = upper * (1 - upper)
        d_linear = -(slope[at, grade] - slope[at, grade + 1]) / own
        d_t = np.zeros(top)
        for k in range(1, top + 1):
            d_t[k - 1] = (slope[grade == k, k] / own[grade == k]).sum() - (slope[grade == k - 1, k] / own[grade == k - 1]).sum()
        later = np.cumsum(d_t[::-1])[::-1]
        grads = [np.bincount(cols, weights=values * d_linear[rows], minlength=n_features) / n + penalty * p[0], np.concatenate([later[:1], later[1:] * np.exp(p[1][1:])]) / n]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return p[0], np.cumsum(np.concatenate([p[1][:1], np.exp(p[1][1:])]))


def _cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut on probabilities with the best F1 on held-out documents; equal ones aren't parted."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(toxic[order])
    score = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    score[:-1][p[order][:-1] == p[order][1:]] = 0
    best = int(score.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order][best] + below) / 2, 0.05, 0.95))


def train_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = LABELLED) -> OrdinalModel:
    """A model from at most ``most`` documents with labels (0: not toxic; 1, or grades from 1)."""
    rows = labelled(docs, labels, label_col, most)
    seen = {(r["held"], r["bad"]): r["n"] for r in rows.groupBy("held", (F.col("label") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda bad, *held: sum(seen.get((h, bad), 0) for h in held)
    if not n(True, True, False) or not n(False, True, False):
        return OrdinalModel(thresholds=np.full(3, 500.0))
    counts = written(feature_counts(rows), "features")

    def fitted(parts: str, held: tuple[bool, ...]) -> tuple[OrdinalModel, np.ndarray, np.ndarray, np.ndarray]:
        """A model of some documents, and first probabilities, labels and held of all."""
        names, odds = choose_features(counts, n(False, *held), n(True, *held), parts)
        model = OrdinalModel(names, np.zeros(len(names)))
        text, feature, value, label, out = encoded(rows, model)
        use = np.isin(out, held)
        number = np.cumsum(use) - 1
        own = use[text]
        cells = number[text[own]], feature[own], value[own]
        grade = label[use] if label.max() > 1 else derived_grades(*cells, odds, label[use] > 0)
        model.weights, model.thresholds = fit_ordinal(*cells, grade.astype(np.int64), len(names))
        linear = np.bincount(text, weights=value * model.weights[feature], minlength=len(label)) if len(names) else np.zeros(len(label))
        return model, _sigmoid(linear - model.thresholds[0]), label > 0, out

    cut = 0.5
    if all(n(bad, held) for bad in (False, True) for held in (False, True)):
        _, p, toxic, out = fitted("n", (False,))
        cut = _cut(p[out], toxic[out])
    model = fitted("nh", (False, True))[0]
    model.cut = cut
    return model


SCORED = "p_toxic double, severity double, grade int, rejected boolean"


def score(docs: DataFrame, model: OrdinalModel, *keep: str) -> DataFrame:
    """The ``keep`` columns with p_toxic (P(grade >= 1)), severity (expected), grade (thresholds passed above one half) and rejected."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(model, batch.column(len(keep)))
            more = [pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array((p > 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= model.cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], names=[*keep, "p_toxic", "severity", "grade", "rejected"])

    name = next(n for k in range(len(keep) + 1) if (n := f"text{k}") not in keep)
    return docs.select(*keep, F.col("text").cast("string").alias(name)).mapInArrow(lean(run), ", ".join([*kinds, SCORED]))


def without_rejected(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(model, batch.column(at).cast(pa.string()))[:, 0] < model.cut))

    return docs.mapInArrow(lean(run), docs.schema)


def _probabilities(model: OrdinalModel, texts: pa.Array) -> np.ndarray:
    return np.concatenate([model.probabilities(x) for _, x in _slices(texts, _SCORE_BYTES)]) if len(texts) else np.empty((0, len(model.thresholds)))
