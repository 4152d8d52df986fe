"""Toxicity as ordinal regression: severity grades from sparse text features.

A cumulative-link model: with the score s = w . x of a document and ordered thresholds
t1 < t2 < ..., the grade is at most k with probability sigmoid(t_{k+1} - s). One weight
per feature serves all thresholds; the expected severity is the mean grade.

Features are counts of words and of word beginnings (``PREFIXES`` characters), so that a
word never seen takes part of its kin's weight. A feature enters the model by how much
more often it is in toxic documents than in others (log-likelihood ratio).

The labels say toxic or not. A toxic document's grade, 1 to ``GRADES`` - 1, is its rank
by the number of its words that are evidence (features that toxic documents have at least
``MIN_RATE`` times as often), cut into equal parts; every other document has grade 0.

Feature statistics and fit use at most ``SAMPLE`` labelled documents, those with the
least hash of their id, half of the places for toxic ones; that bound is what lets their
ids be broadcast. Every document is scored, over its whole text.

Defined results: null and empty texts score no feature and have the severity of a
document without evidence; a document with contradicting labels counts as toxic; labels
that are null, or of unknown documents, are passed over; with no toxic label at all every
severity is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.llm.common import stored, whole

SAMPLE = 40_000
FEATURES = 4096
GRADES = 4
PREFIXES = (4, 5)
MIN_RATE = 8
_STRIPPED = ".,;:!?\"'()[]{}<>«»“”…-*#$%&|"
_REMEMBERED = 100_000
_SLICE = 1000  # texts counted at a time, which bounds what a worker holds


def words_of(text: str) -> list[str]:
    return [w for w in (w.strip(_STRIPPED) for w in text.lower().split()) if w]


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, which are marked by a blank."""
    return [word, *(word[:n] + " " for n in PREFIXES if len(word) > n)]


@dataclass(frozen=True)
class SeverityModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    rejected_from: float = float("inf")

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Mean grade: the sum over thresholds of the chance to lie above."""
        above = [1 / (1 + np.exp(np.clip(t - scores, -500, 500))) for t in self.thresholds]
        return np.sum(above, axis=0) if above else np.zeros_like(scores)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of at most ``sample`` labelled documents."""
    sound = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    one = sound.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = [one.where(F.col("toxic") == t).orderBy(*order).limit(sample // 2) for t in (True, False)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select("doc_id", whole("text").alias("text"))
    # at most ``sample`` ids, so the texts need no shuffle
    return texts.join(F.broadcast(chosen), "doc_id")


def feature_counts(sample: DataFrame) -> DataFrame:
    """How many toxic and how many other documents of the sample have each feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = (b[at : at + _SLICE] for b in batches for at in range(0, len(b), _SLICE))
        for batch in slices:
            counts = {True: Counter(), False: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(words_of(text))
                counts[bool(toxic)].update({f for w in words for f in features_of(w)})
            for toxic, found in counts.items():
                # without a feature, the column of names would have a type of numbers
                if found:
                    yield pd.DataFrame(
                        {"feature": list(found), "toxic": toxic, "n": list(found.values())}
                    )

    rows = sample.mapInPandas(count, "feature string, toxic boolean, n long")
    return rows.groupBy("feature").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic_docs"),
        F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("other_docs"),
    )


def select_features(counts: DataFrame, toxic: int, others: int, limit: int) -> pd.DataFrame:
    """The features that are toxic documents' own: feature, strength, evidence (the log of
    how many times more often a toxic document has it)."""
    a, b = F.col("toxic_docs"), F.col("other_docs")
    share = (a + b) / F.lit(toxic + others)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    strength = 2 * (
        part(a, share * toxic) + part(b, share * others)
        + part(toxic - a, (1 - share) * toxic) + part(others - b, (1 - share) * others)
    )
    rate = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (others + 1))
    chosen = counts.where((a >= 2) & (rate > MIN_RATE)).select(
        "feature", strength.alias("strength"), F.log(rate).alias("evidence")
    )
    # 15.1: one chance in ten thousand for a feature without association
    best = chosen.where("strength > 15.1").orderBy(F.desc("strength"), "feature").limit(limit)
    return best.toPandas()


def sample_rows(sample: DataFrame, features: list[str]) -> pd.DataFrame:
    """The sample as sparse rows: toxic, number of evidence words, positions and counts."""
    position = {f: i for i, f in enumerate(features)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words, found, evidence = words_of(text), Counter(), 0
                for word, n in Counter(words).items():
                    own = [f for f in features_of(word) if f in position]
                    evidence += n * bool(own)
                    for f in own:
                        found[position[f]] += n
                out.append((bool(toxic), evidence, list(found), list(found.values())))
            yield pd.DataFrame(out, columns=["toxic", "evidence", "at", "n"])

    schema = "toxic boolean, evidence int, at array<int>, n array<int>"
    return sample.mapInPandas(rows, schema).toPandas()


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
    prior: np.ndarray, grade_count: int, penalty: float = 1e-3, rounds: int = 600,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit model, by gradient ascent.

    Weights are drawn to a prior, the evidence of the feature by itself: what only few
    documents of the sample have, often beside stronger features, keeps its weight.
    The thresholds are the first one and the logs of the steps between them, so they stay
    ordered. Sparse rows come as (row, column, value) triples; the steps are Adam's.
    """
    n = len(grades)
    above = [float((grades > k).mean()) for k in range(grade_count - 1)]
    start = [np.log((1 - p + 1e-3) / (p + 1e-3)) for p in above]
    steps = np.log(np.maximum(np.diff(start), 0.05))
    features = len(prior)
    params = np.concatenate([prior, start[:1], steps])
    first, second = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p):
        return p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))])

    for t in range(1, rounds + 1):
        cuts = thresholds(params)
        score = np.bincount(rows, values * params[columns], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = _sigmoid(edges[grades + 1] - score)
        lower = _sigmoid(edges[grades] - score)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_score = d_lower - d_upper
        gradient = np.zeros_like(params)
        gradient[:features] = np.bincount(columns, values * d_score[rows], minlength=features) / n
        gradient[:features] -= penalty * (params[:features] - prior)
        d_cuts = np.array([
            d_upper[grades == k].sum() - d_lower[grades == k + 1].sum()
            for k in range(grade_count - 1)
        ]) / n
        gradient[features] = d_cuts.sum()
        later = np.cumsum(d_cuts[::-1])[::-1]
        gradient[features + 1 :] = later[1:] * np.exp(params[features + 1 :])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        params += 0.05 * step
        # features are chosen as evidence for toxicity, so none may count against it
        np.maximum(params[:features], 0, out=params[:features])
    return params[:features], thresholds(params)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
    grades: int = GRADES,
) -> SeverityModel:
    # bounded, and read three times
    rows = stored(labelled_sample(docs, labels, sample), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, others = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic:
        return SeverityModel({}, ())
    chosen = select_features(feature_counts(rows), toxic, others, features)
    names = chosen["feature"].tolist()
    found = sample_rows(rows, names)
    # a fixed order, so that the sums of the fit do not depend on the order of tasks
    found["at"], found["n"] = found["at"].map(tuple), found["n"].map(tuple)
    found = found.sort_values(["toxic", "evidence", "at", "n"], ignore_index=True)
    level = np.zeros(len(found), np.int64)
    is_toxic = found["toxic"].to_numpy(bool)
    evidence = found["evidence"].to_numpy()[is_toxic]
    # equal numbers have equal grades
    below = np.searchsorted(np.sort(evidence), evidence, side="left") / max(1, len(evidence))
    level[is_toxic] = 1 + np.minimum((below * (grades - 1)).astype(int), grades - 2)
    lengths = found["at"].map(len).to_numpy()
    flat = lambda c: np.array([x for v in found[c] for x in v], np.int64)
    rows_of, at, n = np.repeat(np.arange(len(found)), lengths), flat("at"), np.log1p(flat("n"))
    # a word has up to this many features, which share its evidence
    prior = chosen["evidence"].to_numpy(np.float64) / (1 + len(PREFIXES))
    weights, cuts = fit_ordinal(rows_of, at, n, level, prior, grades)
    named, cuts = dict(zip(names, map(float, weights), strict=True)), tuple(map(float, cuts))
    scores = np.bincount(rows_of, n * weights[at], minlength=len(found))
    severity = SeverityModel(named, cuts).expected(scores)
    return SeverityModel(named, cuts, separating(severity, is_toxic))


def separating(severity: np.ndarray, is_toxic: np.ndarray) -> float:
    """The severity that separates the two classes with the least sum of error rates,
    halfway (in logs) between the two neighbouring values of the sample."""
    values = np.unique(severity)
    if len(values) < 2:
        return float("inf")
    bad, good = np.sort(severity[is_toxic]), np.sort(severity[~is_toxic])
    missed = np.searchsorted(bad, values[1:], side="left") / max(1, len(bad))
    accused = 1 - np.searchsorted(good, values[1:], side="left") / max(1, len(good))
    k = int(np.argmin(missed + accused))
    return float(np.sqrt(values[k] * values[k + 1]))


def with_severity(
    docs: DataFrame, model: SeverityModel, text: str = "text", column: str = "severity"
) -> DataFrame:
    """Add the expected severity of a text column."""

    @F.pandas_udf("double")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        relevant: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            scores = []
            for one in texts:
                found: Counter = Counter()
                for word in one.lower().split():
                    own = relevant.get(word)
                    if own is None:
                        if len(relevant) >= _REMEMBERED:
                            relevant.clear()
                        stripped = word.strip(_STRIPPED)
                        own = tuple(f for f in features_of(stripped) if f in model.weights)
                        relevant[word] = own
                    if own:
                        found.update(own)
                scores.append(sum(model.weights[f] * np.log1p(n) for f, n in sorted(found.items())))
            yield pd.Series(model.expected(np.array(scores, float)), dtype="float64")

    return docs.withColumn(column, severity(whole(text)))


def grade_documents(
    docs: DataFrame, labels: DataFrame, rejected_from: float | None = None, **options
) -> DataFrame:
    """All columns, with expected ``severity`` and ``toxic``: severity from ``rejected_from``,
    by default the value that separates the labelled sample best."""
    model = fit(docs, labels, **options)
    limit = model.rejected_from if rejected_from is None else rejected_from
    return with_severity(docs, model).withColumn("toxic", F.col("severity") >= limit)
