"""Toxicity by classifier chains.

Categories are predicted one after another, each by a logistic model over lexical features
and the probabilities of the categories before it.  For training, those earlier probabilities
are out-of-fold predictions, so a later model learns from the errors that the earlier ones
make on unseen text.  The last link is the label of the ``labels`` table; the ones before it
are kinds of toxicity found in the data: the toxic documents of the sample, clustered by the
features they share (spherical k-means from a fixed start).

Features are a document's distinct words and their prefixes, as present or not.  The models
are fitted on at most ``SAMPLE_ROWS`` labelled documents (whole texts, chosen by a hash of the
id, one text for each id); that is the one bound, and with it what the driver holds.  All
features take part whose rate of toxic documents in that sample lies ``EVIDENCE`` standard errors
above the sample's own.  Scoring streams over the whole texts of all documents.

Defined results: null and empty texts have no features and get the models' base rates; labels
that are null, or whose document is missing, are not used, of unlike labels of one id the toxic
one counts, of unlike texts the smallest; without a positive label every probability is 0;
repeated rows are scored one by one; very long texts are read whole; columns other than those
named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import shared_checkpoint

SAMPLE_ROWS = 20_000
FOLDS = 5
LEAST_COUNT = 3
#: Standard errors by which a feature's rate of toxic documents must exceed the sample's (root of the likelihood ratio).
EVIDENCE = 4.0
THRESHOLD = 0.4
PREFIXES = (4, 5, 6, 7)
KINDS = 3
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word and its prefixes (marked by ^)."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def fit(rows: list[np.ndarray], extra: np.ndarray, target: np.ndarray, width: int, steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model: ``width`` features, the extra columns, the constant (Adam, full batch)."""
    size = np.array([len(r) for r in rows], np.int64)
    doc, at = np.repeat(np.arange(len(rows)), size), np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    n = max(1, len(rows))
    weights = np.zeros(width + extra.shape[1] + 1)
    rate = min(max(target.mean() if len(target) else 0.0, 1e-6), 1 - 1e-6)
    weights[-1] = math.log(rate / (1 - rate))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = np.bincount(doc, weights[at], len(rows)) + extra @ weights[width:-1] + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - target
        gradient = np.concatenate([np.bincount(at, error[doc], width), extra.T @ error, [error.sum()]]) / n
        gradient[:-1] += penalty * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


def predict(weights: np.ndarray, rows: list[np.ndarray], extra: np.ndarray, width: int) -> np.ndarray:
    linear = np.array([weights[r].sum() for r in rows]) if rows else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(linear + extra @ weights[width:-1] + weights[-1], -40, 40)))


@dataclass(frozen=True)
class Chain:
    """A fitted chain: places of the features and one weight vector for each category."""

    places: dict[str, int]
    weights: list[np.ndarray]

    def rows(self, texts: list[str | None], known: dict[str, tuple[int, ...]]) -> list[np.ndarray]:
        out = []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text):
                here = known.get(word)
                if here is None:
                    here = tuple(self.places[f] for f in features_of(word) if f in self.places)
                    if len(known) < 1_000_000:  # a cache, nothing depends on it
                        known[word] = here
                found.update(here)
            out.append(np.array(sorted(found), np.int64))
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        extra = np.empty((len(rows), 0))
        for weights in self.weights:
            extra = np.column_stack([extra, predict(weights, rows, extra, len(self.places))])
        return extra


def fit_chain(places: dict[str, int], rows: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the categories (columns of ``targets``) in order, passing on out-of-fold predictions."""
    extra = np.empty((len(rows), 0))
    weights = []
    for c in range(targets.shape[1]):
        target = targets[:, c].astype(float)
        weights.append(fit(rows, extra, target, len(places)))
        held_out = np.zeros(len(rows))
        for k in range(FOLDS):
            inside, out = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            part = fit([rows[i] for i in inside], extra[inside], target[inside], len(places))
            held_out[out] = predict(part, [rows[i] for i in out], extra[out], len(places))
        extra = np.column_stack([extra, held_out])
    return Chain(places, weights)


def kinds_of(rows: list[np.ndarray], width: int, kinds: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Cluster of each row of features, by cosine to the clusters' sums; rows without features are in none (-1)."""
    size = np.array([len(r) for r in rows], np.int64)
    doc, at = np.repeat(np.arange(len(rows)), size), np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    norm = np.sqrt(np.maximum(size, 1))

    def closeness(centre: np.ndarray) -> np.ndarray:
        return np.bincount(doc, centre[at], len(rows)) / norm / (np.sqrt((centre**2).sum()) or 1)

    centres = [np.bincount(at, minlength=width).astype(float)]
    while len(centres) < kinds:  # the row least like all centres so far is the next
        best = np.max([closeness(c) for c in centres], axis=0)
        far = np.zeros(width)
        far[rows[int(np.argmin(np.where(size > 0, best, np.inf)))]] = 1
        centres.append(far)
    found = np.full(len(rows), -1)
    for _ in range(rounds):
        new = np.where(size > 0, np.argmax([closeness(c) for c in centres], axis=0), -1)
        if (new == found).all():
            break
        found = new
        centres = [np.bincount(at, (found == k)[doc] / norm[doc], width) for k in range(kinds)]
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents, by a hash of the id."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` short rows at most
    return shared_checkpoint(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    """Fit a chain on a bounded labelled sample."""
    sample = labelled_sample(docs, labels, rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic > 0)].update({f for w in words_of(text) for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": names, "clean": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]})

    counted = sample.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0))).first()
    rate = (totals[1] + 0.5) / (totals[0] + 1)
    seen = F.col("toxic") + F.col("clean")
    share = lambda part, expected: F.when(F.col(part) > 0, F.col(part) * F.log(F.col(part) / (seen * expected))).otherwise(0.0)
    evidence = 2 * (share("toxic", rate) + share("clean", 1 - rate))  # likelihood ratio against the sample's own rate
    telling = (F.col("toxic") >= LEAST_COUNT) & (F.col("toxic") > rate * seen) & (evidence >= EVIDENCE**2)
    chosen = counted.where(telling).select("feature")
    places = {f: i for i, f in enumerate(sorted(r[0] for r in chosen.collect()))}  # words of the bounded sample
    reader = Chain(places, [])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "at": reader.rows(list(batch["text"]), known), "toxic": (batch["toxic"] > 0).astype("int64")})

    data = sample.mapInPandas(place, "doc_id long, at array<long>, toxic long").toPandas().sort_values("doc_id", kind="stable")  # the bounded sample
    if not len(data) or not data["toxic"].any():
        return Chain({}, [np.array([*[0.0] * c, -40.0]) for c in range(len(CATEGORIES))])
    rows_at, toxic = [np.asarray(a, np.int64) for a in data["at"]], data["toxic"].to_numpy()
    kinds = np.full(len(data), -1)
    kinds[toxic > 0] = kinds_of([r for r, t in zip(rows_at, toxic, strict=True) if t], len(places))
    targets = np.column_stack([*(kinds == k for k in range(KINDS)), toxic > 0]).astype(int)
    return fit_chain(places, rows_at, targets, np.arange(len(data)) % FOLDS)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category, and toxic: the last one reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = chain.probabilities(chain.rows(list(batch["text"]), known))
            out = pd.DataFrame(found, columns=[f"p_{c}" for c in CATEGORIES])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            out["toxic"] = found[:, -1] >= threshold
            yield out

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
