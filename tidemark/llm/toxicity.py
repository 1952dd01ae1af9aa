"""Toxicity grades by cumulative-link (proportional-odds) regression on sparse text features.

Features of a text: whether it has a word, and whether it has a word that begins so (PREFIXES
letters). One weight vector w is shared by all grades; P(grade >= k) = 1 / (1 + exp(b_k - w x)) with rising
thresholds b_k. The outputs are the expected severity, which is the sum of these over k, and the grade.

The labels say toxic or not. Severity among toxic rows is graded by how many different words they
have that mark toxic rows: fewer than GRADES[0], fewer than GRADES[1], or more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, text_of, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Bound of the labelled sample that the model is fitted on: so many toxic and so many other rows.
SAMPLE = 10_000
#: Features kept: those of the largest significance, this many at most; each in at least LEAST_ROWS toxic rows and LEAST_SHARE of them.
FEATURES, LEAST_ROWS, LEAST_SHARE = 4096, 5, 0.005
#: A feature must be so many times likelier in toxic rows, with this z-value.
LEAST_LIFT, LEAST_Z = 8.0, 2.5
GRADES = (3, 6)
LEVELS = len(GRADES) + 1
#: Documents whose chance of any toxicity reaches this are rejected.
REJECT = 0.5
REMEMBERED = 300_000


def names_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class Features(dict):
    """For each word met, the numbers of the features that it has."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = tuple(v for n in names_of(word) if (v := self.vocabulary.get(n)) is not None)
        return got

    def of(self, text: str) -> tuple[list[int], int, int]:
        """(features of a text, number of different words that have any)."""
        has = [f for w in set(WORD.findall(text.lower())) if (f := self[w])]
        return sorted({i for f in has for i in f}), len(has)


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    features: Features | None = field(default=None, compare=False)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. LEVELS, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def predict(self, texts: list[str]) -> np.ndarray:
        if self.features is None:
            self.features = Features(self.vocabulary)
        return self.at_least(np.array([self.weights[self.features.of(t)[0]].sum() for t in texts], float))


def fit_cumulative(rows: list[list[int]], grades: np.ndarray, n_features: int, steps: int = 800, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the most likely model, by gradient steps with momentum (Adam).

    Toxic and other rows weigh the same in all. The first threshold is free and each next one lies above the one before by the exponential of a free number.
    """
    levels = LEVELS
    flat = np.array([i for r in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p = np.zeros(n_features + levels)
    p[n_features] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    hit = np.arange(levels + 1)[None, :]
    toxic = grades > 0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        b = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(owner, w[flat], len(rows))
        q = 1 / (1 + np.exp(np.clip(b[None, :] - score[:, None], -60, 60)))  # at least k
        full = np.hstack([np.ones((len(rows), 1)), q, np.zeros((len(rows), 1))])
        chance = np.maximum(full[:, :-1] - full[:, 1:], 1e-12)
        slope = np.hstack([np.zeros((len(rows), 1)), q * (1 - q), np.zeros((len(rows), 1))])
        own = hit == grades[:, None]
        inverse = (own / chance).sum(1) * weight
        upper = (slope[:, :-1] * own).sum(1) * inverse  # effect of the threshold below the grade
        lower = (slope[:, 1:] * own).sum(1) * inverse
        by_score = upper - lower
        by_b = np.array([-upper[grades == k + 1].sum() + lower[grades == k].sum() for k in range(levels)])
        g = np.zeros_like(p)
        g[:n_features] = -np.bincount(flat, by_score[owner], n_features) + ridge * w
        by_b = -by_b
        g[n_features] = by_b.sum()
        for j in range(levels - 1):
            g[n_features + 1 + j] = by_b[j + 1 :].sum() * gaps[j]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * min(1, 2 - 2 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
    return p[:n_features], b


def copy_key(text: str) -> int:
    """The least hash of the text's runs of three words, which most near copies share."""
    words = WORD.findall(text.lower())
    k = min(3, len(words))
    return min((zlib.crc32(" ".join(words[i : i + k]).encode()) * 0x9E3779B1 & 0xFFFFFFFF for i in range(len(words) - k + 1)), default=0)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(t, toxic) of SAMPLE rows of each kind at most, by a hash of the id; one row of those that share a copy key.

    The ids, which are so bounded, are broadcast. Copies are left out, as words that only they share would seem to mark a kind.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE) for k in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("key", pa.array([copy_key(t) for t in batch["t"].to_pylist()], pa.int64()))

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).join(ids, "_id").select("_id", "t", "toxic")
    rows = rows.mapInArrow(keyed, f"_id {rows.schema['_id'].dataType.simpleString()}, t string, toxic int, key long")
    rows = written(rows, "sample")
    first = rows.groupBy("key", "toxic").agg(F.min("_id").alias("_id"))
    return rows.join(F.broadcast(first.select("_id").distinct()), "_id", "left_semi").select("t", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """The model of a bounded sample of labelled rows. Without toxic rows it has no features and rejects nothing."""
    small_batches(docs.sparkSession)
    sample = sample_of(docs, labels, id_col, text_col, label_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for t, k in zip(batch["t"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                by[k].update({n for w in set(WORD.findall(t.lower())) for n in names_of(w)})
                by[k][""] += 1
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[0][n] for n in names], pa.int64()), pa.array([by[1][n] for n in names], pa.int64())], ["name", "good", "bad"])

    counts = sample.mapInArrow(counted, "name string, good long, bad long").groupBy("name").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = written(counts.filter(F.col("bad") >= LEAST_ROWS), "word-counts")
    total = counts.filter("name = ''").first()
    if not total or not total["good"]:
        return OrdinalModel({}, np.zeros(0), np.full(LEVELS, 60.0))
    share, base = (F.col("bad") + 0.5) / (total["bad"] + 1), (F.col("good") + 0.5) / (total["good"] + 1)
    z = F.log(share / base) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = counts.filter("name <> ''").filter((F.col("bad") >= LEAST_SHARE * total["bad"]) & (share / base >= LEAST_LIFT) & (z >= LEAST_Z)).orderBy(z.desc(), "name").limit(FEATURES).collect()
    vocabulary = {r["name"]: i for i, r in enumerate(top)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(vocabulary)
        for batch in batches:
            got = [features.of(t) for t in batch["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64())], ["toxic", "has", "hits"])

    seen = sorted(sample.mapInArrow(active, "toxic int, has array<int>, hits long").collect())
    grade = lambda r: 0 if not r["toxic"] else 1 + sum(r["hits"] >= g for g in GRADES)
    w, b = fit_cumulative([r["has"] for r in seen], np.array([grade(r) for r in seen]), len(vocabulary))
    return OrdinalModel(vocabulary, w, b)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity from 0 to LEVELS, grade, p_toxic, rejected) of each row's whole text.

    grade: the number of grades whose chance is at least a half. Null, empty and wordless texts have no features and the least severity.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.predict(batch["t"].to_pylist()).reshape(-1, LEVELS)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(q.sum(1).round(6)), pa.array((q >= 0.5).sum(1), pa.int32()), pa.array(q[:, 0].round(6)), pa.array(q[:, 0] >= REJECT)], ["id", "expected_severity", "grade", "p_toxic", "rejected"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, expected_severity double, grade int, p_toxic double, rejected boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with the columns of docs."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch[text_col].to_pylist()]
            yield batch.filter(pa.array(model.predict(texts).reshape(-1, LEVELS)[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)
