"""Operator 2: toxicity by weak supervision.

Labelled training rows give a lexicon of words and word beginnings; its terms are dealt into
voters, beside pattern voters on counts and typography. A generative label model estimates each
voter's class-conditional rates from the voters' covariances over all documents (triplets), finds
dependent pairs by what the model leaves unexplained, and gives posterior labels. A logistic
regression on features of the text is trained on those posteriors and scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.text import slices
from wayfold.storage import discard, materialize

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    """groups: lexicon voters of words, and as many of word beginnings. A term enters the lexicon if
    its share of toxic documents is at least precision and at least support toxic training rows
    hold it; the lexicon_size strongest terms stay. labelled_rows bounds the labelled sample that
    the lexicon is fitted on; broadcast_rows the labels that are broadcast. Pairs of voters whose
    unexplained correlation exceeds dependence count as dependent.
    """

    groups: int = 5
    precision: float = 0.85
    support: int = 5
    lexicon_size: int = 4000
    labelled_rows: int = 500_000
    broadcast_rows: int = 500_000
    dependence: float = 0.15
    threshold: float = 0.7


def held_out():
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _terms(found: list[str]) -> set[str]:
    """Distinct words, and word beginnings marked by a trailing star."""
    out = set(found)
    for n in _PREFIXES:
        out.update([w[:n] + "*" for w in out if len(w) > n and w[-1] != "*"])
    return out


def _count_terms(only):
    """Rows (term, n): documents of the partition that hold the term; only: a broadcast set, or None for all."""

    def run(batches):
        total: Counter = Counter()
        for b in slices(batches, "text"):
            for t in b.column("text").to_pylist():
                found = _terms(words(t))
                total.update(found & only.value if only is not None else found)
            if len(total) > 300_000:
                yield pa.RecordBatch.from_pydict({"term": list(total), "n": pa.array(list(total.values()), pa.int64())})
                total.clear()
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def _document_frequencies(texts: DataFrame, only=None) -> DataFrame:
    return texts.mapInArrow(_count_terms(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> tuple[DataFrame, int, int]:
    """(text, toxic) of labelled rows outside the held-out third, and the toxic and other rows' numbers."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > p.labelled_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * p.labelled_rows / n))
    by = dict(known.groupBy("toxic").count().collect())
    small = n <= p.broadcast_rows
    return docs.join(F.broadcast(known) if small else known, "doc_id").select("text", "toxic"), by.get(1, 0), by.get(0, 0)


def fit_lexicon(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> tuple[dict[str, int], float]:
    """Terms with their voter (0 .. 2 groups - 1), and the share of toxic rows."""
    rows, n_toxic, n_clean = training_rows(docs, labels, p)
    if not n_toxic or not n_clean:
        return {}, 0.5
    least = max(p.support, math.ceil(0.002 * n_toxic))
    seen = _document_frequencies(rows.filter("toxic = 1").select("text")).filter(F.col("n") >= least)
    toxic = {r.term: r.n for r in seen.toLocalIterator()}
    only = docs.sparkSession.sparkContext.broadcast(set(toxic))
    clean = dict(map(tuple, _document_frequencies(rows.filter("toxic = 0").select("text"), only).collect()))
    scored = []
    for t, a in toxic.items():
        share_toxic, share_clean = a / n_toxic, clean.get(t, 0) / n_clean
        odds = n_toxic * share_toxic / (n_toxic * share_toxic + n_clean * share_clean)
        if odds >= p.precision:
            scored.append((-(a * odds), t))
    kept = [t for _, t in sorted(scored)[: p.lexicon_size]]
    return {t: crc32(t.encode()) % p.groups + p.groups * t.endswith("*") for t in kept}, n_toxic / (n_toxic + n_clean)


def voter_names(p: ToxicityParams) -> list[str]:
    return [*(f"words{i}" for i in range(p.groups)), *(f"stems{i}" for i in range(p.groups)), "hits2", "hits3", "dense", "shout", "marks"]


def features(text: str | None, lexicon: dict[str, int], heads: set[str], p: ToxicityParams) -> tuple[list[int], list[float]]:
    """Votes (1 or -1) and the classifier's features of one text."""
    found = words(text)
    groups, hits, distinct = [0] * (2 * p.groups), 0, set()
    for w in found:
        if w[:4] not in heads:
            continue
        g = lexicon.get(w)
        hit = g is not None
        if hit:
            groups[g] += 1
        for n in _PREFIXES:
            g = lexicon.get(w[:n] + "*") if len(w) > n else None
            if g is not None:
                groups[g] += 1
                hit = True
        if hit:
            hits += 1
            distinct.add(w)
    n, size = len(found), len(text or "")
    marks = (text or "").count("!") / (n + 1)
    upper = len(_SHOUT.findall(text or "")) / (n + 1)
    density = hits / (n + 1)
    flags = [hits >= 2, hits >= 3, density >= 0.01, upper > 0.05, marks > 0.05]
    votes = [1 if x else -1 for x in [*groups, *flags]]
    x = [math.log1p(hits), float(hits >= 1), float(hits >= 2), float(hits >= 3), float(hits >= 5), math.log1p(len(distinct)), float(len(distinct) >= 2),
         min(1.0, 20 * density), *(math.log1p(g) for g in groups), min(1.0, upper), min(1.0, marks), math.log1p(size) / 10]
    return votes, x


def _feature_batches(lexicon, p: ToxicityParams):
    def run(batches):
        lex = lexicon.value
        heads = {t.rstrip("*")[:4] for t in lex}
        for b in slices(batches, "text"):
            got = [features(t, lex, heads, p) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([v for v, _ in got], pa.list_(pa.int8())), pa.array([x for _, x in got], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "votes", "x"],
            )

    return run


@dataclass
class LabelModel:
    """rates[y][i]: probability that voter i votes 1 in class y; weight[i] discounts dependent voters."""

    prior: float
    rates: np.ndarray
    weight: np.ndarray
    dependent: list[tuple[int, int]]

    def log_odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """The intercept, and what each voter adds if it votes 1 and if it votes -1."""
        r = np.clip(self.rates, 1e-4, 1 - 1e-4)
        return math.log(self.prior / (1 - self.prior)), self.weight * np.log(r[1] / r[0]), self.weight * np.log((1 - r[1]) / (1 - r[0]))


def fit_label_model(mean: np.ndarray, second: np.ndarray, prior: float, p: ToxicityParams) -> LabelModel:
    """From the voters' means and second moments over all documents and the share of toxic rows."""
    m, var_y = len(mean), prior * (1 - prior)
    cov = second - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    live = [i for i in range(m) if cov[i, i] > 1e-6]
    dependent: set[tuple[int, int]] = set()
    delta = np.zeros(m)
    for _ in range(3):
        free = lambda i, j: (min(i, j), max(i, j)) not in dependent
        for i in live:
            got = [
                cov[i, j] * cov[i, k] / cov[j, k]
                for j, k in combinations([x for x in live if x != i], 2)
                if free(i, j) and free(i, k) and free(j, k) and abs(cov[j, k]) > 1e-3 * sd[j] * sd[k]
            ]
            got = [g for g in got if g > 0]
            size = math.sqrt(float(np.median(got)) / var_y) if got else 0.0
            sign = 1.0 if sum(cov[i, j] for j in live if j != i) >= 0 else -1.0
            delta[i] = sign * min(size, 2.0)
        rest = cov - np.outer(delta, delta) * var_y
        now = {(i, j) for i, j in combinations(live, 2) if abs(rest[i, j]) > p.dependence * sd[i] * sd[j]}
        if now == dependent or len(now) > m * (m - 1) // 3:
            break
        dependent = now
    weight = np.array([1.0 / (1.0 + sum(abs(rest[i, j]) / (sd[i] * sd[j]) for a, b in dependent if i in (a, b) for j in (a + b - i,))) if i in live else 0.0 for i in range(m)])
    up = (mean + (1 - prior) * delta + 1) / 2
    down = (mean - prior * delta + 1) / 2
    return LabelModel(prior, np.clip(np.array([down, up]), 0.001, 0.999), weight, sorted(dependent))


def _moments(table: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and second moments of the votes, summed up in Spark; m * (m + 3) / 2 numbers come back."""
    v = [F.col("votes")[i].cast("double") for i in range(m)]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = table.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.avg(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    second = np.zeros((m, m))
    for i, j in pairs:
        second[i, j] = second[j, i] = row[f"s{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(m)]), second


def posterior(model: LabelModel, votes: str = "votes"):
    base, up, down = model.log_odds()
    z = F.lit(base)
    for i in range(len(up)):
        z = z + F.when(F.col(votes)[i] > 0, F.lit(float(up[i]))).otherwise(F.lit(float(down[i])))
    return 1 / (1 + F.exp(-z))


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted, posterior) for every row of docs.

    Null and empty texts have features of zero and a low score. Repeated rows get equal scores; a
    doc_id that is labelled twice counts as toxic if either label says so. Without labelled rows of
    both classes every score is 0. Columns of docs other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    lexicon, prior = fit_lexicon(docs, labels.select("doc_id", "toxic"), p)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    table = materialize(docs.withColumn("held_out", held_out()).mapInArrow(_feature_batches(sent, p), "doc_id long, held_out boolean, votes array<byte>, x array<double>"), "features")
    if not lexicon or table.isEmpty():
        zero = F.lit(0.0)
        return table.select("doc_id", "held_out", zero.alias("score"), F.lit(0).alias("predicted"), zero.alias("posterior"))
    model = fit_label_model(*_moments(table, len(voter_names(p))), prior, p)
    judged = table.withColumn("posterior", posterior(model))
    soft = judged.select("x", "posterior").groupBy("x", "posterior").agg(F.count("*").cast("double").alias("n"))
    rows = materialize(
        soft.select(array_to_vector("x").alias("features"), F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("posterior") * F.col("n")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), ((1 - F.col("posterior")) * F.col("n")).alias("weight")))).alias("y"))
        .select("features", "y.label", "y.weight"), "posteriors")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, aggregationDepth=2).fit(rows)
    discard(rows)
    scored = fitted.setFeaturesCol("features").transform(judged.withColumn("features", array_to_vector("x")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= p.threshold).cast("int").alias("predicted"), "posterior")
