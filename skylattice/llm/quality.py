"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. For a pair of a preferred (label 1) and another document
(label 0) the chance that the first wins is the logistic function of the difference of their strengths; the weights
minimise that loss, with a small ridge, over pairs, by Newton steps on feature differences. The threshold is the quantile of
the labelled rows' scores at the share of label 0 among all labels, each class weighing its share, and scores are moved so that it
stands at CUT.

Every labelled row teaches. Features are a map over whole texts; only they, not the texts, meet the labels. Rows are numbered, pairs
are joined by number, PAIRS of them for each row of label 0 and each row of label 1 at least once, and a Newton step sums gradient and
Hessian over all pairs in the tasks: only sums of 48 x 48 numbers reach the driver. The threshold is closed in on by histograms, exact.

Null and empty texts have the features of an empty text. Labels that are null or neither 0 nor 1 teach nothing. Without
labels of both classes every score is 0.5. Repeated rows get equal scores; other columns pass by untouched: scored() replaces
only columns named score or predicted, the pipeline's stage none.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, positions, short_batches, staged, whole_text, without

#: Preferred documents that each other document is paired with.
PAIRS = 12
RIDGE = 1e-2
CUT = 0.3
FEATURES = 16
#: Standardised features are cut off here, so that no single one decides.
REACH = 6.0
#: Bins of a histogram of strengths; distinct strengths that may reach the driver in the end.
BINS, LEFT = 4096, 4096

CLASSES = np.zeros((256, 6))
CLASSES[ord("A") : ord("Z") + 1, 0] = 1
CLASSES[ord("a") : ord("z") + 1, 1] = 1
CLASSES[ord("0") : ord("9") + 1, 2] = 1
CLASSES[[ord(c) for c in " \t\r\n"], 3] = 1
CLASSES[[ord(c) for c in ".,;:?'\"-"], 4] = 1
CLASSES[[ord(c) for c in "!#$%&()*+/<=>@[\\]^_`{|}~"], 5] = 1


def features(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    upper, lower, digits, space, marks, symbols = (np.bincount(raw, minlength=256) @ CLASSES).tolist()
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    bare = [len(x) for x in words]
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        upper / n, np.log1p(100 * upper / max(1.0, upper + lower)), digits / n, space / n, marks / n, symbols / n, np.log1p(100 * symbols / n),
        repeats / w, np.log1p(100 * repeats / w), len(counts) / w, max(counts.values(), default=0) / w, pairs / w, sum(bare) / w,
        sum(x <= 3 for x in bare) / w, len(set(lines)) / len(lines), np.log1p(w),
    ]


def expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features and what lies beyond one deviation on either side, so that either extreme can count against a text."""
    z = np.clip((x - mean) / sd, -REACH, REACH)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)


def meetings(n_good: int, n_bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Which good row meets which bad one. Each class meets the other in turn, so that every row is in some pair;
    the turns come back after the sizes' least common multiple, each time one good row further on, until all pairs have been."""
    i = np.arange(max(PAIRS * n_bad, n_good))
    return (i * 7919 + i // math.lcm(n_good, n_bad)) % n_good, i % n_bad


@dataclass(frozen=True)
class Ranking:
    """Weights of the strengths and the move that puts the threshold at CUT; not trained without both classes."""

    trained: bool = False
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None
    weights: np.ndarray | None = None
    threshold: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a text's strength does not depend on its batch.
        return (expand(x, self.mean, self.sd) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        s = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def quantile(values: np.ndarray, mass: np.ndarray, share: float) -> float:
    """The middle between the last value with at most `share` of the mass up to it and the next one."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(mass[order])
    at = int(np.searchsorted(upto, share + 1e-9, "right"))
    return float(values[max(0, at - 1) : at + 1].mean())


def slopes(differences: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One row: the loss's gradient, summed over the differences, and its Hessian, flattened."""
    p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
    return np.concatenate([-(differences * p[:, None]).sum(0), ((differences * (p * (1 - p))[:, None]).T @ differences).ravel()])


def newton(summed: Callable[[np.ndarray], np.ndarray], n: int, width: int, steps: int = 25) -> np.ndarray:
    """Minimises the mean of log(1 + exp(-w . d)) + RIDGE / 2 |w|^2 over n differences d; summed(w): slopes() over all of them."""
    w = np.zeros(width)
    for _ in range(steps):
        sums = summed(w) / n
        step = np.linalg.solve(sums[width:].reshape(width, width) + RIDGE * np.eye(width), sums[:width] + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(differences: np.ndarray, steps: int = 25) -> np.ndarray:
    """newton() over differences in memory."""
    return newton(lambda w: slopes(differences, w), len(differences), differences.shape[1], steps)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the features of each row's text."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def features_of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return docs.select(key, features_of(whole_text(text)).alias("x"))


def summed(table: DataFrame, of: Callable[..., np.ndarray], *columns: str) -> np.ndarray:
    """The sum of of(...) over batches of a table's columns of arrays, each given as a matrix: a row for each task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(*[c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return np.sum([r["total"] for r in table.select(*columns).mapInArrow(run, "total array<double>").collect()], axis=0)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    return learn_from(described(docs, key, text), labels, key, label)


def learn_from(known: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Ranking:
    """The ranking that all labelled rows of known, see described(), teach."""
    spark, keep = known.sparkSession, Scratch(known.sparkSession)
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    rows = keep.table(known.join(usable, key).select("y", F.col(key).alias("key"), "x"), "quality-rows")
    n_bad, n_good = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n_bad or not n_good:
        keep.clear()
        return Ranking()
    n = n_bad + n_good
    mean = summed(rows, lambda x: x.sum(0), "x") / n
    sd = np.maximum(np.sqrt(summed(rows, lambda x: ((x - mean) ** 2).sum(0), "x") / n), 1e-6)
    pairs = keep.table(meeting_rows(spark, rows, n_good, n_bad), "quality-pairs")
    n_pairs = max(PAIRS * n_bad, n_good)
    over = lambda w: summed(pairs, lambda one, other: slopes(expand(one, mean, sd) - expand(other, mean, sd), w), "one", "other")
    ranking = Ranking(True, mean, sd, newton(over, n_pairs, 3 * FEATURES))

    @F.pandas_udf("double")
    def strength(x: pd.Series) -> pd.Series:
        return pd.Series(ranking.strength(np.array(x.tolist()).reshape(len(x), FEATURES)))

    share = counts.get(0, 0) / sum(counts.values())
    strengths = keep.table(rows.select("y", strength("x").alias("s")), "quality-strengths")
    threshold = spread_quantile(strengths, share / n_bad, (1 - share) / n_good, share)
    keep.clear()
    return Ranking(True, mean, sd, ranking.weights, threshold)


def meeting_rows(spark: SparkSession, rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """(one, other): the features of a good and a bad row of each of meetings(), rows numbered by key and features in their class."""
    placed = positions(rows, ["y", "key", "x"], "place").select("place", "x")
    i = spark.range(max(PAIRS * n_bad, n_good))
    turn = F.expr(f"(id * 7919L + id div {math.lcm(n_good, n_bad)}L) % {n_good}L")
    met = i.select("id", (turn + n_bad).alias("good"), (F.col("id") % n_bad).alias("bad"))
    met = met.join(placed.select(F.col("place").alias("bad"), F.col("x").alias("other")), "bad")
    return met.join(placed.select(F.col("place").alias("good"), F.col("x").alias("one")), "good").select("one", "other")


def spread_quantile(strengths: DataFrame, of_bad: float, of_good: float, share: float) -> float:
    """quantile() of a table (y, s) whose rows of y = 0 have the mass of_bad, others of_good; of equal strengths the least mass comes first.

    The strengths between which the share is reached lie in one bin of a histogram, which is cut again until it has few rows or one strength."""
    mass = lambda r: r["bad"] * of_bad + r["good"] * of_good
    sums = (F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    at, below = strengths.agg(*sums).first(), {"bad": 0, "good": 0}
    while at["n"] > LEFT and at["lo"] < at["hi"]:
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("s") - at["lo"]) / (at["hi"] - at["lo"]) * BINS))
        bins = strengths.where(F.col("s").between(at["lo"], at["hi"])).groupBy(bin_.alias("bin")).agg(*sums).orderBy("bin").collect()
        for at in bins:
            upto = {c: below[c] + at[c] for c in below}
            if mass(upto) > share + 1e-9 or at is bins[-1]:
                break
            below = upto
    values, masses = [], []
    if (before := strengths.where(F.col("s") < at["lo"]).agg(F.max("s").alias("s")).first()["s"]) is not None:
        values, masses = [before], [mass(below)]
    for r in strengths.where(F.col("s").between(at["lo"], at["hi"])).groupBy("s").agg(*sums[:2]).orderBy("s").collect():
        first = min(m for c, m in (("bad", of_bad), ("good", of_good)) if r[c])
        values, masses = values + [r["s"]] * 2, masses + [first, mass(r) - first]
    # Where all of the interval is within the share, the next strength is above it.
    if (after := strengths.where(F.col("s") > at["hi"]).agg(F.min("s").alias("s")).first()["s"]) is not None:
        values, masses = values + [after], masses + [1.0]
    return quantile(np.array(values), np.array(masses), share)


def with_score(docs: DataFrame, ranking: Ranking, column: str, text: str = "text") -> DataFrame:
    """docs with the score as one more column."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)))

    return docs.withColumn(column, score(whole_text(text)))


def scored(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    return with_score(without(docs, "score", "predicted"), ranking, "score", text).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    return kept(docs, learn(docs.select("doc_id", "text"), labels))


def kept(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The documents that a ranking does not reject."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)) >= CUT)

    return docs.where(good(whole_text("text")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Features are staged once, for learning and for the scores.
    known = staged(described(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "quality-features")
    ranking = learn_from(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array(x.tolist()).reshape(len(x), FEATURES)))

    done = known.withColumn("score", score("x"))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def in_holdout(doc_id: int) -> bool:
    """The same rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
