"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its host and path suggest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import spread
from docloom.llm.common import Scratch, rows

#: Labelled documents used at most, in the order of a hash of their ids.
MOST_LABELLED = 20_000
#: Least and largest number of documents that a prior counts for.
STRENGTH = (2.0, 1000.0)
#: Score from which a document is kept: low, since a good document lost costs more than a poor one kept.
LEAST = 0.3
N_FEATURES = 8
#: Host and path of a url.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
ODD = re.compile(r"[#*$%&|<>!@^_=+~\\{}\[\]]")


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text: size, word and line shape, case, symbols, digits, repetition."""
    text = text or ""
    words = text.split()
    n, c = len(words), max(1, len(text))
    letters = sum(map(str.isalpha, text))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(n) / 5,
        len(set(words)) / max(1, n),
        min(20.0, sum(map(len, words)) / max(1, n)) / 10,
        len(ODD.findall(text)) / max(1, n),
        letters / c,
        sum(map(str.isupper, text)) / max(1, letters),
        sum(map(str.isdigit, text)) / c,
        len(set(lines)) / max(1, len(lines)),
    ]


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression on x and its squares, by Newton's method; the last is the bias."""
    x = basis(x)
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 4.0 if not len(y) or y[0] else -4.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def basis(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


@dataclass
class Evidence:
    """What a text says: the log-odds slope * margin + shift of a regression's margin, kept within the margins that the
    calibration has seen, and the base rate of the labels, which the log-odds contain."""

    weights: np.ndarray
    slope: float
    shift: float
    range: tuple[float, float]
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(basis(x) @ self.weights, *self.range) + self.shift


def learn(x: np.ndarray, y: np.ndarray) -> Evidence:
    """A regression on all rows, calibrated on margins that regressions on one half give the other.

    Few labels, or labels that the text predicts badly, give log-odds near the base rate, however sure the regression is
    of the rows it has seen. Targets are smoothed by one document of each class, so nothing is ever certain.
    """
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    base = (n1 + 1) / (n1 + n0 + 2)
    whole = fit(x, y)
    if not n1 or not n0:
        return Evidence(whole, 0.0, float(np.log(base / (1 - base))), (0.0, 0.0), base)
    half = np.arange(len(y)) % 2 == 0
    margin = np.zeros(len(y))
    for part in (half, ~half):
        margin[part] = np.clip(basis(x[part]) @ fit(x[~part], y[~part]), -30, 30)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([margin, np.ones(len(y))], axis=1)
    w = np.array([0.0, np.log(base / (1 - base))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, design.T @ (target - p) - np.array([1e-3, 0.0]) * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return Evidence(whole, max(float(w[0]), 0.0), float(w[1]), (float(margin.min()), float(margin.max())), base)


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[float(v) for v in features(t)] for (t,) in rows(b, "text")]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.mapInArrow(run, schema)


def sites_of(pages: DataFrame) -> DataFrame:
    """_id, host, path of documents that pages (page_id, url) name: the last whole number in the url's path is the
    document, the host is lower-cased, path is the host and the first part. Of several pages the smallest page_id."""
    parts = pages.select("page_id", F.lower(F.regexp_extract("url", URL, 1)).alias("host"), F.regexp_extract("url", URL, 2).alias("rest"))
    named = parts.select(
        F.regexp_extract("rest", "/([0-9]+)[^/]*/?$", 1).try_cast("long").alias("_id"),
        F.struct("page_id", "host", F.concat("host", F.lit("/"), F.regexp_extract("rest", "^/([^/]*)", 1)).alias("path")).alias("s"),
    )
    return named.where("_id is not null and s.host != ''").groupBy("_id").agg(F.min("s").alias("s")).select("_id", "s.host", "s.path")


def strength(groups: DataFrame, prior: str) -> float:
    """How many documents a prior counts for: the variance within groups (n, s, q: number, sum, sum of squares) by that
    between them, by the method of moments. The less groups differ beyond chance, the more."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    got = groups.agg(F.sum(F.col("q") - F.col("s") * mean).alias("inside"), F.sum(n * (mean - F.col(prior)) ** 2).alias("apart"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    if not got.n or got.n == got.groups:
        return STRENGTH[1]
    within = max(got.inside / (got.n - got.groups), 0.0)
    between = (got.apart - got.groups * within) / got.n
    return float(min(max(within / between, STRENGTH[0]), STRENGTH[1])) if between > 0 else STRENGTH[1]


def classify(docs: DataFrame, labels: DataFrame, pages: DataFrame, *, most_labelled: int = MOST_LABELLED, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, host, path, document, host_rate, path_rate, score, kept for each row of docs (doc_id, text).

    document is the calibrated probability from the text alone, learned on labels (doc_id, quality), `most_labelled` at
    most. A document's outcome is its label where it has one, else that probability. Outcomes are summed per host and
    path; without the document's own, host_rate is the host's mean shrunk to the global mean and path_rate the path's
    shrunk to host_rate, by as many documents as the groups' variances say. The score is the posterior that starts from
    path_rate and takes the text's evidence, its log-odds against the labels' base rate. kept: score >= least.

    Only numbers and site names are shuffled. Sums are made map-side first; a host with a third of all rows meets its
    one row of sums in a join that adaptive execution splits, or by broadcast if Spark measures the table as small.
    Null or empty text is scored like any other. Without a page of its own a document's site is null and its rates
    are the global mean. Repeated rows each count and have a row. Without labels document is the same for all. No rows:
    no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "classifier")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna().groupBy("_id").agg(F.min("_good").alias("_good"))
    sample = scratch.save(known.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled), "sample")
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"))
    seen = described(texts.join(F.broadcast(sample), "_id"), ["_id", "_good"]).toPandas()
    seen = seen.assign(x=seen["x"].map(tuple)).sort_values(["_id", "x"], kind="stable")
    x = np.array(seen["x"].to_list(), dtype=float).reshape(-1, N_FEATURES)
    says = learn(x, seen["_good"].to_numpy(dtype=float))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([features(t) for (t,) in rows(b, "text")]).reshape(-1, N_FEATURES)
            yield pa.record_batch([b.column("_id"), pa.array(says.log_odds(got), pa.float64())], names=["_id", "log_odds"])

    own = scratch.save(texts.mapInArrow(judged, "_id long, log_odds double"), "own")
    outcome = F.coalesce(F.col("_good").cast("double"), F.col("document"))
    placed = own.withColumn("document", 1 / (1 + F.exp(-F.col("log_odds")))).join(known, "_id", "left").withColumn("x", outcome).drop("_good").join(sites_of(pages), "_id", "left")
    placed = scratch.save(placed, "placed")
    mean = placed.agg(F.avg("x")).first()[0]
    mean = says.base if mean is None else float(mean)
    sums = lambda *by: placed.where("host is not null").groupBy(*by).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    hosts = scratch.save(sums("host").withColumn("mean", F.lit(mean)), "hosts")
    k = strength(hosts, "mean")
    paths = sums("host", "path").join(hosts.select("host", ((F.lit(mean) * k + F.col("s")) / (k + F.col("n"))).alias("host_mean")), "host")
    paths = scratch.save(paths, "paths")
    kp = strength(paths, "host_mean")
    both = scratch.save(paths.alias("p").join(hosts.alias("h"), "host").select(F.col("p.path").alias("_path"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps"), F.col("h.n").alias("hn"), F.col("h.s").alias("hs")), "sites")
    joined = placed.join(both, placed.path == both._path, "left")
    host_rate = F.coalesce((F.lit(mean) * k + F.col("hs") - F.col("x")) / (k + F.col("hn") - 1), F.lit(mean))
    path_rate = F.coalesce((F.col("host_rate") * kp + F.col("ps") - F.col("x")) / (kp + F.col("pn") - 1), F.lit(mean))
    joined = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    evidence = F.col("log_odds") - float(np.log(says.base / (1 - says.base)))
    score = 1 / (1 + F.exp(-(logit(F.col("path_rate")) + evidence)))
    return joined.withColumn("score", score).select(F.col("_id").alias("doc_id"), "host", "path", "document", "host_rate", "path_rate", "score", (F.col("score") >= least).alias("kept"))
