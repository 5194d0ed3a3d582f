"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import spread
from docloom.llm.common import Scratch, give_back, rows, whole_row

TERM = re.compile(r"\w+")
#: Buckets of the term hash, lengths of word beginnings that are terms too.
BUCKETS, PREFIXES = 1 << 20, (4, 5, 6)
#: Labelled documents used at most, in the order of a hash of their ids: bounds what fitting costs and collects.
MOST_LABELLED = 20_000
MEMO = 1_000_000


def terms_of(word: str) -> list[int]:
    """Hashed terms of a lower-cased word: itself and its beginnings."""
    got = [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh64_intdigest(x) % BUCKETS for x in got]


def words_of(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>) over the distinct kept terms of a text.

    place, where given, has the position of each hashed term, or -1: terms that the same training rows have share one.
    """

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    place: np.ndarray | None = None

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum()))

    def places(self, terms: list[int]) -> tuple[int, ...]:
        return tuple(int(i) for i in self.place[terms] if i >= 0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def evidence(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """For each term, in a of n1 toxic and b of n0 other rows, the probability that the classes differ in it.

    The likelihood ratio of two rates to one, with a penalty for the rate fitted, against the share of such terms among
    all, which is estimated from the terms themselves: nothing here is set for a number of rows.
    """

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    n, c = n1 + n0, a + b
    ratio = part(a, c * n1 / n) + part(b, c * n0 / n) + part(n1 - a, (n - c) * n1 / n) + part(n0 - b, (n - c) * n0 / n)
    ratio -= 0.5 * np.log1p(np.minimum(c, n - c))
    share = 1 / max(len(a), 2)
    for _ in range(50):
        differs = sigmoid(np.log(share / (1 - share)) + ratio)
        share = min(max((differs.sum() + 1) / (len(a) + 2 * len(a) ** 0.5), 1e-9), 0.5)
    return differs


def fit(kept: np.ndarray, docs: list[np.ndarray], y: np.ndarray, *, rank: int = 8, rounds: int = 30, rate: float = 0.1, batch: int = 256, shrink: float = 1e-4, hide: float = 0.3, seed: int = 5, scale: np.ndarray | None = None, decay: float | None = None, start: float = 0.02, emptied: bool = False) -> Machine:
    """Logistic loss, minibatch AdaGrad. docs: positions in kept of each document's terms; y: 0 or 1. Deterministic.

    Every other round hides a share of each document's terms, so that one telling term suffices where training texts
    have many. A weight moves by scale (all 1 if None) or by its term's squared factors, if they are larger: what tells
    only in pairs gets a weight too. decay shrinks the factors (as shrink if None), which begin near `start`. emptied: docs are given up one by one as they
    are rearranged, which saves holding them twice.
    """
    rng = np.random.default_rng(seed)
    k, n = len(kept), len(docs)
    share = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(k, dtype=np.float32), rng.normal(0, start, (k, rank)).astype(np.float32)
    if not k or not n or y.min() == y.max():
        return Machine(kept, bias if n else -4.0, w, np.zeros((k, rank)))
    scale, decay = np.ones(k, dtype=np.float32) if scale is None else scale.astype(np.float32), shrink if decay is None else decay
    gb, gw, gv = 1e-8, np.full(k, 1e-8, dtype=np.float32), np.full((k, rank), 1e-8, dtype=np.float32)
    order = rng.permutation(n)
    parts = []
    for a in range(0, n, batch):
        part = order[a : a + batch]
        cols = np.concatenate([docs[i] for i in part])
        sizes = np.array([len(docs[i]) for i in part])
        if emptied:
            for i in part:
                docs[i] = None
        by = np.argsort(cols, kind="stable").astype(np.int32)
        new = np.diff(cols[by], prepend=-1) != 0
        at = np.empty(len(cols), dtype=np.int32)
        at[by] = np.cumsum(new) - 1
        parts.append((y[part], cols[by][new], at, by, np.flatnonzero(new), sizes))
    for turn in range(rounds):
        for p in rng.permutation(len(parts)):
            want, u, at, by, tops, sizes = parts[p]
            if not len(u):
                continue
            row = np.repeat(np.arange(len(want)), sizes)
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            own = v[u]
            squares = (own**2).sum(axis=1)
            free = np.maximum(scale[u], np.minimum(squares, 1))
            x = np.column_stack([w[u] * free, squares, own]).take(at, axis=0)
            seen = rng.random(len(at), dtype=np.float32) >= hide if turn % 2 else None
            if seen is not None:
                x *= seen[:, None]
            sums = np.zeros((len(want), rank + 2), dtype=np.float32)
            sums[row[heads]] = np.add.reduceat(x, heads, axis=0)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(axis=1) - sums[:, 1])
            err = ((sigmoid(z) - want) / len(want)).astype(np.float32)
            e = np.column_stack([err, sums[:, 2:] * err[:, None]]).take(row[by], axis=0)
            if seen is not None:
                e *= seen[by][:, None]
            got = np.add.reduceat(e, tops, axis=0)
            d_w = got[:, 0] * free + shrink * w[u]
            d_v = got[:, 1:] - got[:, :1] * own + decay * own
            d_b = float(err.sum())
            gb += d_b * d_b
            gw[u] += d_w * d_w
            gv[u] += d_v * d_v
            bias -= rate * d_b / np.sqrt(gb)
            w[u] -= rate * d_w / np.sqrt(gw[u])
            v[u] -= 0.2 * rate * d_v / np.sqrt(gv[u])
    return Machine(kept, float(bias), w * np.maximum(scale, np.minimum((v**2).sum(axis=1), 1)), v)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = MOST_LABELLED) -> Machine:
    """A machine from labels (doc_id, toxic) on rows that aren't held out, `most` at most.

    Rows with null doc_id or label are left out; of several labels of an id the largest counts. Every term takes part.
    Terms are counted by class on the executors, with a sum over their rows that tells which have the same rows: those
    share a position. The driver gets the terms, then the rows as positions, packed.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sample = scratch.save(known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(most), "sample")
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("_id"), "text")).join(F.broadcast(sample), "_id").select("_id", "_toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for (text,) in rows(b, "text"):
                got: set[int] = set()
                for w in words_of(text):
                    if w not in memo:
                        if len(memo) > MEMO:
                            memo.clear()
                        memo[w] = terms_of(w)
                    got.update(memo[w])
                out.append(sorted(got))
            yield pa.record_batch([b.column("_id"), b.column("_toxic"), pa.array(out, pa.list_(pa.int32()))], names=["_id", "_toxic", "terms"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), dtype=np.int64)
        for b in batches:
            for i, y, t in rows(b, "_id", "_toxic", "terms"):
                t = np.array(t, dtype=np.int64)
                sums[0 if y else 1, t] += 1
                sums[2, t] += xxhash.xxh64_intdigest(t.tobytes(), i % 2**64) >> 22
        keys = np.flatnonzero(sums[0] + sums[1])
        yield pa.record_batch([pa.array(keys, pa.int32()), *(pa.array(x[keys]) for x in sums)], names=["term", "a", "b", "same"])

    seen = scratch.save(texts.mapInArrow(hashed, "_id long, _toxic int, terms array<int>"), "terms")
    n1, n0 = (seen.where(f"_toxic = {y}").count() for y in (1, 0))
    sums = seen.mapInArrow(counted, "term int, a long, b long, same long").groupBy("term").agg(*(F.sum(x).alias(x) for x in ("a", "b", "same"))).toArrow()
    term, a, b, same = (sums.column(x).to_numpy() for x in ("term", "a", "b", "same"))
    order = np.lexsort((term, same, b, a))
    term, a, b, same = term[order], a[order], b[order], same[order]
    new = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0) | (np.diff(same, prepend=-1) != 0)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[term] = np.cumsum(new) - 1
    term, a, b = term[new], a[new].astype(float), b[new].astype(float)
    del sums, same, new, order

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [zlib.compress(np.diff(np.unique(place[np.array(ts, dtype=np.int64)]), prepend=0).astype("<i4").tobytes(), 1) for (ts,) in rows(b, "terms")]
            yield pa.record_batch([b.column("_id"), b.column("_toxic"), pa.array(out, pa.binary())], names=["_id", "_toxic", "at"])

    got = seen.mapInArrow(placed, "_id long, _toxic int, at binary").toArrow().sort_by([("_id", "ascending"), ("at", "ascending")])
    at = [np.cumsum(np.frombuffer(zlib.decompress(x.as_py()), dtype="<i4"), dtype=np.int32) for x in got.column("at")]
    y = got.column("_toxic").to_numpy().astype(float)
    del got
    give_back()
    if not n1 or not n0:
        model = fit(term, at, y)
    else:
        length = max(sum(map(len, at)) / len(at), 1.0)
        model = fit(term, at, y, rate=0.2, batch=min(256, max(16, len(at) // 16)), scale=evidence(a, b, n1, n0), decay=length / len(at), start=min(0.02, 0.1 / length**0.5), emptied=True)
    model.place = place
    del at
    give_back()
    return model


def scorer(model: Machine, keep: list[str]):
    """mapInArrow function: columns `keep` and the score of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            for (text,) in rows(b, "text"):
                at: set[int] = set()
                for w in words_of(text):
                    hit = memo.get(w)
                    if hit is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        hit = memo[w] = model.places(terms_of(w))
                    if hit:
                        at.update(hit)
                scores.append(float(sigmoid(model.margin(np.array(sorted(at), dtype=np.int64)))))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; more are ignored).

    The text alone is scored, whole: its distinct words and their first letters, hashed. Learned from labels
    (doc_id, toxic) whose crc32(doc_id) % 5 isn't 0. Null and empty texts get the score of a text without terms.
    Repeated rows score alike; a null doc_id isn't held out. Without labels of both classes every score is the same.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    run = scorer(learn(docs, labels, scratch, most_labelled), ["doc_id"])
    scored = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of docs whose text scores below `least`, as they are, whatever their columns' names. No rows: no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    run = scorer(learn(docs, labels, scratch, **options), ["kept"])
    schema = T.StructType([T.StructField("kept", docs.schema), T.StructField("score", T.DoubleType())])
    return spread(docs.select(whole_row(docs).alias("kept"), "text")).mapInArrow(run, schema).where(F.col("score") < least).select("kept.*")
