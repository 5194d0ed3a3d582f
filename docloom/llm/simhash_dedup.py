"""Near-duplicate groups: SimHash fingerprints, linked through covering locality-sensitive hashing."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import spread
from docloom.llm.common import Scratch, row_key, rows, tasks, whole_row

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints compared directly when they share a key; larger buckets are split by a second family of masks.
BUCKET = 2048


def simhash(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint of UTF-8 text: bit i is 1 if set in over half of the shingles' XXH64 values. No word: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(x) + 1 for x in w))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)]
    return majority(np.array(hashes, dtype=np.uint64))


LANES = np.arange(8, dtype=np.uint64)
ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the values. Counted in byte lanes: eight values hold all 64 counts of up to 255 rows."""
    counts = np.zeros((8, 8), dtype=np.int64)
    for a in range(0, len(hashes), 65280):
        part = hashes[a : a + 65280]
        lanes = (part[:, None] >> LANES) & ONES
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 8, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)  # [lane k, byte j] is bit 8 j + k
    return int(np.packbits(bits.T.reshape(64), bitorder="little").view(np.uint64)[0])


def masks(radius: int = RADIUS, order: list[int] | None = None) -> list[int]:
    """2**(radius+1)-1 masks over 64 bits: any two values at most `radius` bits apart agree on all bits of one of them.

    Bit i carries a vector m(i) of radius+1 bits, mask v has the bits with odd <m(i), v>. The at most `radius` vectors
    of the differing bits don't span the space, so some v other than 0 is orthogonal to all: its mask avoids them.
    """
    order = order or list(range(64))
    top = 1 << (radius + 1)
    return [sum(1 << order[i] for i in range(64) if bin((i % top) & v).count("1") % 2) for v in range(1, top)]


def second_masks(radius: int = RADIUS) -> list[int]:
    """A second covering family on shuffled bits, so that a mask of each leaves few bits free."""
    order = list(range(64))
    random.Random(6).shuffle(order)
    return masks(radius, order)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(i, j) pairs that join the linked ones among the values: a tree over each connected set, not all its links."""
    left = np.arange(len(values))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found: list[np.ndarray] = []
            for f in front:
                near = np.bitwise_count(values[left] ^ values[f]) <= radius
                if near.any():
                    yield from ((int(f), int(j)) for j in left[near])
                    found.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(found) if found else left[:0]


def linker(radius: int, bucket: int | None) -> Callable:
    """mapInArrow function over rows sorted by (t, key, fp): links inside each bucket as (a, b) ids, and the rows of
    buckets above `bucket` values as they are (t not null), for splitting. Holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        held: list[np.ndarray] = []
        key, large = None, False

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["a", "b", "t", "key"])
            for c in out:
                c.clear()
            return batch

        def pass_on(part: np.ndarray) -> None:
            out[0] += part[:, 1].tolist()
            out[1] += part[:, 0].tolist()
            out[2] += [key[0]] * len(part)
            out[3] += [key[1]] * len(part)

        def close() -> None:
            if large or not held:
                return
            got = np.concatenate(held) if len(held) > 1 else held[0]
            if len(got) > 1:
                for i, j in forest(got[:, 0].view(np.uint64), radius):
                    out[0].append(int(got[i, 1]))
                    out[1].append(int(got[j, 1]))
                    out[2].append(None)
                    out[3].append(None)

        for b in batches:
            t, k = b.column("t").to_numpy(), b.column("key").to_numpy()
            data = np.stack([b.column("fp").to_numpy(), b.column("rep").to_numpy()], axis=1)
            if not len(t):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                if (t[s], k[s]) != key:
                    close()
                    held, key, large = [], (t[s], k[s]), False
                part = data[s:e]
                if large:
                    pass_on(part)
                    continue
                held.append(part)
                if bucket and sum(map(len, held)) > bucket:
                    for x in held:
                        pass_on(x)
                    held, large = [], True
            if len(out[0]) > 50_000:
                yield flush()
        close()
        yield flush()

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The longs `keep` and fp (the 64 bits as a long) of each row of docs; null or empty text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(x, words) for (x,) in rows(b, "text")), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    some = docs.select(*(F.col(c).cast("long").alias(c) for c in keep), F.col("text").cast("binary").alias("text"))
    return spread(some).mapInArrow(run, ", ".join(f"{c} long" for c in (*keep, "fp")))


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("key", T.LongType())])


def links(reps: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs of rep ids that join all fingerprints of reps (fp, rep) within `radius` bits.

    Each fingerprint goes to one bucket of each mask. A bucket above `bucket` values is dealt again by a second family:
    its members agree on the bits of both masks, so few bits are free and the number of different members is bounded.
    """
    n = tasks(reps.sparkSession)

    def dealt(df: DataFrame, family: list[int], base: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(family)))
        df = df.withColumn("e", F.explode(keys))
        if base:
            return df.select((F.col("t") * len(family) + F.col("e.m")).alias("t"), F.xxhash64("key", "e.k").alias("key"), "fp", "rep")
        return df.select(F.col("e.m").alias("t"), F.col("e.k").alias("key"), "fp", "rep")

    def joined(df: DataFrame, cap: int | None) -> DataFrame:
        return df.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(linker(radius, cap), EDGE)

    first = scratch.save(joined(dealt(reps, masks(radius), ""), bucket), "links-1")
    large = first.where("t is not null").select("t", "key", F.col("b").alias("fp"), F.col("a").alias("rep"))
    second = scratch.save(joined(dealt(large, second_masks(radius), "t"), None), "links-2")
    return first.where("t is null").select("a", "b").union(second.select("a", "b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (smallest node reachable) for each node of edges (a, b); alternates large and small stars.

    Each round's edges are written to the shared folder and the round before is dropped. It ends when a round changes
    no edge. Minima per node are aggregated map-side first; edges of a hub are joined to its one minimum.
    """
    spark = edges.sparkSession

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def star(name: str, e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("b", "a")).toDF("u", "v") if large else e.toDF("u", "v")
        least = scratch.save(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        with_least = around.join(least, "u")
        moved = with_least.where("v > u").select("v", "m") if large else with_least.select("v", "m").union(least.select("u", "m"))
        out = scratch.save(ordered(moved.toDF("a", "b")), name)
        scratch.drop(f"{name}-least")
        return out

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(ordered(edges), "edges-0")
    before, step, last = mark(now), 0, "edges-0"
    while before[0]:
        step += 1
        middle = star(f"edges-{step}-large", now, True)
        now = star(f"edges-{step}", middle, False)
        scratch.drop(last, f"edges-{step}-large")
        last, after = f"edges-{step}", mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()) if before[0] else spark.createDataFrame([], "node long, component long")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text; further columns are ignored).

    Texts are lower-cased (A-Z) and cut into words and shingles of `words` words; documents link when fingerprints
    differ in at most `radius` bits, and component_id is the smallest doc_id reachable. Equal fingerprints are
    collapsed first, so copies cost one row each; between different ones no link is lost, by the cover's guarantee.

    Null or empty text and text without words: fingerprint zero, linked like any other. Repeated rows: each has its
    row in the result. A null doc_id counts as the largest and is null as a component only if nothing else is in it.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, words), "fingerprints")
    return fps.join(classes(fps, scratch, radius, bucket), "fp").select("doc_id", "fp", "component_id")


def classes(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fp, component, component_id of each fingerprint of fps (doc_id, fp): component is the component's smallest
    fingerprint, component_id its smallest doc_id, null if it has none. Nodes of the graph are fingerprints, so rows
    without an id are linked by their texts alone."""
    reps = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    found = scratch.save(components(links(reps.select("fp", F.col("fp").alias("rep")), scratch, radius, bucket), scratch), "components")
    scratch.drop("links-1", "links-2")
    members = scratch.save(reps.join(found, reps.fp == found.node).select("fp", "first", "component"), "members")
    least = scratch.save(members.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    alone = reps.join(found, reps.fp == found.node, "left_anti").select("fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    return scratch.save(members.join(least, "component").select("fp", "component", "component_id").union(alone), "classes")


def keep_first(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id, of different texts of that id the one whose hash
    is smallest, and of rows equal in both the one with the smallest hash over its other columns (maps and variants, which
    have no hash, left out). Rows without a doc_id come after all others and are told apart by their texts. Columns,
    their order and their values stay, whatever their names; no rows give no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    id_, row = row_key(F.col("doc_id"), F.col("text"))
    fps = scratch.save(fingerprints(docs.select(id_.alias("id"), row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), words, ("id", "row", "doc_id")), "fingerprints")
    of = classes(fps, scratch, radius, bucket)
    best = fps.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("best")).join(of.select("fp", "component"), "fp")
    first = scratch.save(best.groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.row"), "first")
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())))
    rows_ = docs.select(whole_row(docs).alias("kept"), id_.alias("id"), row.alias("row"), hashed.alias("by"))
    one = rows_.withColumn("turn", F.row_number().over(Window.partitionBy("id", "row").orderBy("by"))).where("turn = 1")
    return one.join(first, ["id", "row"], "left_semi").select("kept.*")
