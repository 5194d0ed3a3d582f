"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LAST_ID, SPACES, Scratch, ascii_lower, holding, row_key, rows, tasks, whole_row

LEAST = 10
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Batches that a whole corpus is dealt into.
BATCHES = 4
#: A key with over 1 / HOT of a batch's lines is hot. There are fewer than HOT of them, which bounds their broadcast.
HOT = 10_000
KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """id, row, pos, h1, h2 of each line whose key has at least `least` code points; 128 bits of hash stand for the key."""
    id_, row = row_key(F.col("doc_id"), F.col("text"))
    lines = docs.select(id_.alias("id"), row.alias("row"), F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)).alias("pos", "line"))
    return lines.where(F.length("line") >= least).select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


class LineIndex:
    """Which document holds a line first, as sorted runs of (h1, h2, owner) in levels.

    add() takes a batch: its keys merge-anti-join the runs, the new ones become a run of level 0, and the lines of the
    batch that another document owns are returned. When a level has `fanout` runs they are merged into one run of
    the next, so there are few runs to join, and a key is rewritten once a level. Earlier batches own before later
    ones; within a batch the smallest id owns. No key is in two runs.

    Runs and a batch's keys are tables in the same buckets, sorted, one file a bucket: joins among them read both
    sides in order, without exchange or sort. Only a batch's lines are exchanged, once for their keys, by partial sums,
    and once to meet the keys that lose lines, hot ones left out: those are met by a broadcast of at most HOT rows.
    """

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, hot: int = HOT):
        self.scratch, self.fanout, self.hot = scratch, fanout, hot
        self.buckets = tasks(scratch.spark)
        self.levels: list[list[str]] = []
        self.tables: dict[str, DataFrame] = {}
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [self.tables[x] for level in self.levels for x in level]

    def _write(self, keys: DataFrame, level: int) -> None:
        self.made += 1
        name = f"run-{level}-{self.made}"
        self.tables[name] = self.scratch.save_sorted(keys, name, self.buckets, *KEY)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self.tables[names[0]]
                for x in names[1:]:
                    merged = merged.union(self.tables[x])
                self.levels[level] = []
                self._write(merged.groupBy(*KEY).agg(F.min("owner").alias("owner")), level + 1)
                self._forget(names)

    def _forget(self, names: list[str]) -> None:
        for x in names:
            self.tables.pop(x, None)
        self.scratch.drop(*names)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """h1, h2, owner of the keys (h1, h2, first) that no run has."""
        new = keys.select(*KEY, F.col("first").alias("owner"))
        for run in self.runs():
            new = new.join(run, [*KEY], "left_anti")
        return new

    def losing(self, keys: DataFrame) -> DataFrame:
        """h1, h2, n, owner of the keys that a document other than their owner has in the batch."""
        owned, owners = keys, []
        for i, run in enumerate(self.runs()):
            owners.append(f"owner{i}")
            owned = owned.join(run.withColumnRenamed("owner", owners[-1]), [*KEY], "left")
        return owned.withColumn("owner", F.coalesce(*owners)).where("last != owner").select(*KEY, "n", "owner")

    def add(self, lines: DataFrame) -> DataFrame:
        """lines: id, row, pos, h1, h2 of a batch, from a written table. Returns id, row, pos of the lines to drop."""
        batch = self.made + 1
        with holding(self.scratch.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            sums = lines.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
            keys = self.scratch.save_sorted(sums, f"keys-{batch}", self.buckets, *KEY)
            self._write(self.unseen(keys), 0)
            losing = self.scratch.save_sorted(self.losing(keys), f"losing-{batch}", self.buckets, *KEY)
            total = lines.count()
            is_hot = F.col("n") * self.hot > total
            hot = F.broadcast(losing.where(is_hot).select(*KEY, "owner"))
            rest = lines.join(hot.select(*KEY), [*KEY], "left_anti").join(losing.where(~is_hot), [*KEY])
            drops = lines.join(hot, [*KEY]).select("id", "row", "pos", "owner").union(rest.select("id", "row", "pos", "owner"))
            drops = self.scratch.save(drops.where("owner != id").select("id", "row", "pos"), f"drops-{batch}")
            self.scratch.drop(f"keys-{batch}", f"losing-{batch}")
            self._compact()
        return drops

    def close(self) -> None:
        """Removes the runs."""
        self._forget(list(self.tables))
        self.levels = []


def drops_of(docs: DataFrame, *, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT, hot: int = HOT, scratch: Scratch) -> DataFrame:
    """id, row, drops (positions of lines to drop) of the rows that lose lines.

    docs is dealt into `batches` ranges of doc_id, taken in order, so the smallest doc_id owns a line. Only hashes and
    positions are shuffled here. A line in a third of all documents is one key, whose occurrences aren't exchanged: its
    sums are made map-side and it is hot. All but the result is removed at the end.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    at = [i / batches for i in range(1, batches)]
    cuts = docs.select(id_.alias("id")).agg(F.percentile_approx("id", F.array(*(F.lit(x) for x in at)), F.lit(1000)).alias("x")).first().x if at else None
    cuts = sorted(set(cuts or ()))
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = occurrences(docs, least).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(scratch.path("lines"))
    lines = spark.read.schema("id long, row long, pos int, h1 long, h2 long, batch int").parquet(scratch.path("lines"))
    index = LineIndex(scratch, fanout, hot)
    found = [index.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(cuts) + 1)]
    index.close()
    dropped = found[0]
    for x in found[1:]:
        dropped = dropped.union(x)
    out = scratch.save(dropped.groupBy("id", "row").agg(F.collect_set("pos").alias("drops")), "drops")
    scratch.drop("lines", *(f"drops-{i}" for i in range(1, index.made + 1)))
    return out


def _with_drops(docs: DataFrame, kept: Column, scratch: Scratch, **options) -> DataFrame:
    """kept, text and drops of each row of docs."""
    drops = drops_of(docs, scratch=scratch, **options)
    id_, row = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(kept.alias("kept"), F.col("text").alias("text"), id_.alias("id"), row.alias("row")).join(drops, ["id", "row"], "left").select("kept", "text", "drops")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, dropped, left = [], [], []
        for text, drops in rows(b, "text", "drops"):
            lines = (text or "").split("\n")
            gone = set(drops or ())
            n.append(len(lines))
            dropped.append(len(gone))
            left.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "")
        yield pa.record_batch([b.column("kept"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.string())], names=["kept", "n_lines", "n_dropped", "left"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _assemble(batches):
        shas = [hashlib.sha256(x.encode()).hexdigest() for (x,) in rows(b, "left")]
        yield pa.record_batch([b.column("kept"), b.column("n_lines"), b.column("n_dropped"), pa.array(shas, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs (doc_id, text; more are ignored).

    A line whose key has `least` code points or more and is in two or more documents stays only in the one with the
    smallest doc_id. Null and empty text are one empty line. Rows that repeat a doc_id are one document here, each with
    its own lines and result; all rows without a doc_id are one document too, after all others. So a line that only
    rows of one id, or only rows without any, hold stays in all of them. Every line of any length of text counts; no
    rows give no rows; columns of any other name are left alone.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    return _with_drops(docs, F.col("doc_id").cast("long"), scratch, **options).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """docs with the lines gone that line_digests() counts as dropped; a null text becomes empty, n_chars follows the
    text if there is such a column, all else stays, whatever its name."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    schema = T.StructType([T.StructField("kept", docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("left", T.StringType())])
    out = _with_drops(docs, whole_row(docs), scratch, **options).mapInArrow(_assemble, schema)
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("kept")[c]).alias(c) for c in docs.columns))
