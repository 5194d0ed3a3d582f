"""Connectors that run on the driver: a cached, rate-limited fetcher; and gluing of spreadsheet tables."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import deque
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Fetcher:
    """get(url) through a cache and, only where the cache has nothing, at most `most` calls in any `per` seconds."""

    def __init__(self, fetch: Callable[[str], bytes], folder: str, most: int = 10, per: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.folder, self.most, self.per, self.clock, self.sleep = fetch, Path(folder), most, per, clock, sleep
        self.calls: deque[float] = deque()
        self.lock = threading.Lock()

    def _wait(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                while self.calls and now - self.calls[0] >= self.per:
                    self.calls.popleft()
                if len(self.calls) < self.most:
                    self.calls.append(now)
                    return
                self.sleep(self.per - (now - self.calls[0]))

    def get(self, url: str) -> bytes:
        at = self.folder / hashlib.sha256(url.encode()).hexdigest()
        if at.exists():
            return at.read_bytes()
        self._wait()
        got = self.fetch(url)
        self.folder.mkdir(parents=True, exist_ok=True)
        part = at.with_suffix(".part")
        part.write_bytes(got)
        part.rename(at)
        return got


def continuations(tables: DataFrame) -> DataFrame:
    """Each table (sheet, table_id, left, right, top, bottom, header array, first_row array, types array of the column kinds,
    first_types) with the nearest one above it in the same columns and a verdict: 'data' if its first row is of the kinds
    that the upper one's columns have, 'header' if its first row repeats the header or is all text over columns that
    aren't, else 'unsure'."""
    w = Window.partitionBy("sheet", "left", "right").orderBy("top")
    up = lambda c: F.lag(c).over(w)
    t = tables.withColumn("above", up("table_id")).withColumn("_header", up("header")).withColumn("_types", up("types")).where("above is not null")
    same = F.transform("first_row", lambda c: F.lower(F.btrim(c))) == F.transform("_header", lambda c: F.lower(F.btrim(c)))
    fits = F.col("first_types") == F.col("_types")
    text_over = F.forall("first_types", lambda k: k == "text") & F.exists("_types", lambda k: k != "text")
    verdict = F.when(same | text_over, "header").when(fits & F.exists("_types", lambda k: k != "text"), "data").otherwise("unsure")
    return t.select("sheet", "table_id", "above", verdict.alias("verdict"))


def reading_order(body: DataFrame, texts: DataFrame) -> DataFrame:
    """Items of a parsed document in order: body (doc_id, pos, ref, kind, text), then what of texts (doc_id, ref, text) the
    body doesn't hold, so that no text is lost."""
    rest = texts.join(body.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti").withColumn("kind", F.lit("other"))
    last = body.groupBy("doc_id").agg(F.max("pos").alias("_last"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ref"))
    rest = rest.join(last, "doc_id", "left").withColumn("pos", (F.coalesce("_last", F.lit(-1)) + n).cast(body.schema["pos"].dataType)).select(*body.columns)
    return body.unionByName(rest).where(F.btrim("text") != "")


def unreached_rows(rows: DataFrame, reached: DataFrame, most: int = 1000) -> DataFrame:
    """Of tables (document, table_id) with a reached row: rows, reached ones, and the first missing: rows and reached hold
    document, table_id, row."""
    r = reached.select("document", "table_id", "row").distinct().withColumn("_hit", F.lit(1))
    both = rows.join(r, ["document", "table_id", "row"], "left")
    missing = F.slice(F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col("row")))), 1, most)
    return both.groupBy("document", "table_id").agg(F.count("*").alias("rows"), F.count("_hit").alias("reached"), missing.alias("missing")).where("reached > 0")


def rare_identifiers(tokens: DataFrame, most_rows: int = 3, most_files: int = 3) -> DataFrame:
    """Tokens (token, file, row) that stand in few rows and few files."""
    return tokens.groupBy("token").agg(F.countDistinct("file", "row").alias("rows"), F.countDistinct("file").alias("files")).where((F.col("rows") <= most_rows) & (F.col("files") <= most_files))


def record_links(anchors: DataFrame, content: DataFrame) -> DataFrame:
    """Embedded files to record rows: an anchor (child, row, verified) whose row names the file is EXTRACTED, a match of
    content (child, row, shared) alone INFERRED if it is the only best one, else AMBIGUOUS; a lone unverified anchor is
    INFERRED. child, row, confidence, basis."""
    best = content.withColumn("_m", F.max("shared").over(Window.partitionBy("child"))).where("shared = _m")
    best = best.withColumn("_n", F.count("*").over(Window.partitionBy("child")))
    by_text = best.select("child", "row", F.when(F.col("_n") == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), F.lit("content").alias("basis"), F.lit(2).alias("_o"))
    sure = anchors.where("verified").select("child", "row", F.lit("EXTRACTED").alias("confidence"), F.lit("anchor").alias("basis"), F.lit(1).alias("_o"))
    lone = anchors.where("not verified").withColumn("_n", F.count("*").over(Window.partitionBy("child"))).where("_n = 1").select("child", "row", F.lit("INFERRED").alias("confidence"), F.lit("position").alias("basis"), F.lit(3).alias("_o"))
    every = sure.unionByName(by_text).unionByName(lone)
    return every.withColumn("_f", F.min("_o").over(Window.partitionBy("child"))).where("_o = _f").drop("_o", "_f")


def covering_subset(contracts: DataFrame, most: int, by: str = "kind") -> DataFrame:
    """Up to `most` contracts taken in turn from each kind, by id within it: the n-th of every kind before the n+1-th of any."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    return contracts.withColumn("turn", turn).orderBy("turn", by, "id").limit(most)
