"""Mixing sources to target weights: native DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, Scratch, whole_row

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Hash seeds tried for each source; the one whose draw lands nearest the target is used.
SEEDS = 64


def size_of(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from (source, size).

    Sources in code-point order, null last, take the weights in turn. Targets share the total by weight, none above
    `most` times its source. The level at which shares are cut has a closed form: with sources by cap / weight, those
    below the level are a prefix, so running sums of caps and weights find it without iterating. All sums are exact
    whole numbers. One row per source is sorted in one task; rows of documents never are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*(F.lit(w) for w in weights))
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(turns, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    everyone = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    big = lambda c: F.col(c).cast("decimal(19,0)")
    per = per.withColumn("capped", big("left") * big("weight") >= big("cap") * big("weight_left"))
    per = per.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0))).withColumn(
        "rest_weight", F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everyone), F.lit(0))
    )
    share = F.col("weight").cast("double") * F.col("rest").cast("double") / F.col("rest_weight").cast("double")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def digest(doc_id: Column, block: Column) -> Column:
    """SHA-256 of the id and a block number; a null id hashes as 'null'. Each holds eight draws of 32 bits."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), block.cast("string")), 256)


def draw(doc_id: Column, seed: Column) -> Column:
    """A whole number below 2**32, as a double."""
    return F.conv(F.substring(digest(doc_id, F.floor(seed / 8).cast("int")), 8 * (seed % 8) + 1, F.lit(8)), 16, 10).cast("double")


def times(rate: Column, drawn: Column) -> Column:
    """floor(rate), and one more if the draw falls below the fraction."""
    return F.floor(rate).cast("long") + (drawn < (rate - F.floor(rate)) * 4294967296.0).cast("long")


def rate_of(target: str, source_size: str) -> Column:
    return F.coalesce(F.col(target) / F.when(F.col(source_size) > 0, F.col(source_size)), F.lit(0.0))


def copies(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seeds: int = SEEDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs (doc_id, text, source; more are ignored).

    A document's rate is its source's target over its source's size. It is taken floor(rate) times and once more if
    its hash under the source's seed falls below the fraction. Per source, the seed out of `seeds` whose whole draw
    comes nearest the target is used, the smaller of equals, so reruns agree. Sums per source are made map-side first,
    so a source with a third of all rows sends a few rows a task; the table of sources is broadcast only if its file
    is below Spark's threshold, else both sides are shuffled and a hot source is split by adaptive execution.

    Null or empty text: size 0, taken 0. Null source: a source of its own. Repeated rows draw alike. No rows: no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    sizes = scratch.save(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, most).withColumnRenamed("source", "of"), "targets")
    rated = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate_of("target", "source_size"))
    takes = [F.col("size") * times(F.col("rate"), draw(F.col("doc_id"), F.lit(i))) for i in range(seeds)]
    sums = rated.groupBy("of").agg(F.max("target").alias("target"), F.array(*(F.sum(t) for t in takes)).alias("sums"))
    off = F.transform("sums", lambda s: F.abs(s - F.col("target")))
    chosen = scratch.save(sums.select("of", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("seed")), "seeds")
    chosen = targets.alias("t").join(chosen.alias("c"), F.col("t.of").eqNullSafe(F.col("c.of"))).select("t.*", "c.seed")
    chosen = scratch.save(chosen, "chosen")
    final = sizes.join(chosen, F.col("source").eqNullSafe(F.col("of")))
    n = times(rate_of("target", "source_size"), draw(F.col("doc_id"), F.col("seed")))
    return final.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as copies() says, with all their columns, whatever their names. No rows: no rows.

    The copies follow from doc_id, source and the source's rate and seed alone, so they are computed on the row
    itself from the table of sources; texts are not shuffled.
    """
    spark = docs.sparkSession
    scratch = options.pop("scratch", None) or Scratch(spark, "mixing")
    copies(docs, scratch=scratch, **options)
    chosen = spark.read.parquet(scratch.path("chosen"))
    n = times(rate_of("target", "source_size"), draw(F.col("doc_id"), F.col("seed"))).cast("int")
    rows = docs.select(whole_row(docs).alias("kept"), "doc_id", "source").join(chosen, F.col("source").eqNullSafe(F.col("of")))
    taken = rows.select("kept", n.alias("n")).where("n > 0")
    return taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("n")))).select("kept.*")
