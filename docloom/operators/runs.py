"""Logs of calls: usage totals, repeated calls, budgets, rolling limits, spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Totals of calls (model, input_tokens, output_tokens, cost, latency_ms), over all and by each of `by` in turn."""
    return calls.rollup(*by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("calls_without_cost"), F.sum("latency_ms").alias("latency_ms"),
    )


def call_key(tool: Column, args: Column) -> Column:
    """tool(arguments as JSON with sorted names)."""
    entries = F.array_sort(F.map_entries(args))
    return F.concat(tool, F.lit("("), F.to_json(F.map_from_entries(entries)), F.lit(")"))


def repeated(calls: DataFrame, run: str, key: str, order: str) -> DataFrame:
    """calls with `seen`: how often the run made the same call before."""
    return calls.withColumn("seen", F.row_number().over(Window.partitionBy(run, key).orderBy(order)) - 1)


def similar_before(questions: DataFrame, similarity, *, least: float = 0.85, note: float = 0.6) -> DataFrame:
    """For each question (run, subject, n, ...) the most similar one the run asked before about the subject, and whether
    it stands in ('repeat') or is worth a note ('note')."""
    a, b = questions.alias("a"), questions.alias("b")
    met = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("b.n") < F.col("a.n")))
    best = met.select("a.run", "a.n", F.col("b.n").alias("before"), similarity.alias("s")).groupBy("run", "n").agg(F.max(F.struct("s", "before")).alias("b"))
    return best.select("run", "n", "b.before", F.col("b.s").alias("similarity"), F.when(F.col("b.s") >= least, "repeat").when(F.col("b.s") >= note, "note").alias("kind")).where("kind is not null")


def within_budget(calls: DataFrame, run: str, order: str, most: int) -> DataFrame:
    """calls with `allowed`: the first `most` of each run."""
    return calls.withColumn("allowed", F.row_number().over(Window.partitionBy(run).orderBy(order)) <= most)


def rolling_counts(calls: DataFrame, by: str, seconds: Column, window: int = 1) -> DataFrame:
    """calls with `in_window`: how many of the group lie in the `window` seconds up to each."""
    w = Window.partitionBy(by).orderBy(seconds).rangeBetween(-window, 0)
    return calls.withColumn("in_window", F.count("*").over(w))


def compare(base: DataFrame, other: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ratio of other to base by measure as text: '--' where both are zero, 'inf' where only base is."""
    r = F.when((F.col("b") == 0) & (F.col("o") == 0), "--").when(F.col("b") == 0, "inf").otherwise(F.concat(F.format_number(F.col("o") / F.col("b"), 1), F.lit("x")))
    return base.select(*keys, F.col("value").alias("b")).join(other.select(*keys, F.col("value").alias("o")), list(keys), "full_outer").fillna(0, ["b", "o"]).select(*keys, "b", "o", r.alias("ratio"))


def reclassified(before: DataFrame, after: DataFrame, none: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """Totals of changed labels (id, label), and how often each change was made, most frequent first."""
    both = before.select("id", F.col("label").alias("old")).join(after.select("id", F.col("label").alias("new")), "id")
    flipped = F.col("old") != F.col("new")
    totals = both.agg(F.count("*").alias("total"), F.count_if(~flipped).alias("unchanged"), F.count_if(flipped).alias("flipped"), F.count_if(flipped & (F.col("new") == none)).alias("to_none"), F.count_if(flipped & (F.col("old") == none)).alias("from_none"))
    return totals, both.where(flipped).groupBy("old", "new").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "old", "new")
