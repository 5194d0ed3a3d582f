"""Whether an ingestion kept what was in the texts: structure of spans and units, and labels against gold snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import alnum, is_bare_heading
from docloom.operators.answers import unique_snippet
from docloom.operators.segmenting import FURNITURE, check_tiling

#: Least shares of table rows and headings that must be whole; coverage must be complete.
LEAST_ROWS, LEAST_HEADINGS = 0.98, 1.0
RULE_LINE = r"^[ \t]*\|?[ \t:|-]*-[ \t:|-]*\|?[ \t]*$"


def structure(chunks: DataFrame, spans: DataFrame, units: DataFrame, cap: int = 6000) -> DataFrame:
    """One row for each document of chunks (doc_id, chunk_id, text): untiled chunks, share of letters and digits that its
    spans (doc_id, chunk_id, start, end, kind, text) hold, share of table rows whole in one span, headings that stand alone
    before other text, furniture in units (doc_id, unit, part, text), parts over the cap, and whether all is well."""
    docs = chunks.select("doc_id").distinct()
    broken = check_tiling(spans, chunks).join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("doc_id").agg(F.count("*").alias("untiled"))
    held = spans.groupBy("doc_id").agg(F.sum(alnum(F.col("text"))).alias("held"))
    there = chunks.groupBy("doc_id").agg(F.sum(alnum(F.col("text"))).alias("there"))
    lines = chunks.select("doc_id", "chunk_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.ltrim("line").startswith("|") & ~F.col("line").rlike(RULE_LINE))
    in_span = spans.select(F.col("chunk_id").alias("_c"), F.col("text").alias("_t"))
    met = lines.join(in_span, (F.col("chunk_id") == F.col("_c")) & F.contains("_t", F.col("line")), "left_semi").groupBy("doc_id").agg(F.count("*").alias("whole_rows"))
    rows = lines.groupBy("doc_id").agg(F.count("*").alias("rows")).join(met, "doc_id", "left")
    last = spans.groupBy("chunk_id").agg(F.max("start").alias("_last"))
    one_line = ~F.contains(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n"))
    alone = spans.join(last, "chunk_id").where(F.col("kind").isin("heading", "title") & one_line & is_bare_heading(F.col("text")) & (F.col("start") < F.col("_last"))).groupBy("doc_id").agg(F.count("*").alias("lone_headings"))
    odd = spans.where(F.col("kind").isin(*FURNITURE)).select("doc_id", F.btrim("text").alias("f"))
    furniture = units.join(odd.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & F.contains("text", F.col("f")), "left_semi").groupBy("doc_id").agg(F.count("*").alias("furniture"))
    over = units.where(F.length("text") > cap).groupBy("doc_id").agg(F.count("*").alias("over_cap"))
    out = docs
    for part in (broken, held, there, rows, alone, furniture, over):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0)
    coverage = F.when(F.col("there") > 0, F.col("held") / F.col("there")).otherwise(1.0)
    whole = F.when(F.col("rows") > 0, F.col("whole_rows") / F.col("rows")).otherwise(1.0)
    ok = (F.col("untiled") == 0) & (F.col("lone_headings") == 0) & (F.col("furniture") == 0) & (F.col("over_cap") == 0)
    out = out.withColumn("coverage", coverage).withColumn("row_integrity", whole)
    return out.withColumn("passed", ok & (F.col("coverage") >= 1.0) & (F.col("row_integrity") >= LEAST_ROWS)).drop("held", "there")


def pooled(per_document: DataFrame) -> DataFrame:
    """One row: documents, pooled row integrity, least coverage, and whether every document and the pool pass."""
    p = F.coalesce(F.try_divide(F.sum("whole_rows"), F.sum("rows")), F.lit(1.0))
    out = per_document.agg(F.count("*").alias("n"), p.alias("row_integrity"), F.min("coverage").alias("coverage"), F.every((F.col("untiled") == 0) & (F.col("lone_headings") == 0) & (F.col("furniture") == 0) & (F.col("over_cap") == 0)).alias("structure"))
    return out.withColumn("passed", F.col("structure") & (F.col("row_integrity") >= LEAST_ROWS) & (F.col("coverage") >= 1.0))


def labels(units: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """label, gold, predicted, right, precision, recall of unit labels, and one row of what couldn't be compared.

    units: document, unit, text, label; gold: document, snippet_id, snippet, label. A snippet counts for the one unit that
    holds it; one that none or several hold, and a unit whose snippets disagree, are left out and counted.
    """
    at = unique_snippet(units, gold).join(gold.select("snippet_id", "document", F.col("label").alias("want")), "snippet_id")
    missing = at.agg(F.count_if(F.col("n") == 0).alias("unmatched"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    one = at.where("unit is not null").groupBy("document", "unit").agg(F.min("want").alias("want"), F.countDistinct("want").alias("k"))
    bad = one.agg(F.count_if(F.col("k") > 1).alias("conflicting"))
    both = one.where("k = 1").join(units.select("document", "unit", "label"), ["document", "unit"])
    want = both.groupBy(F.col("want").alias("name")).agg(F.count("*").alias("gold"), F.count_if(F.col("want") == F.col("label")).alias("right"))
    got = both.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("predicted"))
    per = want.join(got, "name", "full_outer").fillna(0)
    return per.withColumn("precision", F.try_divide("right", F.col("predicted"))).withColumn("recall", F.try_divide("right", F.col("gold"))), missing.crossJoin(bad)


def score(pool: DataFrame, per_label: DataFrame | None = None, label_accuracy: float | None = None) -> DataFrame:
    """The ingestion gate: structure passes and, if asked for, the share of right labels reaches `label_accuracy`."""
    if per_label is None or label_accuracy is None:
        return pool.select("passed", F.lit(None).cast("double").alias("label_accuracy"))
    acc = per_label.agg(F.try_divide(F.sum("right"), F.sum("gold")).alias("label_accuracy"))
    return pool.select(F.col("passed").alias("_p")).crossJoin(acc).select((F.col("_p") & F.coalesce(F.col("label_accuracy") >= label_accuracy, F.lit(False))).alias("passed"), "label_accuracy")
