"""Lanes in which a model decides over rows that plain rules have narrowed: section boundaries, answers in two steps,
constraints of a question, rules of a section, properties by dimension, extraction by several extractors, and an index of
vectors on disk. Models are hooks over texts; where one fails the row has an error or falls back as stated."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import answers, blocks, retrieval, segmenting, store
from docloom.plans.flows import answer
from docloom.plans.hooks import TextHook, over

HEADING_KINDS = ("heading", "title")


# boundaries


def with_sections(items: DataFrame) -> DataFrame:
    """items (doc_id, pos, kind, text) with `section`: the position of the last heading up to each, 0 before the first."""
    opens = F.when(F.col("kind").isin(*HEADING_KINDS), F.col("pos"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section", F.coalesce(F.max(opens).over(upto), F.lit(0)))


def structural_boundaries(items: DataFrame) -> DataFrame:
    """doc_id, start, end of the ranges of items that begin at headings; the first begins at 0."""
    starts = with_sections(items).select("doc_id", F.col("section").cast("int").alias("start"))
    return segmenting.boundaries(starts, items.groupBy("doc_id").agg((F.max("pos") + 1).cast("int").alias("n")))


def numbered(items: DataFrame, by: Sequence[str], first, most: int = 140) -> DataFrame:
    """One text for each group: '[i] text' lines, i counted from `first`, of at most `most` characters each, which bounds
    what a model is shown of an item, not what is cut; with the number of items and the length of their joined texts."""
    line = F.concat(F.lit("["), (F.col("pos") - first).cast("string"), F.lit("] "), F.substring("text", 1, most))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    filled = F.length(F.btrim("text")) > 0
    chars = F.sum(F.when(filled, F.length("text") + 2).otherwise(0)) - 2
    return items.groupBy(*by).agg(F.count("*").cast("int").alias("n"), chars.alias("chars"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def model_boundaries(items: DataFrame, cuts: TextHook) -> DataFrame:
    """The ranges that begin where a model says (a list of item numbers for each document), repaired: numbers out of range
    and repeats go, 0 always begins one, so no text is ever lost. A document on which it fails is one range."""
    shown = numbered(items, ["doc_id"], F.lit(0))
    said = over(shown.select("doc_id", "n", "text"), cuts, "array<int>")
    starts = said.select("doc_id", F.explode(F.coalesce("out", F.array().cast("array<int>"))).alias("start"))
    return segmenting.boundaries(starts, shown.select("doc_id", "n"))


def refined_boundaries(items: DataFrame, cuts: TextHook, cap: int = 24_000) -> DataFrame:
    """Structural ranges; those of several items whose text is over the cap are cut further by a model, which sees one such
    section at a time. Documents whose sections fit need no call."""
    placed = with_sections(items)
    large = numbered(placed, ["doc_id", "section"], F.col("section")).where((F.col("n") > 1) & (F.col("chars") > cap))
    said = over(large.select("doc_id", "section", "n", "text"), cuts, "array<int>")
    inner = said.select("doc_id", "section", "n", F.explode("out").alias("cut")).where((F.col("cut") > 0) & (F.col("cut") < F.col("n")))
    starts = inner.select("doc_id", (F.col("section") + F.col("cut")).cast("int").alias("start")).union(placed.select("doc_id", F.col("section").cast("int")))
    return segmenting.boundaries(starts, items.groupBy("doc_id").agg((F.max("pos") + 1).cast("int").alias("n")))


# answers


def or_abstained(queries: DataFrame, answered: DataFrame, abstention: str = "The documents do not answer this.") -> DataFrame:
    """query_id, answer for every query (query_id): one without evidence abstains, without a call."""
    none = F.struct(F.lit(abstention).alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit("abstained").alias("kind"))
    return queries.select("query_id").distinct().join(answered, "query_id", "left").withColumn("answer", F.coalesce("answer", none))


def answer_reasoned(evidence: DataFrame, reason: TextHook, emit: TextHook) -> DataFrame:
    """query_id, answer in two steps: a model's analysis of the evidence, then a model's answer on evidence and analysis, held
    to the evidence like any other."""
    block = answers.evidence_block(evidence)
    known = evidence.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    thought = over(block.withColumnRenamed("evidence", "text"), reason, "string", "analysis").drop("error")
    asked = thought.select("query_id", F.concat("text", F.lit("\n\nAnalysis:\n"), F.coalesce("analysis", F.lit(""))).alias("text"))
    got = over(asked, emit, "string").join(known, "query_id")
    return got.select("query_id", answers.finalize(answers.parse_answer(F.coalesce("out", F.lit(""))), F.col("ids")).alias("answer"))


def answer_best_of(evidence: DataFrame, models: Sequence[TextHook], least: int = 1) -> DataFrame:
    """query_id, answer: of several tries the one with most citations; with fewer than `least` that don't abstain, null."""
    tries = None
    for i, model in enumerate(models):
        one = answer(evidence, model).withColumn("try", F.lit(i))
        tries = one if tries is None else tries.unionByName(one)
    return answers.best_of(tries, least=least)


# decisions


def query_constraints(queries: DataFrame, extract: TextHook) -> DataFrame:
    """query_id, dimension, value: the constraints that a model reads in questions (query_id, text), each once; a question on
    which it fails has none and is searched without."""
    got = over(queries.select("query_id", "text"), extract, "array<struct<dimension:string,value:string>>")
    return got.where("error is null").select("query_id", F.inline("out")).where("dimension is not null and value is not null").distinct()


def decided_rules(spans: DataFrame, decide: TextHook, operative: float = 0.5, label: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Spans (span_id, text) that a model holds operative with `operative` or more, each with the labels it gives `label` or
    more, sorted; and the spans on which it failed, which are reported, not taken as empty. The model gives a struct of
    operative and a map of labels."""
    got = over(spans, decide, "struct<operative:double,labels:map<string,double>>")
    kept = got.where(F.col("error").isNull() & (F.col("out.operative") >= operative))
    names = F.array_sort(F.map_keys(F.map_filter("out.labels", lambda k, v: v >= label)))
    return kept.withColumn("labels", names).drop("out", "error"), got.where("error is not null").drop("out")


def needs_more(text, cues: Sequence[str]):
    """Whether a text holds a cue, so that a second call on it is worth while."""
    return F.exists(F.array(*(F.lit(c.lower()) for c in cues)), lambda c: F.contains(F.lower(text), c))


def dimension_lane(spans: DataFrame, classifiers: Mapping[str, TextHook], scope: DataFrame, weak: Sequence[str] = (), none: str = "none") -> DataFrame:
    """span_id, dimension, value, confidence: each dimension's classifier over the spans (span_id, function, text) whose
    function has the dimension in scope (function, dimension). It ranks values, best first; the first is EXTRACTED, the
    others INFERRED, all AMBIGUOUS for weak dimensions; `none` first says nothing. A span on which it fails has no value."""
    out = None
    for dimension, classify in classifiers.items():
        asked = spans.join(scope.where(F.col("dimension") == dimension).select("function").distinct(), "function", "left_semi").select("span_id", "text")
        got = over(asked, classify, "array<string>").where(F.col("error").isNull() & (F.coalesce(F.get("out", F.lit(0)), F.lit(none)) != none))
        each = got.select("span_id", F.posexplode("out").alias("n", "value")).where(F.col("value") != none)
        sure = F.lit("AMBIGUOUS") if dimension in weak else F.when(F.col("n") == 0, "EXTRACTED").otherwise("INFERRED")
        one = each.select("span_id", F.lit(dimension).alias("dimension"), "value", sure.alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def fan_out(chunks: DataFrame, extractors: Mapping[str, TextHook], kind: str, tries: int = 3) -> DataFrame:
    """chunk_id, found (a list of `kind`), failed: what several extractors find in chunks (chunk_id, text), joined in the
    order of their names. One that fails `tries` times on a chunk counts as having found nothing and is named in failed."""

    def patient(hook: TextHook) -> TextHook:
        def run(texts: list[str]) -> list:
            for n in range(tries):
                try:
                    return hook(texts)
                except Exception:
                    if n + 1 == tries:
                        raise
            return []

        return run

    every = None
    for name, hook in extractors.items():
        one = over(chunks.select("chunk_id", "text"), patient(hook), f"array<{kind}>").select("chunk_id", F.lit(name).alias("name"), "out", "error")
        every = one if every is None else every.unionByName(one)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("name", "out")))), lambda x: x["out"])
    return every.groupBy("chunk_id").agg(F.flatten(parts).alias("found"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("name")))).alias("failed"))


def coreferent(clusters: DataFrame, resolvers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """clusters after each resolver, which may merge some of them but has to keep their columns; none: as they are."""
    for resolve in resolvers:
        after = resolve(clusters)
        if after.columns != clusters.columns:
            raise ValueError(f"a resolver gives {after.columns} for {clusters.columns}")
        clusters = after
    return clusters


# an index on disk


def rebuild_index(tables: store.Store, name: str, vectors: DataFrame) -> float:
    """Writes vectors (id, vector) as packed blocks, a new version of the index; seconds taken. Readers of the version before
    go on with it."""
    began = time.monotonic()
    tables.put(name, blocks.packed(vectors.select("id", "vector"), blocks.pack_vectors("id"), blocks.ROWS))
    return time.monotonic() - began


def warm_index(tables: store.Store, names: Sequence[str]) -> dict[str, float]:
    """Reads indexes into the executors' memory; seconds taken by each."""
    took = {}
    for name in names:
        began = time.monotonic()
        tables.get(name).cache().count()
        took[name] = time.monotonic() - began
    return took


def indexed_leg(tables: store.Store, name: str, queries: DataFrame, k: int = retrieval.POOL, digits: int = 6, id_type: str = "bigint") -> DataFrame:
    """dense_leg() over a written index: queries (query_id, vector)."""
    asked = blocks.packed(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), blocks.pack_vectors("query_id"), blocks.QUERIES)
    found = blocks.met(tables.get(name), asked, blocks.cosines(k, digits), f"query_id bigint, id {id_type}, score double")
    return retrieval.ranked(found.withColumn("score", F.round("score", digits)), k)
