"""Answers, judgments and tags: what is read from a model's text and what must hold of it, as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import label_verdict

#: Forms of internal marks that no reader may see, the marks of an answer's support, verdicts.
MARKS = (
    r"\[[^\[\]]+:\d+:[0-9a-fA-F]{8,}\]", r"(?i)\[auto-tag:[^\[\]]*\]", r"(?i)\[confidence:[^\[\]]*\]", r"(?i)\[Exception[^\[\]]*\]", r"\[[^\[\]]*=[^\[\]]*\]",
    r"(?i)\[(?:chunk_id|clause_id|source_doc_id|span_id|answer_kind)\]", r"(?i)<partial\s*/>", r"(?is)<support>.*?</support>",
)
VERDICTS = ("violation", "compliant", "needs_review")
INLINE_ID = r"\[([^\[\]\s]+:\d+:[0-9a-fA-F]{8,})\]"


def tag(text: Column, name: str) -> Column:
    """What stands between <name> and </name>, trimmed; null without them."""
    hit = F.regexp_extract(text, rf"(?is)<{name}>(.*?)</{name}>", 1)
    return F.when(text.rlike(rf"(?is)<{name}>.*?</{name}>"), F.btrim(F.regexp_replace(hit, r"^\s+|\s+$", "")))


def parse_answer(text: Column) -> Column:
    """struct(answer, citations, kind): the <answer> body, else the whole text without marks; cited ids of <citations>, then
    those in the body, each once; kind answered, partial or abstained (an <abstain/> without a body, no text, or support
    'none', which keeps its sentence)."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(t, MARKS[-1], ""), MARKS[-2], "")
    body = F.coalesce(tag(t, "answer"), F.when(t.rlike(r"(?i)<abstain\s*/>"), F.lit("")).otherwise(F.btrim(plain)))
    listed = F.filter(F.split(F.coalesce(tag(t, "citations"), F.lit("")), r"[\s,]+"), lambda c: c != "")
    inline = F.regexp_extract_all(body, F.lit(INLINE_ID), F.lit(1))
    support = F.lower(tag(t, "support"))
    kind = F.when((body == "") | (support == "none"), "abstained").when(F.coalesce(support == "partial", t.rlike(r"(?i)<partial\s*/>")), "partial").otherwise("answered")
    return F.struct(body.alias("answer"), F.array_distinct(F.concat(listed, inline)).alias("citations"), kind.alias("kind"))


def scrubbed(text: Column) -> Column:
    """Prose without internal marks, and without the spaces, commas and brackets that their removal leaves."""
    out = text
    for mark in MARKS:
        out = F.regexp_replace(out, mark, "")
    for pattern, by in (
        (r"\(\s*\)", ""), (r"[ \t]{2,}", " "), (r"[ \t]+([,.;:)])", "$1"), (r"(?:[ \t]*[,;])+([ \t]*[.;:)])", "$1"), (r"(?:[ \t]*[,;])+(?=[ \t]*(?:\n|$))", ""), (r"\n[ \t]+", "\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out)


def finalize(parsed: Column, evidence_ids: Column, abstention: str = "The documents do not answer this.") -> Column:
    """A parsed answer with citations of the evidence only and scrubbed prose; without either it abstains."""
    cites = F.array_intersect(parsed["citations"], evidence_ids)
    prose = scrubbed(parsed["answer"])
    none = (parsed["kind"] == "abstained") | (F.size(cites) == 0) | (prose == "")
    reason = F.when(parsed["kind"] == "abstained", F.coalesce(F.nullif(prose, F.lit("")), F.lit(abstention))).otherwise(F.lit(abstention))
    return F.struct(F.when(none, reason).otherwise(prose).alias("answer"), F.when(none, F.array().cast("array<string>")).otherwise(cites).alias("citations"), F.when(none, "abstained").otherwise(parsed["kind"]).alias("kind"))


def best_of(answers: DataFrame, by: str = "query_id", least: int = 1) -> DataFrame:
    """Of each query's tries (try, answer struct) the one with most citations that doesn't abstain, the first of equals;
    with fewer than `least` such tries it abstains (answer null)."""
    ok = answers.where(F.col("answer.kind") != "abstained")
    n = ok.groupBy(by).agg(F.count("*").alias("n"), F.max_by("answer", F.struct(F.size("answer.citations"), -F.col("try"))).alias("answer"))
    return answers.select(by).distinct().join(n.where(F.col("n") >= least), by, "left").select(by, "answer")


def hedge(confidences: Column) -> Column:
    """Which tone the least certain evidence asks for: tentative, inferred or none."""
    up = F.transform(confidences, lambda c: F.upper(c))
    return F.when(F.array_contains(up, "AMBIGUOUS"), "tentative").when(F.array_contains(up, "INFERRED"), "inferred").otherwise("none")


def evidence_block(items: DataFrame, by: str = "query_id") -> DataFrame:
    """'[id] text' of each query's evidence, by rank, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "id", F.lit("] "), "text").alias("t"))))
    return items.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("evidence"))


def readable_properties(properties: Column) -> Column:
    return F.array_join(F.transform(properties, lambda p: F.concat(F.replace(p["dimension"], F.lit("_"), F.lit(" ")), F.lit(": "), F.replace(p["value"], F.lit("_"), F.lit(" ")))), "; ")


def locator(section: Column, paragraph: Column, bullet: Column) -> Column:
    """'§ s', '§ s ¶n' or '§ s · bullet n'; empty without a section."""
    base = F.concat(F.lit("§ "), section)
    return F.coalesce(F.when(bullet.isNotNull(), F.concat(base, F.lit(" · bullet "), bullet.cast("string"))).when(paragraph.isNotNull(), F.concat(base, F.lit(" ¶"), paragraph.cast("string"))).otherwise(base), F.lit(""))


def findings(pairs: DataFrame) -> DataFrame:
    """Findings from pairs of facts and rules with a ruling (raw_verdict, rationale, raw_confidence; null if none came):
    what can't be read is a review, confidence lies in [0, 1], both citations come from the inputs."""
    none = F.col("raw_verdict").isNull()
    loc = F.when(F.coalesce("fact_locator", F.lit("")) != "", F.concat(F.lit(" "), F.col("fact_locator"))).otherwise("")
    return pairs.select(
        "fact_id", "rule_id", F.when(none, "needs_review").otherwise(label_verdict(F.col("raw_verdict"), VERDICTS, "needs_review")).alias("verdict"),
        F.when(none, "no ruling").otherwise(F.col("rationale")).alias("rationale"), F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("raw_confidence", F.lit(0.0))))).alias("confidence"),
        F.concat("fact_source", loc, F.lit(": "), "fact_text").alias("cites_fact"), F.concat("rule_citation", F.lit(" ("), "rule_id", F.lit("): "), "rule_text").alias("cites_rule"),
    )


def tag_scores(body: Column) -> Column:
    """Array of struct(label, confidence, other) from 'Label:conf' items parted by commas or line ends; OTHER:conf:label
    names what the vocabulary lacks; a label may hold colons; without a confidence it is low."""

    def one(item: Column) -> Column:
        p = F.transform(F.split(item, ":"), lambda x: F.btrim(x))
        other = F.upper(F.get(p, F.lit(0))) == "OTHER"
        name = F.when(other, "OTHER").when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ":"))
        conf = F.when(other, F.coalesce(F.get(p, F.lit(1)), F.lit("low"))).when(F.size(p) == 1, "low").otherwise(F.element_at(p, -1))
        return F.struct(name.alias("label"), F.lower(conf).alias("confidence"), F.when(other, F.coalesce(F.get(p, F.lit(2)), F.lit(""))).otherwise("").alias("other"))

    items = F.filter(F.transform(F.split(body, r"[,\n]"), lambda x: F.btrim(x)), lambda i: (i != "") & ~i.startswith(":"))
    return F.transform(items, one)


def kept_scores(scores: Column, vocabulary: dict[str, str], most: int = 3) -> Column:
    """The first `most` scores of medium or high confidence under their canonical labels; vocabulary maps lower-cased
    labels and aliases to them."""
    names = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    canon = F.transform(scores, lambda s: F.struct(F.element_at(names, F.lower(s["label"])).alias("label"), s["confidence"].alias("confidence")))
    return F.slice(F.filter(canon, lambda s: s["label"].isNotNull() & s["confidence"].isin("medium", "high")), 1, most)


def unknown_labels(scores: Column, vocabulary: dict[str, str]) -> Column:
    """Labels that the vocabulary lacks: the named one of OTHER, else the label itself."""
    names = F.array(*(F.lit(k) for k in vocabulary))
    out = F.transform(F.filter(scores, lambda s: ~F.array_contains(names, F.lower(s["label"]))), lambda s: F.when(F.upper(s["label"]) == "OTHER", s["other"]).otherwise(s["label"]))
    return F.filter(out, lambda x: (x != "") & ~F.upper(x).isin("NONE", "OTHER"))


def provision_verdict(text: Column, section_words: tuple[str, ...] = ("section", "article", "clause", "sec", "art")) -> Column:
    """start, continue or uncertain. After a section word or sign, and for a leading number, the number decides alone: two
    levels at most. Else bare headings and short lines in capitals start; short capitalised lines that aren't sentences
    are uncertain."""
    from docloom.functions.text import ENUMERATION, is_bare_heading

    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    word = rf"(?i)^(?:§\s*|(?:{'|'.join(section_words)})\.?\s+)(?=\(?\d)"
    after = F.regexp_replace(t, word, "")
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0)))
    capitals = (t != "") & ~t.rlike(r"\p{Ll}") & (words < 6)
    start = F.when(t.rlike(word), after.rlike(r"^\(?\d{1,2}(?:\.\d{1,2})?\)?[.)]?(?:\s|$)")).when(t.rlike(r"^\(?\d"), t.rlike(r"^\(?\d{1,2}(?:\.\d{1,2})?\)?\.\s")).otherwise(is_bare_heading(t) | capitals)
    maybe = (t != "") & (F.length(t) <= 90) & ~t.rlike(r"^\p{Ll}") & (t.rlike(ENUMERATION) | ~(t.rlike(r"\.\s") | t.endswith(".")))
    return F.when(start, "start").when(maybe, "uncertain").otherwise("continue")


def answered_nothing(result: Column) -> Column:
    """Whether a JSON result is empty: a resolved or found flag that is false, else all counts zero, else all its
    collections empty; a scalar field alone is an answer."""
    m = F.from_json(result, "map<string,string>")
    flag = lambda k: F.coalesce(F.element_at(m, k) == "false", F.lit(False))
    counts = F.filter(F.map_entries(m), lambda e: e["key"].endswith("_count") & e["value"].rlike(r"^-?\d+$"))
    boxes = F.filter(F.map_values(m), lambda v: v.rlike(r"^\s*[\[{]"))
    empty_boxes = F.when(F.size(boxes) > 0, F.forall(boxes, lambda v: v.rlike(r"^\s*(?:\[\s*\]|\{\s*\})\s*$"))).otherwise(F.lit(False))
    rule = F.when(flag("resolved") | flag("found"), F.lit(True)).when(F.size(counts) > 0, F.forall(counts, lambda e: e["value"] == "0")).otherwise(empty_boxes)
    blank = F.coalesce(F.btrim(result).isin("", "null", "[]", "{}", '""'), F.lit(True))
    return F.when(blank, F.lit(True)).otherwise(F.coalesce(rule, F.lit(False)))


def slice_extracts(outputs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, n, chunk_id, extract of the longest JSON array of such objects in each text; none if there is none."""
    kind = outputs.schema[id_col].dataType.simpleString()

    def longest(text: str) -> list[dict]:
        decoder, found = json.JSONDecoder(), []
        at = text.find("[")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                value = None
            if isinstance(value, list) and value and all(isinstance(x, dict) and {"chunk_id", "extract"} <= x.keys() for x in value):
                found.append(value)
            at = text.find("[", at + 1)
        return max(found, key=len, default=[])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, n, str(x["chunk_id"]), str(x["extract"])) for i, t in zip(b[id_col], b["text"], strict=True) for n, x in enumerate(longest(t or ""))]
            yield pd.DataFrame(out, columns=[id_col, "n", "chunk_id", "extract"])

    return outputs.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, n int, chunk_id string, extract string")


def combined(samples: DataFrame, lists: tuple[str, ...], scalars: tuple[str, ...], by: str = "id") -> DataFrame:
    """One record of several samples (id, sample, ...): lists are united in order, of scalars the first that says
    something (not OTHER), else the first there is."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("sample", F.col(c).alias("v"))))), lambda x: x["v"])
    informative = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.upper(F.col(c).cast("string")) != "OTHER"), F.col("sample")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("sample")))
    return samples.groupBy(by).agg(*(F.array_distinct(F.flatten(order(c))).alias(c) for c in lists), *(F.coalesce(informative(c), first(c)).alias(c) for c in scalars))


def matched_label(raw: Column, vocabulary: list[str], keyword: bool = False, default: str = "OTHER") -> Column:
    """The vocabulary's value whose letters and digits are the same; with `keyword`, else the longest of five letters or
    more that the text holds; else the default."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    options = F.array(*(F.lit(v) for v in vocabulary))
    same = F.get(F.filter(options, lambda v: bare(v) == bare(raw)), F.lit(0))
    if not keyword:
        return F.coalesce(same, F.lit(default))
    held = F.filter(options, lambda v: (F.length(bare(v)) >= 5) & F.contains(bare(raw), bare(v)))
    longest = F.element_at(F.array_sort(F.transform(held, lambda v: F.struct(F.length(bare(v)).alias("n"), v.alias("v")))), -1)["v"]
    return F.coalesce(same, F.when(F.size(held) > 0, longest), F.lit(default))


def clean_list(values: Column) -> Column:
    """Trimmed entries; empty ones, those over 120 characters and those with a tag go."""
    return F.filter(F.transform(values, lambda x: F.btrim(x)), lambda v: (v != "") & (F.length(v) <= 120) & ~F.contains(v, F.lit("<")))


def keyword_labels(texts: DataFrame, keywords: DataFrame, id_col: str = "id") -> DataFrame:
    """id, labels: those of which a keyword (label, keyword) stands in the text; texts without any are left out, so no
    model is asked about them. The keywords are the small side by Spark's own size check."""
    hit = texts.join(keywords, F.contains(F.lower("text"), F.lower("keyword")))
    return hit.groupBy(id_col).agg(F.sort_array(F.collect_set("label")).alias("labels"))


def unique_snippet(units: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippet_id with the one unit of its document whose text holds it, white space aside; null if none or several do."""
    bare = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    met = snippets.alias("s").join(units.alias("u"), (F.col("s.document") == F.col("u.document")) & F.contains(bare("u.text"), bare("s.snippet")))
    per = met.groupBy("s.snippet_id").agg(F.count("*").alias("n"), F.max("u.unit").alias("unit"))
    return snippets.select("snippet_id").join(per, "snippet_id", "left").select("snippet_id", F.when(F.col("n") == 1, F.col("unit")).alias("unit"), F.coalesce("n", F.lit(0)).alias("n"))


def aligned(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Layout items (document, item, text) placed in the chunk (document, chunk, text) that holds them, searched forward
    from the last place: document, item, chunk, start, end; items held by no chunk are left out. A fold over one document."""
    kind = chunks.schema["document"].dataType.simpleString()

    def fold(c: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        out, place, at = [], 0, 0
        c = c.sort_values("chunk").reset_index(drop=True)
        for item, text in i.sort_values("item")[["item", "text"]].itertuples(index=False):
            for p in range(place, len(c)):
                found = c["text"][p].find(text, at if p == place else 0) if text else -1
                if found >= 0:
                    place, at = p, found + len(text)
                    out.append((c["document"][p], item, c["chunk"][p], found, at))
                    break
        return pd.DataFrame(out, columns=["document", "item", "chunk", "start", "end"])

    return chunks.groupBy("document").cogroup(items.groupBy("document")).applyInPandas(fold, f"document {kind}, item long, chunk long, start int, end int")


def located(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts (document, fact_id, text) with the section and item in which their text begins, in the document's items
    (document, pos, section, text) joined by spaces; null where the text isn't found."""
    w = Window.partitionBy("document").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    norm = F.btrim(F.regexp_replace("text", r"\s+", " "))
    i = items.withColumn("norm", norm).withColumn("from", F.coalesce(F.sum(F.length("norm") + 1).over(w), F.lit(0)))
    whole = i.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ").alias("whole"))
    f = facts.withColumn("at", F.btrim(F.regexp_replace("text", r"\s+", " "))).join(whole, "document", "left").withColumn("at", F.expr("instr(whole, at) - 1")).drop("whole")
    met = f.where("at >= 0").alias("f").join(i.alias("i"), (F.col("f.document") == F.col("i.document")) & (F.col("i.from") <= F.col("f.at")) & (F.col("f.at") < F.col("i.from") + F.length("i.norm")))
    return facts.join(met.select(F.col("f.fact_id").alias("fact_id"), F.col("i.section").alias("section"), F.col("i.pos").alias("item")), "fact_id", "left")
