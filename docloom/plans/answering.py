"""What is read from models' texts, over texts built from the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docloom.functions import places, text
from docloom.operators import answers, resolution
from docloom.plans import Catalogue
from docloom.plans.hooks import HashEmbedder, overlap_score, over, reduced, rerank
from docloom.sources import html_text

C = Catalogue()


@C.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'abstained' WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'answered' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'The documents do not answer this.' ELSE 'Order ' || o_orderkey || ' is due.' END AS answer, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n FROM orders")
def answer_finalise(t):
    o = t("orders")
    cid = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(":0:0123abcd"))
    body = F.concat(F.lit("<answer>Order "), F.col("o_orderkey").cast("string"), F.lit(" ["), cid, F.lit("], [auto-tag: DUE] is due.</answer><citations>"), cid, F.lit(" made:1:up</citations>"), F.when(F.col("o_orderkey") % 3 == 0, "<support>partial</support>").otherwise("<support>full</support>"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "<abstain/>").otherwise(body)
    a = answers.finalize(answers.parse_answer(raw), F.array(cid))
    return o.select(F.col("o_orderkey").alias("id"), a.alias("a")).select("id", "a.kind", F.regexp_replace("a.answer", r"\s*,\s*is", " is").alias("answer"), F.size("a.citations").alias("n"))


@C.add("SELECT l_orderkey AS id, count(*) AS n, 'needs_review' AS verdict FROM lineitem GROUP BY 1")
def finding_assembly(t):
    x = t("lineitem")
    pairs = x.select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").cast("string").alias("rule_id"), F.lit("un clear").alias("raw_verdict"), F.lit("r").alias("rationale"), F.lit(7.0).alias("raw_confidence"), F.lit("").alias("fact_locator"), F.lit("doc").alias("fact_source"), F.lit("text").alias("fact_text"), F.lit("policy").alias("rule_citation"), F.lit("rule").alias("rule_text"))
    f = answers.findings(pairs).where("confidence = 1.0")
    return f.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("n"), F.max("verdict").alias("verdict"))


@C.add("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'new_york' WHEN 1 THEN 'england' WHEN 2 THEN NULL WHEN 3 THEN 'delaware' ELSE NULL END AS place FROM customer")
def jurisdictions(t):
    c = t("customer")
    forms = F.array(*(F.lit(x) for x in ("the State of New York, U.S.A.", "the England and Wales", "Illinois or New York", "Delaware courts and the United States of America", "the applicable law")))
    return c.select(F.col("c_custkey").alias("id"), places.jurisdiction(F.get(forms, (F.col("c_custkey") % 5).cast("int"))).alias("place"))


@C.add("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'continue' WHEN 2 THEN 'start' ELSE 'uncertain' END AS verdict FROM part")
def provision_starts(t):
    forms = F.array(F.lit("Section 8. Term"), F.lit("10.5.1. the item is long and it ends here with a point, which is why it is in the body of its provision."), F.lit("Governing Law"), F.lit("IV) Roman: heading"))
    return t("part").select(F.col("p_partkey").alias("id"), answers.provision_verdict(F.get(forms, (F.col("p_partkey") % 4).cast("int"))).alias("verdict"))


@C.add("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'cap:medium' ELSE '' END AS kept, CASE WHEN c_custkey % 3 = 0 THEN 'rent' ELSE '' END AS others FROM customer")
def tag_scores(t):
    c = t("customer")
    body = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Liability Cap:Medium, cap:low").otherwise("cap"), F.when(F.col("c_custkey") % 3 == 0, "\nOTHER:high:rent").otherwise(""))
    s = answers.tag_scores(body)
    vocabulary = {"cap": "cap", "liability cap": "cap"}
    kept = F.array_join(F.transform(answers.kept_scores(s, vocabulary), lambda x: F.concat_ws(":", x["label"], x["confidence"])), ",")
    return c.select(F.col("c_custkey").alias("id"), kept.alias("kept"), F.array_join(answers.unknown_labels(s, vocabulary), ",").alias("others"))


@C.add("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN true ELSE false END AS nothing FROM events")
def empty_results(t):
    forms = F.array(F.lit('{"resolved": false, "rows": [1]}'), F.lit('{"a_count": 0, "b_count": 0, "name": "x"}'), F.lit('{"rows": [1], "other": []}'), F.lit('{"name": "x"}'))
    return t("events").select("event_id", answers.answered_nothing(F.get(forms, (F.col("event_id") % 4).cast("int"))).alias("nothing"))


@C.add("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'price_and_terms' WHEN 1 THEN 'geographic' ELSE 'OTHER' END AS label FROM part")
def enum_labels(t):
    forms = F.array(F.lit("Price and Terms"), F.lit("limits of a geographic kind"), F.lit("unheard of"))
    return t("part").select(F.col("p_partkey").alias("id"), answers.matched_label(F.get(forms, (F.col("p_partkey") % 3).cast("int")), ["price_and_terms", "geographic", "activity"], keyword=True).alias("label"))


@C.add("SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags, arg_min(l_linestatus, (l_linenumber, l_linestatus)) AS first FROM lineitem GROUP BY 1")
def sample_combination(t):
    x = t("lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sample")).agg(F.collect_set("l_returnflag").alias("flags"), F.min("l_linestatus").alias("first"))
    return answers.combined(x, ("flags",), ("first",)).select("id", F.array_join(F.array_sort("flags"), "").alias("flags"), "first").where("first is not null")


@C.add("SELECT s_suppkey AS id, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier")
def registry_ids(t):
    return t("supplier").select(F.col("s_suppkey").alias("id"), text.cik(F.concat(F.lit("CIK"), F.col("s_suppkey").cast("string"))).alias("cik"))


@C.add("SELECT doc_id, count(*) AS n FROM (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))) GROUP BY 1")
def keyword_prefilter(t):
    k = t("benchmark").select(F.col("item_id").alias("label"), F.col("text").alias("keyword"))
    return answers.keyword_labels(t("documents").select("doc_id", "text"), k, "doc_id").select("doc_id", F.size("labels").cast("long").alias("n"))


@C.add("SELECT b.item_id AS snippet_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) GROUP BY 1")
def snippet_units(t):
    units = t("documents").select(F.lit("all").alias("document"), F.col("doc_id").alias("unit"), "text")
    snippets = t("benchmark").select(F.lit("all").alias("document"), F.col("item_id").alias("snippet_id"), F.col("text").alias("snippet"))
    return answers.unique_snippet(units, snippets).where("n > 0").select("snippet_id", "n")


@C.add("SELECT 's' || a.s_suppkey AS src_name, 's' || b.s_suppkey AS dst_name FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def affiliation_facts(t):
    s = t("supplier")
    last = s.agg(F.max("s_suppkey").alias("m"))
    f = s.crossJoin(last).select(F.lit("c").alias("chunk_id"), F.concat(F.lit("s"), "s_suppkey").alias("name"), F.when(F.col("s_suppkey") < F.col("m"), F.concat(F.lit("s"), F.col("s_suppkey") + 1)).otherwise(F.concat(F.lit("S"), "s_suppkey")).alias("affiliate"))
    return resolution.affiliations(f).select(F.col("name").alias("src_name"), F.col("affiliate").alias("dst_name"))


@C.add()
def page_text(t):
    return t("pages").select("page_id", F.length(html_text(F.col("html"))).alias("chars"))


@C.add()
def rerank_passages(t):
    p = t("documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), "text")
    return rerank(p, overlap_score("the that with and of"), 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@C.add()
def embed_documents(t):
    d = t("documents").select("doc_id", "text")
    return over(d, HashEmbedder(16), "array<double>", "dense").select("doc_id", F.size("dense").alias("n"), "error")


@C.add()
def reduce_notes(t):
    n = t("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text")
    return reduced(n, lambda texts: [hashlib.sha256(x.encode()).hexdigest() for x in texts], 3)


@C.add()
def ingest_corpus(t):
    from docloom.plans.flows import ingest

    docs = t("documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return ingest(docs, embed=HashEmbedder(16)).report()
