"""Spans, typed records, graph writes, model output and evaluation inputs, over records made from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import ids, text
from docloom.functions import vectors as V
from docloom.operators import answers, clauses, compliance, evals, extraction, graph, resolution, retrieval, runs, segmenting, store
from docloom.operators.filters import Range
from docloom.plans import Catalogue, flows
from docloom.plans.rules import RULES, rules_and_facts
from docloom.sources import connectors

C = Catalogue()


def words(*parts) -> Column:
    """The parts, columns or plain text in '...', as one string."""
    return F.concat(*(F.lit(p[1:-1]) if isinstance(p, str) and p.startswith("'") else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# spans and texts


@C.add("SELECT 'b' || item_id AS chunk_id, item_id AS position, length(text) AS size FROM benchmark")
def span_texts(t):
    b = t("benchmark").select(words("'b'", "item_id").alias("chunk_id"), F.col("item_id").alias("position"), "text")
    return extraction.read_texts(b.select("chunk_id", "position"), b.select("chunk_id", "text")).select("chunk_id", "position", long(F.length("text")).alias("size"))


@C.add("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 200 AND l_linenumber <= 3")
def span_positions(t):
    return store.read(t("lineitem"), {"l_linenumber": Range(le=3)}, fields=["l_orderkey", "l_linenumber", "l_suppkey"], key_range=("l_orderkey", 100, 200))


@C.add("SELECT 'b' || item_id || ':0:' || sha256(text) AS chunk_id FROM benchmark WHERE item_id % 3 <> 0")
def verified_chunk_texts(t):
    """Every third id has the hash of another text."""
    b = t("benchmark").select("text", words("'b'", "item_id", "':0:'", F.sha2(F.when(F.col("item_id") % 3 == 0, "other").otherwise(F.col("text")), 256)).alias("chunk_id"))
    return extraction.verified_texts(b)[0].select("chunk_id")


@C.add("""WITH l AS (SELECT *, ' ' || l_orderkey || '-' || l_linenumber AS s FROM lineitem), i AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS span_id FROM lineitem WHERE l_linenumber <> 2)
SELECT span_id FROM i WHERE span_id NOT IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_quantity > 25)""")
def uncovered_lines(t):
    x = t("lineitem").withColumn("span_id", words("l_orderkey", "'-'", "l_linenumber"))
    spans = x.select("span_id", F.when(F.col("l_linenumber") == 2, " ").otherwise("words").alias("text")).distinct()
    return clauses.uncovered_spans(spans, x.where("l_quantity > 25").select("span_id")).select("span_id")


@C.add("SELECT n_regionkey AS document, n_nationkey AS item, n_nationkey AS chunk, 2 AS start, CAST(2 + length(n_name) AS INTEGER) AS \"end\" FROM nation")
def layout_alignment(t):
    n = t("nation").withColumn("name", words("'['", "n_name", "']'"))
    chunks = n.select(F.col("n_regionkey").alias("document"), long("n_nationkey").alias("chunk"), words("'x '", "name", "' y'").alias("text"))
    items = n.select(F.col("n_regionkey").alias("document"), long("n_nationkey").alias("item"), F.col("name").alias("text"))
    return answers.aligned(chunks, items).withColumn("end", F.col("end") - 2).withColumn("item", F.col("item").cast("int")).withColumn("chunk", F.col("chunk").cast("int"))


@C.add("SELECT n_regionkey AS document, n_nationkey AS fact_id, 's' || n_nationkey AS section, n_nationkey AS item FROM nation")
def fact_locations(t):
    n = t("nation").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("pos"), words("'s'", "n_nationkey").alias("section"), words("'  about '", "n_name", "'  and more'").alias("text"), "n_name")
    facts = n.select("document", F.col("pos").alias("fact_id"), words("n_name", "' and'").alias("text"))
    return answers.located(facts, n.drop("n_name")).select("document", "fact_id", "section", "item")


@C.add("SELECT l_suppkey AS sheet, l_linenumber AS r, l_partkey % 10 AS c, CASE WHEN l_partkey % 10 < 5 THEN 1 ELSE 2 END AS table_id FROM lineitem WHERE (l_partkey % 10 < 5 AND l_linenumber < 4) OR (l_partkey % 10 >= 5 AND l_linenumber >= 2)")
def cells_in_tables(t):
    cells = t("lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 10).alias("c"))
    two = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("table_id", "l", "rr", "t", "b"), x, strict=True))) for x in ((1, 0, 5, 0, 4), (2, 5, 10, 2, 800))))
    return clauses.cell_in_table(cells, t("supplier").select(F.col("s_suppkey").alias("sheet"), F.inline(two)))


@C.add("""WITH r AS (SELECT user_id AS document, event_id, event_type AS line, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS m FROM events)
SELECT a.document, a.event_id AS row_id, 's' || b.event_id AS span_id FROM r a JOIN r b ON a.document = b.document AND a.line = b.line AND a.n = b.m""")
def nth_occurrences(t):
    """The n-th row of a text to the n-th span with it, the spans being in reverse."""
    e = t("events").select(F.col("user_id").alias("document"), F.col("event_type").alias("line"), "event_id")
    return clauses.same_occurrence(e.select("document", "line", F.col("event_id").alias("row_id"), F.col("event_id").alias("position")), e.select("document", "line", words("'s'", "event_id").alias("span_id"), (-F.col("event_id")).alias("position")))


@C.add("""WITH i AS (SELECT user_id AS doc_id, event_id AS pos, event_type AS kind, CASE WHEN event_type = 'view' THEN 'h' || event_id END AS head FROM events),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS section, count(head) OVER w AS run FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, pos, section, CASE WHEN head IS NULL THEN row_number() OVER (PARTITION BY doc_id, run, kind ORDER BY pos) END AS ordinal FROM s""")
def heading_numbers(t):
    e = t("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "heading").otherwise(F.col("event_type")).alias("kind"), words("'h'", "event_id").alias("text"))
    return extraction.heading_ordinals(e).select("doc_id", "pos", "section", long("ordinal").alias("ordinal"))


# nodes and edges


@C.add("""SELECT l_orderkey AS src, l_partkey AS dst, 'old' AS kind FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT DISTINCT l_orderkey, l_partkey, 'new' FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_linenumber = 1 AND y.l_orderkey = x.l_orderkey AND y.l_partkey = x.l_partkey)""")
def affiliation_backfill(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    batch = x.withColumn("kind", F.lit("new")).withColumn("seq", F.col("l_linenumber")).drop("l_linenumber")
    return store.insert_missing(x.where("l_linenumber = 1").select("src", "dst", F.lit("old").alias("kind")), batch, ["src", "dst"], "seq")


RESOLVED = """resolved AS (SELECT 's' || s_suppkey AS key, CASE WHEN s_acctbal > 0 THEN 'E' || (s_suppkey % 30) END AS entity_id, s_name AS name FROM supplier),
rel AS (SELECT DISTINCT l_suppkey, l_partkey % 20 AS p FROM lineitem)"""


def resolved(t):
    r = t("supplier").select(words("'s'", "s_suppkey").alias("key"), F.lit("ORG").alias("entity_type"), F.when(F.col("s_acctbal") > 0, words("'E'", F.col("s_suppkey") % 30)).alias("entity_id"), F.col("s_name").alias("representative"))
    rel = t("lineitem").select("l_suppkey", (F.col("l_partkey") % 20).alias("p")).distinct().join(r.select(F.col("key").alias("src_key"), F.col("entity_id").alias("src_id"), F.col("representative").alias("src_name")), words("'s'", "l_suppkey") == F.col("src_key"))
    return r, rel.select("src_name", "src_key", "src_id", words("'part '", "p").alias("dst_name"), words("'p'", "p").alias("dst_key"), F.lit(None).cast("string").alias("dst_id"), F.lit("SUPPLIES").alias("relationship_type"))


@C.add(f"""WITH {RESOLVED}, every AS (SELECT coalesce(entity_id, 'UNLINKED:' || key) AS node, name, 'ORG' AS entity_type, key FROM resolved UNION ALL SELECT DISTINCT 'UNLINKED:p' || p, 'part ' || p, NULL, 'p' || p FROM rel)
SELECT node, name, entity_type FROM every QUALIFY row_number() OVER (PARTITION BY node ORDER BY key DESC) = 1""")
def resolution_nodes(t):
    return resolution.to_graph(*resolved(t))[0]


@C.add(f"WITH {RESOLVED} SELECT coalesce(entity_id, 'UNLINKED:' || key) AS src, 'UNLINKED:p' || p AS dst, 'SUPPLIES' AS relationship_type FROM rel JOIN resolved ON key = 's' || l_suppkey")
def resolution_edges(t):
    return resolution.to_graph(*resolved(t))[1]


def flags(t):
    a = t("lineitem").select(F.col("l_orderkey").cast("string").alias("clause_id"), F.lit("flag").alias("dimension"), F.col("l_returnflag").alias("value"), F.lit("EXTRACTED").alias("confidence")).distinct()
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("clause_id"))
    return o, a, t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("clause_id"))


@C.add("SELECT 'Clause' AS type, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT DISTINCT 'PropertyValue', 'flag:' || l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 <> 0")
def clause_nodes(t):
    return extraction.clause_graph(*flags(t))[0]


@C.add("SELECT DISTINCT 'HAS_FLAG' AS edge_type, CAST(l_orderkey AS VARCHAR) AS src, 'flag:' || l_returnflag AS dst, 'EXTRACTED' AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 <> 0")
def clause_edges(t):
    return extraction.clause_graph(*flags(t))[1].drop("span_id")


@C.add("SELECT count(*) AS seen, count(*) FILTER (WHERE n_regionkey = 1 OR n_nationkey % 5 = 2) AS canonicalized FROM nation")
def canonical_patch(t):
    n = t("nation").withColumn("canonical_value", F.when(F.col("n_nationkey") % 5 == 2, "kept"))
    return extraction.patched(n, F.when(F.col("n_regionkey") == 1, F.lower("n_name")))[1]


@C.add("WITH l AS (SELECT *, l_orderkey || '-' || l_linenumber AS span_id FROM lineitem) SELECT span_id, l_partkey AS dst, CASE WHEN span_id IN (SELECT span_id FROM l WHERE l_returnflag = 'R') THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM l")
def ambiguous_marks(t):
    x = t("lineitem").withColumn("span_id", words("l_orderkey", "'-'", "l_linenumber"))
    return extraction.marked_ambiguous(x.select("span_id", F.col("l_partkey").alias("dst"), F.lit("EXTRACTED").alias("confidence")), x.where("l_returnflag = 'R'"))


@C.add("""WITH s AS (SELECT DISTINCT 'order' || l_orderkey AS document, l_linenumber AS row FROM lineitem)
SELECT 'AttachedTo' AS edge_type, 'part' || p_partkey AS src, document || '#' || row AS dst, 'INFERRED' AS confidence, 'content' AS basis FROM part JOIN s ON document = 'order' || (p_partkey % 100) AND row = p_size""")
def embedded_links(t):
    spans = t("lineitem").select(words("'order'", "l_orderkey").alias("document"), F.col("l_linenumber").alias("row")).distinct().withColumn("span_id", words("document", "'#'", "row"))
    children = t("part").select(words("'part'", "p_partkey").alias("child"), words("'order'", F.col("p_partkey") % 100).alias("parent"), F.col("p_size").alias("row"), F.lit("INFERRED").alias("confidence"), F.lit("content").alias("basis"))
    return extraction.child_links(children, spans)[0]


@C.add("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, true AS note_is_null FROM customer")
def migrated_fields(t):
    """Old names moved to new ones, of which one is there already, and a declared field that was missing."""
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("old_segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return store.declare(store.rename_fields(c, {"c_name": "name", "old_segment": "segment"}), {"note": "string"})[0].withColumn("note_is_null", F.col("note").isNull()).drop("note")


@C.add("SELECT 0 AS nodes, 0 AS edges")
def kg_clear(t):
    e = t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes, edges = store.delete(t("orders").select("o_orderkey"), "o_orderkey", e)
    return nodes.agg(F.count("*").cast("int").alias("nodes")).crossJoin(edges.join(t("orders"), F.col("src") == F.col("o_orderkey"), "left_semi").agg(F.count("*").cast("int").alias("edges")))


@C.add("SELECT n_nationkey AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS force, n_name AS text FROM nation UNION ALL SELECT 100 + r_regionkey, 'new', NULL FROM region")
def requirement_upsert(t):
    current = t("nation").select(F.col("n_nationkey").alias("rule_id"), F.lit("old").alias("force"), F.col("n_name").alias("text"))
    batch = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("rule_id")).union(t("region").select(F.col("r_regionkey") + 100)).select("rule_id", F.lit("new").alias("force"), F.lit(1).alias("seq"))
    return store.upsert(current, batch, ["rule_id"], "seq")


@C.add("SELECT c_custkey, lower(c_mktsegment) AS name_key FROM customer WHERE c_mktsegment = 'BUILDING'")
def entities_named(t):
    return graph.entities_by_name(t("customer").select("c_custkey", F.lower("c_mktsegment").alias("name_key")), "building")


# clauses


@C.add("SELECT o_orderkey AS clause_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def clauses_having(t):
    c = t("orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_orderstatus").alias("function"))
    return clauses.having_property(c, flags(t)[1].withColumn("clause_id", long("clause_id")), "flag", "R", "F").select("clause_id")


@C.add("SELECT l_orderkey AS clause_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS sure FROM lineitem GROUP BY 1")
def grounded_properties(t):
    p = F.struct(F.col("l_returnflag").alias("value"), F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").otherwise("EXTRACTED").alias("confidence"))
    nested = t("lineitem").groupBy(F.col("l_orderkey").alias("clause_id")).agg(F.collect_list(p).alias("properties"))
    return nested.select("clause_id", long(F.size(clauses.grounded_only(F.col("properties")))).alias("sure"))


@C.add("""WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT o_orderkey AS ex, o_orderkey + 2 AS cap, 1 AS p FROM e UNION ALL SELECT o_orderkey, o_orderkey + 1, 2 FROM e WHERE o_orderkey % 2 = 0)
SELECT o_orderkey AS clause_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 2 END AS carve_out_of FROM orders WHERE o_orderstatus = 'O' OR o_orderkey % 5 = 0""")
def carve_outs(t):
    o = t("orders").select(F.col("o_orderkey").alias("clause_id"), "o_orderstatus")
    e = o.where("clause_id % 5 = 0").select("clause_id")
    links = e.select(F.col("clause_id").alias("exception"), (F.col("clause_id") + 2).alias("cap"), F.lit(1).alias("cap_position"))
    more = e.where("clause_id % 2 = 0").select("clause_id", F.col("clause_id") + 1, F.lit(2))
    return clauses.attach_exceptions(o.where("o_orderstatus = 'O'").select("clause_id"), links.union(more), e)


@C.add("SELECT l_orderkey AS clause_id, CASE max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM lineitem GROUP BY 1")
def worst_certainties(t):
    c = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("AMBIGUOUS")
    return clauses.worst_certainty(t("lineitem").select(F.col("l_orderkey").alias("clause_id"), c.alias("confidence")))


@C.add("SELECT l_suppkey AS subject, array_to_string(list_sort(list_concat(list_distinct(list('flag=' || l_returnflag)), list_distinct(list('status=' || l_linestatus)))), ',') AS scope FROM lineitem GROUP BY 1")
def subject_scopes(t):
    c = lambda d, v: F.struct(F.lit(d).alias("dimension"), F.col(v).alias("value"))
    got = compliance.subject_scope(t("lineitem").select(F.col("l_suppkey").alias("subject"), F.array(c("flag", "l_returnflag"), c("status", "l_linestatus")).alias("constraints")))
    return got.select("subject", F.array_join(F.transform("scope", lambda x: F.concat(x["dimension"], F.lit("="), x["value"])), ",").alias("scope"))


@C.add("SELECT n_regionkey AS document, n_nationkey AS fact_id, (SELECT string_agg('d' || x.n_nationkey % 3, ',' ORDER BY x.n_nationkey % 3) FROM (SELECT DISTINCT ON (n_regionkey, n_nationkey % 3) * FROM nation) x WHERE x.n_regionkey = n.n_regionkey) AS disclosures FROM nation n")
def document_disclosures(t):
    n = t("nation").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("fact_id"), F.array(words("'d'", F.col("n_nationkey") % 3)).alias("disclosures"))
    return compliance.with_document_disclosures(n).withColumn("disclosures", F.array_join("disclosures", ","))


@C.add("SELECT 'N' || n_nationkey AS name, 'n' || n_nationkey AS rule_id, CASE n_nationkey % 3 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' ELSE 'OBLIGATION' END AS deontic, CASE WHEN n_nationkey % 3 = 2 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence, CASE WHEN n_nationkey % 2 = 0 THEN 'bank' ELSE 'any' END AS actor, 'region=' || n_regionkey AS scope FROM nation WHERE n_nationkey % 7 <> 0")
def requirement_rules(t):
    n = t("nation")
    force = F.when(F.col("n_nationkey") % 3 == 0, "obligation").when(F.col("n_nationkey") % 3 == 1, " Prohibition ").otherwise("maybe")
    raw = n.select(words("'n'", "n_nationkey").alias("source"), F.lit("1").alias("section"), F.when(F.col("n_nationkey") % 7 == 0, " ").otherwise(words("'N'", "n_nationkey")).alias("text"), force.alias("force"), F.array(words("'region: '", "n_regionkey"), F.lit("no value")).alias("scope"), F.when(F.col("n_nationkey") % 2 == 0, "bank").otherwise("").alias("actor"))
    got = compliance.requirements(raw)
    return got.select(F.col("text").alias("name"), F.substring_index("rule_id", ":", 1).alias("rule_id"), "deontic", "confidence", "actor", F.array_join(F.transform("scope", lambda s: F.concat(s["dimension"], F.lit("="), s["value"])), ",").alias("scope"))


@C.add(f"WITH {RULES} SELECT fact_id, rule_id, CASE WHEN rule_id % 2 = 0 THEN 'violation' WHEN rule_id % 3 = 0 THEN 'needs_review' ELSE 'compliant' END AS verdict FROM facts JOIN rules ON facts.region = rules.region WHERE len(segs) = 0 OR list_contains(segs, seg)")
def compliance_findings(t):
    """The whole check, with a judge that reads the rule's number."""

    def judge(texts):
        n = [int(x.rsplit(" ", 1)[1]) for x in texts]
        return ["Violation" if i % 2 == 0 else "no idea" if i % 3 == 0 else "compliant" for i in n]

    facts, rules = rules_and_facts(t)
    facts = facts.withColumn("document", F.lit("d")).withColumn("text", words("'fact '", "fact_id"))
    rules = rules.withColumn("rule_text", words("'rule '", "rule_id")).withColumn("citation", words("'c'", "rule_id"))
    return flows.compliance_check(facts, rules, judge)[0].select("fact_id", "rule_id", "verdict")


# values and records


@C.add("""SELECT c_custkey AS id, 'money' AS kind, '$' || c_custkey AS value FROM customer WHERE c_custkey > 9 UNION ALL SELECT c_custkey, 'bare_number', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey > 99 AND c_custkey NOT BETWEEN 1900 AND 2099
UNION ALL SELECT c_custkey, 'duration', (c_custkey % 90 + 2) || ' days' FROM customer WHERE c_custkey > 9""")
def stated_values(t):
    c = t("customer").where("c_custkey > 9").select(F.col("c_custkey").alias("id"), words("'Fee of  $'", "c_custkey", "', due within '", F.col("c_custkey") % 90 + 2, "' days.'").alias("text"))
    return extraction.values(c).select("id", "kind", "value")


@C.add("SELECT s_suppkey AS id, s_name || ' Inc.' AS name FROM supplier")
def party_lists(t):
    listed = words("'[\"'", "s_name", "' Inc.\", \"Seller\", \"'", F.upper("s_name"), "' INC.\", \"a person\"]'")
    return extraction.parties(t("supplier").select(F.col("s_suppkey").alias("id"), listed.alias("text"))).select("id", "name")


@C.add("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 2 <> 0 THEN 'missing size' END AS error FROM part")
def tagged_records(t):
    body = words("'so: <name> '", "p_name", "' </name>'", F.when(F.col("p_size") % 2 == 0, words("'<SIZE>'", "p_size", "'</SIZE><size> </size>'")).otherwise(""))
    got = extraction.tagged_fields(t("part").select(F.col("p_partkey").alias("id"), body.alias("text")), ["name", "size"], strict=True)
    return got.select("id", F.get("name", F.lit(0)).alias("name"), F.get("size", F.lit(0)).alias("size"), "error")


@C.add("SELECT p_partkey AS id, CAST(i AS INTEGER) AS n, 'c' || i AS chunk_id, p_name AS extract FROM part, (SELECT unnest([0, 1]) AS i)")
def slice_outputs(t):
    row = lambda i: words(f"'{{\"chunk_id\": \"c{i}\", \"extract\": \"'", "p_name", "'\"}'")
    body = words("'note [1] and ['", row(9), "'] or ['", row(0), "', '", row(1), "'] end'")
    return answers.slice_extracts(t("part").select(F.col("p_partkey").alias("id"), body.alias("text")))


@C.add("""SELECT o_orderkey AS clause_id, 'level' AS dimension, o_orderpriority AS value, 'EXTRACTED' AS confidence FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, 'kinds', o_orderstatus, 'EXTRACTED' FROM orders UNION ALL SELECT o_orderkey, 'open', o_orderstatus, CASE WHEN o_orderstatus IN ('O', 'F') THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END FROM orders""")
def typed_assertions(t):
    o = t("orders").select(F.col("o_orderkey").alias("clause_id"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(F.col("o_orderpriority")).alias("level"), F.array(F.col("o_orderstatus"), F.lit(" ")).alias("kinds"), F.array("o_orderstatus").alias("open"))
    return extraction.assertions(o, ["level"], ["kinds"], {"open": ["O", "F"]})


@C.add("SELECT a.clause_id, a.dimension FROM (SELECT DISTINCT l_orderkey AS clause_id, 'd' || l_linenumber AS dimension FROM lineitem) a WHERE a.clause_id % 4 = 0 OR a.dimension IN ('d1', 'd' || (2 + a.clause_id % 3))")
def scoped_dimensions(t):
    a = t("lineitem").select(F.col("l_orderkey").alias("clause_id"), words("'d'", "l_linenumber").alias("dimension")).distinct()
    functions = a.select("clause_id").distinct().where("clause_id % 4 != 0").select("clause_id", words("'f'", F.col("clause_id") % 3).alias("function"))
    dims = t("region").where("r_regionkey < 3").select(words("'f'", "r_regionkey").alias("function"), F.explode(F.array(F.lit("d1"), words("'d'", F.col("r_regionkey") + 2))).alias("dimension"))
    return extraction.scoped(a, functions, dims)


@C.add("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS number, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS flag, CASE WHEN p_size % 3 = 0 THEN '2024-01-02' ELSE '2024-01-02T03:04:05' END AS day FROM part")
def cell_texts(t):
    day = F.when(F.col("p_size") % 3 == 0, F.lit("2024-01-02 00:00:00")).otherwise("2024-01-02 03:04:05").cast("timestamp_ntz")
    return t("part").select("p_partkey", extraction.cell_text(F.col("p_size") / 2, "double").alias("number"), extraction.cell_text(F.col("p_size") > 25, "boolean").alias("flag"), extraction.cell_text(day, "timestamp_ntz").alias("day"))


@C.add("SELECT o_orderkey AS id, 'order status: ' || o_orderstatus || '; sent by: rail freight' AS said FROM orders")
def readable_records(t):
    p = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    return t("orders").select(F.col("o_orderkey").alias("id"), answers.readable_properties(F.array(p("order_status", F.col("o_orderstatus")), p("sent_by", F.lit("rail_freight")))).alias("said"))


@C.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber % 3 = 0 THEN '§ ' || l_suppkey || ' · bullet ' || l_linenumber WHEN l_linenumber % 3 = 1 THEN '§ ' || l_suppkey || ' ¶' || l_linenumber ELSE '§ ' || l_suppkey END AS place FROM lineitem")
def locators(t):
    n = F.col("l_linenumber")
    place = answers.locator(F.when(n != 1, F.col("l_suppkey").cast("string")), F.when(n % 3 == 1, n), F.when(n % 3 == 0, n))
    return t("lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


@C.add("SELECT event_id, event_type || '({\"a\":\"' || user_id || '\",\"b\":\"x\"})' AS key FROM events")
def call_keys(t):
    return t("events").select("event_id", runs.call_key(F.col("event_type"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("user_id").cast("string"))).alias("key"))


@C.add("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'violation' WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'compliant' END AS verdict FROM orders")
def verdict_labels(t):
    raw = F.when(F.col("o_orderstatus") == "F", " Violation").when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderstatus") == "P", "Needs-Review").otherwise("COMPLIANT")).otherwise(F.when(F.col("o_orderstatus") == "P", "hard to say").otherwise("compliant "))
    return t("orders").select(F.col("o_orderkey").alias("id"), text.label_verdict(raw, answers.VERDICTS, "needs_review").alias("verdict"))


@C.add("SELECT n_regionkey AS table_id, '| name | key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || '\\|x | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def markdown_tables(t):
    row = F.array(words("n_name", "'|x'"), F.col("n_nationkey").cast("string"))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"])
    g = t("nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), grid).alias("grid"))
    return g.select("table_id", segmenting.table_markdown(F.col("grid")).alias("markdown"))


@C.add("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'picture' ELSE 'other' END AS kind FROM part")
def layout_kinds(t):
    label = F.when(F.col("p_size") % 4 == 0, "Section_Header").when(F.col("p_size") % 4 == 1, "TEXT").when(F.col("p_size") % 4 == 2, "picture").otherwise("strange")
    return t("part").select("p_partkey", segmenting.layout_kind(label).alias("kind"))


@C.add("SELECT p_partkey, p_size % 3 = 0 AS heading FROM part")
def bare_headings(t):
    name = F.when(F.col("p_size") % 3 == 0, words("p_size", "'. '", F.initcap("p_name"))).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(words(F.initcap("p_name"), "': the rest'"))
    return t("part").select("p_partkey", text.is_bare_heading(name).alias("heading"))


@C.add("SELECT p_partkey, p_size % 4 <> 0 AND p_size % 4 <> 2 AND length(regexp_replace(p_name, '[^a-z]', '', 'g')) >= 6 AS extractable FROM part")
def extractable_lines(t):
    line = F.when(F.col("p_size") % 4 == 0, words("p_name", "' ..... 12'")).when(F.col("p_size") % 4 == 2, F.upper("p_name")).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", text.is_extractable(line).alias("extractable"))


@C.add("""WITH x AS (SELECT p_partkey, p_name AS a, CASE p_size % 3 WHEN 0 THEN 'The ' || upper(p_name) || '.' WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_type END AS b FROM part)
SELECT p_partkey, contains(lower(a), trim(lower(b), ' .,;:')) OR contains(trim(lower(b), ' .,;:'), lower(a)) AS lenient, trim(regexp_replace(regexp_replace(lower(b), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS squad FROM x""")
def text_keys(t):
    b = F.when(F.col("p_size") % 3 == 0, words("'The '", F.upper("p_name"), "'.'")).when(F.col("p_size") % 3 == 1, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_type"))
    return t("part").select("p_partkey", text.lenient_match(F.col("p_name"), b).alias("lenient"), text.squad_key(b).alias("squad"))


@C.add("SELECT p_partkey, 'p' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '.x' AS sort_key FROM part")
def natural_keys(t):
    return t("part").select("p_partkey", text.natural_key(words("'p'", "p_partkey", "'.x'")).alias("sort_key"))


# vectors and tags


@C.add("SELECT p_partkey, p_size || ',' || (p_size + 100) AS ids, '2.0,1.0' AS weights FROM part")
def sparse_vectors(t):
    m = F.map_from_arrays(F.array(F.col("p_size") + 100, F.col("p_size")), F.array(F.lit(1.0), F.lit(2.0)))
    s = V.sparse_pairs(m)
    return t("part").select("p_partkey", F.array_join(s["ids"].cast("array<string>"), ",").alias("ids"), F.array_join(s["weights"].cast("array<string>"), ",").alias("weights"))


@C.add("SELECT a.p_partkey, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 9) AS jaccard FROM (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part) a JOIN (SELECT p_partkey - 1 AS p_partkey, string_split(p_name, ' ') AS y FROM part) b ON a.p_partkey = b.p_partkey")
def word_overlap(t):
    a = t("part").select("p_partkey", F.split("p_name", " ").alias("x"))
    b = t("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("y"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(V.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


TAG = "CASE {} % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END"


@C.add("SELECT p_partkey, CASE greatest(p_partkey % 3, p_size % 3) WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS weakest, CASE greatest(p_partkey % 3, p_size % 3) WHEN 0 THEN 'none' WHEN 1 THEN 'inferred' ELSE 'tentative' END AS tone FROM part")
def weakest_tags(t):
    tag = lambda c: F.when(F.col(c) % 3 == 0, "EXTRACTED").when(F.col(c) % 3 == 1, "INFERRED").otherwise("AMBIGUOUS")
    return t("part").select("p_partkey", V.weakest(tag("p_partkey"), tag("p_size")).alias("weakest"), answers.hedge(F.array(F.lower(tag("p_partkey")), tag("p_size"))).alias("tone"))


@C.add("SELECT l_orderkey AS query_id, string_agg('[' || l_linenumber || '] ' || l_returnflag || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, '[' || l_linenumber || '] ' || l_returnflag || l_partkey) AS evidence FROM lineitem GROUP BY 1")
def evidence_blocks(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_linenumber").cast("string").alias("id"), words("l_returnflag", "l_partkey").alias("text"))
    return answers.evidence_block(items)


@C.add("""WITH e AS (SELECT vec_id AS span_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(len(embedding)), lambda i: CASE WHEN i < 2 THEN 1.0::DOUBLE ELSE 0.0 END)), 6) AS score FROM embeddings WHERE vec_id % 3 = 1)
SELECT span_id, score, true AS low_confidence FROM e ORDER BY score DESC, span_id LIMIT 5""")
def document_guess(t):
    e = t("embeddings").select(F.col("vec_id").alias("span_id"), words("'d'", F.col("vec_id") % 3).alias("document_id"), F.col("embedding").alias("dense"))
    return extraction.document_fallback(e, F.array(F.lit(1.0), F.lit(1.0)), "d1").select("span_id", "score", "low_confidence")


# answers, batches and hooks' results


@C.add("""WITH e AS (SELECT user_id AS query_id, event_id, event_id % 4 AS n FROM events WHERE event_id % 3 <> 0), b AS (SELECT query_id, arg_max(event_id, n * 1000000000 - event_id) AS try, count(*) AS k FROM e GROUP BY 1)
SELECT q.query_id, CASE WHEN k >= 2 THEN try END AS try FROM (SELECT DISTINCT user_id AS query_id FROM events) q LEFT JOIN b ON b.query_id = q.query_id""")
def best_answers(t):
    kind = F.when(F.col("event_id") % 3 == 0, "abstained").otherwise("answered")
    a = F.struct(F.col("event_id").alias("id"), kind.alias("kind"), F.slice(F.array(*(F.lit(x) for x in "abc")), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("citations"))
    got = answers.best_of(t("events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("try"), a.alias("answer")), least=2)
    return got.select("query_id", F.col("answer.id").alias("try"))


@C.add("SELECT p_partkey AS id, p_name || ',' || p_type AS kept FROM part")
def clean_lists(t):
    v = F.array(words("' '", "p_name", "' '"), F.lit(""), F.lit("<b>"), F.repeat(F.lit("x"), F.lit(121)), F.col("p_type"))
    return t("part").select(F.col("p_partkey").alias("id"), F.array_join(answers.clean_list(v), ",").alias("kept"))


PROBABILITIES = "p AS (SELECT event_id AS id, unnest(['a', 'b', 'c', 'd']) AS label, unnest([(event_id % 7) / 10.0::DOUBLE, (event_id % 5) / 10.0::DOUBLE, (event_id % 3) / 10.0::DOUBLE, 0.25::DOUBLE]) AS probability, unnest([0, 1, 2, 3]) AS i FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY probability DESC, i) AS rank FROM p)"


def probabilities(t):
    p = F.array(*((F.col("event_id") % m) / 10 for m in (7, 5, 3)), F.lit(0.25))
    return extraction.ranked_labels(t("events").select(F.col("event_id").alias("id"), p.alias("p")), ["a", "b", "c", "d"])


@C.add(f"WITH {PROBABILITIES} SELECT id, rank, label, probability, CASE WHEN probability >= 0.6 THEN 'high' WHEN probability >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank <= 3 AND probability >= 0.2")
def classifier_labels(t):
    return probabilities(t).withColumn("rank", long("rank"))


@C.add(f"WITH {PROBABILITIES}, f AS (SELECT id, CASE label WHEN 'a' THEN 'x' WHEN 'b' THEN 'x' WHEN 'c' THEN 'y' END AS family FROM ranked WHERE rank <= 2 AND probability >= 0.2) SELECT id, max(family) AS family FROM f GROUP BY 1 HAVING count(family) = 2 AND count(DISTINCT family) = 1")
def second_looks(t):
    return extraction.needs_confirmation(probabilities(t), {"a": "x", "b": "x", "c": "y"})


@C.add("SELECT n_regionkey AS document, n_nationkey // 5 AS pos, CASE WHEN n_nationkey // 5 < 4 THEN 's' || n_nationkey ELSE '' END AS scores FROM nation")
def batch_scores(t):
    """Two batches of two spans each; the last span of every document is in none, and one result is beyond the spans."""
    n = t("nation").select(F.col("n_regionkey").alias("document"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("pos"), "n_nationkey")
    r = n.where("pos < 4").select("document", (F.col("pos") - F.col("pos") % 2).alias("first"), (F.col("pos") % 2).alias("index"), F.array(words("'s'", "n_nationkey")).alias("scores"))
    beyond = r.where("first = 2 and index = 1").withColumn("index", F.lit(9))
    return extraction.merged_batches(r.unionByName(beyond), n.select("document", "pos")).withColumn("scores", F.array_join("scores", ","))


@C.add("SELECT DISTINCT l_orderkey AS clause_id, l_returnflag AS value, CASE WHEN l_orderkey % 3 = 0 AND l_returnflag = 'R' THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM lineitem")
def judge_gate(t):
    a = flags(t)[1]
    v = a.select("clause_id", "dimension", "value", F.when(long("clause_id") % 3 == 0, F.col("value") != "R").alias("holds"))
    return extraction.gated_by_judge(a, v, ["flag"]).select(long("clause_id").alias("clause_id"), "value", "confidence")


@C.add("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'strong' ELSE 'weak' END AS made_by FROM part")
def escalated_records(t):
    p = t("part").select("p_partkey", "p_size", F.lit("weak").alias("made_by"))
    return extraction.escalated(p, F.col("p_size") > 40, lambda d: d.withColumn("made_by", F.lit("strong"))).select("p_partkey", "made_by")


@C.add("SELECT DISTINCT o_custkey AS anchor, arg_min(o_orderkey, o_orderkey) AS detail FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def settled_failures(t):
    rejected = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("detail"), F.col("o_orderkey").alias("position"))
    return extraction.settled(t("customer").select(F.col("c_custkey").alias("anchor")), rejected)[1]


@C.add("SELECT c_custkey AS anchor FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def settled_records(t):
    rejected = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("detail"), F.col("o_orderkey").alias("position"))
    return extraction.settled(t("customer").select(F.col("c_custkey").alias("anchor")), rejected)[0]


@C.add("SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 'chunk:empty,' ELSE '' END) || (CASE WHEN doc_id % 7 = 0 THEN 'tag:late' ELSE '' END) AS failures FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def document_failures(t):
    d = t("documents").select("doc_id")
    got = extraction.failures_by_document(tag=d.where("doc_id % 7 = 0").withColumn("detail", F.lit("late")), chunk=d.where("doc_id % 5 = 0").withColumn("detail", F.lit("empty")))
    parts = F.transform("failures", lambda f: F.concat(f["kind"], F.lit(":"), f["detail"], F.when(f["kind"] == "chunk", ",").otherwise("")))
    return got.select("doc_id", F.array_join(parts, "").alias("failures"))


@C.add("SELECT coalesce(a.n_name, b.n_name) AS name, CASE WHEN a.n_name IS NULL THEN 'extra' WHEN b.n_name IS NULL THEN 'missing' ELSE 'matched' END AS state FROM (SELECT n_name FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT n_name FROM nation WHERE n_regionkey > 1) b ON a.n_name = b.n_name")
def schema_states(t):
    n = t("nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return extraction.reconciled(n.where("n_regionkey < 3"), n.where("n_regionkey > 1"))


@C.add("SELECT DISTINCT 'c' || event_id % 200 AS call_id, 'n' || event_id % 200 AS need FROM events WHERE event_id % 2 = 0 AND event_id % 200 % 3 <> 0")
def blocked_needs(t):
    e = t("events").select(words("'c'", F.col("event_id") % 200).alias("call_id"), F.when(F.col("event_id") % 2 == 0, words("'{\"status\": \"blocked\", \"need\": \"n'", F.col("event_id") % 200, "'\"}'")).otherwise("no JSON").alias("body"))
    handled = t("events").where("event_id % 200 % 3 = 0").select(words("'c'", F.col("event_id") % 200).alias("call_id")).distinct()
    return extraction.new_reports(e, handled)


@C.add("SELECT o_custkey AS item_id, trim(lower(o_orderpriority), ' .') AS key, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) || '.' ELSE lower(o_orderpriority) || '  ' END, o_orderkey) AS text FROM orders GROUP BY 1, 2")
def merged_extractions(t):
    spelled = F.when(F.col("o_orderkey") % 2 == 0, words(F.upper("o_orderpriority"), "'.'")).otherwise(words(F.lower("o_orderpriority"), "'  '"))
    return evals.different(t("orders").select(F.col("o_custkey").alias("item_id"), spelled.alias("text"), F.col("o_orderkey").alias("position")), text.lenient_key(F.col("text")))


# entities


@C.add("SELECT upper(s_name) || '!' AS name, 'E' || s_suppkey AS entity_id FROM supplier")
def registry_matches(t):
    s = t("supplier")
    rows = s.select(words("'E'", "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"))
    return resolution.exact_matches(s.select(words(F.upper("s_name"), "'!'").alias("name")), rows).select("name", "entity_id")


@C.add("SELECT s_suppkey AS key, CASE WHEN s_acctbal > 0 THEN 'E' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'PRIVATE:' || s_suppkey END AS entity_id FROM supplier")
def private_identities(t):
    s = t("supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.when(F.col("s_acctbal") > 0, words("'E'", "s_suppkey")).alias("entity_id"))
    return resolution.private_ids(s, s.where("key % 2 = 0").select("key")).withColumn("key", long("key"))


@C.add("SELECT trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS surface, 'E' || s_suppkey AS entity_id FROM (SELECT s_suppkey, unnest([s_name, s_name || ', Inc.']) AS n FROM supplier WHERE s_suppkey % 3 = 0)")
def verified_surfaces(t):
    s = t("supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, words("'E'", "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, "PRIVATE").otherwise("SKIP")
    return extraction.verified_registry(s.select(kind.alias("resolution"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("representative"), F.array(words("s_name", "', Inc.'"), F.col("s_name")).alias("variants")))[0]


@C.add("SELECT s_suppkey AS id, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || ',0000000077' AS ids FROM supplier WHERE s_suppkey <> 77 UNION ALL SELECT 77, '0000000077' FROM supplier WHERE s_suppkey = 77")
def feed_ids(t):
    feed = words("'<feed><CIK> '", "s_suppkey", "' </CIK><x/><cik>77</cik><cik>'", "s_suppkey", "'</cik><cik>none</cik></feed>'")
    return extraction.listed_ids(t("supplier").select(F.col("s_suppkey").alias("id"), feed.alias("text"))).withColumn("ids", F.array_join("ids", ","))


# evaluation


@C.add("SELECT min(n) AS gate, min(n) > 100 AS passed, count(*) AS repeats FROM (SELECT user_id % 5 AS r, count(*) AS n FROM events GROUP BY 1)")
def eval_repeats(t):
    per = t("events").groupBy((F.col("user_id") % 5).alias("repeat")).agg(F.count("*").alias("gate")).withColumn("passed", F.col("gate") > 100)
    return evals.over_repeats(per, "gate")


@C.add("""WITH g AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS id, l_orderkey % 3 AS kind FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS id FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT g.item_id, kind, count(r.id) / CAST(count(*) AS DOUBLE) AS r FROM g LEFT JOIN r ON r.item_id = g.item_id AND r.id = g.id GROUP BY 1, 2) SELECT kind, count(*) AS n, round(avg(r), 9) AS recall, avg(r) >= 0.5 AS passed FROM p GROUP BY 1""")
def recall_by_kind(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") % 3).alias("kind"), "l_linenumber")
    return evals.relational(x, x.where("l_linenumber <= 3"), recall=0.5, by="kind").withColumn("recall", F.round("recall", 9))


@C.add("WITH e AS (SELECT event_type, user_id % 2 AS half FROM events) SELECT event_type, count(*) FILTER (WHERE half = 0) AS b, count(*) FILTER (WHERE half = 1) AS o FROM e GROUP BY 1")
def run_comparison(t):
    e = t("events").groupBy("event_type", (F.col("user_id") % 2).alias("half")).agg(F.count("*").alias("value"))
    return runs.compare(e.where("half = 0"), e.where("half = 1"), ("event_type",)).select("event_type", "b", "o")


# sources


@C.add("SELECT n_regionkey AS doc_id, n_nationkey AS pos, n_name AS text FROM nation UNION ALL SELECT r_regionkey, 24 - (4 - r_regionkey) + CAST(i AS INTEGER), r_name || i FROM region, (SELECT unnest([1, 2]) AS i)")
def reading_orders(t):
    """What the body lacks follows its last item, in order of its reference."""
    body = t("nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("pos"), words("'n'", "n_nationkey").alias("ref"), F.lit("text").alias("kind"), F.col("n_name").alias("text"))
    more = t("region").select(F.col("r_regionkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), "r_name").select("doc_id", words("'z'", "i").alias("ref"), words("r_name", "i").alias("text"))
    texts = body.select("doc_id", "ref", "text").union(more)
    return connectors.reading_order(body, texts).select("doc_id", "pos", "text")


@C.add("""WITH x AS (SELECT DISTINCT l_suppkey AS document, l_linenumber AS row, max(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) AS hit FROM lineitem GROUP BY 1, 2)
SELECT document, count(*) AS rows, count(*) FILTER (WHERE hit = 1) AS reached, coalesce(string_agg(CASE WHEN hit = 0 THEN row END, ',' ORDER BY row), '') AS missing FROM x GROUP BY 1 HAVING max(hit) = 1""")
def unreached_rows(t):
    x = t("lineitem").select(F.col("l_suppkey").alias("document"), F.lit("t").alias("table_id"), F.col("l_linenumber").alias("row"), "l_quantity")
    got = connectors.unreached_rows(x.select("document", "table_id", "row").distinct(), x.where("l_quantity > 48"))
    return got.select("document", "rows", "reached", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@C.add("SELECT p_partkey AS id, p_type AS kind, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS turn FROM part ORDER BY turn, kind, id LIMIT 12")
def covering_parts(t):
    return connectors.covering_subset(t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind")), 12).withColumn("turn", long("turn"))


@C.add("SELECT token, count(DISTINCT (file, row)) AS rows, count(DISTINCT file) AS files FROM (SELECT 'T' || (p_partkey % 700) AS token, p_size AS file, p_partkey AS row FROM part) GROUP BY 1 HAVING count(DISTINCT (file, row)) <= 3 AND count(DISTINCT file) <= 2")
def rare_tokens(t):
    p = t("part").select(words("'T'", F.col("p_partkey") % 700).alias("token"), F.col("p_size").alias("file"), F.col("p_partkey").alias("row"))
    return connectors.rare_identifiers(p, 3, 2)


@C.add("""SELECT p_partkey AS child, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS row, CASE p_partkey % 4 WHEN 0 THEN 'EXTRACTED' WHEN 3 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS confidence,
CASE p_partkey % 4 WHEN 0 THEN 'anchor' WHEN 1 THEN 'content' WHEN 3 THEN 'content' ELSE 'position' END AS basis FROM part UNION ALL SELECT p_partkey, 5, 'AMBIGUOUS', 'content' FROM part WHERE p_partkey % 4 = 3""")
def record_links(t):
    """0: a verified anchor beside a match; 1: one best match; 2: a lone anchor; 3: two equal matches."""
    p = t("part").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") % 4).alias("k"))
    anchors = p.where("k = 0").select("child", F.lit(1).alias("row"), F.lit(True).alias("verified")).union(p.where("k = 2").select("child", F.lit(4), F.lit(False)))
    match = lambda k, row, n: p.where(f"k = {k}").select("child", F.lit(row).alias("row"), F.lit(n).alias("shared"))
    return connectors.record_links(anchors, match(0, 2, 3).union(match(1, 2, 3)).union(match(1, 3, 1)).union(match(3, 4, 2)).union(match(3, 5, 2)))


@C.add("SELECT s_suppkey AS sheet, 2 AS table_id, 1 AS above, CASE s_suppkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'data' WHEN 2 THEN 'header' ELSE 'unsure' END AS verdict FROM supplier")
def sheet_continuations(t):
    """A second table under a first one of text and number: 0 repeats the header, 1 goes on, 2 is all text, 3 is otherwise."""
    s = t("supplier").select(F.col("s_suppkey").alias("sheet"), (F.col("s_suppkey") % 4).alias("k"))
    arr = lambda *v: F.array(*(F.lit(x) for x in v))
    one = s.select("sheet", F.lit(1).alias("table_id"), F.lit(0).alias("left"), F.lit(2).alias("right"), F.lit(0).alias("top"), F.lit(3).alias("bottom"), arr("Name", "Price").alias("header"), arr("a", "1").alias("first_row"), arr("text", "number").alias("types"), arr("text", "number").alias("first_types"))
    row = F.when(F.col("k") == 0, arr(" name", "PRICE ")).otherwise(arr("b", "2"))
    kinds = F.when(F.col("k") <= 1, arr("text", "number")).when(F.col("k") == 2, arr("text", "text")).otherwise(arr("number", "number"))
    two = s.select("sheet", F.lit(2).alias("table_id"), F.lit(0).alias("left"), F.lit(2).alias("right"), F.lit(5).alias("top"), F.lit(9).alias("bottom"), row.alias("header"), row.alias("first_row"), arr("text", "number").alias("types"), kinds.alias("first_types"))
    return connectors.continuations(one.union(two))


@C.add("SELECT 'c' || o_orderkey AS id, 'P:' || o_orderkey || ':' || left(sha256(o_orderpriority), 16) AS content_id, left(sha256(o_orderstatus || '|' || o_orderpriority), 32) AS cache_key FROM orders")
def cache_keys(t):
    return t("orders").select(words("'c'", "o_orderkey").alias("id"), ids.content_id(F.lit("P"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("content_id"), ids.cache_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("cache_key"))


@C.add("SELECT vec_id AS query_id, vec_id + i AS id, CAST(i AS DOUBLE) AS score, CAST(2 - i AS INTEGER) AS rank FROM embeddings, (SELECT unnest([0, 1]) AS i) WHERE vec_id % 50 = 0")
def sparse_weights(t):
    """Given sparse vectors: each query shares one term with its own row, of weight 0 products aside, and one with the next."""
    e = t("embeddings").select(F.col("vec_id").alias("id"))
    rows = e.union(e.agg((F.max("id") + 1).alias("id"))).select("id", F.create_map(words("'t'", "id"), F.lit(1.0)).alias("weights"))
    queries = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.create_map(words("'t'", "id"), F.lit(0.0), words("'t'", F.col("id") + 1), F.lit(1.0)).alias("weights"))
    return retrieval.sparse_leg(rows, queries, 5)
