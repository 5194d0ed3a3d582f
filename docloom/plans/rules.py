"""Clause and compliance logic over parts, orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import clauses, compliance
from docloom.plans import Catalogue

C = Catalogue()


def day(c):
    return F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))


DAY = "date_diff('day', DATE '1992-01-01', CAST({} AS DATE))"


@C.add(f"""WITH s AS (SELECT DISTINCT l_suppkey AS document, l_orderkey || '-' || {DAY.format('l_shipdate')} AS span_id, {DAY.format('l_shipdate')} AS a, {DAY.format('l_shipdate')} + 20 AS b FROM lineitem),
p AS (SELECT s_suppkey AS document, CAST(i AS INTEGER) AS page, i * 30 AS a, i * 30 + 30 AS b, 'box' || i AS box FROM supplier, (SELECT unnest(range(90)) AS i)),
m AS (SELECT DISTINCT s.document, span_id, page, box FROM s JOIN p ON s.document = p.document AND s.a < p.b AND s.b > p.a)
SELECT s.document, s.span_id, coalesce(array_to_string(list_sort(list(page)), ','), '') AS pages, CASE WHEN count(page) = 1 THEN max(box) END AS box FROM s LEFT JOIN m USING (document, span_id) GROUP BY 1, 2""")
def page_overlap(t):
    s = t("lineitem").select(F.col("l_suppkey").alias("document"), F.concat_ws("-", F.col("l_orderkey").cast("string"), day("l_shipdate").cast("string")).alias("span_id"), day("l_shipdate").alias("start"), (day("l_shipdate") + 20).alias("end")).distinct()
    p = t("supplier").select(F.col("s_suppkey").alias("document"), F.explode(F.sequence(F.lit(0), F.lit(89))).alias("page")).select("document", "page", (F.col("page") * 30).alias("start"), (F.col("page") * 30 + 30).alias("end"), F.concat(F.lit("box"), "page").alias("box"))
    return clauses.overlapping_pages(s, p, 365).withColumn("pages", F.array_join("pages", ","))


@C.add(f"""WITH s AS (SELECT l_suppkey AS document, l_orderkey || '-' || l_linenumber AS span_id, {DAY.format('l_shipdate')} AS a, {DAY.format('l_shipdate')} + 20 AS b FROM lineitem),
l AS (SELECT s_suppkey AS document, CASE WHEN i % 3 = 0 THEN 'X' WHEN i % 3 = 1 THEN 'Y' ELSE 'Z' END AS label, i * 50 AS a, i * 50 + 15 + i % 20 AS b, i AS position FROM supplier, (SELECT unnest(range(50)) AS i)),
m AS (SELECT s.document, span_id, label, row_number() OVER (PARTITION BY s.document, span_id ORDER BY least(s.b, l.b) - greatest(s.a, l.a) DESC, position) AS n FROM s JOIN l ON s.document = l.document AND s.a < l.b AND s.b > l.a)
SELECT s.document, s.span_id, coalesce(label, 'NONE') AS label FROM s LEFT JOIN m ON m.document = s.document AND m.span_id = s.span_id AND n = 1""")
def label_max_overlap(t):
    s = t("lineitem").select(F.col("l_suppkey").alias("document"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("span_id"), day("l_shipdate").alias("start"), (day("l_shipdate") + 20).alias("end"))
    lab = t("supplier").select(F.col("s_suppkey").alias("document"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("position"))
    name = F.when(F.col("position") % 3 == 0, "X").when(F.col("position") % 3 == 1, "Y").otherwise("Z")
    lab = lab.select("document", name.alias("label"), (F.col("position") * 50).alias("start"), (F.col("position") * 50 + 15 + F.col("position") % 20).alias("end"), "position")
    return clauses.widest_label(s, lab)


COOC = """co AS (SELECT dimension, function, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS clause_id, p_brand AS dimension, l_returnflag AS function FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N') GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS nd, sum(n) OVER (PARTITION BY function) AS nf, sum(n) OVER () AS tot FROM co), dims AS (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#21']) AS dimension)"""


def cooccurrences(t):
    x = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return clauses.cooccurrence(x.select(F.col("l_orderkey").alias("clause_id"), F.col("p_brand").alias("dimension"), F.when(F.col("l_returnflag") == "N", "NONE").otherwise(F.col("l_returnflag")).alias("function")))


@C.add(f"WITH {COOC} SELECT * FROM co")
def cooccurrence(t):
    return cooccurrences(t)


def routed(score):
    def f(t):
        dims = t("part").select(F.col("p_brand").alias("dimension")).where(F.col("dimension").isin("Brand#11", "Brand#12", "Brand#21"))
        return clauses.route(cooccurrences(t), dims, k=2, score=score)

    f.__name__ = f"route_functions_{score}"
    return f


for kind, value in (("conditional", "n / CAST(nd AS DOUBLE)"), ("lift", "(n / CAST(nd AS DOUBLE)) / (nf / CAST(tot AS DOUBLE))"), ("pmi", "log2((n / CAST(nd AS DOUBLE)) / (nf / CAST(tot AS DOUBLE)))")):
    C.add(f"WITH {COOC}, s AS (SELECT function, round(sum({value}), 9) AS score FROM w WHERE dimension IN (SELECT dimension FROM dims) GROUP BY 1) SELECT function, score, row_number() OVER (ORDER BY score DESC, function) AS rank FROM s QUALIFY rank <= 2")(routed(kind))


@C.add("""WITH m AS (SELECT user_id AS unit, event_id AS member, event_id AS position, event_type = 'view' AS heading, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label, event_id % 3 AS label_order, (event_id % 17) / 16.0 AS score FROM events),
o AS (SELECT *, min(CAST(heading AS INT)) OVER (PARTITION BY unit) AS only_headings FROM m), k AS (SELECT * FROM o WHERE only_headings = 1 OR NOT heading),
t AS (SELECT unit, label, round(sum(score), 9) AS total, min(label_order) AS o FROM k GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY total DESC, o) AS n FROM t),
c AS (SELECT k.unit, k.member, row_number() OVER (PARTITION BY k.unit ORDER BY k.score DESC, k.position) AS n FROM k JOIN b ON b.unit = k.unit AND b.label = k.label AND b.n = 1)
SELECT b.unit, b.label, b.total, c.member FROM b JOIN c ON c.unit = b.unit AND c.n = 1 WHERE b.n = 1""")
def provision_vote(t):
    e = t("events")
    lab = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b").otherwise("c")
    m = e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("member"), F.col("event_id").alias("position"), (F.col("event_type") == "view").alias("heading"), lab.alias("label"), (F.col("event_id") % 3).alias("label_order"), ((F.col("event_id") % 17) / 16.0).alias("score"))
    return clauses.vote(m).withColumn("total", F.round("total", 9)).select("unit", "label", "total", "member")


RULES = "rules AS (SELECT n_nationkey AS rule_id, n_regionkey AS region, CASE WHEN n_nationkey % 3 = 0 THEN ['BUILDING', 'MACHINERY'] WHEN n_nationkey % 3 = 1 THEN [] ELSE ['AUTOMOBILE'] END AS segs FROM nation), facts AS (SELECT c_custkey AS fact_id, n_regionkey AS region, c_mktsegment AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def rules_and_facts(t):
    none = F.array().cast("array<string>")
    seg = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).when(F.col("n_nationkey") % 3 == 1, none).otherwise(F.array(F.lit("AUTOMOBILE")))
    scope = F.when(F.size(seg) > 0, F.create_map(F.lit("segment"), seg)).otherwise(F.create_map().cast("map<string,array<string>>"))
    rules = t("nation").select(F.col("n_nationkey").alias("rule_id"), F.array(F.col("n_regionkey").cast("string")).alias("types"), scope.alias("rule_scope"))
    facts = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return facts.select(F.col("c_custkey").alias("fact_id"), F.col("n_regionkey").cast("string").alias("claim_type"), F.create_map(F.lit("segment"), F.array("c_mktsegment")).alias("fact_scope")), rules


@C.add(f"WITH {RULES} SELECT fact_id, rule_id FROM facts JOIN rules ON facts.region = rules.region WHERE len(segs) = 0 OR list_contains(segs, seg)")
def applicability_pairs(t):
    facts, rules = rules_and_facts(t)
    return compliance.pairs(facts, rules, compliance.constraint_applies(F.col("rule_scope"), F.col("fact_scope"))).select("fact_id", "rule_id")


@C.add(f"WITH {RULES} SELECT fact_id, rule_id FROM facts JOIN rules ON facts.region = rules.region WHERE NOT (len(segs) = 0 OR list_contains(segs, seg))")
def gated_pairs(t):
    facts, rules = rules_and_facts(t)
    return compliance.gated(facts, rules, compliance.constraint_applies(F.col("rule_scope"), F.col("fact_scope"))).select("fact_id", "rule_id")


@C.add("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN true ELSE c_custkey % 2 = 0 END AS passes FROM customer")
def actor_gate(t):
    c = t("customer")
    subjects = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Broker"), F.lit("Dealer"))).otherwise(F.array(F.lit("Broker")))
    domains = {"automobile": "vehicles", "furniture": "homes", "broker": "finance", "dealer": "vehicles", "cabinets": "homes"}
    actor = F.when(F.col("c_mktsegment") == "FURNITURE", "Automobile").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", compliance.actor_matches(actor, subjects, {"household": "anyone"}, domains).alias("passes"))


@C.add("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'special' WHEN o_orderpriority = '5-LOW' THEN 'review' WHEN o_orderstatus = 'F' THEN 'prohibition' WHEN o_orderstatus = 'P' THEN 'permission' ELSE 'obligation' END AS route FROM orders")
def deontic_route(t):
    o = t("orders")
    kind = F.when(F.col("o_orderstatus") == "F", "PROHIBITION").when(F.col("o_orderstatus") == "P", "PERMISSION").otherwise("OBLIGATION")
    return o.select("o_orderkey", compliance.deontic_route(F.when(F.col("o_orderkey") % 11 == 0, "special"), F.when(F.col("o_orderpriority") == "5-LOW", "AMBIGUOUS"), kind).alias("route"))


FINDINGS = "f AS (SELECT l_partkey AS rule_id, l_orderkey AS fact_id, l_suppkey AS document, CASE WHEN l_quantity > 45 THEN 'violation' WHEN l_quantity > 30 THEN 'needs_review' ELSE 'compliant' END AS verdict, 'c' || l_orderkey || '-' || l_linenumber AS citation, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def findings(t):
    v = F.when(F.col("l_quantity") > 45, "violation").when(F.col("l_quantity") > 30, "needs_review").otherwise("compliant")
    return t("lineitem").select(F.col("l_partkey").alias("rule_id"), F.col("l_orderkey").alias("fact_id"), F.col("l_suppkey").alias("document"), v.alias("verdict"), F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("citation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@C.add(f"WITH {FINDINGS} SELECT rule_id, CASE max(CASE verdict WHEN 'violation' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END) WHEN 2 THEN 'violation' WHEN 1 THEN 'needs_review' ELSE 'compliant' END AS verdict, count(DISTINCT fact_id) AS facts, arg_min(citation, seq) AS citation FROM f GROUP BY 1")
def gap_matrix(t):
    return compliance.gap_matrix(findings(t))


@C.add(f"WITH {FINDINGS}, c AS (SELECT document, count(*) AS n, count(*) FILTER (WHERE verdict = 'violation') AS violations, count(*) FILTER (WHERE verdict = 'needs_review') AS reviews FROM f GROUP BY 1) SELECT *, CASE WHEN violations >= 2 THEN 'violation' WHEN violations > 0 OR reviews > 0 THEN 'needs_review' ELSE 'compliant' END AS verdict FROM c")
def report_verdict(t):
    return compliance.report(findings(t))


@C.add("SELECT rule_id, defense, score, rank FROM (SELECT a.p_partkey AS rule_id, b.p_partkey AS defense, CAST(-abs(a.p_size - b.p_size) AS INTEGER) AS score, row_number() OVER (PARTITION BY a.p_partkey ORDER BY -abs(a.p_size - b.p_size) DESC, b.p_partkey) AS rank FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE a.p_size <= 10 AND b.p_size > 10) WHERE rank <= 3")
def defense_links(t):
    p = t("part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("source"), "p_size")
    return compliance.defenses(p.where("p_size <= 10"), p.where("p_size > 10"), -F.abs(F.col("p.p_size") - F.col("d.p_size")))


@C.add("SELECT c_custkey AS clause_id, CASE WHEN contains(lower(c_name || ' works in the building trade'), CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'machine' ELSE 'zzz' END) THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def grounding(t):
    c = t("customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    a = c.select(F.col("c_custkey").alias("clause_id"), F.lit("segment").alias("dimension"), F.col("c_mktsegment").alias("value"), F.concat("c_name", F.lit(" works in the Building trade")).alias("text"), F.lit("EXTRACTED").alias("confidence"))
    cues = c.sparkSession.createDataFrame([("segment", "BUILDING", "building"), ("segment", "MACHINERY", "machine")], "dimension string, value string, cue string")
    return clauses.reground(clauses.grounded(a, cues)).select("clause_id", "confidence")


@C.add("WITH a AS (SELECT DISTINCT l_orderkey AS clause_id, 'flag' AS dimension, l_returnflag AS value FROM lineitem), n AS (SELECT clause_id, count(DISTINCT value) AS k FROM a GROUP BY 1) SELECT a.clause_id, dimension, value, CASE WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM a JOIN n ON n.clause_id = a.clause_id")
def contradiction_flags(t):
    a = t("lineitem").select(F.col("l_orderkey").alias("clause_id"), F.lit("flag").alias("dimension"), F.col("l_returnflag").alias("value")).distinct()
    return clauses.contradictions(a.withColumn("confidence", F.lit("EXTRACTED")), ("flag",))


@C.add("SELECT o_orderkey AS clause_id, len(list(l_partkey)) AS n, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS kinds FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def clause_index(t):
    x = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    props = x.select(F.col("l_orderkey").alias("clause_id"), F.lit("type").alias("dimension"), F.col("p_type").alias("value"), F.lit("EXTRACTED").alias("confidence"))
    c = t("orders").select(F.col("o_orderkey").alias("clause_id"))
    n = x.groupBy(F.col("l_orderkey").alias("clause_id")).agg(F.count("*").alias("n"))
    nested = clauses.with_properties(c, props)
    return nested.join(n, "clause_id").select("clause_id", "n", F.array_join(F.array_sort(F.transform("properties", lambda p: p["value"])), "|").alias("kinds"))


@C.add("SELECT l_orderkey AS clause_id, string_agg('line' || l_linenumber, ' ' ORDER BY l_linenumber) AS text FROM lineitem GROUP BY 1")
def clause_texts(t):
    x = t("lineitem")
    spans = x.select(F.concat_ws("#", "l_orderkey", "l_linenumber").alias("span_id"), F.concat(F.lit("line"), "l_linenumber").alias("text")).dropDuplicates(["span_id"])
    c = x.groupBy(F.col("l_orderkey").alias("clause_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ns"))
    c = c.select("clause_id", F.transform("ns", lambda i: F.concat_ws("#", F.col("clause_id").cast("string"), i.cast("string"))).alias("span_ids"))
    return clauses.texts_of(c, spans)


@C.add("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(that|the|with)($|[^\\p{L}\\p{N}_])') AS operative FROM documents")
def operative_text(t):
    d = t("documents")
    return d.select("doc_id", F.col("text").rlike(text.cue_pattern(["the", "that", "with"])).alias("operative"))
