"""Structured reads, counts, edges and writes over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import ids, text
from docloom.operators import store
from docloom.operators.filters import NOT_NULL, Contains, Range
from docloom.plans import Catalogue

C = Catalogue()


@C.add("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_retailprice > 901 AND contains(lower(p_name), 'g') ORDER BY p_partkey")
def kg_read_range_contains(t):
    return store.read(t("part"), {"p_size": Range(ge=10, le=20), "p_retailprice": Range(gt=901), "p_name": Contains("G")}, fields=["p_partkey", "p_name", "p_size", "p_retailprice"], order_by="p_partkey")


@C.add("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7")
def kg_read_membership(t):
    return store.read(t("customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 7}, fields=["c_custkey", "c_name", "c_mktsegment"])


@C.add("SELECT l.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def kg_read_not_null(t):
    joined = t("documents").select("doc_id").join(t("labels").select(F.col("doc_id").alias("_id"), "quality"), F.col("doc_id") == F.col("_id"), "left")
    return store.read(joined, {"quality": NOT_NULL}, fields=["doc_id", "quality"])


@C.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000")
def kg_key_range(t):
    return store.read(t("orders"), fields=["o_orderkey", "o_custkey"], key_range=("o_orderkey", 1000, 2000))


@C.add("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def kg_scope_to_nothing(t):
    return store.read(t("orders"), {"o_orderstatus": []}, fields=["o_orderkey", "o_custkey"])


@C.add("SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0")
def kg_distinct(t):
    return store.read(t("customer"), {"c_acctbal": Range(gt=0.0)}, distinct="c_mktsegment")


@C.add("SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING') AND c_acctbal >= 500.0")
def kg_count_filtered(t):
    return store.count(t("customer"), {"c_mktsegment": ["BUILDING"], "c_acctbal": Range(ge=500.0)})


@C.add("SELECT 'customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def kg_counts_by_type(t):
    parts = [t(n).select(F.lit(n).alias("type")) for n in ("customer", "supplier", "nation", "part")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("type").agg(F.count("*").alias("n"))


@C.add("SELECT p_partkey, p_name FROM part WHERE p_size = 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def kg_read_ordered_limit(t):
    return store.read(t("part"), {"p_size": 5}, fields=["p_partkey", "p_name"], order_by="p_retailprice DESC, p_partkey", limit=10)


@C.add("SELECT * FROM supplier WHERE s_suppkey = 17 LIMIT 1")
def kg_point_lookup(t):
    return store.one(t("supplier"), "s_suppkey", 17)


@C.add("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE 'double' END AS type FROM (DESCRIBE SELECT * FROM customer)")
def kg_schema(t):
    df = t("customer")
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")


def order_edges(t):
    """Edges order -> customer and order -> supplier."""
    a = t("orders").select(F.lit("PLACED_BY").alias("edge_type"), F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    b = t("lineitem").select(F.lit("SUPPLIED_BY").alias("edge_type"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_extendedprice").alias("weight"))
    return a.unionAll(b)


@C.add("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_totalprice > 200000")
def kg_edge_scan(t):
    return store.edges(order_edges(t), edge_type="PLACED_BY", edge_where={"weight": Range(gt=200000)}).select("src", "dst")


@C.add("SELECT o.o_orderkey AS order_id, s.s_name AS supplier, l.l_extendedprice AS weight FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE o.o_orderpriority = '1-URGENT' AND l.l_extendedprice >= 30000 AND s.s_nationkey IN (1, 2, 3)")
def kg_edges_out(t):
    out = store.edges(order_edges(t), t("orders"), start_key="o_orderkey", where={"o_orderpriority": "1-URGENT"}, edge_type="SUPPLIED_BY", edge_where={"weight": Range(ge=30000)}, target=t("supplier"), target_key="s_suppkey", target_where={"s_nationkey": [1, 2, 3]})
    return out.select(F.col("c_o_orderkey").alias("order_id"), F.col("v_s_name").alias("supplier"), F.col("e_weight").alias("weight"))


@C.add("SELECT c.c_custkey AS customer, o.o_orderkey AS order_id FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3 AND o.o_orderstatus = 'F'")
def kg_edges_in(t):
    out = store.edges(order_edges(t), t("customer"), start_key="c_custkey", where={"c_nationkey": 3}, direction="in", edge_type="PLACED_BY", target=t("orders"), target_key="o_orderkey", target_where={"o_orderstatus": "F"})
    return out.select(F.col("c_c_custkey").alias("customer"), F.col("v_o_orderkey").alias("order_id"))


@C.add("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey IN (1, 2) THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 100, 'NOWHERE', NULL")
def kg_upsert_merge(t):
    n = t("nation")
    a = n.where("n_regionkey = 1").select("n_nationkey", F.upper("n_name").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"), F.lit(2).alias("seq"))
    b = n.where("n_regionkey = 1").select("n_nationkey", F.lit("older").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"), F.lit(1).alias("seq"))
    c = n.where("n_regionkey IN (1, 2)").select("n_nationkey", F.lit(None).cast("string").alias("n_name"), F.lit(99).alias("n_regionkey"), F.lit(3).alias("seq"))
    d = n.limit(1).select(F.lit(100).alias("n_nationkey"), F.lit("NOWHERE").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"), F.lit(4).alias("seq"))
    return store.upsert(n, a.unionAll(b).unionAll(c).unionAll(d), ["n_nationkey"], "seq")


@C.add("SELECT 'IN' AS edge_type, n_nationkey AS src, n_regionkey AS dst, CASE WHEN n_nationkey < 10 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS weight FROM nation UNION ALL SELECT 'NEAR', n_nationkey, n_nationkey + 1, CAST(1 AS DOUBLE) FROM nation WHERE n_nationkey < 5")
def ensure_edges_last_wins(t):
    n = t("nation")
    now = n.select(F.lit("IN").alias("edge_type"), F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit(0.0).alias("weight"))
    again = now.where("src < 10").select("edge_type", "src", "dst", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("weight")).withColumn("seq", F.col("weight").cast("int"))
    new = n.where("n_nationkey < 5").select(F.lit("NEAR").alias("edge_type"), F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst"), F.lit(1.0).alias("weight"), F.lit(1).alias("seq"))
    return store.ensure_edges(now, again.unionByName(new), "seq")


@C.add("SELECT count(*) AS created FROM nation WHERE n_nationkey < 5")
def ensure_edges_created(t):
    n = t("nation")
    now = n.select(F.lit("IN").alias("edge_type"), F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    new = n.where("n_nationkey < 5").select(F.lit("NEAR").alias("edge_type"), F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return store.created_edges(now, now.unionAll(new).unionAll(new)).agg(F.count("*").alias("created"))


@C.add("SELECT count(*) FILTER (WHERE p_brand <> 'Brand#11' AND p_size < 10) AS changed, count(*) FILTER (WHERE p_brand = 'Brand#11' OR p_size < 10) AS now FROM part")
def kg_update_changed(t):
    out, changed = store.update(t("part"), {"p_brand": "Brand#11", "p_name": None}, {"p_size": Range(lt=10)})
    before = t("part").agg(F.count_if(changed).alias("changed"))
    return before.crossJoin(out.agg(F.count_if(F.col("p_brand") == "Brand#11").alias("now")))


@C.add("SELECT (SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (1, 2)) AS nodes, (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey NOT IN (1, 2)) AS edges")
def kg_delete_cascade(t):
    e = t("lineitem").select((F.col("l_orderkey") + 1000000000).alias("src"), F.col("l_suppkey").alias("dst"))
    nodes, left = store.delete(t("supplier"), "s_suppkey", e, {"s_nationkey": [1, 2]})
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(left.agg(F.count("*").alias("edges")))


@C.add("SELECT (SELECT count(*) FROM supplier) AS entities, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey FROM lineitem WHERE l_linenumber <= 2)) AS relations, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderstatus = 'F')) AS mentions")
def write_graph_idempotent(t):
    chunks = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("chunk_id"))
    first = t("lineitem").where("l_linenumber = 1")
    new = first.select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.lit("supplier").alias("name"), F.lit(1).alias("seq"))
    ents = t("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    rel = t("lineitem").where("l_linenumber <= 2").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("relationship_type"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.lit(1).alias("seq"))
    empty_rel, empty_men = rel.drop("seq").limit(0), new.select("chunk_id", "entity_id").limit(0)
    state = (ents, empty_rel, empty_men)
    for _ in range(2):
        state = store.write_graph(*state, chunks, new, rel, "seq")
    counts = [d.agg(F.count("*").alias(n)) for d, n in zip(state, ("entities", "relations", "mentions"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@C.add("SELECT doc_id, 'doc_' || doc_id AS slug, 'doc_' || doc_id || ':0:' || sha256(text) AS chunk_id, 'doc_' || doc_id || ':s1:' || substr(sha256(text), 1, 16) AS content_id, substr(sha256('doc ' || doc_id || '|' || source || '|v1'), 1, 32) AS cache_key FROM documents")
def content_hash_ids(t):
    d = t("documents")
    name = F.concat(F.lit("/doc "), F.col("doc_id").cast("string"), F.lit("?"))
    s = ids.slug(name)
    return d.select("doc_id", s.alias("slug"), ids.chunk_id(s, F.lit(0), F.col("text")).alias("chunk_id"), ids.content_id(s, F.lit("s1"), F.col("text")).alias("content_id"), ids.cache_key(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("source"), F.lit("v1")).alias("cache_key"))


@C.add("SELECT doc_id, ok.n AS n_documents FROM documents, (SELECT count(DISTINCT md5(text)) AS n FROM documents) ok WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))")
def content_gate(t):
    d = t("documents").select("doc_id", F.md5("text").alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    done = d.limit(0)
    fresh = store.gate(first, done, ["hash"])
    return fresh.select("doc_id").crossJoin(fresh.agg(F.count("*").alias("n_documents")))


@C.add("SELECT s_suppkey, s_name, upper(substr(s_name, 1, 3)) AS prefix FROM supplier WHERE s_acctbal >= 0")
def split_valid_rows(t):
    good, _ = store.split_valid(t("supplier"), {"not_negative": F.col("s_acctbal") >= 0, "named": F.length("s_name") > 0})
    return good.select("s_suppkey", "s_name", F.upper(F.substring("s_name", 1, 3)).alias("prefix"))


@C.add("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 4 AND regexp_matches(x, '[0-9]')))) AS n FROM documents")
def identifier_tokens(t):
    return t("documents").select("doc_id", F.size(text.identifier_tokens(F.col("text"))).alias("n"))
