"""Scorers over labels, benchmark, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators import evals, runs
from docloom.plans import Catalogue

C = Catalogue()

#: A rule to predict quality with: long texts without many symbols.
RULE = "CASE WHEN n_chars > 300 THEN 'good' ELSE 'bad' END"
GOLD = f"""
gold AS (SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected, toxic FROM labels),
pred AS (SELECT doc_id AS item_id, {RULE} AS verdict, round((doc_id % 11) / 10.0, 1) AS score FROM documents WHERE lang <> 'de'),
judged AS (SELECT g.*, p.verdict, p.score, p.item_id IS NOT NULL AS answered FROM gold g LEFT JOIN pred p USING (item_id))"""


def gold(t):
    return t("labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), "toxic")


def predictions(t):
    return t("documents").where("lang <> 'de'").select(F.col("doc_id").alias("item_id"), F.expr(RULE).alias("verdict"), F.round((F.col("doc_id") % 11) / 10.0, 1).alias("score"))


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@C.add(f"WITH {GOLD}, c AS (SELECT expected, avg(CASE WHEN coalesce(verdict = expected, false) THEN 1.0 ELSE 0.0 END) AS recall FROM judged GROUP BY 1) SELECT round((SELECT min(recall) FROM c), 9) AS min_class_recall, round((SELECT avg(recall) FROM c), 9) AS mean_class_recall, count(*) AS n, count(*) FILTER (WHERE NOT answered) AS errors, round(avg(CASE WHEN coalesce(verdict = expected, false) THEN 1.0 ELSE 0.0 END), 9) AS top1_accuracy, round(avg(CASE WHEN answered THEN 1.0 ELSE 0.0 END), 9) AS tags_per_item, (SELECT min(recall) FROM c) >= 0.5 AS passed FROM judged")
def score_classification(t):
    g = gold(t).select("item_id", F.array("expected").alias("labels"))
    p = predictions(t).select("item_id", F.array("verdict").alias("ranked"))
    return r9(evals.classification(g, p, floor=0.5), "min_class_recall", "mean_class_recall", "top1_accuracy", "tags_per_item")


@C.add(f"WITH {GOLD} SELECT expected AS gold, verdict AS predicted, count(*) AS n FROM judged WHERE answered AND verdict <> expected GROUP BY 1, 2")
def confusion_pairs(t):
    return evals.confusions(gold(t).select("item_id", F.array("expected").alias("labels")), predictions(t).select("item_id", F.array("verdict").alias("ranked")))


RATES = """count(*) AS n, count(*) FILTER (WHERE NOT answered) AS errors, round(count(*) FILTER (WHERE answered AND verdict = expected) / CAST(count(*) AS DOUBLE), 9) AS accuracy,
round(count(*) FILTER (WHERE answered AND verdict = 'bad' AND expected = 'bad') / nullif(CAST(count(*) FILTER (WHERE answered AND verdict = 'bad') AS DOUBLE), 0), 9) AS precision,
round(count(*) FILTER (WHERE answered AND verdict = 'bad' AND expected = 'bad') / nullif(CAST(count(*) FILTER (WHERE expected = 'bad') AS DOUBLE), 0), 9) AS recall,
round(count(*) FILTER (WHERE answered AND verdict = 'bad' AND expected <> 'bad') / nullif(CAST(count(*) FILTER (WHERE expected <> 'bad') AS DOUBLE), 0), 9) AS false_alarm_rate"""


@C.add(f"WITH {GOLD}, r AS (SELECT {RATES} FROM judged) SELECT *, coalesce(precision >= 0.5, false) AND coalesce(recall >= 0.5, false) AS passed FROM r")
def score_judgment(t):
    return r9(evals.judgment(gold(t), predictions(t), actionable="bad", precision=0.5, recall=0.5), "accuracy", "precision", "recall", "false_alarm_rate")


@C.add(f"WITH {GOLD} SELECT toxic, {RATES} FROM judged GROUP BY toxic")
def score_judgment_by_group(t):
    return r9(evals.rates(evals.judged(gold(t), predictions(t)), "bad", "toxic"), "accuracy", "precision", "recall", "false_alarm_rate")


@C.add(f"WITH {GOLD}, b AS (SELECT CASE WHEN score < 0.2 THEN 0 WHEN score < 0.4 THEN 1 WHEN score < 0.6 THEN 2 WHEN score < 0.8 THEN 3 ELSE 4 END AS bin, expected FROM judged WHERE score IS NOT NULL) SELECT bin, count(*) AS n, round(avg(CASE WHEN expected = 'good' THEN 1.0 ELSE 0.0 END), 9) AS share FROM b GROUP BY bin")
def calibration(t):
    return r9(evals.calibration(evals.judged(gold(t), predictions(t)), "good"), "share")


@C.add("""WITH x AS (SELECT doc_id AS item_id, n_chars AS chars, CAST(toxic = 0 AS INT) AS found, 1 AS n_gold FROM labels JOIN documents USING (doc_id)), n AS (SELECT *, row_number() OVER (ORDER BY chars, found, n_gold, item_id) - 1 AS i, count(*) OVER () AS c FROM x),
g AS (SELECT *, CAST(((i + 1) * least(4, c) + c - 1) // c - 1 AS INTEGER) AS grp FROM n) SELECT grp, count(*) AS n, min(chars) AS least, max(chars) AS most, round(sum(found) / CAST(sum(n_gold) AS DOUBLE), 9) AS recall FROM g GROUP BY grp""")
def length_groups(t):
    items = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("chars"), (F.col("toxic") == 0).cast("int").alias("found"), F.lit(1).alias("n_gold"))
    return r9(evals.length_groups(items), "recall")


RANKED = """
grades AS (SELECT o_custkey AS item_id, l_partkey AS id, max(l_linenumber) AS grade, max(l_tax) AS tax FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
ranked AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY (id * 7919) % 1000, id) AS rank FROM grades WHERE tax > 0.02),
rel AS (SELECT item_id, id FROM grades WHERE grade >= 2),
per AS (SELECT rel.item_id, count(*) AS relevant, count(r.id) AS found FROM rel LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.item_id = rel.item_id AND r.id = rel.id GROUP BY 1),
dcg AS (SELECT g.item_id, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg FROM ranked r JOIN grades g ON g.item_id = r.item_id AND g.id = r.id WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT item_id, sum((pow(2.0, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, id) AS r FROM grades) WHERE r <= 10 GROUP BY 1),
gain AS (SELECT i.item_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg FROM ideal i LEFT JOIN dcg d ON d.item_id = i.item_id)"""


def ranked_lists(t):
    from pyspark.sql import Window

    g = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    grades = g.groupBy(F.col("o_custkey").alias("item_id"), F.col("l_partkey").alias("id")).agg(F.max("l_linenumber").alias("grade"), F.max("l_tax").alias("tax"))
    w = Window.partitionBy("item_id").orderBy((F.col("id") * 7919) % 1000, "id")
    return grades, grades.where("tax > 0.02").select("item_id", "id", F.row_number().over(w).alias("rank"))


@C.add(f"WITH {RANKED}, every AS (SELECT DISTINCT item_id FROM grades) SELECT count(*) AS n, count(per.item_id) AS scored, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.item_id = every.item_id)) AS errors, round(avg(found / CAST(relevant AS DOUBLE)), 9) AS recall, round(avg(CASE WHEN per.item_id IS NOT NULL THEN ndcg END), 9) AS ndcg, avg(found / CAST(relevant AS DOUBLE)) >= 0.2 AS passed FROM every LEFT JOIN per ON per.item_id = every.item_id LEFT JOIN gain ON gain.item_id = every.item_id")
def score_retrieval(t):
    grades, ranked = ranked_lists(t)
    return r9(evals.retrieval(grades.select("item_id").distinct(), grades, ranked, k=10, recall=0.2, least=2), "recall", "ndcg")


@C.add(f"WITH {RANKED} SELECT item_id, round(ndcg, 9) AS ndcg FROM gain")
def ndcg_per_item(t):
    grades, ranked = ranked_lists(t)
    return r9(evals.graded_gain(ranked, grades, 10), "ndcg")


@C.add(f"WITH {RANKED}, p AS (SELECT g.item_id, count(r.id) / CAST(count(*) AS DOUBLE) AS r FROM grades g LEFT JOIN ranked r ON r.item_id = g.item_id AND r.id = g.id GROUP BY 1) SELECT count(*) AS n, round(avg(r), 9) AS recall, avg(r) >= 0.7 AS passed FROM p")
def score_relational(t):
    grades, ranked = ranked_lists(t)
    return r9(evals.relational(grades, ranked, recall=0.7), "recall")


NAMES = """
g0 AS (SELECT s_nationkey AS item_id, s_name AS text, s_suppkey AS position FROM supplier), p0 AS (SELECT s_nationkey AS item_id, upper(s_name) || ' .' AS text, s_suppkey AS position FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_nationkey, 'unrelated ' || s_nationkey, 100000 FROM supplier),
g AS (SELECT DISTINCT item_id, trim(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), ' .,;:') AS k FROM g0), p AS (SELECT DISTINCT item_id, trim(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), ' .,;:') AS k FROM p0),
m AS (SELECT g.item_id, g.k AS gk, p.k AS pk FROM g JOIN p ON g.item_id = p.item_id AND (contains(g.k, p.k) OR contains(p.k, g.k))),
h AS (SELECT x.item_id, x.n AS n_gold, coalesce(f.f, 0) AS found, coalesce(o.n, 0) AS n_out, coalesce(f.p, 0) AS kept FROM (SELECT item_id, count(*) AS n FROM g GROUP BY 1) x LEFT JOIN (SELECT item_id, count(DISTINCT gk) AS f, count(DISTINCT pk) AS p FROM m GROUP BY 1) f ON f.item_id = x.item_id LEFT JOIN (SELECT item_id, count(*) AS n FROM p GROUP BY 1) o ON o.item_id = x.item_id)"""


def name_lists(t):
    s = t("supplier")
    g = s.select(F.col("s_nationkey").alias("item_id"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("position"))
    p = s.where("s_acctbal > 0").select(F.col("s_nationkey").alias("item_id"), F.concat(F.upper("s_name"), F.lit(" .")).alias("text"), F.col("s_suppkey").alias("position"))
    return g, p.unionAll(s.select("s_nationkey", F.concat(F.lit("unrelated "), "s_nationkey"), F.lit(100000).cast("long")))


@C.add(f"WITH {NAMES}, r AS (SELECT count(*) AS n, sum(found) / CAST(sum(n_gold) AS DOUBLE) AS recall, sum(kept) / CAST(sum(n_out) AS DOUBLE) AS precision FROM h) SELECT n, round(recall, 9) AS recall, round(precision, 9) AS precision, round(2 * recall * precision / (recall + precision), 9) AS f1, recall >= 0.5 AND precision >= 0.5 AS passed FROM r")
def score_extraction(t):
    return r9(evals.extraction(*name_lists(t), recall=0.5, precision=0.5), "recall", "precision", "f1")


@C.add(f"WITH {NAMES}, r AS (SELECT count(*) AS n, avg(found / CAST(n_gold AS DOUBLE)) AS recall, avg(CASE WHEN n_out > 0 THEN kept / CAST(n_out AS DOUBLE) ELSE 0 END) AS precision FROM h) SELECT n, round(recall, 9) AS recall, round(precision, 9) AS precision, round(2 * recall * precision / (recall + precision), 9) AS f1, recall >= 0.5 AND precision >= 0.5 AS passed FROM r")
def score_extraction_macro(t):
    return r9(evals.extraction(*name_lists(t), recall=0.5, precision=0.5, average="macro"), "recall", "precision", "f1")


CITES = """
gold AS (SELECT o_orderkey AS item_id, list(CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_linenumber <= 2 AND o_orderstatus <> 'P') AS cites FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
pred AS (SELECT o_orderkey AS item_id, list(CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_linenumber <= 1) AS cites, bool_or(o_orderpriority = '5-LOW') AS abstained FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
j AS (SELECT g.item_id, coalesce(g.cites, []) AS cites, coalesce(p.cites, []) AS got, p.abstained FROM gold g LEFT JOIN pred p ON p.item_id = g.item_id),
r AS (SELECT count(*) AS n, count(*) FILTER (WHERE abstained IS NULL) AS errors, avg(CASE WHEN len(cites) > 0 THEN len(list_intersect(cites, got)) / CAST(len(list_distinct(cites)) AS DOUBLE) END) AS cr, avg(CASE WHEN len(cites) = 0 THEN CASE WHEN coalesce(abstained, false) THEN 1.0 ELSE 0.0 END END) AS ab FROM j)"""


@C.add(f"WITH {CITES} SELECT n, errors, round(cr, 9) AS citation_recall, round(ab, 9) AS abstention, cr >= 0.3 AND ab >= 0.3 AS passed FROM r")
def score_generation(t):
    x = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    cite = F.col("l_partkey").cast("string")
    g = x.groupBy(F.col("o_orderkey").alias("item_id")).agg(F.collect_list(F.when((F.col("l_linenumber") <= 2) & (F.col("o_orderstatus") != "P"), cite)).alias("cites"))
    p = x.where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderkey").alias("item_id")).agg(F.collect_list(F.when(F.col("l_linenumber") <= 1, cite)).alias("cites"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("abstained"))
    return r9(evals.generation(g, p, citation_recall=0.3, abstention=0.3), "citation_recall", "abstention")


@C.add("""WITH g AS (SELECT s_nationkey AS item_id, lower(s_name) AS k FROM supplier), c AS (SELECT s_nationkey AS item_id, lower(s_name) AS k FROM supplier WHERE s_acctbal > 0), v AS (SELECT s_nationkey AS item_id, lower(s_name) AS k, s_acctbal > 8000 AS ign FROM supplier WHERE s_acctbal > 2000 UNION ALL SELECT s_nationkey, 'other', false FROM supplier WHERE s_acctbal < 0)
SELECT round((SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM c WHERE c.item_id = g.item_id AND (contains(g.k, c.k) OR contains(c.k, g.k)))) / (SELECT CAST(count(*) AS DOUBLE) FROM g), 9) AS coverage,
round((SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM v WHERE NOT v.ign AND v.item_id = g.item_id AND (contains(g.k, v.k) OR contains(v.k, g.k)))) / (SELECT CAST(count(*) AS DOUBLE) FROM g), 9) AS recall,
round((SELECT count(*) FROM (SELECT DISTINCT item_id, k FROM v WHERE NOT ign) v WHERE EXISTS (SELECT 1 FROM g WHERE v.item_id = g.item_id AND (contains(g.k, v.k) OR contains(v.k, g.k)))) / (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT item_id, k FROM v WHERE NOT ign)), 9) AS precision""")
def score_candidate_choice(t):
    s = t("supplier").select(F.col("s_nationkey").alias("item_id"), F.col("s_name").alias("text"), "s_acctbal")
    chosen = s.where("s_acctbal > 2000").select("item_id", "text").unionAll(s.where("s_acctbal < 0").select("item_id", F.lit("other")))
    return r9(evals.candidate_choice(s, s.where("s_acctbal > 0"), chosen, s.where("s_acctbal > 8000").select("item_id", "text")), "coverage", "recall", "precision")


@C.add("SELECT toxic AS label, count(*) AS n, round(avg(CASE WHEN coalesce(CAST(doc_id % 2 AS INT) = toxic, false) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labels GROUP BY toxic")
def score_choice(t):
    lab = t("labels")
    return r9(evals.choice(lab.select(F.col("doc_id").alias("item_id"), F.array("toxic").alias("accepted")), lab.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 2).cast("int").alias("choice"))), "accuracy")


@C.add("SELECT user_id AS item_id, count(DISTINCT event_type) > 1 AS flipped, count(*) FILTER (WHERE event_type IS NULL) AS errors FROM events GROUP BY 1")
def eval_flips(t):
    return evals.flips(t("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("repeat"), F.col("event_type").alias("output")))


@C.add("""WITH p AS (SELECT a.item_id AS id, string_split(trim(regexp_replace(regexp_replace(lower(a.text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS x, string_split(trim(regexp_replace(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
c AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(x) AS w FROM p) WHERE w <> '' GROUP BY 1, 2), d AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(y) AS w FROM p) WHERE w <> '' GROUP BY 1, 2), s AS (SELECT id, sum(least(c.n, d.n)) AS same FROM c JOIN d USING (id, w) GROUP BY 1),
f AS (SELECT p.id, coalesce(same, 0) / CAST(len(list_filter(x, lambda w: w <> '')) AS DOUBLE) AS pr, coalesce(same, 0) / CAST(len(list_filter(y, lambda w: w <> '')) AS DOUBLE) AS re FROM p LEFT JOIN s ON s.id = p.id)
SELECT id, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM f""")
def token_prf(t):
    b = t("benchmark")
    pairs = b.select(F.col("item_id").alias("id"), F.col("text").alias("predicted")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("gold")), "id")
    return r9(evals.token_overlap(pairs), "precision", "recall", "f1")


@C.add("SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t):
    """Each vector and the next one."""
    e = t("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def calls(t):
    return t("events").select(F.col("event_type").alias("model"), F.col("user_id").alias("run"), (F.col("event_id") % 50).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9).alias("cost"), (F.col("event_id") % 100).alias("latency_ms"), "event_id", "ts", "props")


CALLS = "calls AS (SELECT event_type AS model, user_id AS run, event_id % 50 AS input_tokens, event_id % 7 AS output_tokens, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 END AS cost, event_id % 100 AS latency_ms, event_id, ts, props FROM events)"


@C.add(f"WITH {CALLS} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost) AS BIGINT) AS cost, count(*) FILTER (WHERE cost IS NULL) AS calls_without_cost, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM calls GROUP BY ROLLUP (model)")
def usage_rollup(t):
    return runs.usage(calls(t), "model")


@C.add(f"WITH {CALLS} SELECT event_id, run, row_number() OVER (PARTITION BY run, model || props ORDER BY event_id) - 1 AS seen FROM calls")
def call_dedup_exact(t):
    return runs.repeated(calls(t).withColumn("key", F.concat("model", "props")), "run", "key", "event_id").select("event_id", "run", "seen")


@C.add(f"WITH {CALLS} SELECT event_id, run, row_number() OVER (PARTITION BY run ORDER BY event_id) <= 3 AS allowed FROM calls")
def dispatch_budget(t):
    return runs.within_budget(calls(t), "run", "event_id", 3).select("event_id", "run", "allowed")


@C.add(f"WITH {CALLS} SELECT event_id, model, count(*) OVER (PARTITION BY model ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM calls")
def rolling_limiter(t):
    c = calls(t).withColumn("sec", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    return runs.rolling_counts(c, "model", F.col("sec"), 3600).select("event_id", "model", "in_window")


@C.add("""WITH b AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'KEEP' ELSE 'NONE' END AS old, CASE WHEN toxic = 1 THEN 'NONE' ELSE 'KEEP' END AS new FROM labels) SELECT count(*) AS total, count(*) FILTER (WHERE old = new) AS unchanged, count(*) FILTER (WHERE old <> new) AS flipped, count(*) FILTER (WHERE old <> new AND new = 'NONE') AS to_none, count(*) FILTER (WHERE old <> new AND old = 'NONE') AS from_none FROM b""")
def reclassification(t):
    lab = t("labels")
    return runs.reclassified(lab.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "KEEP").otherwise("NONE").alias("label")), lab.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "NONE").otherwise("KEEP").alias("label")))[0]
