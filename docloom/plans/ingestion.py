"""Lines, offsets, sections, runs, spans and units over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import segmenting as S
from docloom.plans import Catalogue

C = Catalogue()

LINES = "ls AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents), ln AS (SELECT * FROM ls WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')"


@C.add(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(text) AS hash FROM ln")
def doc_lines(t):
    return S.lines(t("documents")).select("doc_id", "pos", F.sha2("text", 256).alias("hash"))


@C.add(f"""WITH {LINES}, o AS (SELECT doc_id, pos, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM ln)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(st AS BIGINT) AS start, CAST(st + length(text) AS BIGINT) AS "end" FROM o""")
def chunk_offsets(t):
    return S.offsets(S.lines(t("documents"))).select("doc_id", "pos", "start", "end")


@C.add("""WITH i AS (SELECT conv_id AS doc_id, turn AS pos, text, role = 'user' AS heading FROM conversations), s AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM i)
SELECT doc_id, CAST(section AS BIGINT) AS section, sha256(coalesce(max(text) FILTER (WHERE heading), '')) AS title, sha256(coalesce(string_agg(text, chr(10) ORDER BY pos, text) FILTER (WHERE NOT heading), '')) AS body FROM s GROUP BY 1, 2""")
def heading_sections(t):
    items = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", "role")
    return S.sections(items, F.col("role") == "user").select("doc_id", "section", F.sha2(F.coalesce("title", F.lit("")), 256).alias("title"), F.sha2("body", 256).alias("body"))


@C.add("""WITH e AS (SELECT user_id AS k, event_id AS n, event_type = 'error' AS bad FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - row_number() OVER (PARTITION BY k, bad ORDER BY n) AS g FROM e)
SELECT k, bad, min(n) AS first, max(n) AS last FROM i GROUP BY k, bad, g""")
def page_runs(t):
    e = t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("n"), (F.col("event_type") == "error").alias("bad"))
    return S.runs(e, "k", "n", "bad")


@C.add("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS st FROM lineitem WHERE l_linenumber > 0 AND l_linenumber < 6 UNION SELECT DISTINCT l_orderkey, 0 FROM lineitem)
SELECT doc_id, st AS start, coalesce(lead(st) OVER (PARTITION BY doc_id ORDER BY st), 6) AS "end" FROM s""")
def partition_repair(t):
    x = t("lineitem")
    sizes = x.select(F.col("l_orderkey").alias("doc_id"), F.lit(6).alias("n")).distinct()
    return S.boundaries(x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start")), sizes)


@C.add()
def wrapped_merge(t):
    return S.wrapped(S.lines(t("documents")), ~F.col("text").startswith("|"))


@C.add()
def sentence_spans(t):
    return S.exploded(t("documents"), lambda x: [(c,) for c in S.sentence_cuts(x)], "cut int", ["cut"])


@C.add()
def layout_segments(t):
    c = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
    return S.spans(c).select("chunk_id", "n", "start", "end", "kind", "error")


@C.add("SELECT 0 AS broken")
def contract_checks_tiling(t):
    """Every text is tiled by its spans: none is broken."""
    c = t("documents").where("length(text) > 0").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
    made = S.exploded(c, lambda x: [(a, b, k) for a, b, k in S.spans_of(x)], "start int, end int, kind string", ["start", "end", "kind"], "chunk_id")
    return S.check_tiling(made, c).agg(F.count("*").cast("int").alias("broken"))


@C.add()
def hard_split(t):
    return S.chunks(t("documents"), 2000).select("doc_id", "n", F.length("text").alias("size"), "error")


@C.add()
def group_units(t):
    c = t("documents").select("doc_id", "text")
    made = S.exploded(c, lambda x: [(a, k, x[a:b]) for a, b, k in S.spans_of(x)], "start int, kind string, text string", ["start", "kind", "text"])
    spans = made.select("doc_id", F.lit("c0").alias("chunk_id"), F.col("n").alias("pos"), "kind", "text")
    return S.capped_units(S.units(spans)).select("doc_id", "unit", "part", F.length("text").alias("size"))


@C.add("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimates(t):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@C.add("SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(CAST(64 + p_size AS INTEGER)) ELSE 'A' || chr(CAST(64 + p_size - 26 AS INTEGER)) END AS letters FROM part")
def column_letters(t):
    return t("part").select("p_partkey", text.column_letters((F.col("p_size") - 1).cast("int")).alias("letters"))


@C.add("SELECT l_orderkey AS doc_id, 1 AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS row, 'line,flag' AS header, l_linenumber || ',x y' AS cells FROM lineitem")
def record_tables(t):
    x = t("lineitem")
    rows = F.array_sort(F.collect_list("l_linenumber"))
    grid = F.concat(F.array(F.array(F.lit("line"), F.lit(" flag"))), F.transform(rows, lambda i: F.array(i.cast("string"), F.lit("x \n y"))))
    tables = x.groupBy(F.col("l_orderkey").alias("doc_id")).agg(grid.alias("grid")).withColumn("table_id", F.lit(1))
    return S.table_rows(tables).withColumn("header", F.array_join("header", ",")).withColumn("cells", F.array_join("cells", ","))


@C.add("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 10 THEN 'BLANK' END AS quality FROM documents WHERE length(trim(coalesce(text, ''))) < 10")
def scan_quality_blank(t):
    d = t("documents").select("doc_id", S.scan_quality(F.col("text")).alias("quality"))
    return d.where("quality = 'BLANK'")


@C.add()
def scan_quality_text(t):
    return t("documents").select("doc_id", S.scan_quality(F.col("text")).alias("quality"))
