"""Clauses of documents: nesting, positions, interval joins, co-occurrence routing, votes, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import certainty_name, doubt


def with_properties(clauses: DataFrame, properties: DataFrame) -> DataFrame:
    """clauses (clause_id, ...) each with its properties (clause_id, dimension, value, confidence), sorted; none: empty."""
    nested = properties.groupBy("clause_id").agg(F.sort_array(F.collect_set(F.struct("dimension", "value", "confidence"))).alias("properties"))
    empty = F.array().cast(nested.schema["properties"].dataType)
    return clauses.join(nested, "clause_id", "left").withColumn("properties", F.coalesce("properties", empty))


def uncovered_spans(spans: DataFrame, clauses: DataFrame) -> DataFrame:
    """Spans (span_id, text) that no clause covers, blank ones left out."""
    return spans.where(F.btrim("text") != "").join(clauses.select("span_id"), "span_id", "left_anti")


def having_property(clauses: DataFrame, properties: DataFrame, dimension: str, value: str, function: str | None = None) -> DataFrame:
    hit = properties.where((F.col("dimension") == dimension) & (F.col("value") == value)).select("clause_id")
    return (clauses if function is None else clauses.where(F.col("function") == function)).join(hit, "clause_id", "left_semi")


def grounded_only(properties: Column) -> Column:
    return F.filter(properties, lambda p: p["confidence"] != "AMBIGUOUS")


def nearest(exceptions: DataFrame, caps: DataFrame, window: int = 3000, cell: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Links (contract, exception, cap, gap) of each exception to the nearest cap of its contract, and the exceptions
    without one within `window` characters. Both sides: contract, id, start, end, position; equal gaps go to the first
    cap by position. The nearest cap to the left and to the right come from one sorted pass over a contract each, overlapping
    ones from a join by cell of the text: no contract's caps meet all its exceptions."""
    own = lambda at, n: exceptions.select("contract", "id", F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(n).alias("c"))
    placed = F.struct(F.col("end").alias("at"), (-F.col("position")).alias("p"), F.col("id").alias("cap"))
    ends = caps.select("contract", F.lit(None).cast(exceptions.schema["id"].dataType).alias("id"), F.col("end").alias("at"), F.lit(0).alias("side"), placed.alias("c"))
    before = Window.partitionBy("contract").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    left = own("start", ends.schema["c"].dataType).unionByName(ends).withColumn("c", F.max("c").over(before)).where("side = 1 and c is not null")
    left = left.select("contract", F.col("id").alias("exception"), (F.col("at") - F.col("c.at")).alias("gap"), (-F.col("c.p")).alias("p"), "c.cap")
    placed = F.struct(F.col("start").alias("at"), F.col("position").alias("p"), F.col("id").alias("cap"))
    starts = caps.select("contract", F.lit(None).cast(exceptions.schema["id"].dataType).alias("id"), F.col("start").alias("at"), F.lit(0).alias("side"), placed.alias("c"))
    after = Window.partitionBy("contract").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    right = own("end", starts.schema["c"].dataType).unionByName(starts).withColumn("c", F.min("c").over(after)).where("side = 1 and c is not null")
    right = right.select("contract", F.col("id").alias("exception"), (F.col("c.at") - F.col("at")).alias("gap"), "c.p", "c.cap")
    cells = F.explode(cells_of(F.col("start"), F.col("end"), cell))
    e, c = exceptions.withColumn("cell", cells).alias("e"), caps.withColumn("cell", cells).alias("c")
    met = e.join(c, (F.col("e.contract") == F.col("c.contract")) & (F.col("e.cell") == F.col("c.cell"))).where("e.start < c.end and c.start < e.end")
    over = met.select("e.contract", F.col("e.id").alias("exception"), F.lit(0).alias("gap"), F.col("c.position").alias("p"), F.col("c.id").alias("cap"))
    every = left.unionByName(right).unionByName(over)
    best = every.groupBy("contract", "exception").agg(F.min(F.struct("gap", "p", "cap")).alias("b")).select("contract", "exception", "b.cap", "b.gap")
    links = best.where(F.col("gap") <= window)
    return links, exceptions.join(links.select(F.col("contract"), F.col("exception").alias("id")), ["contract", "id"], "left_anti")


def cells_of(start: Column, end: Column, cell: int) -> Column:
    """Numbers of the cells of `cell` places that a range from start to before end touches, one at least."""
    return F.sequence(F.floor(start / cell), F.floor(F.greatest(end - 1, start) / cell))


def overlapping_pages(spans: DataFrame, pages: DataFrame, cell: int = 4096) -> DataFrame:
    """span_id with the sorted different pages whose range it overlaps, and the box if there is exactly one: spans
    (document, span_id, start, end), pages (document, page, start, end, box). Both sides are dealt to cells of the text,
    so a pair meets by document and cell, not by document alone."""
    cells = F.explode(cells_of(F.col("start"), F.col("end"), cell))
    s = spans.select("document", "span_id", "start", "end", cells.alias("cell")).alias("s")
    p = pages.select("document", "page", "start", "end", "box", cells.alias("cell")).alias("p")
    met = s.join(p, (F.col("s.document") == F.col("p.document")) & (F.col("s.cell") == F.col("p.cell"))).where("s.start < p.end and s.end > p.start")
    hit = met.select("s.document", "s.span_id", "p.page", "p.box").distinct()
    got = hit.groupBy("document", "span_id").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.when(F.count("*") == 1, F.max("box")).alias("box"))
    return spans.select("document", "span_id").join(got, ["document", "span_id"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))


def widest_label(spans: DataFrame, labels: DataFrame, none: str = "NONE", cell: int = 4096) -> DataFrame:
    """span_id with the label that overlaps it most, of equals the first by position, or `none`: spans (document,
    span_id, start, end), labels (document, label, start, end, position). Both meet by document and cell of the text; that a
    pair may meet in several cells doesn't change which is best."""
    cells = F.explode(cells_of(F.col("start"), F.col("end"), cell))
    s, a = spans.withColumn("cell", cells).alias("s"), labels.withColumn("cell", cells).alias("a")
    met = s.join(a, (F.col("s.document") == F.col("a.document")) & (F.col("s.cell") == F.col("a.cell"))).where("s.start < a.end and s.end > a.start")
    overlap = F.least(F.col("s.end"), F.col("a.end")) - F.greatest(F.col("s.start"), F.col("a.start"))
    best = met.groupBy("s.document", "s.span_id").agg(F.max_by("a.label", F.struct(overlap, -F.col("a.position"))).alias("label"))
    return spans.select("document", "span_id").join(best, ["document", "span_id"], "left").fillna({"label": none})


def cell_in_table(cells: DataFrame, tables: DataFrame, rows: int = 256) -> DataFrame:
    """Cells (sheet, r, c) with the table (sheet, table_id, l, t, rr, b) whose rectangle holds them. Both meet by sheet and
    strip of rows, of which a cell is in one."""
    x = cells.withColumn("_strip", F.floor(F.col("r") / rows)).alias("x")
    y = tables.where("b > t").withColumn("_strip", F.explode(cells_of(F.col("t"), F.col("b"), rows))).alias("y")
    met = x.join(y, (F.col("x.sheet") == F.col("y.sheet")) & (F.col("x._strip") == F.col("y._strip")))
    return met.where("y.l <= x.c and x.c < y.rr and y.t <= x.r and x.r < y.b").select("x.*", "y.table_id").drop("_strip")


def same_occurrence(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (document, row_id, line, position) to spans (document, span_id, line, position): the n-th row with a line to
    the n-th span with it."""
    nth = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("document", "line").orderBy("position")))
    return nth(rows).select("document", "line", "n", "row_id").join(nth(lines).select("document", "line", "n", "span_id"), ["document", "line", "n"]).select("document", "row_id", "span_id")


def cooccurrence(rows: DataFrame) -> DataFrame:
    """dimension, function, n from rows (clause_id, dimension, function): different rows, NONE and empty left out."""
    return rows.where(F.col("function").isNotNull() & ~F.col("function").isin("", "NONE")).select("clause_id", "dimension", "function").distinct().groupBy("dimension", "function").agg(F.count("*").alias("n"))


def route(counts: DataFrame, dimensions: DataFrame, *, k: int, score: str = "conditional", least: int = 1, digits: int = 9) -> DataFrame:
    """The k functions with the largest sums over the query's dimensions of P(f|d), its lift over P(f), or log2 of it
    (pmi); pairs below `least` don't count. Ties by name."""
    total = Window.partitionBy()
    of_d, of_f = Window.partitionBy("dimension"), Window.partitionBy("function")
    p = counts.withColumn("nd", F.sum("n").over(of_d)).withColumn("nf", F.sum("n").over(of_f)).withColumn("all", F.sum("n").over(total))
    cond = F.col("n") / F.col("nd")
    lift = cond / (F.col("nf") / F.col("all"))
    value = {"conditional": cond, "lift": lift, "pmi": F.log2(lift)}[score]
    got = p.where(F.col("n") >= least).join(dimensions.select("dimension").distinct(), "dimension", "left_semi").groupBy("function").agg(F.round(F.sum(value), digits).alias("score"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "function"))).where(F.col("rank") <= k)


def vote(members: DataFrame, by: str = "unit") -> DataFrame:
    """The label of each unit with the largest sum of scores over its members that aren't headings (all, if none else),
    the first by label order of equals, and the member that scores it highest. members: unit, member, position, heading,
    label, label_order, score."""
    only = F.min(F.col("heading").cast("int")).over(Window.partitionBy(by)) == 1
    m = members.where(F.lit(True)).withColumn("_only", only).where(F.col("_only") | ~F.col("heading"))
    sums = m.groupBy(by, "label").agg(F.sum("score").alias("total"), F.min("label_order").alias("o"))
    label = sums.groupBy(by).agg(F.max_by(F.struct("label", "total"), F.struct(F.round("total", 9), -F.col("o"))).alias("w")).select(by, "w.label", "w.total")
    cite = m.join(label.select(by, "label"), [by, "label"]).groupBy(by).agg(F.max_by("member", F.struct("score", -F.col("position"))).alias("member"))
    return label.join(cite, by)


def worst_certainty(properties: DataFrame, by: str = "clause_id") -> DataFrame:
    return properties.groupBy(by).agg(certainty_name(F.max(doubt(F.col("confidence")))).alias("confidence"))


def grounded(assertions: DataFrame, cues: DataFrame, open_dimensions: tuple[str, ...] = (), semantic: tuple[str, ...] = ()) -> DataFrame:
    """assertions (id, dimension, value, text) with `grounded`: a closed value needs one of its cues (dimension, value,
    cue) in the text, an open value one of its words of two or more characters, a semantic one nothing."""
    lower = F.lower("text")
    words = F.filter(F.split(F.lower("value"), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    by_cue = cues.groupBy("dimension", "value").agg(F.collect_set(F.lower("cue")).alias("cues"))
    got = assertions.join(by_cue, ["dimension", "value"], "left")
    closed = F.exists(F.coalesce("cues", F.array().cast("array<string>")), lambda c: F.contains(F.lower(F.col("text")), c))
    rule = F.when(F.col("dimension").isin(*semantic) if semantic else F.lit(False), F.lit(True)).when(F.col("dimension").isin(*open_dimensions) if open_dimensions else F.lit(False), F.exists(words, lambda w: F.contains(lower, w)))
    return got.withColumn("grounded", rule.otherwise(closed)).drop("cues")


def reground(assertions: DataFrame) -> DataFrame:
    """EXTRACTED without ground becomes AMBIGUOUS."""
    return assertions.withColumn("confidence", F.when((F.col("confidence") == "EXTRACTED") & ~F.col("grounded"), "AMBIGUOUS").otherwise(F.col("confidence")))


def contradictions(assertions: DataFrame, scalar: tuple[str, ...]) -> DataFrame:
    """assertions with AMBIGUOUS where a dimension that has one value has several in a clause."""
    n = F.size(F.collect_set("value").over(Window.partitionBy("clause_id", "dimension")))
    return assertions.withColumn("confidence", F.when(F.col("dimension").isin(*scalar) & (n > 1), "AMBIGUOUS").otherwise(F.col("confidence")))


def texts_of(clauses: DataFrame, spans: DataFrame) -> DataFrame:
    """clause_id with its spans' texts in order, joined by spaces: clauses (clause_id, span_ids), spans (span_id, text)."""
    each = clauses.select("clause_id", F.posexplode("span_ids").alias("n", "span_id")).join(spans.select("span_id", "text"), "span_id")
    ordered = F.array_sort(F.collect_list(F.struct("n", "text")))
    return each.groupBy("clause_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def attach_exceptions(clauses: DataFrame, links: DataFrame, exceptions: DataFrame) -> DataFrame:
    """clauses and the exceptions that aren't among them, each exception marked with its first cap by cap_position."""
    first = links.groupBy("exception").agg(F.min_by("cap", "cap_position").alias("carve_out_of"))
    extra = exceptions.join(clauses.select("clause_id"), "clause_id", "left_anti")
    both = clauses.unionByName(extra, allowMissingColumns=True)
    return both.join(first.withColumnRenamed("exception", "clause_id"), "clause_id", "left")
