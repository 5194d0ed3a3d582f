"""Rules against assertions: applicability, actor gates, selection of evidence, verdict roll-ups.

Rules and facts are DataFrames; scopes are maps of dimension to a list of values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"compliant": 0, "needs_review": 1, "violation": 2}


def severity(verdict: Column) -> Column:
    return F.when(verdict == "violation", 2).when(verdict == "needs_review", 1).when(verdict == "compliant", 0)


def verdict_name(rank: Column) -> Column:
    return F.when(rank == 2, "violation").when(rank == 1, "needs_review").when(rank == 0, "compliant")


def constraint_applies(rule: Column, subject: Column) -> Column:
    """For every dimension that the rule constrains and the subject carries, the values meet."""
    return F.forall(F.map_keys(rule), lambda d: ~F.map_contains_key(subject, d) | F.arrays_overlap(F.element_at(rule, d), F.element_at(subject, d)))


def claim_types(override: Column, scope: Column, everything: Column) -> Column:
    """A curated override wins, else the rule's own scope; an empty one is every type."""
    chosen = F.coalesce(override, scope)
    return F.when(F.coalesce(F.size(chosen), F.lit(0)) > 0, chosen).otherwise(everything)


def actor_matches(actor: Column, subjects: Column, synonyms: dict[str, str], domains: dict[str, str], generic: tuple[str, ...] = ("anyone", "all")) -> Column:
    """A generic or missing actor passes; another fails only if its domain differs from that of every subject."""
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    role = lambda c: F.coalesce(F.element_at(pairs(synonyms), F.lower(F.btrim(c))), F.lower(F.btrim(c)))
    domain = lambda c: F.element_at(pairs(domains), c)
    a = role(actor)
    disjoint = lambda s: (a != role(s)) & domain(a).isNotNull() & domain(role(s)).isNotNull() & (domain(a) != domain(role(s)))
    open_ = actor.isNull() | (F.btrim(actor) == "") | a.isin(*generic)
    return open_ | (F.size(subjects) == 0) | F.exists(subjects, lambda s: ~F.coalesce(disjoint(s), F.lit(False)))


def deontic_route(override: Column, confidence: Column, deontic: Column) -> Column:
    """The override, else review for an ambiguous rule, else by type."""
    by_type = F.when(deontic == "PROHIBITION", "prohibition").when(deontic == "PERMISSION", "permission").otherwise("obligation")
    return F.coalesce(override, F.when(confidence == "AMBIGUOUS", "review").otherwise(by_type))


def pairs(facts: DataFrame, rules: DataFrame, condition: Column) -> DataFrame:
    """Facts and the rules that apply to them. Facts and rules meet by claim type, the one thing every rule states:
    facts (fact_id, claim_type, ...), rules (rule_id, types, ...); condition is over both."""
    by_type = rules.withColumn("claim_type", F.explode("types"))
    return facts.join(by_type, "claim_type").where(condition)


def gated(facts: DataFrame, rules: DataFrame, passes: Column) -> DataFrame:
    """Pairs of the same claim type that the gate stops."""
    return pairs(facts, rules, ~F.coalesce(passes, F.lit(False)))


def top_rules(scored: DataFrame, context: int = 3, content: int = 5) -> DataFrame:
    """scored (fact_id, rule_id, kind, score): the best context and content rules of each fact, ties by rule id."""
    place = F.row_number().over(Window.partitionBy("fact_id", "kind").orderBy(F.desc("score"), "rule_id"))
    most = F.when(F.col("kind") == "context", context).otherwise(content)
    return scored.withColumn("rank", place).where(F.col("rank") <= most)


def columns_read(left: DataFrame, right: DataFrame, on: Column, c: Column) -> tuple[list[str], list[str]]:
    """Names of the columns of each side that an expression over their join reads."""
    met = left.join(right, on)
    ids = lambda attributes: [attributes.apply(i).exprId().id() for i in range(attributes.size())]
    read = set(ids(met.select(c)._jdf.queryExecution().analyzed().references().toSeq()))
    hit = [i in read for i in ids(met._jdf.queryExecution().analyzed().output())]
    n = len(left.columns)
    return [x for x, h in zip(left.columns, hit[:n], strict=True) if h], [x for x, h in zip(right.columns, hit[n:], strict=True) if h]


def defenses(prohibitions: DataFrame, permissions: DataFrame, score: Column, top: int = 3) -> DataFrame:
    """Up to `top` permissions of each prohibition's source, best first, ties by rule_id. score reads columns of p and d.

    Rules of one source that are equal in what the score reads are a class: classes meet, a class of permissions with its
    `top` first ids, and each prohibition takes what its class gets. So pairs grow with the classes of a source, not with
    its rules; a score that reads rule_id makes each rule a class.
    """
    p, d, same = prohibitions.alias("p"), permissions.alias("d"), F.col("p.source") == F.col("d.source")
    of_p, of_d = (list(dict.fromkeys(["source", *x])) for x in columns_read(p, d, same, score))
    place = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    last = F.asc_nulls_last("defense")
    first = permissions.select(*of_d, F.col("rule_id").alias("defense")).withColumn("_n", place(of_d, last)).where(F.col("_n") <= top).drop("_n")
    met = prohibitions.select(*of_p).distinct().alias("p").join(first.alias("d"), same).select(*(F.col(f"p.{x}").alias(f"_class_{x}") for x in of_p), "d.defense", score.alias("score"))
    best = met.withColumn("_n", place([f"_class_{x}" for x in of_p], F.desc("score"), last)).where(F.col("_n") <= top)
    each = prohibitions.select("rule_id", *(x for x in of_p if x != "rule_id"))
    taken = each.join(best, reduce(and_, (F.col(x).eqNullSafe(F.col(f"_class_{x}")) for x in of_p))).select("rule_id", "defense", "score")
    return taken.withColumn("rank", place(["rule_id"], F.desc("score"), last)).where(F.col("rank") <= top)


def subject_scope(facts: DataFrame) -> DataFrame:
    """subject with the union of its facts' constraints (dimension, value)."""
    return facts.select("subject", F.explode("constraints").alias("c")).groupBy("subject").agg(F.sort_array(F.collect_set("c")).alias("scope"))


def with_document_disclosures(facts: DataFrame) -> DataFrame:
    """Each fact's disclosures with those of its whole document, sorted."""
    whole = F.flatten(F.collect_list("disclosures").over(Window.partitionBy("document")))
    return facts.withColumn("disclosures", F.array_sort(F.array_distinct(F.concat("disclosures", whole))))


def gap_matrix(findings: DataFrame) -> DataFrame:
    """rule_id, worst verdict, number of facts, first citation by seq: findings (fact_id, rule_id, verdict, citation, seq)."""
    return findings.groupBy("rule_id").agg(
        verdict_name(F.max(severity(F.col("verdict")))).alias("verdict"), F.countDistinct("fact_id").alias("facts"), F.min_by("citation", "seq").alias("citation")
    )


def report(findings: DataFrame, by: str = "document") -> DataFrame:
    """Counts and the report's verdict: two violations are one, a single one or a review is a review."""
    v, r = F.count_if(F.col("verdict") == "violation"), F.count_if(F.col("verdict") == "needs_review")
    whole = F.when(v >= 2, "violation").when((v > 0) | (r > 0), "needs_review").otherwise("compliant")
    return findings.groupBy(by).agg(F.count("*").alias("n"), v.alias("violations"), r.alias("reviews"), whole.alias("verdict"))


def requirements(extracted: DataFrame, deontic: tuple[str, ...] = ("OBLIGATION", "PROHIBITION", "PERMISSION"), default_actor: str = "any") -> DataFrame:
    """Rules from extracted rows (source, section, text, force, scope array of 'dimension: value', actor): blank texts
    go, an unknown force is an ambiguous OBLIGATION."""
    from docloom.functions.ids import content_id

    force = F.upper(F.btrim("force"))
    known = F.coalesce(force.isin(*deontic), F.lit(False))
    scope = F.transform(F.filter("scope", lambda s: F.contains(s, F.lit(":"))), lambda s: F.struct(F.btrim(F.substring_index(s, ":", 1)).alias("dimension"), F.btrim(F.regexp_replace(s, "^[^:]*:", "")).alias("value")))
    return extracted.where(F.btrim("text") != "").select(
        content_id(F.col("source"), F.col("section"), F.col("text")).alias("rule_id"), "source", "section", F.btrim("text").alias("text"), F.when(known, force).otherwise("OBLIGATION").alias("deontic"),
        F.when(known, "EXTRACTED").otherwise("AMBIGUOUS").alias("confidence"), scope.alias("scope"), F.coalesce(F.nullif(F.btrim("actor"), F.lit("")), F.lit(default_actor)).alias("actor"),
    )
