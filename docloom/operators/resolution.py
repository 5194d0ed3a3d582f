"""Entity mentions: clustering, closed-world resolution, near-duplicate flags, fuzzy matching, fragmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import surface_key
from docloom.functions.vectors import certainty_name, doubt, jaccard


def cluster(mentions: DataFrame, key: Column, *, typed: bool = True) -> DataFrame:
    """Clusters of mentions (name, entity_type, confidence, chunk_id, position) by key, and type if asked.

    variants are sorted; the representative is the longest name, the first by position of equal ones; confidence is
    the weakest. A mention with an empty key belongs to none.
    """
    by = ["key", "entity_type"] if typed else ["key"]
    m = mentions.withColumn("key", key).where("key != ''")
    best = F.min_by("name", F.struct(-F.length("name"), "position"))
    aggs = [best.alias("representative"), F.sort_array(F.collect_set("name")).alias("variants")]
    if "confidence" in mentions.columns:
        aggs += [certainty_name(F.max(doubt(F.col("confidence")))).alias("confidence")]
    if "chunk_id" in mentions.columns:
        aggs += [F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids")]
    return m.groupBy(*by).agg(*aggs)


def near_duplicates(clusters: DataFrame, stop_words: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """Pairs of clusters (key_a < key_b) of a type where one's tokens are properly within the other's, or both begin
    alike and share `least` of their tokens. Clusters meet by their
    rarest token, which is among those of whatever holds all their tokens, or by a token of the rare ends of both, of which
    sets that share `least` have one in common; so frequent tokens bring few together."""
    t = F.filter(F.split("key", " "), lambda x: ~x.isin(*stop_words, ""))
    c = clusters.select("key", "entity_type", t.alias("tokens")).where(F.size("tokens") > 0)
    e = c.withColumn("token", F.explode(F.array_distinct("tokens")))
    seen = e.groupBy("entity_type", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity_type", "key")
    e = e.join(seen, ["entity_type", "token"]).withColumn("i", F.row_number().over(w.orderBy("n", "token"))).withColumn("size", F.count("*").over(w))
    prefix = e.where(F.col("i") <= F.col("size") - F.ceil(F.col("size") * least) + 1)

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("a.key") != F.col("b.key")))
        one, two = F.struct(F.col("a.key").alias("key"), F.col("a.tokens").alias("t")), F.struct(F.col("b.key").alias("key"), F.col("b.tokens").alias("t"))
        first = F.col("a.key") < F.col("b.key")
        return met.select(F.col("a.entity_type").alias("entity_type"), F.when(first, one).otherwise(two).alias("x"), F.when(first, two).otherwise(one).alias("y"))

    met = meet(e.where("i = 1"), e).union(meet(prefix, prefix))
    pairs = met.select("entity_type", F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"), F.col("x.t").alias("ta"), F.col("y.t").alias("tb")).distinct()
    sa, sb = F.array_distinct("ta"), F.array_distinct("tb")
    shared = F.size(F.array_intersect(sa, sb))
    within = (F.size(sa) != F.size(sb)) & (shared == F.least(F.size(sa), F.size(sb)))
    alike = (F.element_at("ta", 1) == F.element_at("tb", 1)) & (jaccard(sa, sb) >= least)
    return pairs.where(within | alike).select("entity_type", "key_a", "key_b")


def registry(rows: DataFrame) -> DataFrame:
    """surface key to entity_id from rows (entity_id, name, position); the first row of a key wins."""
    keyed = rows.withColumn("surface", surface_key(F.col("name"))).where("surface != ''")
    return keyed.groupBy("surface").agg(F.min_by("entity_id", "position").alias("entity_id"))


def resolve(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """clusters with entity_id: of the representative, else of the first variant in order that is known; null if none is.
    known: surface, entity_id. The world is closed: nothing is made up."""
    names = F.concat(F.array("representative"), "variants")
    tried = clusters.select("key", "entity_type", F.posexplode(names).alias("n", "name")).withColumn("surface", surface_key(F.col("name")))
    hit = tried.join(known, "surface").groupBy("key", "entity_type").agg(F.min_by("entity_id", "n").alias("entity_id"))
    return clusters.join(hit, ["key", "entity_type"], "left")


def resolve_relations(relations: DataFrame, resolved: DataFrame, known: DataFrame, key) -> DataFrame:
    """relations (src_name, dst_name, ...) with src_key, src_id, dst_key, dst_id. A name of a cluster takes the cluster's
    id even if that is null; other names are looked up. Of clusters with one key the last type counts. Edges whose ends
    resolve to one id go; two unresolved ends stay."""
    last = resolved.groupBy("key").agg(F.max_by("entity_id", "entity_type").alias("_id"), F.lit(True).alias("_found"))
    out = relations
    for side in ("src", "dst"):
        out = out.withColumn(f"{side}_key", key(F.col(f"{side}_name"))).withColumn("_surface", surface_key(F.col(f"{side}_name")))
        out = out.join(last.withColumnRenamed("key", f"{side}_key"), f"{side}_key", "left").join(known.withColumnRenamed("surface", "_surface").withColumnRenamed("entity_id", "_known"), "_surface", "left")
        out = out.withColumn(f"{side}_id", F.when(F.col("_found"), F.col("_id")).otherwise(F.col("_known"))).drop("_id", "_found", "_known", "_surface")
    return out.where(~F.coalesce(F.col("src_id") == F.col("dst_id"), F.lit(False)))


def private_ids(resolved: DataFrame, private: DataFrame) -> DataFrame:
    """resolved with ids 'PRIVATE:<key>' for clusters without one whose key is in private (key)."""
    p = private.select("key").distinct().withColumn("_private", F.concat(F.lit("PRIVATE:"), "key"))
    return resolved.join(p, "key", "left").withColumn("entity_id", F.coalesce("entity_id", "_private")).drop("_private")


def fragmentation(assigned: DataFrame) -> DataFrame:
    """Share of gold entities in more than one node, from assigned (gold, node); 0 without gold."""
    per = assigned.where("gold is not null").groupBy("gold").agg(F.countDistinct("node").alias("nodes"))
    return per.agg(F.coalesce(F.avg((F.col("nodes") > 1).cast("double")), F.lit(0.0)).alias("rate"), F.count("*").alias("n"))


def exact_matches(names: DataFrame, rows: DataFrame) -> DataFrame:
    """names (name) with the entity_id of the first row of rows (entity_id, name, position) with the same surface key."""
    return names.withColumn("surface", surface_key(F.col("name"))).join(registry(rows), "surface", "left")


def fuzzy_matches(names: DataFrame, rows: DataFrame, *, least: float = 0.34, top: int = 3) -> DataFrame:
    """The `top` rows (entity_id, title) of each name by token overlap of `least` or more, by (-score, title)."""
    a = names.select("name", F.array_distinct(F.split(surface_key(F.col("name")), " ")).alias("ta"))
    b = rows.select("entity_id", "title", F.array_distinct(F.split(surface_key(F.col("title")), " ")).alias("tb"))
    shared = a.withColumn("t", F.explode("ta")).where("t != ''").join(b.withColumn("t", F.explode("tb")), "t").groupBy("name", "entity_id", "title").agg(F.count("*").alias("n"), F.first(F.size("ta")).alias("na"), F.first(F.size("tb")).alias("nb"))
    score = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    out = shared.where(score >= least).withColumn("score", F.round(score, 3))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "title", "entity_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= top).select("name", "rank", "entity_id", "title", "score")


def to_graph(resolved: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by node key, the last cluster by (key, type) of each, with a bare node for ends that no cluster has; edges."""
    key = lambda i, k: F.coalesce(F.nullif(F.col(i), F.lit("")), F.concat(F.lit("UNLINKED:"), F.col(k)))
    own = resolved.select(key("entity_id", "key").alias("node"), F.col("representative").alias("name"), "entity_type", F.lit(1).alias("p"), F.struct("key", "entity_type").alias("o"))
    ends = [relations.select(key(f"{s}_id", f"{s}_key").alias("node"), F.col(f"{s}_name").alias("name"), F.lit(None).cast("string").alias("entity_type"), F.lit(0).alias("p"), F.struct(F.col(f"{s}_key").alias("key"), F.lit("").alias("entity_type")).alias("o")) for s in ("src", "dst")]
    every = own.unionByName(ends[0]).unionByName(ends[1])
    nodes = every.groupBy("node").agg(F.max_by(F.struct("name", "entity_type"), F.struct("p", "o")).alias("x")).select("node", "x.name", "x.entity_type")
    return nodes, relations.select(key("src_id", "src_key").alias("src"), key("dst_id", "dst_key").alias("dst"), *(c for c in relations.columns if not c.startswith(("src_", "dst_"))))


def party_pairs(parties: DataFrame) -> DataFrame:
    """Every pair of a chunk's parties (chunk_id, name, position) in order, as CONTRACTS_WITH."""
    a, b = parties.alias("a"), parties.alias("b")
    met = a.join(b, (F.col("a.chunk_id") == F.col("b.chunk_id")) & (F.col("a.position") < F.col("b.position")))
    return met.select(F.col("a.chunk_id").alias("chunk_id"), F.col("a.name").alias("src_name"), F.col("b.name").alias("dst_name"), F.lit("CONTRACTS_WITH").alias("relationship_type"))


def affiliations(facts: DataFrame) -> DataFrame:
    """facts (chunk_id, name, affiliate) without blank ends and those that name themselves, case aside."""
    a, b = F.btrim("name"), F.btrim("affiliate")
    return facts.where((a != "") & (b != "") & (F.lower(a) != F.lower(b))).distinct()
