"""Evaluation scorers: gold left-joined to predictions, one row of gates and diagnostics each, plus detail tables.

gold has item_id; predictions have item_id and are fewer at times: a missing one is an error and counts as wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import lenient_key, squad_key


def passed(gates: dict[str, float]) -> Column:
    """Every gate has a value and reaches its threshold."""
    out = F.lit(True)
    for name, least in gates.items():
        out = out & F.coalesce(F.col(name) >= F.lit(least), F.lit(False))
    return out


def class_recall(gold: DataFrame, predictions: DataFrame, k: int = 1) -> DataFrame:
    """label, n, recall at k: gold (item_id, labels), predictions (item_id, ranked)."""
    both = gold.join(predictions.select("item_id", "ranked"), "item_id", "left")
    top = F.slice(F.coalesce("ranked", F.array().cast("array<string>")), 1, k)
    each = both.select(F.explode("labels").alias("label"), top.alias("top"))
    return each.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.array_contains("top", F.col("label")).cast("double")).alias("recall"))


def classification(gold: DataFrame, predictions: DataFrame, *, floor: float, k: int = 1, top1_floor: float | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: the least recall of the classes that aren't excluded, top-1 accuracy, errors and whether it passed."""
    per = class_recall(gold, predictions, k).where(~F.col("label").isin(*exclude) if exclude else F.lit(True))
    gated = per.agg(F.min("recall").alias("min_class_recall"), F.avg("recall").alias("mean_class_recall"))
    p = predictions.select("item_id", "ranked", F.lit(True).alias("_has"))
    both = gold.join(p, "item_id", "left")
    ranked = F.coalesce("ranked", F.array().cast("array<string>"))
    right = F.coalesce(F.array_contains("labels", F.get(ranked, F.lit(0))), F.lit(False))
    whole = both.agg(F.count("*").alias("n"), F.count_if(F.col("_has").isNull()).alias("errors"), F.avg(right.cast("double")).alias("top1_accuracy"), F.avg(F.least(F.size(ranked), F.lit(k)).cast("double")).alias("tags_per_item"))
    gates = {"min_class_recall": floor} | ({"top1_accuracy": top1_floor} if top1_floor is not None else {})
    return gated.crossJoin(whole).withColumn("passed", passed(gates))


def confusions(gold: DataFrame, predictions: DataFrame, most: int = 50) -> DataFrame:
    """gold label, predicted label, count of wrong top predictions; most frequent first, then by name."""
    both = gold.join(predictions, "item_id").withColumn("p", F.get("ranked", F.lit(0))).where("p is not null").where(~F.array_contains("labels", F.col("p")))
    n = both.groupBy(F.get("labels", F.lit(0)).alias("gold"), F.col("p").alias("predicted")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "gold", "predicted").limit(most)


def graded_gain(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """item_id, ndcg at k from ranked (item_id, id, rank) and grades (item_id, id, grade): gain 2**grade - 1 over
    log2(rank + 1), against the ideal order of every graded id; 0 where the ideal is 0."""
    gain = lambda r: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(r) + 1)
    dcg = ranked.where(F.col("rank") <= k).join(grades, ["item_id", "id"]).groupBy("item_id").agg(F.sum(gain("rank")).alias("dcg"))
    ideal = grades.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("grade"), "id"))).where(F.col("r") <= k).groupBy("item_id").agg(F.sum(gain("r")).alias("idcg"))
    return ideal.join(dcg, "item_id", "left").select("item_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def item_recall(ranked: DataFrame, grades: DataFrame, k: int | None, least: int = 1) -> DataFrame:
    """item_id, relevant, found, recall of the items with something relevant."""
    rel = grades.where(F.col("grade") >= least).select("item_id", "id").distinct()
    top = (ranked.where(F.col("rank") <= k) if k else ranked).select("item_id", "id").distinct().withColumn("_hit", F.lit(1))
    return rel.join(top, ["item_id", "id"], "left").groupBy("item_id").agg(F.count("*").alias("relevant"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("relevant"))


def retrieval(gold: DataFrame, grades: DataFrame, ranked: DataFrame, *, k: int, recall: float, least: int = 1, ndcg_k: int = 10) -> DataFrame:
    """One row: mean recall at k over items with something relevant, nDCG, items left out, errors."""
    per = item_recall(ranked, grades, k, least)
    gain = graded_gain(ranked, grades, ndcg_k)
    answered = ranked.select("item_id").distinct().withColumn("_has", F.lit(True))
    every = gold.select("item_id").join(per, "item_id", "left").join(gain, "item_id", "left").join(answered, "item_id", "left")
    out = every.agg(
        F.count("*").alias("n"), F.count("recall").alias("scored"), F.count_if(F.col("_has").isNull()).alias("errors"), F.avg("recall").alias("recall"),
        F.avg(F.when(F.col("recall").isNotNull(), F.coalesce("ndcg", F.lit(0.0)))).alias("ndcg"),
    )
    return out.withColumn("passed", passed({"recall": recall}))


def different(items: DataFrame, key: Column) -> DataFrame:
    """item_id, text, key: the first spelling, by position, of each normalised form; empty forms go."""
    k = items.withColumn("key", key).where("key != ''")
    return k.groupBy("item_id", "key").agg(F.min_by("text", "position").alias("text"))


def extraction_hits(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """item_id, n_gold, found, n_out, kept over items with gold: gold and predicted are (item_id, text, position)."""
    g, p = different(gold, lenient_key(F.col("text"))), different(predicted, lenient_key(F.col("text")))
    met = g.select("item_id", F.col("key").alias("gk")).join(p.select("item_id", F.col("key").alias("pk")), "item_id").where(F.contains("gk", F.col("pk")) | F.contains("pk", F.col("gk")))
    found = met.groupBy("item_id").agg(F.countDistinct("gk").alias("found"), F.countDistinct("pk").alias("kept"))
    out = p.groupBy("item_id").agg(F.count("*").alias("n_out"))
    return g.groupBy("item_id").agg(F.count("*").alias("n_gold")).join(found, "item_id", "left").join(out, "item_id", "left").fillna(0, ["found", "kept", "n_out"]).select("item_id", "n_gold", "found", "n_out", "kept")


def extraction(gold: DataFrame, predicted: DataFrame, *, recall: float, precision: float, average: str = "micro") -> DataFrame:
    """One row: recall and precision, apart, pooled (micro) or as means over items (macro), F1 and whether both passed."""
    h = extraction_hits(gold, predicted)
    if average == "macro":
        r, p = F.avg(F.col("found") / F.col("n_gold")), F.avg(F.when(F.col("n_out") > 0, F.col("kept") / F.col("n_out")).otherwise(0.0))
    else:
        r, p = F.try_divide(F.sum("found"), F.sum("n_gold")), F.try_divide(F.sum("kept"), F.sum("n_out"))
    out = h.agg(F.count("*").alias("n"), r.alias("recall"), p.alias("precision"))
    f1 = F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))
    return out.withColumn("f1", f1).withColumn("passed", passed({"recall": recall, "precision": precision}))


def length_groups(items: DataFrame, groups: int = 4) -> DataFrame:
    """grp, n, least and most length, recall over up to four equal groups of items (item_id, chars, found, n_gold) by
    length. Group g has the places from g*n/G up to (g+1)*n/G, which isn't what ntile does."""
    w = Window.orderBy("chars", "found", "n_gold", "item_id")
    every = Window.partitionBy()
    at = items.withColumn("i", F.row_number().over(w) - 1).withColumn("n_all", F.count("*").over(every))
    g = F.least(F.lit(groups), F.col("n_all"))
    at = at.withColumn("grp", (F.floor(((F.col("i") + 1) * g + F.col("n_all") - 1) / F.col("n_all")) - 1).cast("int"))
    return at.groupBy("grp").agg(F.count("*").alias("n"), F.min("chars").alias("least"), F.max("chars").alias("most"), F.try_divide(F.sum("found"), F.sum("n_gold")).alias("recall"))


def judged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold (item_id, expected, ...) with verdict, score and whether there is an answer."""
    return gold.join(predictions.select("item_id", "verdict", *(["score"] if "score" in predictions.columns else []), F.lit(True).alias("answered")), "item_id", "left").fillna(False, ["answered"])


def rates(rows: DataFrame, actionable: str, *by: str) -> DataFrame:
    """n, errors, accuracy, precision, recall and false-alarm rate of the actionable verdict, whole or by group."""
    ok, e, v = F.col("answered"), F.col("expected"), F.col("verdict")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    hit, called, wanted = n(ok & (e == actionable) & (v == actionable)), n(ok & (v == actionable)), n(e == actionable)
    out = rows.groupBy(*by) if by else rows
    return out.agg(
        F.count("*").alias("n"), n(~ok).alias("errors"), F.try_divide(n(ok & (e == v)), F.count("*")).alias("accuracy"), F.try_divide(hit, called).alias("precision"),
        F.try_divide(hit, wanted).alias("recall"), F.try_divide(n(ok & (v == actionable) & (e != actionable)), n(e != actionable)).alias("false_alarm_rate"),
    )


def judgment(gold: DataFrame, predictions: DataFrame, *, actionable: str, precision: float, recall: float) -> DataFrame:
    return rates(judged(gold, predictions), actionable).withColumn("passed", passed({"precision": precision, "recall": recall}))


def calibration(rows: DataFrame, label: str) -> DataFrame:
    """bin, n, share of `label` among the expected by fifths of the score; the last bin is closed."""
    s = F.col("score")
    fifth = F.when(s < 0.2, 0).when(s < 0.4, 1).when(s < 0.6, 2).when(s < 0.8, 3).otherwise(4)
    return rows.where((s >= 0) & (s <= 1)).groupBy(fifth.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("expected") == label).cast("double")).alias("share"))


def relational(gold: DataFrame, reached: DataFrame, *, recall: float, by: str | None = None) -> DataFrame:
    """Mean recall of the answer sets: gold (item_id, id, ...), reached (item_id, id); whole, or by a column of gold."""
    g = gold.select("item_id", "id", *([by] if by else [])).distinct()
    r = reached.select("item_id", "id").distinct().withColumn("_hit", F.lit(1))
    per = g.join(r, ["item_id", "id"], "left").groupBy("item_id", *([by] if by else [])).agg((F.count("_hit") / F.count("*")).alias("r"))
    out = per.groupBy(by) if by else per
    return out.agg(F.count("*").alias("n"), F.avg("r").alias("recall")).withColumn("passed", passed({"recall": recall}))


def generation(gold: DataFrame, predictions: DataFrame, *, citation_recall: float, abstention: float) -> DataFrame:
    """Citation recall over answerable items and abstention over the others: gold (item_id, cites array), an empty one is
    unanswerable; predictions (item_id, cites array, abstained). A missing answer has recall 0 and isn't an abstention."""
    p = predictions.select("item_id", F.col("cites").alias("_cites"), "abstained")
    both = gold.join(p, "item_id", "left")
    answerable = F.size("cites") > 0
    got = F.size(F.array_intersect("cites", F.coalesce("_cites", F.array().cast("array<string>")))) / F.size(F.array_distinct("cites"))
    none = F.coalesce(F.col("abstained"), F.lit(False))
    out = both.agg(
        F.count("*").alias("n"), F.count_if(F.col("abstained").isNull()).alias("errors"), F.avg(F.when(answerable, got)).alias("citation_recall"),
        F.avg(F.when(~answerable, none.cast("double"))).alias("abstention"),
    )
    return out.withColumn("passed", passed({"citation_recall": citation_recall, "abstention": abstention}))


def candidate_choice(gold: DataFrame, candidates: DataFrame, chosen: DataFrame, ignore: DataFrame) -> DataFrame:
    """Coverage of gold values by candidates, recall and precision of the chosen; all (item_id, text). Chosen values that
    match an ignored one count neither way."""
    key = lambda d, n: d.select("item_id", lenient_key(F.col("text")).alias(n)).where(f"{n} != ''").distinct()
    g, c, v, i = key(gold, "g"), key(candidates, "c"), key(chosen, "v"), key(ignore, "i")
    meets = lambda a, b: F.contains(a, F.col(b)) | F.contains(b, F.col(a))
    v = v.join(i, (v.item_id == i.item_id) & meets("v", "i"), "left_anti")
    covered = g.join(c, (g.item_id == c.item_id) & meets("g", "c"), "left_semi").agg(F.count("*").alias("covered"))
    found = g.join(v, (g.item_id == v.item_id) & meets("g", "v"), "left_semi").agg(F.count("*").alias("found"))
    right = v.join(g, (g.item_id == v.item_id) & meets("v", "g"), "left_semi").agg(F.count("*").alias("right"))
    sums = g.agg(F.count("*").alias("n_gold")).crossJoin(v.agg(F.count("*").alias("n_chosen"))).crossJoin(covered).crossJoin(found).crossJoin(right)
    return sums.select(F.try_divide("covered", F.col("n_gold")).alias("coverage"), F.try_divide("found", F.col("n_gold")).alias("recall"), F.try_divide("right", F.col("n_chosen")).alias("precision"))


def choice(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """label, n, accuracy: an item is right if its choice is among the accepted; its label is the first of them."""
    both = gold.join(predictions, "item_id", "left")
    right = F.coalesce(F.array_contains("accepted", F.col("choice")), F.lit(False))
    return both.groupBy(F.get("accepted", F.lit(0)).alias("label")).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def over_repeats(runs: DataFrame, gate: str) -> DataFrame:
    """The least value of a gate over repeats (repeat, <gate>, passed), null if any is; passed if all are."""
    return runs.agg(F.when(F.count_if(F.col(gate).isNull()) == 0, F.min(gate)).alias(gate), F.every("passed").alias("passed"), F.count("*").alias("repeats"))


def flips(outputs: DataFrame) -> DataFrame:
    """Items whose answered repeats (item_id, repeat, output; null is an error) differ, and errors."""
    return outputs.groupBy("item_id").agg(F.countDistinct("output").alias("n"), F.count_if(F.col("output").isNull()).alias("errors")).select("item_id", (F.col("n") > 1).alias("flipped"), "errors")


def token_overlap(pairs: DataFrame) -> DataFrame:
    """id, precision, recall, f1 of words of predicted and gold texts (id, predicted, gold), repeats counted."""
    words = lambda c: F.filter(F.split(squad_key(F.col(c)), " "), lambda w: w != "")
    count = lambda c, n: pairs.select("id", F.explode(words(c)).alias("w")).groupBy("id", "w").agg(F.count("*").alias(n))
    both = count("predicted", "p").join(count("gold", "g"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("p", "g")).alias("same"))
    sizes = pairs.select("id", F.size(words("predicted")).alias("np"), F.size(words("gold")).alias("ng"))
    out = sizes.join(both, "id", "left").fillna(0, ["same"])
    p, r = F.coalesce(F.try_divide("same", F.col("np")), F.lit(0.0)), F.coalesce(F.try_divide("same", F.col("ng")), F.lit(0.0))
    return out.select("id", p.alias("precision"), r.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
