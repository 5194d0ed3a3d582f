"""Lanes with stand-in models."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval, store
from docloom.plans import lanes


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


@pytest.fixture
def items(spark):
    body = [("d", 0, "paragraph", "before"), ("d", 1, "heading", "One"), ("d", 2, "paragraph", "x" * 50), ("d", 3, "paragraph", "y" * 50), ("d", 4, "title", "Two"), ("d", 5, "paragraph", "z"), ("e", 0, "paragraph", "alone"), ("f", 0, "heading", "H"), ("f", 1, "paragraph", "t")]
    return spark.createDataFrame(body, "doc_id string, pos int, kind string, text string")


def test_structural_boundaries(items):
    assert rows(lanes.structural_boundaries(items)) == [("d", 0, 1), ("d", 1, 4), ("d", 4, 6), ("e", 0, 1), ("f", 0, 2)]


def test_model_boundaries_are_repaired(items):
    def cuts(texts):
        if any("alone" in t for t in texts):
            raise ValueError("no")
        return [[9, 3, 3, -1, 1] for _ in texts]

    assert rows(lanes.model_boundaries(items, cuts)) == [("d", 0, 1), ("d", 1, 3), ("d", 3, 6), ("e", 0, 1), ("f", 0, 1), ("f", 1, 2)]


def test_refined_boundaries_see_large_sections_only(items):
    def cuts(texts):
        assert all(len(t.split("\n")) == 3 and t.startswith("[0] One") for t in texts)
        return [[2, 0, 7] for _ in texts]

    assert rows(lanes.refined_boundaries(items, cuts, cap=60)) == [("d", 0, 1), ("d", 1, 3), ("d", 3, 4), ("d", 4, 6), ("e", 0, 1), ("f", 0, 2)]
    assert rows(lanes.refined_boundaries(items, lambda t: 1 / 0, cap=1000)) == rows(lanes.structural_boundaries(items))


def test_answers(spark):
    ev = spark.createDataFrame([(1, 1, "c1:0:0123abcd", "fact one"), (1, 2, "c1:1:0123abcd", "fact two"), (2, 1, "c2:0:0123abcd", "other")], "query_id int, rank int, id string, text string")
    cited = lambda texts: [f"<answer>so</answer><citations>{re.findall(r'c.:.:[0-9a-f]+', t)[0]}</citations>" for t in texts]
    both = lambda texts: [f"<answer>so</answer><citations>{' '.join(re.findall(r'c.:.:[0-9a-f]+', t))}</citations>" for t in texts]

    def emit(texts):
        assert all("Analysis:\nthought about" in t for t in texts)
        return cited(texts)

    got = lanes.or_abstained(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), lanes.answer_reasoned(ev, lambda ts: [f"thought about {len(t)}" for t in ts], emit))
    assert [(r.query_id, r.answer.kind, r.answer.citations) for r in got.orderBy("query_id").collect()] == [(1, "answered", ["c1:0:0123abcd"]), (2, "answered", ["c2:0:0123abcd"]), (3, "abstained", [])]
    best = lanes.answer_best_of(ev, [cited, both, lambda ts: ["<abstain/>"] * len(ts)]).orderBy("query_id").collect()
    assert [len(r.answer.citations) for r in best] == [2, 1]


def test_query_constraints(spark):
    q = spark.createDataFrame([(1, "a cap of Delaware"), (2, "broken")], "query_id int, text string")

    def extract(texts):
        if "broken" in texts:
            raise ValueError
        return [[("place", "delaware"), ("place", "delaware"), ("kind", "cap")] for _ in texts]

    assert rows(lanes.query_constraints(q, extract)) == [(1, "kind", "cap"), (1, "place", "delaware")]


def test_decided_rules(spark):
    s = spark.createDataFrame([("a", "must pay"), ("b", "a preamble"), ("c", "fails")], "span_id string, text string")

    def decide(texts):
        if "fails" in texts:
            raise ValueError
        return [{"operative": 0.9 if "must" in t else 0.1, "labels": {"loans": 0.8, "cards": 0.2, "ads": 0.6}} for t in texts]

    kept, failed = lanes.decided_rules(s, decide)
    assert [(r.span_id, r.labels) for r in kept.collect()] == [("a", ["ads", "loans"])] and [r.span_id for r in failed.collect()] == ["c"]
    assert [r.x for r in s.select(lanes.needs_more(F.col("text"), ["MUST"]).alias("x")).collect()] == [True, False, False]


def test_dimension_lane(spark):
    s = spark.createDataFrame([("a", "cap", "both"), ("b", "term", "both"), ("c", "cap", "nothing")], "span_id string, function string, text string")
    scope = spark.createDataFrame([("cap", "amount"), ("cap", "place"), ("term", "length")], "function string, dimension string")
    hook = lambda texts: [["x", "y"] if t == "both" else ["none", "x"] for t in texts]
    got = rows(lanes.dimension_lane(s, {"amount": hook, "length": hook, "place": hook}, scope, weak=["place"]))
    assert got == [("a", "amount", "x", "EXTRACTED"), ("a", "amount", "y", "INFERRED"), ("a", "place", "x", "AMBIGUOUS"), ("a", "place", "y", "AMBIGUOUS"), ("b", "length", "x", "EXTRACTED"), ("b", "length", "y", "INFERRED")]


def test_fan_out(spark):
    c = spark.createDataFrame([("c1", "ok"), ("c2", "bad")], "chunk_id string, text string")

    def picky(texts):
        if "bad" in texts:
            raise ValueError
        return [["p"] for _ in texts]

    got = {r.chunk_id: (r.found, r.failed) for r in lanes.fan_out(c, {"z": lambda ts: [["z1", "z2"] for _ in ts], "a": picky}, "string").collect()}
    assert got == {"c1": (["p", "z1", "z2"], []), "c2": (["z1", "z2"], ["a"])}


def test_coreferent(spark):
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    assert rows(lanes.coreferent(c, [])) == rows(c) and rows(lanes.coreferent(c, [lambda d: d.where("key = 'a'")])) == [("a", "A")]
    with pytest.raises(ValueError, match="resolver"):
        lanes.coreferent(c, [lambda d: d.select("key")])


def test_index_on_disk(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    tables = store.Store(spark, f"file://{tmp_path}")
    assert lanes.rebuild_index(tables, "vectors", v) > 0 and set(lanes.warm_index(tables, ["vectors"])) == {"vectors"}
    assert rows(lanes.indexed_leg(tables, "vectors", q, 7)) == rows(retrieval.dense_leg(v, q, 7))
    lanes.rebuild_index(tables, "vectors", v.where("id < 50"))
    assert max(r.id for r in lanes.indexed_leg(tables, "vectors", q, 7).collect()) < 50
