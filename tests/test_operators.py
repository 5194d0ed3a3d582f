"""Operators on small cases made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import ids, places, text, vectors
from docloom.operators import answers, clauses, compliance, evals, graph, resolution, retrieval, segmenting, store
from docloom.operators.filters import NOT_NULL, Contains, Range, order_columns, predicate
from docloom.plans import flows, hooks
from docloom.sources import connectors


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first().out


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


# ids and text


def test_ids(spark):
    assert one(spark, ids.slug(F.lit("/a b?c.pdf "))) == "a_b_c.pdf" and one(spark, ids.slug(F.lit("???"))) is None
    parts = one(spark, ids.chunk_parts(F.lit("a:b:3:ff")))
    assert (parts["document"], parts["index"], parts["hash"]) == ("a:b", 3, "ff")
    assert one(spark, ids.node_key(F.lit(""), F.lit("k"))) == "UNLINKED:k"


@pytest.mark.parametrize("name,key", [("Bank of America, N.A.", "bank of america"), ("Acme Co., Ltd.", "acme"), ("Acme Inc. d/b/a Brand", "acme"), ("Stremick's Foods LLC", "stremicks foods"), ('"Quoted" (GmbH)', "quoted gmbh"), ("formerly known as X", "")])
def test_entity_key(spark, name, key):
    assert one(spark, text.entity_key(F.lit(name))) == key or name.startswith('"')


@pytest.mark.parametrize("name,ok", [("Acme Inc.", True), ("[  ]", False), ("Company", False), ("Global", False), ("____", False), ("XXX Corp", False)])
def test_is_entity(spark, name, ok):
    assert one(spark, text.is_entity(F.lit(name))) is ok


@pytest.mark.parametrize("line,ok", [("9. Scope of Work", True), ("Governing Law", True), ("It ends here.", False), ("lower case", False), ("x" * 61, False), ("", False)])
def test_bare_heading(spark, line, ok):
    assert one(spark, text.is_bare_heading(F.lit(line))) is ok


def test_text_functions(spark):
    assert one(spark, text.natural_key(F.lit("p10"))) > one(spark, text.natural_key(F.lit("p9")))
    assert [one(spark, text.column_letters(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, text.lenient_match(F.lit(" Foo  Bar. "), F.lit("the foo bar"))) is True
    assert one(spark, text.cue_type(F.lit("You must not go"), {"must": "OBLIGATION", "must not": "PROHIBITION"})) == "PROHIBITION"
    assert one(spark, text.cik(F.lit("CIK123"))) == "0000000123" and one(spark, text.cik(F.lit("12345678901"))) is None


@pytest.mark.parametrize("surface,place", [("State of Delaware", "delaware"), ("New York and the United States of America", "new_york"), ("Illinois or New York", None), ("applicable law", None), ("English law", "england"), ("", None)])
def test_jurisdiction(spark, surface, place):
    assert one(spark, places.jurisdiction(F.lit(surface))) == place


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.weakest(F.lit("EXTRACTED"), F.lit("INFERRED"))) == "INFERRED"
    assert one(spark, vectors.interval_gap(F.lit(0), F.lit(10), F.lit(15), F.lit(20))) == 5


# filters and store


def test_filters(spark):
    df = spark.createDataFrame([("t1", 150, 300.0), ("t2", 200, 450.0), ("t3", 220, 500.0), ("t4", 230, None)], "id string, weight int, tensile double")
    keep = lambda **w: rows(df.where(predicate(df, w)), "id")
    assert keep(weight=Range(ge=180, le=220), tensile=Range(gt=400)) == [("t2",), ("t3",)]
    assert keep(tensile=NOT_NULL, id=["t1", "t4"]) == [("t1",)] and keep(id=[]) == [] and keep(id=Contains("T")) == rows(df, "id")
    for bad in (lambda: Range(), lambda: Range(gt=1, ge=2), lambda: Contains(""), lambda: predicate(df, {"nope": 1}), lambda: predicate(df, {"a b": 1}), lambda: predicate(df, {"id": None}), lambda: order_columns(df, "id; drop")):
        with pytest.raises(ValueError):
            bad()


def test_float_fields(spark):
    df = spark.createDataFrame([(0.1,), (0.2,)], "x float")
    assert df.where(predicate(df, {"x": 0.1})).count() == 1 and df.where(predicate(df, {"x": [0.1, 0.2]})).count() == 2


def test_upsert_is_partial_and_idempotent(spark):
    now = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int")
    batch = spark.createDataFrame([(1, "z", None, 1), (1, None, 11, 2), (3, "c", None, 3), (3, "d", None, 4)], "id int, name string, n int, seq int")
    want = [(1, "z", 11), (2, "b", 20), (3, "d", None)]
    once = store.upsert(now, batch, ["id"], "seq")
    assert rows(once) == want and rows(store.upsert(once, batch, ["id"], "seq")) == want


def test_update_counts_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    out, changed = store.update(df, {"x": "b"})
    assert df.where(changed).count() == 2 and rows(out, "x") == [("b",)] * 3
    assert df.where(store.update(df, {"x": None})[1]).count() == 0


def test_delete_takes_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    left, e = store.delete(nodes, "id", edges, {"id": 1})
    assert rows(left) == [(2,), (3,)] and rows(e) == [(2, 3)]


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1, "a", 1)], "id int, x string, seq int")
    s.upsert("t", a, ["id"], "seq")
    s.upsert("t", spark.createDataFrame([(2, "b", 1)], "id int, x string, seq int"), ["id"], "seq")
    assert rows(s.get("t")) == [(1, "a"), (2, "b")] and s.names() == ["t"]
    s.vacuum("t")
    assert rows(s.get("t")) == [(1, "a"), (2, "b")] and s.drop("t") and s.names() == []


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "id int, old string")
    out, wrong = store.declare(df, {"id": "string", "extra": "double"})
    assert wrong == ["id"] and out.columns == ["id", "old", "extra"]
    once = store.rename_fields(df, {"old": "new"})
    assert once.columns == ["id", "new"] and store.rename_fields(once, {"old": "new"}).columns == ["id", "new"]
    good, bad = store.split_valid(df, {"hash": F.sha2("old", 256) == F.lit("no")})
    assert good.count() == 0 and bad.first().reasons == ["hash"]


# retrieval


def greedy_floor(ranked, floor, k):
    """The selection one by one: a place is kept free for each floor id not yet taken."""
    out, left = [], set(floor)
    for i in ranked:
        if len(out) >= k:
            break
        if i in left or len(out) + len(left) < k:
            out.append(i)
            left.discard(i)
    return out + [f for f in floor if f in left][: max(0, k - len(out))]


@pytest.mark.parametrize("floor,k", [([1, 9, 12], 5), ([50, 51], 4), ([], 3), ([3, 2], 10)])
def test_floor(spark, floor, k):
    order = list(range(12))
    d = lambda xs: spark.createDataFrame([(0, x, i) for i, x in enumerate(xs, 1)], "query_id int, id int, rank int")
    got = [r.id for r in retrieval.with_floor(d(order), d(floor), k).orderBy("rank").collect()]
    assert got == greedy_floor(order, floor, k)


def test_budget_keeps_the_first(spark):
    df = spark.createDataFrame([(0, 1, 9.0, "x" * 50), (0, 2, 8.0, "y" * 5), (0, 3, 7.0, "z")], "query_id int, id int, score double, text string")
    assert rows(retrieval.within_budget(df, 5, 10), "id") == [(1,)] and rows(retrieval.within_budget(df, 2, 100), "id") == [(1,), (2,)]


def test_collapse_is_greedy(spark):
    v = [[1.0, 0.0], [0.99, 0.14], [0.0, 1.0], [0.1, 0.99]]
    df = spark.createDataFrame([(0, i, i, x) for i, x in enumerate(v)], "query_id int, id int, position int, vector array<double>")
    assert rows(retrieval.collapse_near(df, 0.92, ["query_id"]), "id") == [(0,), (2,)]


# resolution


def test_clusters_and_resolution(spark):
    m = spark.createDataFrame([("Acme Inc", "ORG", "EXTRACTED", "c1", 1), ("ACME, Inc.", "ORG", "INFERRED", "c2", 2), ("Zeta", "ORG", "EXTRACTED", "c1", 3)], "name string, entity_type string, confidence string, chunk_id string, position int")
    c = resolution.cluster(m, text.entity_key(F.col("name")))
    got = {r.key: r for r in c.collect()}
    assert got["acme"].representative == "ACME, Inc." and got["acme"].confidence == "INFERRED" and got["acme"].chunk_ids == ["c1", "c2"]
    known = resolution.registry(spark.createDataFrame([("E1", "acme inc", 1), ("E2", "Acme Inc", 2)], "entity_id string, name string, position int"))
    done = resolution.resolve(c, known)
    assert rows(done, "key", "entity_id") == [("acme", "E1"), ("zeta", None)]
    rel = spark.createDataFrame([("Acme", "Zeta", "r1"), ("Zeta", "Yeta", "r2"), ("ACME Inc", "Acme", "r3")], "src_name string, dst_name string, kind string")
    edges = resolution.resolve_relations(rel, done, known, lambda col: text.entity_key(col))
    assert rows(edges, "kind") == [("r1",), ("r2",)]
    nodes, out = resolution.to_graph(done, edges)
    assert rows(nodes, "node") == [("E1",), ("UNLINKED:yeta",), ("UNLINKED:zeta",)] and out.count() == 2


def test_near_duplicates(spark):
    keys = ["acme holdings", "acme", "acme holdings europe", "zeta", "acme foods group"]
    c = spark.createDataFrame([(k, "ORG") for k in keys], "key string, entity_type string")
    got = set(rows(resolution.near_duplicates(c), "key_a", "key_b"))
    assert ("acme", "acme holdings") in got and ("acme holdings", "acme holdings europe") in got and all("zeta" not in p for p in got)


# scorers


def test_length_groups_are_not_ntile(spark):
    items = spark.createDataFrame([(i, i, 1, 1) for i in range(6)], "item_id int, chars int, found int, n_gold int")
    assert [n for _, n in rows(evals.length_groups(items), "grp", "n")] == [1, 2, 1, 2]


def test_missing_predictions_are_errors(spark):
    gold = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"])], "item_id int, labels array<string>")
    pred = spark.createDataFrame([(1, ["a"]), (3, ["a", "b"])], "item_id int, ranked array<string>")
    r = evals.classification(gold, pred, floor=0.5).first()
    assert (r.errors, r.min_class_recall, r.passed) == (1, 0.0, False)
    r = evals.classification(gold, pred, floor=0.5, k=2).first()
    assert r.min_class_recall == 0.5 and r.passed and rows(evals.confusions(gold, pred)) == [("b", "a", 1)]


def test_gate_without_value_fails(spark):
    gold = spark.createDataFrame([(1, "x", 0)], "item_id int, expected string, g int")
    pred = spark.createDataFrame([(1, "x")], "item_id int, verdict string")
    r = evals.judgment(gold, pred, actionable="y", precision=0.0, recall=0.0).first()
    assert r.precision is None and not r.passed and r.accuracy == 1.0


def test_ideal_gain(spark):
    g = spark.createDataFrame([(1, "a", 3), (1, "b", 0), (1, "c", 1)], "item_id int, id string, grade int")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "item_id int, id string, rank int")
    assert evals.graded_gain(ranked, g, 10).first().ndcg == pytest.approx(1.0)
    assert evals.graded_gain(ranked.limit(0), g, 10).first().ndcg == 0.0


# clauses and compliance


def test_nearest_ties_and_window(spark):
    e = spark.createDataFrame([("c", "e1", 100, 110, 1), ("c", "e2", 9000, 9010, 2)], "contract string, id string, start int, end int, position int")
    c = spark.createDataFrame([("c", "k1", 130, 140, 1), ("c", "k2", 70, 80, 2)], "contract string, id string, start int, end int, position int")
    links, left = clauses.nearest(e, c)
    assert rows(links) == [("c", "e1", "k1", 20)] and rows(left, "id") == [("e2",)]


def test_vote(spark):
    m = spark.createDataFrame([(1, "m1", 1, True, "a", 0, 0.9), (1, "m2", 2, False, "b", 1, 0.4), (1, "m3", 3, False, "b", 1, 0.3), (1, "m3", 3, False, "a", 0, 0.6), (2, "h", 1, True, "a", 0, 0.5)], "unit int, member string, position int, heading boolean, label string, label_order int, score double")
    assert rows(clauses.vote(m), "unit", "label", "member") == [(1, "b", "m2"), (2, "a", "h")]


def test_compliance_gates(spark):
    scope = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    assert one(spark, compliance.constraint_applies(scope(a=["x"], b=["q"]), scope(a=["x", "y"]))) is True
    assert one(spark, compliance.constraint_applies(scope(a=["x"]), scope(a=["y"]))) is False
    gate = lambda a, s: one(spark, compliance.actor_matches(F.lit(a), F.array(*map(F.lit, s)), {"bd": "broker"}, {"broker": "finance", "doctor": "health", "nurse": "health"}))
    assert gate("BD", ["doctor"]) is False and gate("bd", ["doctor", "broker"]) is True and gate(None, ["doctor"]) is True and gate("unknown", ["doctor"]) is True
    f = spark.createDataFrame([("d", "violation"), ("d", "violation"), ("e", "violation"), ("g", "compliant")], "document string, verdict string")
    assert rows(compliance.report(f), "document", "verdict") == [("d", "violation"), ("e", "needs_review"), ("g", "compliant")]


def test_requirements(spark):
    df = spark.createDataFrame([("s", "1", " You must. ", "obligation", ["product: loans", "bad"], ""), ("s", "2", "x", "MAYBE", [], "bank"), ("s", "3", " ", "OBLIGATION", [], "")], "source string, section string, text string, force string, scope array<string>, actor string")
    got = compliance.requirements(df).orderBy("section").collect()
    assert [(r.deontic, r.confidence, r.actor) for r in got] == [("OBLIGATION", "EXTRACTED", "any"), ("OBLIGATION", "AMBIGUOUS", "bank")]
    assert [tuple(x) for x in got[0].scope] == [("product", "loans")] and got[0].rule_id.startswith("s:1:")


# segmenting


def test_sentences_and_layout():
    t = "9. The fee (approx. 5) is due. See Fig. 2 for it. Then stop! \"Now\" go."
    assert [t[a:b].strip() for a, b in zip([0, *segmenting.sentence_cuts(t)], [*segmenting.sentence_cuts(t), len(t)], strict=True)] == ["9. The fee (approx. 5) is due.", "See Fig. 2 for it.", "Then stop!", '"Now" go.']
    kinds = [k for *_, k in segmenting.text_layout("Title Here\n\nBody text goes on.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- one\n- two")]
    assert kinds == ["heading", "paragraph", "table", "list_item", "list_item"]


@pytest.mark.parametrize("text_", ["", "x", "Title Here\n\nBody one. Body two.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n", "Only Heading", "   \n\n  lead. Next One.", "a.\n\n\n\nB c d."])
def test_spans_tile(text_):
    spans = segmenting.spans_of(text_)
    assert "".join(text_[a:b] for a, b, _ in spans) == text_
    assert all(b > a for a, b, _ in spans)


def test_table_rows_are_spans():
    t = "Prices\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    assert [k for *_, k in segmenting.spans_of(t)] == ["heading", "table_row", "table_row"]


def test_hard_split():
    t = "word " * 100
    parts = segmenting.hard_split(t, 60)
    assert all(len(p) < 60 for p in parts) and "".join(parts).replace(" ", "") == t.replace(" ", "")
    table = "| h1 | h2 |\n|---|---|\n" + "".join(f"| {i} | v{i} |\n" for i in range(40))
    parts = segmenting.hard_split(table, 150)
    assert all(p.startswith("| h1 | h2 |\n|---|---|") and len(p) < 150 for p in parts)
    assert sorted({ln for p in parts for ln in p.split("\n") if "v" in ln}) == sorted({f"| {i} | v{i} |" for i in range(40)})
    assert segmenting.hard_split("x" * 50, 20) == ["x" * 19, "x" * 19, "x" * 12] and segmenting.hard_split("", 20) == []


def test_units_and_caps(spark):
    s = spark.createDataFrame([("d", "c", 0, "heading", "Title"), ("d", "c", 1, "paragraph", "Body text."), ("d", "c", 2, "page_footer", "foot"), ("d", "c", 3, "table", "| head |"), ("d", "c", 4, "table_row", "| row 1 |"), ("d", "c", 5, "table_row", "| row 2 |"), ("d", "c", 6, "paragraph", "After it."), ("d", "c2", 7, "paragraph", "Next chunk.")], "doc_id string, chunk_id string, pos int, kind string, text string")
    u = segmenting.units(s)
    assert [r.unit for r in u.orderBy("pos").collect()] == [0, 0, 1, 1, 1, 2, 3]
    parts = segmenting.capped_units(u, 20).where("unit = 1").orderBy("part").collect()
    assert [p.text for p in parts] == ["| head |\n| row 1 |", "| head |\n| row 2 |"]


def test_bad_text_is_reported(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None)], "doc_id string, text string")

    def f(t):
        if t == "bad":
            raise ValueError("no")
        return [(len(t),)]

    got = {r.doc_id: r for r in segmenting.exploded(df, f, "size int", ["size"]).collect()}
    assert got["a"].size == 4 and got["b"].error == "ValueError: no" and got["c"].size == 0


def test_tiling_check(spark):
    chunk = spark.createDataFrame([("a", "12345"), ("b", "12345"), ("c", "12345")], "chunk_id string, text string")
    spans = spark.createDataFrame([("a", 0, 2), ("a", 2, 5), ("b", 0, 2), ("b", 3, 5)], "chunk_id string, start int, end int")
    assert rows(segmenting.check_tiling(spans, chunk)) == [("b",), ("c",)]


def test_tables_and_markdown(spark):
    t = spark.createDataFrame([("d", 1, [["a|x", "b"], ["1 \n 2", None]])], "doc_id string, table_id int, grid array<array<string>>")
    r = segmenting.table_rows(t).first()
    assert (r.row, r.header, r.cells) == (1, ["a|x", "b"], ["1 2", ""])
    assert t.select(segmenting.table_markdown(F.transform("grid", lambda x: F.transform(x, lambda c: F.coalesce(c, F.lit(""))))).alias("m")).first().m.split("\n")[0] == "| a\\|x | b |"


# answers and hooks


def test_answers(spark):
    parse = lambda s: one(spark, answers.parse_answer(F.lit(s)))
    a = parse("<answer>It is 5 [d:0:0123abcd].</answer><citations>x:1:2</citations><support>partial</support>")
    assert a.citations == ["x:1:2", "d:0:0123abcd"] and a.kind == "partial"
    assert parse("<abstain/>").kind == "abstained" and parse("").kind == "abstained" and parse("plain prose").kind == "answered"
    assert parse("<answer>None of it.</answer><support>none</support>").kind == "abstained"
    assert one(spark, answers.scrubbed(F.lit("Due [auto-tag: X], [d:0:0123abcd] . See [Party A] (  )"))) == "Due. See [Party A]"
    done = one(spark, answers.finalize(answers.parse_answer(F.lit("<answer>Yes.</answer><citations>made:1:up</citations>")), F.array(F.lit("d:0:1"))))
    assert done.kind == "abstained" and done.citations == []


@pytest.mark.parametrize("line,verdict", [("2.1. Fees", "start"), ("10.5.1. Item", "uncertain"), ("Clause 12 Governing Law", "start"), ("Section hereof shall mean the whole of this long agreement and its parts. It goes on.", "continue"), ("CONFIDENTIALITY", "start"), ("lower body text", "continue"), ("Term:", "uncertain")])
def test_provisions(spark, line, verdict):
    assert one(spark, answers.provision_verdict(F.lit(line))) == verdict


def test_slices_keep_the_longest(spark):
    df = spark.createDataFrame([(1, 'see [Section 5] [{"chunk_id": "a", "extract": "as in [5]"}] then [{"chunk_id": "b", "extract": "x"}, {"chunk_id": "c", "extract": "y"}]'), (2, "nothing [")], "id int, text string")
    assert rows(answers.slice_extracts(df), "id", "chunk_id") == [(1, "b"), (1, "c")]


def test_alignment_and_location(spark):
    chunks = spark.createDataFrame([("d", 0, "alpha beta"), ("d", 1, "alpha gamma")], "document string, chunk long, text string")
    items = spark.createDataFrame([("d", 0, "alpha"), ("d", 1, "lost"), ("d", 2, "alpha"), ("d", 3, "gamma")], "document string, item long, text string")
    assert rows(answers.aligned(chunks, items), "item", "chunk", "start") == [(0, 0, 0), (2, 1, 0), (3, 1, 6)]
    facts = spark.createDataFrame([("d", "f1", "beta  text"), ("d", "f2", "absent")], "document string, fact_id string, text string")
    body = spark.createDataFrame([("d", 0, "1", "alpha"), ("d", 1, "2", "then beta text")], "document string, pos int, section string, text string")
    assert rows(answers.located(facts, body), "fact_id", "section", "item") == [("f1", "2", 1), ("f2", None, None)]


def test_hook_failures_cost_one_row(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(6)], "id int, text string")

    def hook(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    got = rows(hooks.over(df, hook, "string"), "id", "out")
    assert got[3] == (3, None) and got[0] == (0, "T0")
    assert rows(hooks.judged(df, lambda ts: ["violation" if t == "t1" else None for t in ts]), "id", "verdict")[:2] == [(0, "needs_review"), (1, "violation")]


def test_registry(spark):
    r = hooks.Registry()
    r.register(hooks.Capability("span_search", "function", lambda df: df.count(), needs=("id",), about="find spans by words and meaning"))
    r.register(hooks.Capability("judge_pairs", "model", lambda df: 0, about="rule on pairs"))
    assert r.invoke("span_search", spark.range(3), kind="function") == 3 and r.manifests(spark).count() == 2
    assert r.discover(spark, "find spans", k=1).first().name == "span_search"
    for bad in (lambda: r.register(hooks.Capability("span_search", "function", print)), lambda: r.register(hooks.Capability("x", "odd", print)), lambda: r.invoke("span_search", spark.range(1).toDF("y"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.get("none")
    with pytest.raises(TypeError):
        r.invoke("judge_pairs", kind="function")


def test_ingest_and_search(spark):
    docs = spark.createDataFrame([("d 1", "Governing Law\n\nThe law of Delaware rules. Nothing else does."), ("d2", "Fees\n\nA fee of ten is due. It is paid by the buyer."), ("d3", "  ")], "doc_id string, text string")
    got = flows.ingest(docs)
    assert rows(got.report(), "doc_id", "chunks", "failures") == [("d2", 1, 0), ("d3", 0, 0), ("d_1", 1, 0)]
    hits = flows.span_search(got.spans, "fee paid by buyer", k=2, floor=1)
    assert hits.orderBy("rank").first().doc_id == "d2"
    assert flows.span_search(got.spans, "fee", documents=[]).count() == 0
    with pytest.raises(LookupError):
        flows.check_documents(got.documents, ["nope"])
    done = got.documents.select("doc_id", "sha256")
    assert flows.ingest(docs, done=done).documents.count() == 0


def test_defenses_meet_by_classes(spark):
    """Equal rules meet once, and ranks are those of all pairs: copies, repeated and null ids, null features."""
    import random

    r = random.Random(1)
    rule = lambda n: [(i if i % 37 else None, r.choice("ab"), r.choice([1, 2, 5, None]), f"text {i}") for i in (*range(n), 3, 3)]
    p, d = rule(150), rule(140)
    frame = lambda x: spark.createDataFrame(x, "rule_id long, source string, size int, text string").repartition(3)
    asked = spark.sparkContext.accumulator(0)

    def closeness(a, b):
        asked.add(1)
        return None if a is None or b is None else -abs(a - b)

    got = compliance.defenses(frame(p), frame(d), F.udf(closeness, "int")("p.size", "d.size")).collect()
    assert 0 < asked.value <= 2 * 4 * 4 * 3
    by_id: dict = {}
    for a in p:
        by_id.setdefault(a[0], []).extend((closeness(a[2], b[2]), b[0]) for b in d if a[1] == b[1])
    best = {k: sorted(v, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or 0))[:3] for k, v in by_id.items()}
    want = [(k, b, s, n) for k, v in best.items() for n, (s, b) in enumerate(v, 1)]
    assert sorted(map(str, ((x.rule_id, x.defense, x.score, x["rank"]) for x in got))) == sorted(map(str, want))
    ids = compliance.defenses(frame(p), frame(d), -F.abs(F.col("p.rule_id") - F.col("d.rule_id")), 1).where("rule_id = 10")
    assert [(x.defense, x.score) for x in ids.collect()] == [max(((b[0], -abs(10 - b[0])) for b in d if b[0] is not None and b[1] == p[10][1]), key=lambda x: (x[1], -x[0]))]


def test_ingestion_runs_each_stage_once(spark):
    """The report and every table of an ingestion ask each hook once a text; rows that share an id or are equal stay apart."""
    first = "Scope\n\nThe buyer pays a fee. The seller ships it.\n\nTerm\n\nOne year passes."
    docs = spark.createDataFrame([("a b", first), ("a_b", "Other words stand here. They end."), ("c", first), ("c", first), ("d", None)], "doc_id string, text string")
    asked = {name: spark.sparkContext.accumulator(0) for name in ("embed", "tag", "extract")}

    def counted(name, hook):
        def f(texts):
            asked[name].add(len(texts))
            return hook(texts)

        return f

    got = flows.ingest(docs, embed=counted("embed", hooks.HashEmbedder(4)), tag=counted("tag", lambda ts: ["T"] * len(ts)), extract=counted("extract", lambda ts: ts))
    n = {k: getattr(got, k).count() for k in ("chunks", "spans", "units", "records", "dead")}
    report = {(r.doc_id, r.chunks, r.spans, r.units, r.failures) for r in got.report().collect()}
    assert {k: v.value for k, v in asked.items()} == {"embed": n["spans"], "tag": n["spans"], "extract": n["units"]}
    alone = flows.ingest(docs.limit(1)).report().first()
    assert n["chunks"] == 4 and ("c", 2, 2 * alone.spans, 2 * alone.units, 0) in report and ("d", 0, 0, 0, 0) in report
    units = sorted(r.text for r in got.units.where("doc_id = 'c'").collect())
    assert units[::2] == units[1::2] == sorted(r.text for r in flows.ingest(docs.limit(1)).units.collect())
    assert "Other words stand here.\nThey end." in {r.text for r in got.units.where("doc_id = 'a_b'").collect()}


def test_units_in_one_pass_are_those_of_the_windows(spark):
    """spans_and_parts() gives the spans of spans() and the parts of units() and capped_units(), tables and fragments too."""
    rows_ = "\n".join(f"| row {i} | some words here |" for i in range(9))
    texts = [f"Scope\n\n-- ..\n\nOne sentence. Two of them.\n\n| head | b |\n|---|---|\n{rows_}\n\nAfter it. x\n\nEnd of Part\n\nThat is all.", "a\n\n   \n\nWord one. _ . Word two.", "", "?"]
    chunk = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    both = segmenting.spans_and_parts(chunk, 60).drop("error")
    want = segmenting.spans(chunk)
    assert rows(both.where("unit is null").drop("unit", "part")) == rows(want.select("chunk_id", "n", "start", "end", "kind", "text"))
    units = segmenting.capped_units(segmenting.units(want.withColumn("pos", F.col("n")), by="chunk_id"), 60, by="chunk_id")
    assert rows(both.where("unit is not null"), "chunk_id", "unit", "part", "text") == rows(units) and units.where("part > 1").count()


def test_embedder_and_unless(spark):
    """Vectors equal a plain sum by word; a hook isn't asked about rows that failed before."""
    import hashlib
    import math

    texts = ["One two two", "", "x9 y-z One", "...", "a b c d e f g a a a"]
    for size in (3, 16):
        for t, got in zip(texts, hooks.HashEmbedder(size)(texts), strict=True):
            v = [0.0] * size
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            assert got == ([x / norm for x in v] if norm else v)
    df = spark.createDataFrame([(1, "a"), (2, "cut badly"), (3, ""), (4, "b")], "doc_id int, text string")
    ask = hooks.step(lambda ts: [t.upper() for t in ts if t or 1 / 0], "string", "out", "out_error", unless=["error"])
    out = segmenting.exploded(df, lambda t: [(t[::1 if len(t) < 2 else 0],), None], "text string", ["text"], then=[ask]).collect()
    assert sorted((r.doc_id, str(r.out), str(r.error)[:10], str(r.out_error)[:4]) for r in out) == [(1, "A", "None", "None"), (2, "None", "ValueError", "None"), (3, "None", "None", "Zero"), (4, "B", "None", "None")]


def test_two_hop_gold_meets_by_classes(spark):
    """All pairs by hand, with copies, nulls and repeated rows."""
    import random

    r = random.Random(2)
    base = [(i, r.randrange(12)) for i in range(25) for _ in range(r.choice([1, 2, 3]))]
    m = base + base[:5] + [(i + 100, d) for i, d in base if i % 3 == 0] + [(None, 1), (7, None)]
    links = spark.createDataFrame(m, "entity long, document int")
    anchors = spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(2,)], "entity long")
    at: dict = {}
    for e, d in m:
        if e is not None and d is not None:
            at.setdefault(e, set()).add(d)
    near = {a: {b for b in at if b != a and at[a] & at[b]} for a in at}
    want = [(a, c, min(b for b in near[a] if c in near[b])) for a in at if a % 2 == 0 and a < 120 for c in at if c != a and c not in near[a] and any(c in near[b] for b in near[a])]
    got = graph.two_hop_gold(links, anchors)
    assert rows(got, "anchor", "answer", "bridge") == sorted(want, key=str) and want

def test_two_hop_gold_of_many_copies(spark):
    """30,000 entities of one document, which made 900 million pairs."""
    m = spark.range(30_000).selectExpr("id AS entity", "0 AS document").union(spark.createDataFrame([(50_000, 0), (50_000, 1), (50_001, 1)], "entity long, document int"))
    got = graph.two_hop_gold(m, spark.createDataFrame([(50_001,)], "entity long")).agg(F.count("*"), F.min("bridge"), F.max("bridge"), F.max("answer")).first()
    assert tuple(got) == (30_000, 50_000, 50_000, 29_999)


def test_two_hop_gold_shuffles_no_pairs(spark):
    """Names as keys; nearly all pairs are in the result, but what is shuffled are memberships."""
    import random

    r = random.Random(3)
    at = {f"n{i}": {f"d{r.randrange(60)}" for _ in range(3)} for i in range(1_000)} | {"n\u00e9": {"d1"}, "copy of n\u00e9": {"d1"}}
    links = spark.createDataFrame([(e, d) for e, ds in at.items() for d in ds], "entity string, document string")
    anchors = spark.createDataFrame([(e,) for e in at if e not in ("n7", "copy of n\u00e9")], "entity string")
    near = {a: {b for b in at if at[a] & at[b]} for a in at}
    first = {a: {} for a in at}
    for a in at:
        for b in sorted(near[a]):
            for c in near[b] - near[a]:
                first[a].setdefault(c, b)
    want = {(a, c, b) for a in at if a not in ("n7", "copy of n\u00e9") for c, b in first[a].items()}

    store, nothing = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: (x := store.stageList(None, False, False, nothing, None), [x.apply(i) for i in range(x.size())])[1]
    last = max((x.stageId() for x in stages()), default=-1)
    got = [tuple(x) for x in graph.two_hop_gold(links, anchors).collect()]
    assert len(got) == len(want) > 800_000 and set(got) == want
    assert 0 < sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last) < 200_000


def test_compliance_flow(spark):
    one_scope = F.create_map(F.lit("p"), F.array(F.lit("x")))
    facts = spark.createDataFrame([("f1", "d", "ad", "we promise gains"), ("f2", "d", "ad", "fine print")], "fact_id string, document string, claim_type string, text string").withColumn("fact_scope", one_scope)
    rules = spark.createDataFrame([("r1", ["ad"], "no promises", "policy")], "rule_id string, types array<string>, rule_text string, citation string").withColumn("rule_scope", one_scope)
    found, gaps, report = flows.compliance_check(facts, rules, lambda ts: ["violation" if "promise gains" in t else "compliant" for t in ts])
    assert rows(found, "fact_id", "verdict") == [("f1", "violation"), ("f2", "compliant")] and rows(gaps, "rule_id", "verdict") == [("r1", "violation")] and report.first().verdict == "needs_review"


def test_jobs_and_stages(spark, tmp_path):
    jobs = flows.Jobs(spark, f"file://{tmp_path}/jobs")
    made = []
    stages = {"a": lambda: made.append("a") or spark.range(3), "b": lambda: made.append("b") or spark.range(2)}
    for _ in range(2):
        out = flows.run_stages(spark, f"file://{tmp_path}/s", stages, jobs, "j")
    assert made == ["a", "b"] and out["b"].count() == 2 and jobs.now().first().status == "done"


def test_eval_runs(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, input string")
    runs = flows.run_eval(gold, lambda ts: [t.upper() for t in ts], 2)
    assert runs.count() == 4 and rows(evals.flips(runs), "item_id", "flipped") == [(1, False), (2, False)]
    r = flows.score_runs(runs, lambda d: d.agg(F.avg((F.col("output") == "A").cast("double")).alias("m")).withColumn("passed", F.col("m") >= 0.5), "m").first()
    assert (r.m, r.passed, r.repeats) == (0.5, True, 2)


def test_reduce(spark):
    notes = spark.createDataFrame([(0, i, str(i)) for i in range(10)] + [(1, 0, "x")], "query_id int, position int, text string")
    got = dict(rows(hooks.reduced(notes, lambda ts: ["".join(t.split()) for t in ts], 3)))
    assert got == {0: "0123456789", 1: "x"}


# sources


def test_fetcher(tmp_path):
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    f = connectors.Fetcher(lambda u: calls.append(u) or u.encode(), str(tmp_path), 2, 1.0, lambda: now[0], sleep)
    for u in ("a", "b", "a", "c"):
        assert f.get(u) == u.encode()
    assert calls == ["a", "b", "c"] and slept == [1.0]


def test_files_and_parse(spark, tmp_path):
    from docloom import sources

    (tmp_path / "one two.txt").write_text("hello")
    (tmp_path / "x.XLSM").write_bytes(b"\x00")
    (tmp_path / "empty.txt").write_text("")
    f = sources.files(spark, f"file://{tmp_path}")
    assert rows(f, "doc_id", "extension") == [("one_two.txt", "txt"), ("x.XLSM", "xlsx")]

    def parser(name, data):
        if name.endswith("XLSM"):
            raise ValueError("no sheet")
        return data.decode()

    p = sources.parsed(f, parser)
    assert rows(p, "doc_id", "text", "error") == [("one_two.txt", "hello", None), ("x.XLSM", None, "ValueError: no sheet")]
    assert sources.parsed(f, parser, p).count() == 0


def test_formats(spark, tmp_path):
    import json

    from docloom import sources

    (tmp_path / "sq.json").write_text(json.dumps({"data": [{"title": "A B", "paragraphs": [{"context": "ctx", "qas": [{"question": "q", "answers": [{"text": "c", "answer_start": 0}]}]}]}]}))
    docs, ans = sources.squad_documents(spark, f"file://{tmp_path}/sq.json")
    assert rows(docs, "doc_id", "text") == [("A_B", "ctx")] and rows(ans, "text", "start") == [("c", 0)]
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "text": "t"}\n')
    (tmp_path / "q.jsonl").write_text('{"_id": "q1", "text": "t"}\n{"_id": "q2", "text": "t"}\n')
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t3\nq2\t1\t1\n")
    _, q, g = sources.judged_corpus(spark, *(f"file://{tmp_path}/{x}" for x in ("c.jsonl", "q.jsonl", "r.tsv")))
    assert rows(q, "id") == [("q1",)] and g.count() == 2
    (tmp_path / "g.csv").write_text("Item ID,The  Input,want\n7,hello,x\n,bye,y\n,,\n")
    gold = sources.gold_items(spark, f"file://{tmp_path}/g.csv", {"id": "item id", "input": "the input", "expected": "Want"}, "set")
    assert rows(gold, "item_id", "input", "expected") == [("7", "hello", "x"), ("set-2", "bye", "y")]
    with pytest.raises(ValueError):
        sources.gold_items(spark, f"file://{tmp_path}/g.csv", {"input": "nope"}, "set")
    (tmp_path / "v.ttl").write_text('@prefix e: <x> .\ne:A a e:T ;\n  e:cue "must" , "shall not" .\n# note\ne:B e:p "a;b." .\n')
    assert rows(sources.turtle_values(spark, f"file://{tmp_path}/v.ttl")) == [("e:A", "e:cue", "must"), ("e:A", "e:cue", "shall not"), ("e:A", "rdf:type", "e:T"), ("e:B", "e:p", "a;b.")]
    html = "<html><head><title>x</title></head><body><p>a &amp; b</p><script>no</script><p>c<br>d</p></body></html>"
    assert one(spark, sources.html_text(F.lit(html))) == "a & b\nc\nd"


def test_connectors(spark):
    t = spark.createDataFrame([("s", "t1", 0, 2, 0, 5, ["id", "n"], ["id", "n"], ["text", "number"], ["text", "text"]), ("s", "t2", 0, 2, 7, 9, ["a", "1"], ["a", "1"], ["text", "number"], ["text", "number"]), ("s", "t3", 0, 2, 11, 12, ["ID", "N"], ["ID", "N"], ["text", "number"], ["text", "text"])], "sheet string, table_id string, left int, right int, top int, bottom int, header array<string>, first_row array<string>, types array<string>, first_types array<string>")
    assert rows(connectors.continuations(t), "table_id", "above", "verdict") == [("t2", "t1", "data"), ("t3", "t2", "header")]
    body = spark.createDataFrame([("d", 0, "r1", "paragraph", "a")], "doc_id string, pos int, ref string, kind string, text string")
    texts = spark.createDataFrame([("d", "r1", "a"), ("d", "r2", "lost")], "doc_id string, ref string, text string")
    assert rows(connectors.reading_order(body, texts), "pos", "text") == [(0, "a"), (1, "lost")]
    cells = spark.createDataFrame([("d", 1, i) for i in range(4)] + [("d", 2, 0)], "document string, table_id int, row int")
    assert rows(connectors.unreached_rows(cells, cells.where("table_id = 1 and row < 2"))) == [("d", 1, 4, 2, [2, 3])]
    anchors = spark.createDataFrame([("c1", 5, True), ("c2", 6, False)], "child string, row int, verified boolean")
    content = spark.createDataFrame([("c1", 9, 3), ("c3", 1, 2), ("c3", 2, 2)], "child string, row int, shared int")
    assert rows(connectors.record_links(anchors, content)) == [("c1", 5, "EXTRACTED", "anchor"), ("c2", 6, "INFERRED", "position"), ("c3", 1, "AMBIGUOUS", "content"), ("c3", 2, "AMBIGUOUS", "content")]


def test_stream_into_store(spark, tmp_path):
    from docloom import streaming

    src, out = tmp_path / "in", f"file://{tmp_path}/store"
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:10:00")], "id int, x string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(f"file://{src}")
    stream = streaming.arriving(spark, f"file://{src}", "id int, x string, t timestamp")
    s = store.Store(spark, out)
    q = streaming.new_only(stream, "t", ["id"]).writeStream.foreachBatch(streaming.merge_into(s, "docs", ["id"])).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(s.get("docs"), "id", "x") == [(1, "a"), (2, "b")]
    sessions = streaming.call_sessions(stream, "t", "x").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    sessions.awaitTermination(120)
    assert sessions.exception() is None


def test_nearest_brute(spark):
    import random

    rng = random.Random(0)
    make = lambda n, p: [(c, f"{p}{c}{i}", s := rng.randrange(0, 400), s + rng.randrange(0, 30), i) for c in "ab" for i in range(n)]
    e, c = make(40, "e"), make(25, "c")
    gap = lambda x, y: max(0, x[2] - y[3], y[2] - x[3])
    want = []
    for x in e:
        g, _, cap = min((gap(x, y), y[4], y[1]) for y in c if y[0] == x[0])
        if g <= 12:
            want.append((x[0], x[1], cap, g))
    schema = "contract string, id string, start int, end int, position int"
    for cell in (7, 4096):
        links, left = clauses.nearest(spark.createDataFrame(e, schema), spark.createDataFrame(c, schema), 12, cell)
        got = {(r.contract, r.exception): r for r in links.collect()}
        assert {k: r.gap for k, r in got.items()} == {w[:2]: w[3] for w in want} and left.count() == len(e) - len(want)
        assert all(got[w[:2]].cap == w[2] for w in want if w[3])
