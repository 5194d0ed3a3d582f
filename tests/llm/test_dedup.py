"""Line, near-copy and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import line_dedup, simhash_dedup, substring_dedup
from docloom.llm.common import LAST_ID

SPACES = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def brute_lines(rows):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(SPACES))
    num = lambda i: LAST_ID if i is None else i
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), LAST_ID), num(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), num(i)) == num(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def same(df, want, *names):
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("batches,fanout,hot", [(1, 2, 10_000), (4, 2, 1), (7, 3, 5)])
def test_lines_odd(odd, batches, fanout, hot):
    got = line_dedup.line_digests(odd, batches=batches, fanout=fanout, hot=hot)
    same(got, brute_lines(rows_of(odd)), "doc_id", "n_lines", "n_dropped", "kept_sha256")


SHARED = "A shared line long enough"
REPEATED_IDS = [
    (1, SHARED), (5, f"{SHARED}\nsecond line of the one"), (5, "unique zzz line number one\nsecond line of the other"), (5, f"{SHARED}\nsecond line of the one"),
    (None, f"{SHARED}\nno id and a line of its own"), (None, "precious only copy here\nno id and a line of its own"), (None, None), (7, "second line of the other\nsecond line of the one"),
]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_rows_that_share_an_id_keep_their_own_lines(spark, hot):
    df = spark.createDataFrame(REPEATED_IDS, "doc_id long, text string")
    same(line_dedup.line_digests(df, hot=hot), brute_lines(REPEATED_IDS), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    kept = [x for r in line_dedup.drop_repeated_lines(df, hot=hot).collect() for x in r.text.split("\n")]
    for line in ("unique zzz line number one", "precious only copy here"):
        assert kept.count(line) == 1
    assert kept.count(SHARED) == 1 and kept.count("no id and a line of its own") == 2


def test_lines_of_random_texts(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), "\n".join(f"{'  ' * rng.randint(0, 1)}Line number {rng.randint(0, 60)} of these" for _ in range(rng.randint(0, 12)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 20):
        same(line_dedup.line_digests(df, batches=6, fanout=2, hot=hot), brute_lines(rows), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_runs_are_joined_as_they_lie(spark):
    """No exchange and no sort below the joins of a batch's keys with the runs."""
    from docloom.llm.common import Scratch, holding

    scratch = Scratch(spark, "test")
    index = line_dedup.LineIndex(scratch, fanout=3)
    lines = lambda a, b: scratch.save(spark.range(a, b).selectExpr("id", "id as row", "0 as pos", "id % 50 as h1", "id % 50 * 7 as h2"), f"lines-{a}")
    assert index.add(lines(0, 30)).count() == 0
    assert index.add(lines(30, 60)).count() == 10
    keys = scratch.save_sorted(lines(40, 70).selectExpr("id", "id as h1", "id * 7 as h2").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")), "keys", index.buckets, "h1", "h2")
    with holding(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), holding(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        for df in (index.unseen(keys), index.losing(keys)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == len(index.runs()) == 2 and "Exchange" not in plan and "Sort [" not in plan
        assert sorted(r.h1 for r in index.unseen(keys).collect()) == list(range(50, 70))
    assert index.add(lines(60, 90)).count() == 30 and len(index.runs()) == 1 and index.levels[1]
    scratch.clear()


def test_lines_empty(none):
    assert line_dedup.line_digests(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_lines_stage_keeps_columns(odd):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    two = {r.doc_id: r for r in out.collect()}[2]
    assert not two.text.startswith("  A LINE") and two.n_chars == len(two.text)


def brute_simhash(text, words=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    num = [LAST_ID if i is None else i for i in ids]
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), LAST_ID), num[i])
    return [None if least[find(i)] == LAST_ID else least[find(i)] for i in range(len(ids))]


def test_simhash_odd(odd):
    rows = rows_of(odd)
    fps = [brute_simhash(t) for _, t in rows]
    want = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps), strict=True)), key=str)
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == want


def test_simhash_empty(none):
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.keep_first(none).count() == 0


def test_cover_guarantee():
    family = simhash_dedup.masks(4)
    rng = random.Random(1)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in family) and any(diff & m == 0 for m in simhash_dedup.second_masks(4))
    assert {bin(m).count("1") for m in family} == {32}


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_of_dense_groups(spark, bucket):
    """Many values in one bucket, split by the second family when the bucket is small."""
    rng = random.Random(3)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = sorted(fps)
    from docloom.llm.common import Scratch

    reps = spark.createDataFrame([(simhash_dedup.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    scratch = Scratch(spark, "test")
    found = {r.node: r.component for r in simhash_dedup.components(simhash_dedup.links(reps, scratch, 4, bucket), scratch).collect()}
    want = brute_components(list(range(len(fps))), fps)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_components_of_a_chain(spark):
    from docloom.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 450)], "a long, b long")
    got = {r.node: r.component for r in simhash_dedup.components(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}


def test_keep_first(odd):
    out = simhash_dedup.keep_first(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and len(ids) == len(set(ids)) and 3 in ids and 4 not in ids and ids.count(6) == 1 and 8 not in ids


def test_null_ids_are_told_apart_by_text(spark):
    """Unrelated texts without an id join nothing, also where one is near document 5 and another near document 9."""
    rng = random.Random(8)
    texts = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(200)) for c in "abcdef"]
    five, nine, *others = texts
    rows = [(5, five), (9, nine), (None, five), (None, nine), (None, others[0]), (None, others[1]), (None, others[1]), (None, others[2]), (12, others[3])]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    ids = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    fp = lambda t: simhash_dedup.signed(brute_simhash(t))
    assert ids == {(i, fp(t)): {five: 5, nine: 9, others[3]: 12}.get(t) for i, t in rows}
    out = simhash_dedup.keep_first(df)
    want = [(5, five), (9, nine), (None, others[0]), (None, others[1]), (None, others[2]), (12, others[3])]
    assert out.columns == df.columns and sorted(rows_of(out), key=str) == sorted(want, key=str)


def brute_repeats(rows, length=50):
    num = lambda i: LAST_ID if i is None else i
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            first[w] = min(first.get(w, LAST_ID), num(i))
    out = []
    for i, t in raw:
        cover = np.zeros(len(t) + 1, dtype=bool)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < num(i):
                cover[a : a + length] = True
        left = bytes(np.frombuffer(t, dtype=np.uint8)[~cover[:-1]])
        spans = int((cover[:-1] & ~np.append(False, cover[:-2])).sum()) if t else 0
        out.append((i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"crowd": 1, "block_bytes": 2000}, {"crowd": 4, "block_bytes": 100_000}])
def test_repeats_odd(odd, options):
    got = substring_dedup.repeats(odd, **options)
    same(got, brute_repeats(rows_of(odd)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_of_rows_that_fill_blocks(spark):
    """Equal rows beyond a block's size are taken once, each with its result and its own columns."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(30))
    rows = [(5, f"{shared} and five {word()}"), *[(7, f"begin {word()} {shared}")] * 1] * 1 + [(9, "seven own words that nobody else has in this whole small table of texts")] * 40
    rows += [(9, None)] * 30 + [(None, f"{shared} no id")] * 50 + [(7, f"another text of seven {shared}")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    got = substring_dedup.repeats(df, block_bytes=1000, keep=["n", "doc_id"])
    same(got, brute_repeats(rows), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(r.n for r in got.collect()) == list(range(len(rows)))
    assert {(r.n, r.doc_id) for r in got.collect()} == {(i, r[0]) for i, r in enumerate(rows)}


def test_blocks_and_places_have_partitions_of_their_own(spark, odd):
    plan = substring_dedup.repeats(odd.where("doc_id != 6"), block_bytes=10_000, place_bytes=50_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("shufflepartitionidpassthrough") == 2


def test_repeats_periodic(spark):
    rng = random.Random(5)
    texts = ["ab" * 700, "ab" * 300 + "c", "x" * 49, "x" * 50, "x" * 51, "".join(rng.choice("ab") for _ in range(3000))]
    texts += [texts[5][100:400] + "zz" + texts[5][1000:1049] + "q", "y" * 20 + texts[5][2950:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(substring_dedup.repeats(df), brute_repeats(list(enumerate(texts))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_empty(none):
    assert substring_dedup.repeats(none).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(5000)) for _ in range(3)]
    whole = substring_dedup.Block(texts, np.arange(3))
    monkeypatch.setattr(substring_dedup, "STRETCH", 600)
    parts = substring_dedup.Block(texts, np.arange(3))
    covers = lambda b: sorted((int(t), int(s) + i, int(v)) for v, t, s, n in zip(b.anchor, b.text, b.start, b.n, strict=True) for i in range(int(n)))
    assert covers(whole) == covers(parts)


def test_longest_previous_factor():
    rng = random.Random(4)
    text = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(120)), dtype=np.uint8)
    starts = np.arange(100)
    owner = np.array([rng.randrange(6) for _ in starts])
    got = substring_dedup.longest_previous(text, starts, owner, 12)
    raw = text.tobytes()

    def common(a, b):
        n = 0
        while n < 12 and raw[a + n] == raw[b + n]:
            n += 1
        return n

    assert got.tolist() == [max([common(a, b) for b in starts if owner[b] < owner[a]], default=0) for a in starts]
