"""The pipeline's stages on documents with extra columns of any name, repeated ids and none."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing, simhash_dedup, toxicity
from docloom.llm.common import Scratch, cleared

#: Names that the operators use inside, and some they used before.
INSIDE = (
    "kept id row pos h1 h2 owner first last n hot batch drops left n_lines n_dropped fp component component_id best by turn node a b t key rep "
    "size source_size target seed of rate copies taken sums rank weight cap score toxic _id _toxic _text _drops _score _mix_n _mix_of _first _turn _n _dropped _kept"
).split()


def stages(labels):
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels),
        "lines": line_dedup.drop_repeated_lines,
        "simhash": simhash_dedup.keep_first,
        "mix": mixing.mix,
    }


@pytest.mark.parametrize("name", ["toxicity", "lines", "simhash", "mix"])
def test_any_column_name(odd, labels, name):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = plain.select("*", *(F.concat(F.lit(f"{x} "), F.coalesce(F.col("lang"), F.lit("none"))).alias(x) for x in INSIDE))
    stage = stages(labels)[name]
    got = stage(more)
    assert got.columns == more.columns and got.schema.simpleString() == more.schema.simpleString()
    kept = got.collect()
    assert all(r[x] == f"{x} {r.lang or 'none'}" for r in kept for x in INSIDE)
    assert sorted(map(str, (tuple(r[c] for c in plain.columns) for r in kept))) == sorted(map(str, map(tuple, stage(plain).collect())))


def test_keep_first_loses_no_text(spark):
    """Rows of one id with unrelated texts are of different components and all stay; equal rows stay once."""
    rng = random.Random(4)
    texts = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(120)) for c in "abcd"]
    rows = [(5, texts[0], "x"), (5, texts[1], "x"), (5, texts[0], "x"), (6, texts[0], "y"), (None, texts[2], "z"), (None, texts[3], "z"), (None, texts[1], "z"), (4, texts[3] + " more", None)]
    out = simhash_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[7]]))


def test_scratch_is_cleared(spark, odd):
    before = len(Scratch.open)
    with cleared():
        simhash_dedup.keep_first(odd).count()
        own = Scratch(spark, "test")
        own.save(spark.range(3), "x")
        assert len(Scratch.open) > before
    assert len(Scratch.open) == before
    p, fs = own._place(own.root)
    assert not fs.exists(p)
