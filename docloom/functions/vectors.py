"""Dense and sparse vectors, ranks and set measures as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is zero; components beyond the shorter vector count as zero products."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def sparse_pairs(weights: Column) -> Column:
    """A map of token ids to weights as struct(ids, weights), ids ascending and weights aligned."""
    ids = F.array_sort(F.map_keys(weights))
    return F.struct(ids.alias("ids"), F.transform(ids, lambda i: F.element_at(weights, i)).alias("weights"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; null where nothing is relevant."""
    known = F.array_distinct(relevant)
    return F.when(F.size(known) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), known)) / F.size(known))


def weakest(*tags: Column) -> Column:
    """The least certain of EXTRACTED, INFERRED and AMBIGUOUS."""
    return certainty_name(F.greatest(*(doubt(t) for t in tags)))


def doubt(tag: Column) -> Column:
    return F.when(tag == "EXTRACTED", 0).when(tag == "INFERRED", 1).when(tag == "AMBIGUOUS", 2)


def certainty_name(rank: Column) -> Column:
    return F.when(rank == 0, "EXTRACTED").when(rank == 1, "INFERRED").when(rank == 2, "AMBIGUOUS")


def interval_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), a_start - b_end, b_start - a_end)
