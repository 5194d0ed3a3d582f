"""Queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


#: Columns that Spark numbers with 32 bits, where SQL alone would give 64.
NARROW = {"identifier_tokens": "n", "exception_links": "gap", "call_dedup_exact": "seen"} | dict.fromkeys(
    (
        "dense_topk", "sparse_topk", "hybrid_rrf", "hybrid_rrf_scoped", "dense_floor", "span_search", "typed_constraint_rank", "property_boosted", "fuse_streams", "bounded_evidence",
        "dense_only_search", "fuzzy_candidates", "route_functions_conditional", "route_functions_lift", "route_functions_pmi", "defense_links",
    ),
    "rank",
)


class Catalogue:
    """Named queries; add() registers one with its SQL, or with None where SQL can't express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            if sql:
                c = NARROW.get(f.__name__)
                self.sql[f.__name__] = f"SELECT * REPLACE (CAST({c} AS INTEGER) AS {c}) FROM ({sql}) AS q" if c else sql
            return f

        return put


def catalogues() -> list[Catalogue]:
    from docloom.plans import answering, evaluation, graphs, ingestion, reading, records, rules, searching

    return [reading.C, searching.C, graphs.C, evaluation.C, rules.C, ingestion.C, answering.C, records.C]
