"""Typed node and edge tables: reads, traversals, upserts, updates and deletes over DataFrames.

A graph is two things: a DataFrame for each node type with its key column, and one DataFrame of edges with columns
edge_type, src, dst and properties. Writes are merges: they return the table as it is afterwards. Store keeps such
tables as versions in a folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.filters import order_columns, predicate


def read(df: DataFrame, where: Mapping[str, Any] | None = None, *, fields: Sequence[str] | None = None, distinct: str | None = None, order_by: str | None = None, limit: int | None = None, key_range: tuple[str, Any, Any] | None = None) -> DataFrame:
    """Filter, then project (or the different values of one field, which overrides fields), then order, then cut."""
    out = df.where(predicate(df, where, key_range))
    if distinct:
        out = out.select(distinct).distinct()
    if order_by:
        out = out.orderBy(*order_columns(out, order_by))
    if limit is not None:
        out = out.limit(limit)
    return out if distinct or not fields else out.select(*fields)


def count(df: DataFrame, where: Mapping[str, Any] | None = None, *, key_range: tuple[str, Any, Any] | None = None) -> DataFrame:
    """One row, n; zero for an empty membership."""
    return df.where(predicate(df, where, key_range)).agg(F.count("*").alias("n"))


def one(df: DataFrame, key: str, value: Any) -> DataFrame:
    return read(df, {key: value}, limit=1)


def edges(edge: DataFrame, start: DataFrame | None = None, *, start_key: str = "id", where: Mapping[str, Any] | None = None, key_range: tuple | None = None, direction: str = "out", edge_type: str | None = None, edge_where: Mapping[str, Any] | None = None, target: DataFrame | None = None, target_key: str = "id", target_where: Mapping[str, Any] | None = None) -> DataFrame:
    """Edges, or the walk start - edge - target with columns prefixed c_, e_ and v_.

    Without a start the edge table is scanned. Parallel edges give parallel rows. Node filters are applied before the
    join, so a narrow start is what Catalyst sees when it picks the join.
    """
    e = edge.where(predicate(edge, edge_where))
    if edge_type:
        e = e.where(F.col("edge_type") == edge_type)
    if start is None:
        return e
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    c = start.where(predicate(start, where, key_range))
    out = prefixed(c, "c_").join(prefixed(e, "e_"), F.col(f"c_{start_key}") == F.col(f"e_{near}"))
    if target is not None:
        v = prefixed(target.where(predicate(target, target_where)), "v_")
        out = out.join(v, F.col(f"e_{far}") == F.col(f"v_{target_key}"))
    return out


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def latest(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """For each key the last value given for each property; null is 'not given'."""
    rest = [c for c in batch.columns if c not in (*keys, seq)]
    return batch.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """current after the batch: only properties that the batch gives are set, new keys are added, later rows win.

    batch has the key columns, some of current's others, and seq. One shuffle by key holds both sides.
    """
    rest = [c for c in current.columns if c not in keys]
    old = current.withColumn("_seq", F.lit(None).cast("long")).withColumn("_old", F.lit(True))
    new = batch.select(*keys, *(F.col(c) if c in batch.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in rest), F.col(seq).cast("long").alias("_seq"), F.lit(False).alias("_old"))
    both = old.unionByName(new)
    order = F.struct(~F.col("_old"), "_seq")
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest)).select(*current.columns)


EDGE_KEYS = ("edge_type", "src", "dst")


def ensure_edges(current: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """One edge for each (type, src, dst); the batch's last properties win, those it doesn't give stay."""
    return upsert(current, batch, EDGE_KEYS, seq)


def created_edges(current: DataFrame, batch: DataFrame, keys: Sequence[str] = EDGE_KEYS) -> DataFrame:
    """The batch's different edges that current lacks."""
    return batch.select(*keys).distinct().join(current.select(*keys).distinct(), list(keys), "left_anti")


def insert_missing(current: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """current and the batch's rows with new keys, the first of each key; what is there is never overwritten."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")
    return current.unionByName(first.join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def update(df: DataFrame, values: Mapping[str, Any], where: Mapping[str, Any] | None = None, *, key_range: tuple | None = None) -> tuple[DataFrame, Column]:
    """df with values set where the filter holds, and the condition under which a row changed.

    A row changes if a field is null or differs. A None never clears a value: what is unknown doesn't differ.
    """
    hit = predicate(df, where, key_range)
    changed = F.lit(False)
    for name, v in values.items():
        if v is not None:
            changed = changed | F.col(name).isNull() | (F.col(name) != F.lit(v))
    changed = F.coalesce(hit & changed, F.lit(False))
    out = df.select(*(F.when(changed, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if values.get(c) is not None else F.col(c) for c in df.columns))
    return out, changed


def delete(nodes: DataFrame, key: str, edge: DataFrame, where: Mapping[str, Any] | None = None, *, key_range: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes left, and edges left: those of a deleted node at either end go. No filter deletes all."""
    gone = F.coalesce(predicate(nodes, where, key_range), F.lit(False))
    ids = nodes.where(gone).select(F.col(key).alias("_gone")).distinct()
    left = edge.join(ids, edge.src == F.col("_gone"), "left_anti").join(ids, edge.dst == F.col("_gone"), "left_anti")
    return nodes.where(~gone), left


def write_graph(entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame, new_entities: DataFrame, new_relations: DataFrame, seq: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities after an upsert, relations and mentions with what was absent; running it twice changes nothing.

    A mention is made only to a chunk that exists. A relation is the same if src, dst, type and chunk_id are.
    """
    ent = upsert(entities, new_entities, ["entity_id"], seq)
    rel_keys = ["src", "dst", "relationship_type", "chunk_id"]
    rel = insert_missing(relations, new_relations, rel_keys, seq)
    found = new_entities.select("chunk_id", "entity_id", seq).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    men = insert_missing(mentions, found.select("chunk_id", "entity_id", seq), ["chunk_id", "entity_id"], seq)
    return ent, rel, men


def gate(batch: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has not been done yet: the content-hash gate of every stage."""
    return batch.join(done.select(*keys).distinct(), list(keys), "left_anti")


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of the failed ones."""
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda r: r.isNotNull())
    judged = df.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


@dataclass
class Store:
    """Named tables as numbered Parquet versions under a path; a write adds a version, readers use the newest whole one.

    `put` writes version n+1 and leaves n for readers that have begun; `vacuum` removes what is older.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.path}/{name}")
        if not fs.exists(at):
            return []
        whole = (s.getPath() for s in fs.listStatus(at) if fs.exists(path(f"{s.getPath().toString()}/_SUCCESS")))
        return sorted(int(p.getName()[1:]) for p in whole)

    def names(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path))) if fs.exists(path(self.path)) else []

    def get(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}/v{versions[-1]}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        n = (self._versions(name) or [0])[-1] + 1
        df.write.parquet(f"{self.path}/{name}/v{n}")
        return self.get(name)

    def upsert(self, name: str, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
        if name not in self.names():
            return self.put(name, latest(batch, keys, seq).select(*(c for c in batch.columns if c != seq)))
        return self.put(name, upsert(self.get(name), batch, keys, seq))

    def vacuum(self, name: str) -> None:
        fs, path = self._fs()
        for n in self._versions(name)[:-1]:
            fs.delete(path(f"{self.path}/{name}/v{n}"), True)

    def drop(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.delete(path(f"{self.path}/{name}"), True)

    def schema(self, name: str) -> dict[str, str]:
        return dict(self.get(name).dtypes)


def declare(df: DataFrame, fields: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """df with the declared columns it lacks as nulls, and the columns whose type differs from what is declared: those
    are reported and left alone. Columns that aren't declared stay."""
    have = dict(df.dtypes)
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in have})
    return out, sorted(c for c, t in fields.items() if c in have and have[c] != t)


def rename_fields(df: DataFrame, old_to_new: Mapping[str, str]) -> DataFrame:
    """Fields moved to new names; where both exist the new one wins. Running it again changes nothing."""
    for old, new in old_to_new.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df
