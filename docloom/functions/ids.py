"""Identity of documents, chunks, spans, nodes and values, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Runs of characters outside letters, digits, dot, underscore and hyphen become one underscore; none at the ends.
    A name of which nothing is left gives null."""
    return F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit(""))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", document, index.cast("string"), F.sha2(text, 256))


def chunk_parts(chunk: Column) -> Column:
    """struct(document, index, hash) of a chunk id, read from its end, since a document may hold colons."""
    parts = F.regexp_extract_all(chunk, F.lit("^(.*):([0-9]+):([^:]*)$"), F.lit(0))
    take = lambda i: F.nullif(F.regexp_extract(chunk, "^(.*):([0-9]+):([^:]*)$", i), F.lit(""))
    return F.when(F.size(parts) == 1, F.struct(take(1).alias("document"), take(2).cast("long").alias("index"), take(3).alias("hash")))


def span_id(chunk: Column, index: Column) -> Column:
    return F.concat(chunk, F.lit("#"), index.cast("string"))


def document_of(any_id: Column) -> Column:
    return F.substring_index(any_id, ":", 1)


def in_scope(clause: Column, contract: str) -> Column:
    """Ids of one contract as a half-open range, which reaches the scan as two pushed comparisons."""
    return (clause >= f"{contract}:") & (clause < f"{contract};")


def node_key(entity_id: Column, surface_key: Column) -> Column:
    return F.coalesce(F.nullif(entity_id, F.lit("")), F.concat(F.lit("UNLINKED:"), surface_key))


def value_key(dimension: Column, value: Column) -> Column:
    return F.concat(dimension, F.lit(":"), value)


def content_id(source: Column, section: Column, text: Column) -> Column:
    return F.concat_ws(":", source, section, F.substring(F.sha2(text, 256), 1, 16))


def child_document(parent: Column, content: Column) -> Column:
    return F.concat(parent, F.lit(".emb."), F.substring(F.sha2(content, 256), 1, 12))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
