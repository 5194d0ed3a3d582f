"""What the corpus operators share: the shared work folder, table reading, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.scratch import Scratch, cleared, holding, no_shuffle_left, shared_folder

__all__ = ["Scratch", "cleared", "holding", "no_shuffle_left", "shared_folder"]

#: The characters that separate words; Python's bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null doc_id counts as this one, so it sorts after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name that an operator adds can clash with theirs."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """id and row of a document: rows that repeat an id, or have none, are told apart by a hash of id and text. Rows that
    are equal in both have one key; what is decided on id and text alone is the same for them."""
    id_ = F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))
    return id_, F.xxhash64(id_, F.coalesce(text, F.lit("")))


class Shipped:
    """A file that the driver can read, sent to every executor once."""

    def __init__(self, spark: SparkSession, path: str):
        spark.sparkContext.addFile(path)
        self.name = os.path.basename(path)

    def path(self) -> str:
        """Where it lies on the executor that asks."""
        return SparkFiles.get(self.name)


def give_back() -> None:
    """Returns memory that freed arrays still hold to the system, so that later steps of the driver have it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tasks(spark: SparkSession) -> int:
    """Number of partitions for a shuffle whose partition numbers matter."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows(batch, *names: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch, row by row; a few hundred rows at a time are Python objects."""
    for a in range(0, batch.num_rows, 256):
        part = batch.slice(a, 256)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)
