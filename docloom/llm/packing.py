"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import spread
from docloom.llm.common import Shipped, rows, tasks

WINDOW, END = 1024, 0
#: Pieces packed together; also bounds what a task holds.
GROUP = 1024
#: What is left over of a document is cut into pieces of this size, so that windows come out near equal.
PART = 256


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of near-equal sums.

    Each item starts as a partial partition of k parts, one holding it. The two with the widest spread are merged,
    largest part with smallest and so on, so that imbalances oppose, until one partition is left.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # only the parts that aren't empty, largest first
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = k - len(a)
        if len(b) <= spare:
            merged = a + b
        else:
            lone, pair = b[:spare], b[spare:]  # the largest of b take empty parts, the rest the smallest of a
            at = len(a) - len(pair)
            merged = a[:at] + lone + [(x + y, p + q) for (x, p), (y, q) in zip(a[at:], reversed(pair), strict=True)]
        merged.sort(key=lambda part: -part[0])
        low = merged[-1][0] if len(merged) == k else 0
        n += 1
        heapq.heappush(heap, (low - merged[0][0], n, merged))
    return [p for _, p in heap[0][2]]


def pack(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """difference() into as few parts as the total needs, one more as often as a part exceeds the window."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= window for p in parts):
            return parts
        k += 1


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a tokenizer file, if it is byte-level BPE whose ids follow the order of its merges."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ids = model["vocab"]
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(ids):
        return None
    return {bytes(of[c] for c in piece): i for piece, i in ids.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a file of the tokenizers library.

    A byte-level BPE file is run by tiktoken on the ranks read from it, which gives the same ids in a fraction of the
    time. Texts that hold the string of an added token, which the library takes out of a text first, those with very
    long runs of white space, which tiktoken's splitter can't take, and files of other kinds go to the library itself.
    """

    #: The splitting pattern of this kind of tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RUN = r"\s{2000}"

    def __init__(self, path: str):
        self.path, self.whole, self.quick = path, None, None
        spec = read_spec(path)
        if ranks := byte_level_ranks(spec):
            import tiktoken

            self.quick = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
            self.slow = re.compile("|".join([self.RUN, *added]))

    def library(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        ids = self.quick.encode_ordinary(text) if self.quick and not self.slow.search(text) else self.library(text)
        return np.array(ids, dtype="<u4").tobytes()


NUMBERS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECE = ", ".join(f"{c} long" for c in (*NUMBERS, "nth"))
PLACED = ", ".join(f"{c} long" for c in (*NUMBERS, "sequence_id", "offset"))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, part_size: int = PART) -> DataFrame:
    """Whole windows of each document, and its remainder in pieces of at most `part_size`: doc_id, start, length, ids_crc32,
    doc_tokens, nth. nth counts a task's documents that are equal in id and tokens, so equal pieces can be dealt apart."""
    file = Shipped(docs.sparkSession, tokenizer)
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(file.path())
        seen: dict[int, int] = {}
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in rows(b, "doc_id", "text"):
                ids = memoryview(encode(text or "") + last)
                n = len(ids) // 4
                key = hash((doc_id or 0, n, zlib.crc32(ids)))
                nth = seen[key] = seen.get(key, -1) + 1
                full = n - n % window
                for a in [*range(0, full, window), *range(full, n, part_size)]:
                    part = ids[4 * a : 4 * min(n, a + (window if a < full else part_size))]
                    for c, x in zip(out, (doc_id, a, len(part) // 4, zlib.crc32(part), n, nth), strict=True):
                        c.append(x)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=[*NUMBERS, "nth"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECE)


def place(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """cut (PIECE rows), without nth, with sequence_id and offset.

    Pieces are dealt by a hash over the whole row to a fixed number of partitions and sorted, so a rerun of a lost
    task numbers alike. Of equal pieces a partition gets as many as there are tasks that made them at most, on average
    its share. A whole window is a sequence of its own; the rest are packed `group` at a time. A task
    holds one group. Sequence numbers carry the partition above 40 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def emit(placed: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in placed], pa.int64()) for i in range(7)], names=[*NUMBERS, "sequence_id", "offset"])

        def packed(items: list[tuple]) -> list[tuple]:
            nonlocal next_id
            out = []
            for part in pack([r[2] for r in items], window):
                at = 0
                for i in part:
                    out.append((*items[i], next_id, at))
                    at += items[i][2]
                next_id += bool(part)
            return out

        for b in batches:
            out = []
            for r in rows(b, *NUMBERS):
                if r[2] == window:
                    out.append((*r, next_id, 0))
                    next_id += 1
                else:
                    held.append(r)
                    if len(held) == group:
                        out += packed(held)
                        held = []
            yield emit(out)
        yield emit(packed(held))

    n = tasks(cut.sparkSession)
    return cut.repartition(n, F.xxhash64(*NUMBERS, "nth")).sortWithinPartitions(*NUMBERS).mapInArrow(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = END, part_size: int = PART, group: int = GROUP) -> DataFrame:
    """Pieces of docs (doc_id, text; more are ignored) in sequences of at most `window` tokens.

    A document's tokens are its ids, then `end`. It is cut at every `window` tokens; what is left over is cut at every
    `part_size` and packed. Ids are the library's by default, so the string of an added token is that token. Null or
    empty text: `end` alone. Repeated rows and null ids: packed like any other row. No rows: no pieces. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; only these numbers are shuffled, never texts.
    """
    return place(pieces(docs, tokenizer, window, end, part_size), window, group)
