"""Removal of repeated byte strings by longest-previous-factor arrays over anchored suffixes.

A text is cut into runs of windows (strings of `length` bytes) that share an anchor: the smallest hash of the grams in
a window. The anchor depends on the window's bytes alone, so equal windows of different documents have equal anchors,
and only texts with a common anchor need to meet. Work goes in blocks of documents:

1. a block sends the hashes of its anchors, once each; those known in one document only are done with;
2. it sends the different strings around the others, each once, to where the anchor is gathered. There the suffixes
   that start at a window are sorted, and the longest previous factor, from the previous and next smaller document in
   suffix order, tells which windows are in an earlier document;
3. it gets a bit for each string, and one for each window where the string's windows differ, and cuts its texts.

Anchors in very many different strings, as at the ends of a passage that a third of all documents share, are dealt
by window instead, so no place gathers them. Bytes are compared, not hashes, except in telling apart the strings of
one block and anchor.

Blocks and places grow in number with the corpus, and each has a partition of its own. A block sends every place one
message, so from 1 TB on blocks grow too, with the square root of the corpus; their messages stay some hundred bytes long
up to some hundred TB. Rows that are equal in id and text and would fill a block are taken once and get one result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, row_key, tasks

LENGTH, GRAM = 50, 24
#: Bytes of a block of documents at least, and of the corpus for each place that anchors are gathered at.
BLOCK_BYTES, PLACE_BYTES = 8 << 20, 64 << 20
#: What a row costs a block besides its text.
ROW_BYTES = 200
#: Bytes looked at together; longer texts are taken in overlapping stretches.
STRETCH = 1 << 20
#: Windows of a run at most.
RUN = 200
#: Strings of an anchor, summed over blocks, above which its windows are dealt one by one.
CROWD = 1024

U = np.uint64
_rng = np.random.default_rng(11)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Hashes:
    """Hashes of any substring of a buffer in constant time each: sums of table values times powers of an odd base."""

    up: np.ndarray = np.zeros(0, dtype=np.uint64)
    down: np.ndarray = np.zeros(0, dtype=np.uint64)

    def __init__(self, buffer: np.ndarray):
        n = len(buffer) + 1
        if len(Hashes.up) < n:
            Hashes.up, Hashes.down = powers(BASE, n), powers(BACK, n)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(TABLE[buffer] * Hashes.up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hashes.down[start])

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * Hashes.down[: len(self.sums) - size])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Block:
    """Runs of the texts of a block: anchor and string hash, text number, first byte in it, number of windows."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.texts, self.ids, self.length = texts, ids, length
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, int, int]] = []
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t) - length + 1), STRETCH - length + 1) if len(t) >= length else ():
                b = min(len(t), a + STRETCH)
                held.append((i, a, b))
                size += b - a
                if size >= STRETCH:
                    parts.append(self._runs(held, gram))
                    held, size = [], 0
        if held:
            parts.append(self._runs(held, gram))
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        whole = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, dtype=k) for j, k in enumerate(kinds)]
        self.anchor, self.string, self.text, self.start, self.n = whole

    def _runs(self, held: list[tuple[int, int, int]], gram: int) -> tuple[np.ndarray, ...]:
        buffer = np.frombuffer(b"".join([self.texts[i][a:b] for i, a, b in held]), dtype=np.uint8)
        lens = np.array([b - a for _, a, b in held])
        hashes = Hashes(buffer)
        least = sliding_min(hashes.grams(gram), self.length - gram + 1)
        counts = lens - self.length + 1  # windows of each stretch
        firsts = np.cumsum(lens) - lens
        of = np.repeat(np.arange(len(lens)), counts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts, counts)
        value = least[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(at)))
        if n.max() > RUN:  # long runs, of texts that repeat themselves
            since = np.arange(len(at)) - np.repeat(begin, n)
            begin = np.flatnonzero(since % RUN == 0)
            n = np.diff(np.append(begin, len(at)))
        s = at[begin]
        i, a = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        where = of[begin]
        return value[begin], hashes.of(s, s + n + self.length - 1), i[where], s - firsts[where] + a[where], n

    def bytes_of(self, run: int, offset: int = 0, n: int | None = None) -> bytes:
        a = int(self.start[run]) + offset
        return self.texts[self.text[run]][a : a + (int(self.n[run]) if n is None else n) + self.length - 1]


def dump(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as byte planes, compressed."""
    plain = [a if isinstance(a, bytes) else (a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(plain, protocol=5))


def load(blob: bytes) -> list:
    out = []
    for x in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        if isinstance(x, bytes):
            out.append(x)
        else:
            kind, n, planes = x
            size = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, n).T).reshape(-1).view(kind))
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, dtype=x.dtype))


class Cut:
    """What all steps must agree on: key of an anchor, and the place that a key belongs to."""

    def __init__(self, places: int, bits: int, length: int, gram: int, crowd: int):
        self.places, self.bits, self.length, self.gram, self.crowd = places, bits, length, gram, crowd

    def key(self, anchor: np.ndarray) -> np.ndarray:
        return mixed(anchor ^ U(0x5851F42D4C957F2D)) >> U(64 - self.bits)

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """Where each place's share of sorted keys ends."""
        edges = [-(-(i << self.bits) // self.places) for i in range(1, self.places)]
        return np.append(np.searchsorted(keys, np.array(edges, dtype=np.uint64)), len(keys)) if edges else np.array([len(keys)])

    def block(self, table: pa.Table) -> Block:
        order = table.column("id").to_numpy()
        texts = [x or b"" for x in table.column("text").to_pylist()]
        return Block(texts, order, self.length, self.gram)

    # step 1

    def anchors(self, block: Block) -> Iterator[tuple[int, bytes]]:
        """For each place: its keys in the block, whether two ids have them, and the number of their strings."""
        if not len(block.anchor):
            return
        key, ids = self.key(block.anchor), block.ids[block.text]
        order = np.lexsort((block.string, key))
        k, s, d = key[order], block.string[order], ids[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        fresh = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])).astype(np.int64)
        strings = np.minimum(np.add.reduceat(fresh, first), 65535).astype(np.uint16)
        several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        k, a = k[first], 0
        for place, b in enumerate(self.ends(k)):
            if b > a:
                yield place, dump(steps(k[a:b]), strings[a:b], np.packbits(several[a:b]))
            a = b

    def shared(self, blocks: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """For each block: its keys that two documents have, and whether they are crowded."""
        keys, strings, several, n = [], [], [], []
        for blob in blobs:
            k, s, m = load(blob)
            keys.append(np.cumsum(k, dtype=np.uint64))
            strings.append(s)
            several.append(np.unpackbits(m, count=len(k)).astype(bool))
            n.append(len(k))
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
        size = np.diff(np.append(first, len(k)))
        two = (size > 1) | (np.add.reduceat(np.concatenate(several)[order].astype(np.int64), first) > 0)
        crowded = np.add.reduceat(np.concatenate(strings)[order].astype(np.int64), first) > self.crowd
        keep, crowd = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
        keep[order], crowd[order] = np.repeat(two, size), np.repeat(crowded, size)
        at = 0
        for block, ks, m in zip(blocks, keys, n, strict=True):
            own = keep[at : at + m]
            if own.any():
                yield block, dump(steps(ks[own]), np.packbits(crowd[at : at + m][own]))
            at += m

    # step 2

    def strings(self, block: Block, blobs: list[bytes]):
        """The block's shared strings as (run numbers, where each of them first is) and those of crowded anchors as
        single windows, each in the order in which they are sent: lists of (place, runs, offsets, windows, groups)."""
        flags = [load(b) for b in blobs]
        known = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in flags]) if flags else np.zeros(0, dtype=np.uint64)
        crowd = np.concatenate([np.unpackbits(c, count=len(k)).astype(bool) for k, c in flags]) if flags else np.zeros(0, dtype=bool)
        by = np.argsort(known)
        known, crowd = known[by], crowd[by]
        key = self.key(block.anchor)
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
        alone = hit & crowd[at] if len(known) else hit
        plain = np.flatnonzero(hit & ~alone)
        # every window of the runs of crowded anchors, as a run of one
        runs = np.flatnonzero(alone)
        n = block.n[runs]
        run = np.repeat(runs, n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        window = np.fromiter((int.from_bytes(hashlib.blake2b(block.bytes_of(r, o, 1), digest_size=8).digest(), "little") for r, o in zip(run, offset, strict=True)), dtype=np.uint64, count=len(run))
        sides = [
            (key[plain], block.string[plain], plain, np.zeros(len(plain), dtype=np.int64), block.n[plain]),
            (window >> U(64 - self.bits), window, run, offset, np.ones(len(run), dtype=np.int64)),
        ]
        out = []
        for k, s, r, o, w in sides:
            d = block.ids[block.text[r]]
            order = np.lexsort((r, o, d, s, k))
            k, s, r, o, w, d = (x[order] for x in (k, s, r, o, w, d))
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
            out.append((k, r, o, w, d, first))
        return out

    def sent(self, block: Block, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """For each place: keys, smallest ids, lengths and bytes of the strings that the block has for it."""
        sides = self.strings(block, blobs)
        cuts = [self.ends(k[first]) if len(first) else np.zeros(self.places, dtype=np.int64) for k, *_, first in sides]
        for place in range(self.places):
            parts = []
            for (k, r, o, w, d, first), ends in zip(sides, cuts, strict=True):
                f = first[(ends[place - 1] if place else 0) : ends[place]]
                parts.append((k[f], d[f], w[f], [block.bytes_of(int(x), int(y), int(z)) for x, y, z in zip(r[f], o[f], w[f], strict=True)]))
            if any(len(p[0]) for p in parts):
                lens = np.concatenate([p[2] for p in parts]).astype(np.uint16)
                text = b"".join(x for p in parts for x in p[3])
                yield place, dump(steps(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts]), lens, text)

    def judged(self, blocks: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """For each block, in the order in which it sent its strings: whether a string is in an earlier document than
        the block's first with it, and else which of its windows are in an earlier document."""
        number: dict[bytes, int] = {}
        key_of: list[int] = []
        least: list[int] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for blob in blobs:
            keys, ids, lens, text = load(blob)
            keys = np.cumsum(keys, dtype=np.uint64)
            at, mine = 0, np.zeros(len(keys), dtype=np.int64)
            for j, (k, d, w) in enumerate(zip(keys.tolist(), ids.tolist(), lens.tolist(), strict=True)):
                s = text[at : at + w + self.length - 1]
                at += w + self.length - 1
                i = number.setdefault(s, len(key_of))
                if i == len(key_of):
                    key_of.append(k)
                    least.append(d)
                elif d < least[i]:
                    least[i] = d
                mine[j] = i
            rows.append((mine, ids))
        first = np.array(least, dtype=np.int64)
        masks = self.earlier(list(number), np.array(key_of, dtype=np.uint64), first)
        for block, (mine, ids) in zip(blocks, rows, strict=True):
            gone = first[mine] < ids
            found = [(j, masks[i]) for j, i in enumerate(mine.tolist()) if i in masks and not gone[j]]
            yield block, dump(np.packbits(gone), np.array([len(gone)]), np.array([j for j, _ in found], dtype=np.int64), np.array([len(m) for _, m in found], dtype=np.int64), np.packbits(np.concatenate([m for _, m in found])) if found else np.zeros(0, dtype=np.uint8))

    def earlier(self, strings: list[bytes], keys: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """By string, a mask of its windows that are in a string of a smaller id; strings without any are left out."""
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1]) if len(keys) else np.zeros(0, dtype=np.int64)
        among = np.unique(np.concatenate([order[same], order[same + 1]])) if len(same) else np.zeros(0, dtype=np.int64)
        out: dict[int, np.ndarray] = {}
        by_key = among[np.argsort(keys[among], kind="stable")]
        edges = np.flatnonzero(np.append(True, keys[by_key][1:] != keys[by_key][:-1])) if len(by_key) else []
        a = 0
        for b in [*(e for e in edges if e), len(by_key)] if len(by_key) else ():
            if b - a < 4096 and b != len(by_key):
                continue  # several anchors at a time
            part = by_key[a:b]
            a = b
            text = np.frombuffer(b"".join([strings[i] for i in part]), dtype=np.uint8)
            lens = np.array([len(strings[i]) for i in part])
            n = lens - self.length + 1
            of = np.repeat(np.arange(len(part)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(lens) - lens, n)
            hit = longest_previous(text, at, first[part][of], self.length) >= self.length
            ends = np.cumsum(n)
            for j in np.unique(of[hit]):
                out[int(part[j])] = hit[ends[j] - n[j] : ends[j]]
        return out

    # step 3

    def removed(self, block: Block, flags: list[bytes], verdicts: dict[int, bytes]) -> list[np.ndarray]:
        """For each text a mask of its bytes to remove; None if there is none."""
        masks: list[np.ndarray | None] = [None] * len(block.texts)
        sides = self.strings(block, flags)
        cuts = [self.ends(k[first]) if len(first) else np.zeros(self.places, dtype=np.int64) for k, *_, first in sides]
        ends = [np.append(first[1:], len(k)) for k, *_, first in sides]

        def mark(text: int, a: int, b: int) -> None:
            m = masks[text]
            if m is None:
                m = masks[text] = np.zeros(len(block.texts[text]) + 1, dtype=np.int32)
            m[a] += 1
            m[b] -= 1

        for place, blob in verdicts.items():
            bits, count, which, sizes, packed = load(blob)
            gone = np.unpackbits(bits, count=int(count[0])).astype(bool)
            windows = np.unpackbits(packed, count=int(sizes.sum())).astype(bool)
            after = np.cumsum(sizes)
            own = {int(j): windows[e - s : e] for j, s, e in zip(which, sizes, after, strict=True)}
            j = 0
            for (k, r, o, w, d, first), cut, end in zip(sides, cuts, ends, strict=True):
                lo, hi = (cut[place - 1] if place else 0), cut[place]
                for f, e in zip(first[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                    smallest, mask, all_gone = d[f], own.get(j), gone[j]
                    j += 1
                    for x in range(f, e):
                        a = int(block.start[r[x]] + o[x])
                        if all_gone or d[x] > smallest:
                            mark(block.text[r[x]], a, a + int(w[x]) + self.length - 1)
                        elif mask is not None:
                            for i in np.flatnonzero(mask).tolist():
                                mark(block.text[r[x]], a + i, a + i + self.length)
        return [None if m is None else np.cumsum(m[:-1]) > 0 for m in masks]


def longest_previous(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """For the suffix at each of starts, the longest common prefix, `most` at most, with a suffix of a smaller owner.

    Suffixes are sorted by their first `most` bytes. In that order the best partner of a suffix is its previous or next
    one with a smaller owner; both are found with a stack, along with the least common prefix on the way.
    """
    padded = np.concatenate([text, np.zeros(most + 8, dtype=np.uint8)])
    words = []
    for a in range(0, most, 8):
        take = min(8, most - a)
        word = np.zeros(len(starts), dtype=np.uint64)
        for i in range(take):
            word = (word << U(8)) | padded[starts + a + i].astype(np.uint64)
        words.append(word << U(8 * (8 - take)))
    order = np.lexsort(tuple(reversed(words)))
    common = np.zeros(len(order), dtype=np.int64)  # with the suffix before
    open_ = np.ones(max(0, len(order) - 1), dtype=bool)
    for a, word in zip(range(0, most, 8), words, strict=True):
        x = word[order][1:] ^ word[order][:-1]
        lead = sum((x < U(1 << (8 * i))).astype(np.int64) for i in range(8))  # bytes that agree
        common[1:] += np.where(open_, np.minimum(lead, most - a), 0)
        open_ &= x == 0
    rank = owner[order].tolist()
    lcp = common.tolist()
    best = [0] * len(rank)
    for back in (False, True):
        stack: list[tuple[int, int]] = []  # (owner, least common prefix from it to the next in the stack or to here)
        walk = range(len(rank) - 1, -1, -1) if back else range(len(rank))
        for i in walk:
            c = (lcp[i + 1] if i + 1 < len(rank) else 0) if back else lcp[i]
            while stack and stack[-1][0] >= rank[i]:
                c = min(c, stack.pop()[1])
            if stack and c > best[i]:
                best[i] = c
            stack.append((rank[i], c))
    out = np.zeros(len(rank), dtype=np.int64)
    out[order] = best
    return out


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, place_bytes: int = PLACE_BYTES, crowd: int = CROWD, keep: list[str] | None = None, with_text: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Columns `keep` of docs, n_bytes, n_removed, n_spans, kept (the remaining bytes as text or, if they aren't UTF-8,
    null) and kept_sha256, for each row of docs (doc_id, text; more are ignored).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Texts
    count as UTF-8, whole; matches stay within a document; strings are judged on the input. Null and empty texts have no
    bytes. A null doc_id counts as the largest. Rows of one doc_id don't remove each other's bytes. No rows: no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    names = [f"keep_{c}" for c in keep or ["doc_id"]]
    id_, row = row_key(F.col("doc_id"), F.col("text"))
    base = docs.select(id_.alias("id"), row.alias("row"), F.col("text").cast("binary").alias("text"), *(F.col(c[5:]).alias(c) for c in names))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    sizes = docs.select(id_.alias("id"), row.alias("row"), size.alias("bytes")).groupBy("id", "row").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = scratch.save(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    block_bytes = max(block_bytes, 8 * math.isqrt(total))
    hot = scratch.save(sizes.where((F.col("n") > 1) & (F.col("bytes") > block_bytes)).select("id", "row"), "hot")
    scratch.drop("sizes")
    found = lambda df: _repeats(df, names, total, length, gram, block_bytes, place_bytes, crowd, with_text, scratch)
    results = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    last = [*(F.col(c).alias(c[5:]) for c in names), *results]
    if hot.isEmpty():
        return found(base.withColumn("once", F.lit(False))).select(*last)
    many = base.join(hot, ["id", "row"], "left_semi")
    one = many.groupBy("id", "row").agg(F.first("text").alias("text")).withColumn("once", F.lit(True))
    done = found(base.join(hot, ["id", "row"], "left_anti").withColumn("once", F.lit(False)).unionByName(one, allowMissingColumns=True))
    done = scratch.save(done, "done")
    again = many.drop("text").join(done.where("once").select("id", "row", *results), ["id", "row"])
    return done.where("not once").select(*last).union(again.select(*last))


def _repeats(rows: DataFrame, names: list[str], total: int, length: int, gram: int, block_bytes: int, place_bytes: int, crowd: int, with_text: bool, scratch: Scratch) -> DataFrame:
    """id, row, once, `names` and the results for each of rows (id, row, text, once, `names`)."""
    n = tasks(rows.sparkSession)
    blocks, places = max(n, -(-total // block_bytes)), max(n, -(-total // place_bytes))
    bits = min(62, max(40, int(total // 12 + 1).bit_length() + 14))
    cut = Cut(places, bits, length, gram, crowd)
    passed = ["id", "row", "once", *names]
    dealt = rows.select(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int").alias("block"), "text", *passed).repartitionById(blocks, "block")
    small = rows.select(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int").alias("block"), "id", "text").repartitionById(blocks, "block")
    blob = "place int, block int, blob binary"

    def table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["place", "block", "blob"])

    def one(t: pa.Table) -> pa.Table:
        return table([(p, t.column("block")[0].as_py(), x) for p, x in cut.anchors(cut.block(t))])

    def two(t: pa.Table) -> pa.Table:
        place = t.column("place")[0].as_py()
        return table([(place, b, x) for b, x in cut.shared(t.column("block").to_pylist(), t.column("blob").to_pylist())])

    def three(t: pa.Table, flags: pa.Table) -> pa.Table:
        if not t.num_rows or not flags.num_rows:
            return table([])
        return table([(p, t.column("block")[0].as_py(), x) for p, x in cut.sent(cut.block(t), in_order(flags))])

    def four(t: pa.Table) -> pa.Table:
        place = t.column("place")[0].as_py()
        return table([(place, b, x) for b, x in cut.judged(t.column("block").to_pylist(), t.column("blob").to_pylist())])

    def five(t: pa.Table, replies: pa.Table) -> pa.Table:
        kind = np.array(replies.column("kind").to_pylist(), dtype=np.int64)
        block = cut.block(t)
        masks: list = [None] * t.num_rows
        if len(kind):
            verdicts = replies.filter(pa.array(kind == 2))
            masks = cut.removed(block, in_order(replies.filter(pa.array(kind == 1))), dict(zip(verdicts.column("place").to_pylist(), verdicts.column("blob").to_pylist(), strict=True)))
        out: list[list] = [[], [], [], [], []]
        for x, m in zip(block.texts, masks, strict=True):
            left = x if m is None else np.frombuffer(x, dtype=np.uint8)[~m].tobytes()
            spans = 0 if m is None else int(m[0]) + int((m[1:] & ~m[:-1]).sum())
            for c, v in zip(out, (len(x), len(x) - len(left), spans, text_of(left) if with_text else None, hashlib.sha256(left).hexdigest()), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([*(t.column(c) for c in passed), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*passed, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    at_place = lambda df: df.repartitionById(places, "place").groupBy("place")
    at_block = lambda df: df.repartitionById(blocks, "block").groupBy("block")
    flags = scratch.save(at_place(small.groupBy("block").applyInArrow(one, blob)).applyInArrow(two, blob), "flags")
    strings = small.groupBy("block").cogroup(at_block(flags)).applyInArrow(three, blob)
    verdicts = scratch.save(at_place(strings).applyInArrow(four, blob), "verdicts")
    replies = flags.withColumn("kind", F.lit(1)).union(verdicts.withColumn("kind", F.lit(2)))
    types = ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in passed), "n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string"])
    return dealt.groupBy("block").cogroup(at_block(replies)).applyInArrow(five, types)


def in_order(flags: pa.Table) -> list[bytes]:
    return [x for _, x in sorted(zip(flags.column("place").to_pylist(), flags.column("blob").to_pylist(), strict=True))]


def text_of(left: bytes) -> str | None:
    try:
        return left.decode()
    except UnicodeDecodeError:
        return None
