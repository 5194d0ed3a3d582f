"""Token counts under a unigram model: forward scores over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import spread
from docloom.llm.common import Shipped, rows

#: Cuts a text into pre-tokens: a run of non-space with one space before it if there is one, or a run of spaces.
PRE = re.compile(rb"[ ]?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?=[ ]?[^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
#: Nodes after which a trie is given up for a new one; bounds a task's memory.
MOST_NODES = 1_500_000
#: Pre-tokens longer than this aren't put in the trie: they are scored by themselves, whole.
LONG = 256


def pieces_of(path: str) -> dict[bytes, float]:
    """Pieces of a ranks file (base64 bytes and rank a line) with log-probabilities by Zipf's law over the ranks."""
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - total for p, r in ranks.items()}


class Trie:
    """Distinct pre-tokens with the best score, and its number of pieces, of every prefix.

    A node's best split ends in a piece that ends there, after the best split of an ancestor. Both depend on the path
    alone, so a prefix that pre-tokens share is scored once. Of equal scores the one with fewer pieces is used.
    """

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.new()

    def new(self) -> None:
        self.children: list[dict[int, int] | None] = [None]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[bytes, int] = {}

    def tokens(self, word: bytes) -> int:
        """Pieces of the best split; found at the word's end in the trie, which it is put into if it is new."""
        got = self.terminal.get(word)
        if got is not None:
            return got
        if len(word) > LONG:
            return self.alone(word)
        if len(self.best) > MOST_NODES:
            self.new()
        children, best, count, get, longest = self.children, self.best, self.count, self.pieces.get, self.longest
        path = [0]
        node = 0
        for i, c in enumerate(word):
            below = children[node]
            nxt = below.get(c) if below else None
            if nxt is None:
                score, n = self._step(word, i + 1, lambda j: (best[path[j]], count[path[j]]), get, longest)
                nxt = len(best)
                best.append(score)
                count.append(n)
                children.append(None)
                if below is None:
                    children[node] = {c: nxt}
                else:
                    below[c] = nxt
            path.append(nxt)
            node = nxt
        self.terminal[word] = count[node]
        return count[node]

    @staticmethod
    def _step(word: bytes, end: int, before, get, longest: int) -> tuple[float, int]:
        top, least = -math.inf, 0
        for j in range(max(0, end - longest), end):
            s = get(word[j:end])
            if s is not None:
                b, n = before(j)
                s += b
                if s > top or s == top and n + 1 < least:
                    top, least = s, n + 1
        return top, least

    def alone(self, word: bytes) -> int:
        """The same for a long word, without nodes; holds its scores only."""
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            s, n = self._step(word, end, lambda j: (best[j], count[j]), self.pieces.get, self.longest)
            best.append(s)
            count.append(n)
        return count[-1]


def count_tokens(texts: Iterable[bytes | None], trie: Trie) -> Iterator[tuple[int, int]]:
    """Number of pre-tokens and of tokens of each text."""
    for text in texts:
        words = Counter(PRE.findall(text or b""))
        yield sum(words.values()), sum(n * trie.tokens(w) for w, n in words.items())


def token_counts(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens for each row of docs (doc_id, text; more are ignored).

    A text's UTF-8 bytes are cut into pre-tokens and each is split into pieces of the vocabulary so that the sum of
    the pieces' log-probabilities is largest. Every task keeps a trie of the pre-tokens it has seen; nothing is
    shuffled. Null or empty text: zeros. Repeated rows: counted alike. Any byte is a piece, so every text has a split.
    """
    file = Shipped(docs.sparkSession, ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces_of(file.path()))
        for b in batches:
            texts = [t for (t,) in rows(b, "text")]
            got = list(count_tokens(texts, trie))
            columns = [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())]
            yield pa.record_batch([b.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, n_bytes long, n_pretokens long, n_tokens long")
