"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Every task inserts the distinct pre-tokens of its rows in a trie. A node stands for a prefix and keeps its best forward
score and the number of pieces of that segmentation, so a prefix that many pre-tokens share is scored once; a terminal
node is the pre-token's count. The pieces and their scores are those of a public rank file: a piece of rank r scores
-log(r + 2) (Zipf's law, in integer millionths so that sums are exact); fewer pieces win between equal scores. As every
single byte is a piece, every text can be cut.

A pre-token of over ``LONG`` bytes shares its first LONG bytes in the trie; the forward scores of the rest are kept in a
window as wide as the longest piece, so a run of letters of any length takes bounded memory. A trie that reaches
``max_nodes`` nodes is dropped and begun anew, and so are the counts remembered of whole pre-tokens (by their bytes): both
bound memory and change no count.

A null or empty text has no tokens, an empty table no rows; rows that repeat are counted each. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, REMEMBERED = 1024, 16_000_000  # bytes of a pre-token that enter the trie; of pre-tokens whose counts a task keeps
SCHEMA = "struct<n_pretokens: bigint, n_tokens: bigint, score: bigint>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    return {p: -round(1e6 * math.log(r + 2)) for p, r in ranks.items()}


class PrefixTrie:
    """Pre-tokens to (best score, fewest pieces); nodes are (parent, byte) with one forward value each."""

    def __init__(self, scores: dict[bytes, int], max_nodes: int = 1_500_000):
        self.ends, self.max_nodes, self.longest = piece_ends(scores), max_nodes, max(map(len, scores))
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.fwd: list[tuple[int, int]] = [(0, 0)]

    def insert(self, word: bytes) -> tuple[int, int]:
        if len(self.fwd) > self.max_nodes:
            self.reset()
        child, fwd = self.child, self.fwd
        path, node, head = [0], 0, word[:LONG]
        for i, b in enumerate(head, 1):
            key = node << 8 | b
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(fwd)
                fwd.append(self._best(word, i, lambda j: fwd[path[j]]))
            node = nxt
            path.append(node)
        if len(word) == len(head):
            return fwd[node]
        window = deque((fwd[n] for n in path[-self.longest :]), maxlen=self.longest)
        for i in range(LONG + 1, len(word) + 1):
            first = i - len(window)
            window.append(self._best(word, i, lambda j, first=first: window[j - first]))
        return window[-1]

    def _best(self, word: bytes, i: int, before) -> tuple[int, int]:
        """The best (score, minus pieces) of word[:i], from the scores of shorter prefixes: pieces that end there, shorter
        ones first, as long as some piece has that end."""
        ends, best = self.ends, None
        for j in range(i - 1, -1, -1):
            s = ends.get(word[j:i], 0)
            if s == 0:
                break
            if s is not None:
                f = before(j)
                cand = (f[0] + s, f[1] - 1)
                if best is None or cand > best:
                    best = cand
        return best


def piece_ends(scores: dict[bytes, int]) -> dict[bytes, int | None]:
    """Every end of a piece: its score if it is a piece itself, else None. No score is 0."""
    return {p[i:]: None for p in scores for i in range(1, len(p))} | scores


def counter(spark, ranks_path: str, pattern: str, max_nodes: int = 1_500_000):
    """A column function text -> struct(n_pretokens, n_tokens, score)."""
    shared = spark.sparkContext.broadcast(piece_scores(read_ranks(ranks_path)))

    @F.arrow_udf(SCHEMA)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, cut, memo, held = PrefixTrie(shared.value, max_nodes), regex.compile(pattern), {}, 0
        for batch in texts:
            n, k, s = [], [], []
            for t in batch:
                words = tokens = score = 0
                for m in cut.finditer(t.as_py() or ""):
                    w = m[0]
                    got = memo.get(w)
                    if got is None:
                        held += len(w) + 60
                        if held > REMEMBERED:
                            memo, held = {}, len(w)
                        got = memo[w] = trie.insert(w.encode())
                    words += 1
                    score += got[0]
                    tokens -= got[1]
                n.append(words)
                k.append(tokens)
                s.append(score)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64())], ["n_pretokens", "n_tokens", "score"])

    return count


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = 1_500_000) -> DataFrame:
    """One row per row of docs: its id, n_pretokens, n_tokens, score (millionths of a natural logarithm)."""
    count = counter(docs.sparkSession, ranks_path, pattern, max_nodes)
    return docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col).cast("string")).alias("t")).select("doc_id", "t.n_pretokens", "t.n_tokens", "t.score")
