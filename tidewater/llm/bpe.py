"""Byte-level BPE by DuckDB recursive queries, run inside each partition.

A partition's pre-tokens (matches of the split pattern) become rows (word, toks, ranks): a list of tokens, at first one per
byte, and a list of the ranks at which a token merges with the one before it (null: never; one more than tokens, the first
and last are null). A recursive query contracts each word's leftmost pair of minimum rank and joins the new token and its
neighbours on both sides to the merge table, until no pair of the word can merge; decoding gathers the bytes of all tokens of
a batch from the vocabulary's. A worker keeps what it has encoded (a bounded number of bytes), so a pre-token is merged once
and not once for each occurrence. Of what the ids decode to it keeps only what differs from the pre-token's own bytes (with a
vocabulary that tells all bytes apart, nothing).

The merge table holds every split of a vocabulary entry into two entries; a pre-token that is itself an entry starts as
that one token, as the tiktoken library does. The recursion keeps the lists of every round, up to half the square of a pre-token's bytes, so
a batch is bounded by the sum of these squares. Pre-tokens of over ``LONG`` bytes take one recursion step per merge over
all their rows, so they are merged by a heap in the same order instead (exact, n log n).

A null text counts as empty: no ids, and the hash of the empty string. Null and repeated ids, and repeated rows, are rows
like any other. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Mapping
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_keeps

LONG, SQUARES_AT_ONCE = 400, 2_000_000
CACHED, OVERHEAD, KEPT = 60_000_000, 230, 5  # bytes of kept pre-tokens and their results; what one takes, and each of its characters

MERGE = """
WITH RECURSIVE step(word, toks, ranks, low) AS (
    SELECT word, toks, ranks, list_min(ranks) FROM tokens
  UNION ALL
    SELECT word, toks, ranks, list_min(ranks)
    FROM (SELECT c.word, c.toks[1:c.at - 2] || [c.low] || c.toks[c.at + 1:] AS toks, c.ranks[1:c.at - 2] || [l.rank, r.rank] || c.ranks[c.at + 2:] AS ranks
          FROM (SELECT *, list_position(ranks, low) AS at FROM step WHERE low IS NOT NULL) c
          LEFT JOIN merges l ON l.l = c.toks[c.at - 2] AND l.r = c.low LEFT JOIN merges r ON r.l = c.low AND r.r = c.toks[c.at + 1])
)
SELECT word, toks, array_to_string(toks, ',') AS ids FROM step WHERE low IS NULL ORDER BY word
"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def cost(word: str) -> int:
    """About how many bytes a pre-token takes to keep, ids included."""
    return OVERHEAD + KEPT * len(word)


class Known(Mapping):
    """What a codec keeps, as pre-token -> (ids, number of ids, decoded bytes)."""

    def __init__(self, ids: dict[str, str], odd: dict[str, bytes]):
        self.ids, self.odd = ids, odd

    def __getitem__(self, word: str) -> tuple[str, int, bytes]:
        ids = self.ids[word]
        return ids, ids.count(",") + 1, decoded([word], self.odd)

    def __iter__(self) -> Iterator[str]:
        return iter(self.ids)

    def __len__(self) -> int:
        return len(self.ids)


def decoded(words: list[str], odd: dict[str, bytes]) -> bytes:
    """What the ids of these pre-tokens decode to: their own bytes, but for those in `odd`."""
    if not odd:
        return "".join(words).encode()
    return b"".join([odd[w] if w in odd else w.encode() for w in words])


class Codec:
    """Encodes and decodes distinct pre-tokens; one for each Python worker."""

    def __init__(self, data: bytes):
        self.ranks = ranks = parse_ranks(data)
        self.names = {r: b for b, r in ranks.items()}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.ids: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}  # pre-tokens whose ids decode to other bytes than theirs
        self.held = 0
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": "false"})
        splits = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True)) if splits else (pa.array([], pa.int32()),) * 3
        merges = pa.table({"l": left, "r": right, "rank": rank})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.pairs = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], dtype=np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        self.sizes[list(ranks.values())] = [len(b) for b in ranks]
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.bytes = np.frombuffer(b"".join([self.names[r] for r in sorted(self.names)]), dtype=np.uint8)

    @property
    def known(self) -> Known:
        return Known(self.ids, self.odd)

    def learn(self, used: Iterable[str]) -> None:
        """Have all of these in `known`. What is known makes up two generations of half of CACHED each: when the newer is full
        it becomes the older, what is used of that comes back, and the rest goes with the next change."""
        used = set(used)
        if self.held > CACHED // 2:
            self.before, self.ids, self.held = self.ids, {}, 0
        words = used.difference(self.ids)
        self.held += OVERHEAD * len(words) + KEPT * sum(map(len, words))
        again = words.intersection(self.before)
        self.ids.update({w: self.before[w] for w in again})
        held, squares = [], 0
        for w in words.difference(again):
            b = w.encode()
            n = len(b) ** 2
            if len(b) > LONG and b not in self.ranks:
                out = self.by_heap(b)
                self._keep(w, b, ",".join(map(str, out)), b"".join(map(self.names.__getitem__, out)))
                continue
            if held and squares + n > SQUARES_AT_ONCE:
                self._merge(held)
                held, squares = [], 0
            held.append((w, b))
            squares += n
        if held:
            self._merge(held)

    def _keep(self, word: str, own: bytes, ids: str, decodes: bytes) -> None:
        self.ids[word] = ids
        if decodes != own:
            self.odd[word] = decodes

    def _merge(self, words: list[tuple[str, bytes]]) -> None:
        """Encode and decode (pre-token, its UTF-8), by one query for all of them."""
        parts = [x for x in words if x[1] not in self.ranks]
        whole = [x for x in words if x[1] in self.ranks]  # these begin as one token each
        some, raw = parts + whole, np.frombuffer(b"".join([b for _, b in parts]), dtype=np.uint8)
        size = np.array([len(b) for _, b in parts] + [1] * len(whole))
        tok = np.concatenate([self.first[raw], np.array([self.ranks[b] for _, b in whole], dtype=np.int64)]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        behind = ends + np.arange(len(ends), dtype=np.int32)
        ranks = np.full(len(tok) + len(some), -1, dtype=np.int32)
        ranks[np.arange(1, len(raw)) + np.repeat(np.arange(len(parts)), size[: len(parts)])[1:]] = self.pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        ranks[behind[:-1]] = -1
        tokens = pa.table({"word": np.arange(len(some), dtype=np.int32), "toks": pa.ListArray.from_arrays(ends, tok), "ranks": pa.ListArray.from_arrays(behind, pa.array(ranks, mask=ranks < 0))})
        self.con.register("tokens", tokens)
        got = self.con.sql(MERGE).to_arrow_table().combine_chunks()
        self.con.unregister("tokens")
        toks = got.column("toks").combine_chunks()
        decodes, at = self._decode(toks.flatten().to_numpy(), np.append(0, np.cumsum(toks.value_lengths().to_numpy())))
        for (w, own), ids, i, j in zip(some, got.column("ids").to_numpy().tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            self._keep(w, own, ids, decodes[i:j])

    def _decode(self, toks: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all tokens, one after the other, and where those of each run of tokens begin and end."""
        size = self.sizes[toks]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[toks] - ends[:-1], size)].tobytes(), ends[cuts]

    def by_heap(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out


def codec(data: bytes) -> Codec:
    return worker_keeps("bpe " + hashlib.sha256(data).hexdigest(), lambda: Codec(data))


AT_ONCE = 2_000_000  # characters of texts that are cut together; a longer text is cut by itself, bit by bit


def _groups(texts: pa.Array):
    held, size = [], 0
    for t in texts:
        text = t.as_py() or ""
        if held and size + len(text) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _long(text: str, coder: Codec, cut: regex.Pattern, digest: bool, check: bool = False, at_once: int = 200_000) -> tuple:
    """One text's row, with no more than at_once pre-tokens in hand."""
    n, ids, decodes, begun = 0, hashlib.sha256() if digest else [], hashlib.sha256() if digest else [], False
    own, at, same = text.encode() if check else b"", 0, True
    put = (lambda to, x: to.update(x)) if digest else (lambda to, x: to.append(x))
    matches = (m[0] for m in cut.finditer(text))
    while ws := list(islice(matches, at_once)):
        used = set(ws)
        coder.learn(used)
        some = ",".join(map(coder.ids.__getitem__, ws))
        put(ids, (b"," if begun else b"") + some.encode())
        said = decoded(ws, coder.odd)
        if check:
            same = same and own.startswith(said, at)
            at += len(said)
        else:
            put(decodes, said)
        n, begun = n + some.count(",") + 1, True
    if digest:
        return n, ids.hexdigest(), decodes.hexdigest()
    return b"".join(ids).decode(), n, same and at == len(own) if check else b"".join(decodes)


SCHEMA = "struct<ids: string, n_tokens: bigint, decoded: binary>"
CHECKED = "struct<ids: string, n_tokens: bigint, round_trip: boolean>"
DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def _rows(group: list[str], coder: Codec, cut: regex.Pattern, digest: bool, check: bool) -> list[tuple]:
    if len(group) == 1 and len(group[0]) > AT_ONCE:
        return [_long(group[0], coder, cut, digest, check)]
    words = [cut.findall(t) for t in group]
    used = set().union(*words)
    coder.learn(used)
    get, rows = coder.ids.__getitem__, []
    for text, ws in zip(group, words, strict=True):
        ids, decodes = ",".join(map(get, ws)), decoded(ws, coder.odd)
        n = ids.count(",") + 1 if ws else 0
        if digest:
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decodes).hexdigest()))
        else:
            rows.append((ids, n, decodes == text.encode() if check else decodes))
    return rows


def _each(texts: Iterator[pa.Array], data: bytes, pattern: str, digest: bool, check: bool = False) -> Iterator[pa.Array]:
    """An array for each group of texts, not for each batch: a batch's ids take several times what its texts do."""
    coder, cut = codec(data), regex.compile(pattern)
    if digest:
        names, kinds = ("n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.string(), pa.string())
    else:
        names, kinds = ("ids", "n_tokens", "round_trip" if check else "decoded"), (pa.string(), pa.int64(), pa.bool_() if check else pa.binary())
    for batch in texts:
        for group in _groups(batch):
            cols = zip(*_rows(group, coder, cut, digest, check), strict=True)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))
        del batch
        pa.default_memory_pool().release_unused()


def encoder(spark, ranks_path: str, pattern: str, digest: bool = False, check: bool = False):
    """A column function: text -> struct(ids, n_tokens, decoded), or their digests, made where the ids are; or with `check`
    struct(ids, n_tokens, round_trip), whether the ids decode to the text, which spares sending what they decode to."""
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(DIGEST if digest else CHECKED if check else SCHEMA)
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(texts, shared.value, pattern, digest, check)

    return encode


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids (decimal, joined by commas), n_tokens, decoded (bytes); or their digests."""
    encode = encoder(docs.sparkSession, ranks_path, pattern, digest)
    return docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text_col).cast("string")).alias("t")).select("doc_id", "t.*")
