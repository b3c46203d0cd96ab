"""Byte-level BPE (1): encoding by ranks and decoding, on padded matrices of byte pieces.

A text is cut by the vocabulary's pattern. A piece that is itself a token is done; the others are put,
by bucket of length, into padded matrices of token ids. In every round each row merges its leftmost pair
of least rank, pair ranks come from a hash table of pairs, and the matrix loses a column (compaction);
rows without a pair leave. A matrix costs a piece the square of its length; so pieces longer than LONG bytes
(words aren't) make the same merges in the same order one at a time, by a heap over a linked list.

Cases: null text counts as empty and has no ids; control strings such as <|endoftext|> are ordinary text;
repeated rows each give a row; texts over BLOCK characters are cut and encoded in blocks of pieces; an empty
table gives no rows; other columns are not read by the query, and stay beside ids and decoded in the operators.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import table, text_or_empty
from rowloom.llm.textnp import trim

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 256
#: Cells of one padded matrix, entries of the piece cache, characters of a text taken at once, bytes of a result batch.
CELLS, CACHE, BLOCK, BATCH = 1 << 18, 150_000, 1 << 20, 4 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank by pair of ids: open addressing, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key, at, todo = self.key(left, right), None, np.arange(len(rank))
        at = self.slot(key)
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = np.unique(at[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.keys[at[won]], self.ranks[at[won]] = key[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            taken = self.keys[at[todo]] != key[todo]
            at[todo[taken]] = (at[todo[taken]] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 31) | right.astype(np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE for what is no pair; a negative id is padding."""
        key = self.key(left, right)
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Bpe:
    """Encoder and decoder of one vocabulary of ranks (lines of base64 bytes and a rank)."""

    def __init__(self, blob: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.token = {i: t for t, i in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = (x for t, r in self.rank.items() for k in range(1, len(t)) if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None for x in (a, b, r))
        self.pairs = PairTable(*np.fromiter(pairs, np.int64).reshape(-1, 3).T)
        self.pieces = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def merged_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row of a matrix of ids that is padded with -1 on the right: (ids, how many of each row)."""
        out, count = np.zeros(rows.shape, "<u4"), np.zeros(len(rows), np.int64)
        where = np.arange(len(rows))

        def end(which: np.ndarray, left: np.ndarray) -> None:
            out[which, : left.shape[1]] = np.maximum(left, 0)
            count[which] = (left >= 0).sum(1)

        ranks = self.pairs(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            if not ranks.shape[1]:
                end(where, rows)
                break
            at = ranks.argmin(1)  # the leftmost of the least
            each = np.arange(len(rows))
            least = ranks[each, at]
            if (done := least == NONE).any():
                end(where[done], rows[done])
                on = ~done
                rows, ranks, where, at, least = rows[on], ranks[on], where[on], at[on], least[on]
                if not len(rows):
                    break
                # Padding that no row needs any more goes too.
                width = int((rows >= 0).any(0).sum())
                rows, ranks, each = rows[:, :width], ranks[:, : width - 1], each[: len(rows)]
            rows[each, at] = least
            cols = np.arange(rows.shape[1] - 1)
            rows = np.where(cols > at[:, None], rows[:, 1:], rows[:, :-1])
            cols = cols[:-1]
            ranks = np.where(cols > at[:, None], ranks[:, 1:], ranks[:, :-1])
            for k in (at - 1, at):  # the two pairs that have the merged token
                ok = np.flatnonzero((k >= 0) & (k < ranks.shape[1]))
                ranks[ok, k[ok]] = self.pairs(rows[ok, k[ok]], rows[ok, k[ok] + 1])
        return out, count

    def merged_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges of one piece of any length, in n log n: its tokens are a linked list, and a heap has the pairs by rank
        and place, so that the leftmost of the least comes first. A pair that has changed since is passed over."""
        n, ranks = len(ids), self.pairs(ids[:-1], ids[1:])
        has = np.flatnonzero(ranks != NONE)
        heap = ((ranks[has].astype(np.int64) << 32) | has).tolist()
        heapify(heap)
        token, now = ids.tolist(), [*ranks.tolist(), int(NONE)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def pair(i: int, j: int) -> None:
            rank = self.rank.get(self.token[token[i]] + self.token[token[j]]) if j < n else None
            now[i] = NONE if rank is None else rank
            if rank is not None:
                heappush(heap, rank << 32 | i)

        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if now[i] != rank:
                continue
            j = after[i]
            token[i], token[j], now[j] = rank, -1, NONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            pair(i, k)
            if (p := before[i]) >= 0:
                pair(p, i)
        return np.array([t for t in token if t >= 0], np.int64)

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        pieces = list(pieces)
        coded = [p.encode() for p in pieces]
        whole = [self.rank.get(b) for b in coded]
        out = {p: i.to_bytes(4, "little") for p, i in zip(pieces, whole) if i is not None}
        todo = [k for k, i in enumerate(whole) if i is None]
        length = np.fromiter((len(coded[k]) for k in todo), np.int64, len(todo))
        bucket = np.minimum(np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64), LONG.bit_length())
        for e in np.unique(bucket):
            own = np.flatnonzero(bucket == e)
            if 1 << int(e) > LONG:
                for k in own:
                    p = todo[k]
                    out[pieces[p]] = self.merged_long(self.byte[np.frombuffer(coded[p], np.uint8)]).astype("<u4").tobytes()
                continue
            own = own[np.argsort(length[own], kind="stable")]
            for j in range(0, len(own), step := max(1, CELLS >> int(e))):
                part = own[j : j + step]
                n = length[part]
                rows = np.full((len(part), n.max()), -1, np.int32)
                rows[np.arange(rows.shape[1]) < n[:, None]] = self.byte[np.frombuffer(b"".join([coded[todo[k]] for k in part]), np.uint8)]
                ids, count = self.merged_rows(rows)
                blob, width = ids.tobytes(), 4 * ids.shape[1]
                for i, (k, c) in enumerate(zip(part.tolist(), (4 * count).tolist())):
                    out[pieces[todo[k]]] = blob[i * width : i * width + c]
        return out

    def blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.pieces.findall(text)
        else:
            found = (m[0] for m in self.pieces.finditer(text))
            while part := list(islice(found, BLOCK // 4)):
                yield part

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. The pieces of all texts that aren't in the cache are encoded together."""
        if sum(map(len, texts)) > BLOCK and len(texts) > 1:
            half = len(texts) // 2
            yield from self.encode(texts[:half])
            yield from self.encode(texts[half:])
            return
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            yield b"".join(self._known(part) for part in self.blocks(texts[0]))
            return
        cut = [self.pieces.findall(t) for t in texts]
        self._learn({p for part in cut for p in part})
        for part in cut:
            yield b"".join(map(self.cache.__getitem__, part))

    def _learn(self, pieces: set[str]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache.update(self.encode_pieces(pieces - self.cache.keys()))

    def _known(self, part: list[str]) -> bytes:
        self._learn(set(part))
        return b"".join(map(self.cache.__getitem__, part))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def loaded(blob: bytes, pattern: str) -> Bpe:
    """One encoder for each vocabulary and worker."""
    key = hashlib.md5(blob + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(blob, pattern)
    return _LOADED[key]


def vocabulary(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _mapped(df: DataFrame, column: str, to: list[str], per_batch) -> DataFrame:
    """df with binary columns `to`, which per_batch makes of the values of `column`, a list for each."""
    names = [c for c in df.columns if c not in to]
    schema = df.select(*names).schema
    for c in to:
        schema = schema.add(c, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(256, int(batch.num_rows * BATCH / max(1, batch.nbytes))))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                made = [pa.array(x, pa.binary()) for x in per_batch(part.column(column).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, *to])
        for one in _LOADED.values():
            one.cache.clear()
        trim()

    return df.select(*df.columns).mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the ids of each whole text, as little-endian unsigned 32-bit integers. The vocabulary is
    sent to the workers once; its size is that of the file and doesn't depend on the data."""
    blob = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return _mapped(docs, text, [to], lambda texts: [list(loaded(blob.value, pattern).encode(["" if t is None else t for t in texts]))])


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the bytes that the ids stand for."""
    blob = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    return _mapped(df, ids, [to], lambda found: [[loaded(blob.value, pattern).decode(x or b"") for x in found]])


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ids and decoded, as decode(encode(docs)), but in one Python worker a task: it holds one vocabulary, and the ids are sent once."""
    blob = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def both(texts: list[str | None]) -> list[list[bytes]]:
        bpe = loaded(blob.value, pattern)
        ids = list(bpe.encode(["" if t is None else t for t in texts]))
        return [ids, [bpe.decode(x) for x in ids]]

    return _mapped(docs, text, ["ids", "decoded"], both)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    coded = round_trip(docs.select("doc_id", text_or_empty("text").alias("text"))).select("doc_id", "ids", "decoded")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids and digests of each document."""
    coded = round_trip(docs.select("doc_id", text_or_empty("text").alias("text"))).select("doc_id", "ids", "decoded")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
