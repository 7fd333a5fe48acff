"""Byte-level BPE of whole columns of text, in padded numpy matrices.

Texts are split by the tokenizer's pattern; equal pieces are encoded once per worker. New pieces of a batch are
bucketed by byte length into padded matrices of token ids. In every round each row merges its leftmost pair of
minimum rank; ranks come from an open-addressing hash table over numpy arrays, a merge shifts the row's tail left, and
rows without a pair left are compacted away. The vocabulary file is read once on the driver and goes to the workers as
one broadcast of a few MB, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from convoloom.session import table

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("CONVOLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int32(2**31 - 1)
#: Pieces above this many bytes merge on a heap instead of in a matrix: the same merges in n log n.
LONG = 512
#: Pieces remembered by a worker; then it starts afresh.
REMEMBER = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks aren't consecutive")
    return [t for _, t in pairs]


def merges_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left << 20 | right) and the id each merges to. A token's pair is what merges of lower rank leave of it."""
    rank = {t: i for i, t in enumerate(tokens)}
    keys, ids = [], []
    for r, token in enumerate(tokens):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = r, -1
            for i in range(len(parts) - 1):
                k = rank.get(parts[i] + parts[i + 1], r)
                if k < best:
                    best, at = k, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            keys.append(rank[parts[0]] << 20 | rank[parts[1]])
            ids.append(r)
    return np.array(keys, np.int64), np.array(ids, np.int32)


class PairTable:
    """Open addressing over numpy arrays: pair key -> merged id, NEVER if the pair doesn't merge."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NEVER, np.int32)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            winners = left[free][first]
            self.keys[slot[winners]], self.ids[slot[winners]] = keys[winners], ids[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        bad = (left < 0) | (right < 0)
        slot = self._slot(np.where(bad, 0, keys).ravel())
        keys, out = keys.ravel(), np.full(keys.size, NEVER, np.int32)
        open_ = np.flatnonzero(~bad.ravel())
        for _ in range(self.probes):
            if not len(open_):
                break
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ids[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ids: np.ndarray, pattern: str = PATTERN):
        self.byte_ids, self.pairs, self.split, self.known = byte_ids, PairTable(keys, ids), regex.compile(pattern), {}

    def matrix(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        """Merges rows of like length: every round each row's leftmost pair of minimum rank."""
        width = max(map(len, rows))
        ids = np.full((len(rows), width), -1, np.int32)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = self.byte_ids[np.frombuffer(r, np.uint8)]
        out: list = [None] * len(rows)
        which = np.arange(len(rows))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 1), NEVER, np.int32)
        while len(which):
            at = ranks.argmin(1)
            low = ranks[np.arange(len(which)), at]
            done = low == NEVER
            if done.any():
                for i, row in zip(which[done], ids[done]):
                    out[i] = tuple(row[row >= 0].tolist())
                keep = ~done
                ids, ranks, which, at, low = ids[keep], ranks[keep], which[keep], at[keep], low[keep]
                if not len(which):
                    break
                width = int((ids >= 0).sum(1).max())
                ids, ranks = ids[:, :width], ranks[:, : max(1, width - 1)]
            n = np.arange(len(which))
            ids[n, at] = low
            shift = np.arange(ids.shape[1] - 1)[None, :] + (np.arange(ids.shape[1] - 1)[None, :] > at[:, None])
            ids = np.concatenate([np.take_along_axis(ids, shift, 1), np.full((len(n), 1), -1, np.int32)], 1)
            if ranks.shape[1] > 1:
                shift = np.arange(ranks.shape[1] - 1)[None, :] + (np.arange(ranks.shape[1] - 1)[None, :] >= at[:, None])
                ranks = np.concatenate([np.take_along_axis(ranks, shift, 1), np.full((len(n), 1), NEVER, np.int32)], 1)
            else:
                ranks = np.full_like(ranks, NEVER)
            before = at > 0
            ranks[n[before], at[before] - 1] = self.pairs.find(ids[n[before], at[before] - 1], ids[n[before], at[before]])
            inside = at < ids.shape[1] - 1
            ranks[n[inside], at[inside]] = self.pairs.find(ids[n[inside], at[inside]], ids[n[inside], at[inside] + 1])
        return out

    def long_piece(self, piece: bytes) -> tuple[int, ...]:
        """The same merges over a linked list and a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64)
        first = self.pairs.find(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, len(piece))) + [-1], [-1, *range(len(piece) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NEVER]
        heapq.heapify(heap)
        pair = {}

        def push(i, j):
            key = (ids[i], ids[j])
            if key not in pair:
                pair[key] = int(self.pairs.find(np.array([key[0]]), np.array([key[1]]))[0])
            if pair[key] != NEVER:
                heapq.heappush(heap, (pair[key], i, *key))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces) -> None:
        """Encodes the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, list(pieces)
        buckets: dict[int, list] = {}
        for p in new:
            raw = p.encode("utf8")
            if len(raw) > LONG:
                self.known[p] = self.long_piece(raw)
            else:
                buckets.setdefault(max(2, (len(raw) - 1).bit_length()), []).append((p, raw))
        for rows in buckets.values():
            for i in range(0, len(rows), 16384):
                part = rows[i : i + 16384]
                for (p, _), ids in zip(part, self.matrix([raw for _, raw in part])):
                    self.known[p] = ids

    def encode(self, texts: list[str | None], at_once: int = 2_000_000) -> list[list[int]]:
        """Token ids of each text; null and empty give an empty list. at_once characters are split together."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < at_once):
                size += len(texts[j] or "")
                j += 1
            pieces = [self.split.findall(t) if t else [] for t in texts[i:j]]
            self.learn(set(chain.from_iterable(pieces)))
            known = self.known
            out += [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
            i = j
        return out


def parts_of_tokenizer(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = read_ranks(path)
    byte_ids = np.zeros(256, np.int32)
    for i, t in enumerate(tokens):
        if len(t) == 1:
            byte_ids[t[0]] = i
    return byte_ids, *merges_of(tokens)


_encoder: dict = {}


def encoder_of(shared, name: str) -> Encoder:
    """The worker's encoder, made once and used by all its tasks."""
    if name not in _encoder:
        _encoder[name] = Encoder(*shared.value)
    return _encoder[name]


def share_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A broadcast of the tokenizer's parts: about 1 MB for 50,000 ranks."""
    return spark.sparkContext.broadcast(parts_of_tokenizer(os.path.join(folder, f"{name}.tiktoken")))


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids (array<int>) of every row: the text by the tokenizer, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text; a text of any
    length is encoded whole; lone surrogates can't occur in Spark's strings. Repeated rows give repeated results.
    """
    shared = share_tokenizer(df.sparkSession, name, folder)

    def go(batches):
        e = encoder_of(shared, name)
        for b in batches:
            ids = e.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and n_tokens of every row, 0 for null and empty texts."""
    shared = share_tokenizer(df.sparkSession, name, folder)

    def go(batches):
        e = encoder_of(shared, name)
        for b in batches:
            n = [len(x) for x in e.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, n_tokens bigint")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")
