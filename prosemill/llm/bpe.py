"""Byte-level BPE encoding and decoding with numpy: padded matrices by length, one merge a row and round.

Words (matches of the split pattern) of like length stand in one padded matrix of ids. Each round every row merges its leftmost pair of least rank, found
in a matrix of the neighbours' ranks; ranks of pairs come from an open-addressing hash table. Rows without a mergeable pair leave the matrix, which also
loses its emptied column. Words above LONG bytes take a heap instead: one merge a round would cost the square of their length.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .pieces import PieceEncoder, flat_index

#: Above any rank: no such pair.
NONE = np.int32(2**31 - 1)
#: Bytes of a word above which a heap is used.
LONG = 1024
#: Cells of a matrix at most.
CELLS = 1 << 21
#: White space of the split pattern, as the Unicode property has it.
SPACE = r"\t-\r \x85\xa0  -     　"


class PairTable:
    """Ranks by pair of ids: open addressing with linear probing, built and searched by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ranks, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), 0
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several the last one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 31) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE for pairs that aren't in the table or hold padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        flat, at = out.reshape(-1), np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.reshape(-1)[at], right.reshape(-1)[at])
        slot = self._slot(keys)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held >= 0)
            if not on.any():
                break
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class MatrixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        split = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(split, np.int64).reshape(-1, 3).T)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_lens = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.token_lens[r] = len(t)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.blob = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(size) - size
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their numbers of ids, flat ids
        edge = 1
        while (size >= edge).any() and edge <= LONG:
            upto = min(LONG, max(edge, edge * 5 // 4))  # a bucket: lengths from edge to upto
            rows = np.flatnonzero((size >= edge) & (size <= upto))
            step = max(1, CELLS // upto)
            for k in range(0, len(rows), step):
                parts += self._merge(rows[k : k + step], raw, starts, size, upto)
            edge = upto + 1
        for w in np.flatnonzero(size > LONG):
            ids = self._merge_long(words[w])
            parts.append((np.array([w]), np.array([len(ids)]), ids))
        lens = np.zeros(len(words), np.int64)
        for rows, n, _ in parts:
            lens[rows] = n
        at, out = np.cumsum(lens) - lens, np.empty(int(lens.sum()), np.int32)
        for rows, n, ids in parts:
            out[flat_index(at[rows], n)] = ids
        return out, lens

    def _merge(self, rows: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, done = size[rows], []
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = raw[flat_index(starts[rows], n)]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if rank.shape[1]:
                best = rank.argmin(1)  # the leftmost of the least
                least = rank[np.arange(len(rows)), best]
                on = least < NONE
            else:
                on = np.zeros(len(rows), bool)
            if not on.all():
                off = ~on
                done.append((rows[off], n[off], ids[off][np.arange(ids.shape[1]) < n[off][:, None]]))
                rows, n, ids = rows[on], n[on], ids[on]
                if not len(rows):
                    break
                rank, best, least = rank[on], best[on], least[on]
            each, col = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids[each, best] = least
            ids = np.where(col <= best[:, None], ids[:, :-1], ids[:, 1:])
            rank = np.where(col[:-1] < best[:, None], rank[:, :-1], rank[:, 1:])
            n = n - 1
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1] = self.pairs.get(ids[has, best[has] - 1], ids[has, best[has]])
            has = np.flatnonzero(best < rank.shape[1])
            rank[has, best[has]] = self.pairs.get(ids[has, best[has]], ids[has, best[has] + 1])
        return done

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one word, with a heap of (rank, place) over a linked list."""
        ids, n = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), len(word)
        part = [word[i : i + 1] for i in range(n)]
        nxt, prv, ranks = [*range(1, n), -1], list(range(-1, n - 1)), self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if part[i] else -1
            if j < 0 or ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j], ids[i], nxt[i] = part[i] + part[j], b"", r, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (q := ranks.get(part[i] + part[nxt[j]])) is not None:
                    heapq.heappush(heap, (q, i))
            if prv[i] >= 0 and (q := ranks.get(part[prv[i]] + part[i])) is not None:
                heapq.heappush(heap, (q, prv[i]))
        return np.array([t for t, p in zip(ids, part, strict=True) if p], np.int32)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each; equal words are merged once."""
        plain = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and not t[1].isspace() and not t[-1].isspace() and " " not in t[1:]]
        found = self.pattern.findall("".join([texts[i] for i in plain]))  # in these, the first word alone starts with a space
        first = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(first, append=len(found))
        rest = np.ones(len(texts), bool)
        rest[plain] = False
        if rest.any():
            order = np.concatenate([plain, np.flatnonzero(rest)]).astype(np.int64)
            for i in order[len(plain) :]:
                more = self.pattern.findall(texts[i])
                counts[i] = len(more)
                found += more
        words = list(dict.fromkeys(found))
        index = dict(zip(words, range(len(words)), strict=True))
        at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        if rest.any():  # back into the order of the texts
            begin = np.zeros(len(texts), np.int64)
            begin[order] = np.cumsum(counts[order]) - counts[order]
            at = at[flat_index(begin, counts)]
        ids, lens = self.encode_words([w.encode() for w in words])
        starts = np.cumsum(lens) - lens
        total = np.concatenate([[0], np.cumsum(lens[at])])
        ends = np.cumsum(counts)
        return ids[flat_index(starts[at], lens[at])], total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        return self.blob[flat_index(self.token_starts[ids], self.token_lens[ids])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _codec(path: str, pattern: str) -> tuple[MatrixBPE, PieceEncoder]:
    bpe = MatrixBPE(read_ranks(path), pattern)
    return bpe, PieceEncoder(bpe.encode_texts)


def local_file(path: str) -> str:
    """path, or the copy of it that the driver sent with SparkContext.addFile if it was given as files://name."""
    return SparkFiles.get(path.removeprefix("files://")) if path.startswith("files://") else path


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of the text, and decoded binary, the bytes that these ids stand for. ranks_path: a rank file that every machine has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = _codec(local_file(ranks_path), pattern)
        for part, texts in chunks(batches, "_text"):
            ids, lens = pieces.encode(texts)
            ends = np.concatenate([[0], np.cumsum(lens)])
            sizes = np.concatenate([[0], np.cumsum(bpe.token_lens[ids])])[ends]
            blob = bpe.decode(ids)
            decoded = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(blob))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), decoded], ["_key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>, decoded binary").withColumnRenamed("_key", key)
