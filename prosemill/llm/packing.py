"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition keeps at most `open_windows` windows. A document first gives up its full windows; what is left goes whole into the open window that it
fits best. If it fits none and no further window may be opened, the fullest is emitted: topped up with the head of the document if both parts have
min_piece tokens at least, padded otherwise. Windows still open at the end of a partition are merged: `fan_in` partitions at a time, fullest first,
filled to the brim, so that one window of each such group is short. Nothing is gathered beyond fan_in * open_windows windows.

Defined cases: a null or empty text is a document of its end token alone; repeated rows are packed each by itself; extra columns are ignored; an empty
table gives an empty result. Results follow the order of rows within partitions, which a reread table keeps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import local_file, read_ranks
from .common import chunks, materialise
from .pieces import PieceEncoder

#: Columns of a piece: ids_crc32 over the little-endian 32-bit ids.
PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def _of_json(path: str) -> tuple[dict[bytes, int] | None, dict[str, int]]:
    """Ranks and special tokens of a tokenizers file; no ranks if it isn't byte-level BPE whose ids follow its merges, or changes text before."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, special = own["model"], {t["content"]: t["id"] for t in own["added_tokens"]}
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves; the others from U+0100 on
    spelled = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not own["normalizer"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"])
    if model["type"] != "BPE" or not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None, special
    return {bytes(spelled[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special


def _encoder(path: str, pattern: str) -> PieceEncoder:
    """Of a tokenizers file (.json), special tokens in the text included, or of ranks (any other); the first use in a process reads the file.

    Where a tokenizers file is plain byte-level BPE, tiktoken takes its merges and special tokens: the ids are those of the library, in less time."""
    if (path, pattern) not in _ENCODERS:
        ranks, special = _of_json(local_file(path)) if path.endswith(".json") else (read_ranks(local_file(path)), {})
        if ranks is None:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(local_file(path))
            ids_of: Callable[[list[str]], list[list[int]]] = lambda ts: [e.ids for e in own.encode_batch_fast(ts, add_special_tokens=False)]
        else:
            import tiktoken

            held = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            ids_of = lambda ts: [held.encode(t, allowed_special="all") if "<|" in t else held.encode_ordinary(t) for t in ts]
            if any("<|" not in t for t in special):
                ids_of = lambda ts: [held.encode(t, allowed_special="all") for t in ts]
        if any(" " in t for t in special):
            raise ValueError(f"special tokens with blanks: {path}")

        def many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = ids_of(texts)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())), lens

        _ENCODERS[path, pattern] = PieceEncoder(many)
    return _ENCODERS[path, pattern]


class Packer:
    """emit(pieces, full) gets the pieces (doc, start, ids, doc_tokens) of each window that is done."""

    def __init__(self, length: int, open_windows: int, min_piece: int, emit: Callable[[list[tuple]], None]):
        self.length, self.most, self.min_piece, self.emit = length, open_windows, min_piece, emit
        self.windows: list[list[tuple]] = []
        self.free: list[int] = []

    def _put(self, w: int, piece: tuple) -> None:
        self.windows[w].append(piece)
        self.free[w] -= len(piece[2])
        if not self.free[w]:
            self._close(w)

    def _close(self, w: int) -> None:
        self.emit(self.windows.pop(w))
        self.free.pop(w)

    def add(self, doc: object, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.length:
            self.emit([(doc, at, ids[at : at + self.length], n)])
            at += self.length
        while at < n:
            rest = n - at
            best = min((f, w) for w, f in enumerate(self.free) if f >= rest)[1] if any(f >= rest for f in self.free) else -1
            if best < 0:
                if len(self.windows) < self.most:
                    self.windows.append([])
                    self.free.append(self.length)
                    continue
                fullest = self.free.index(min(self.free))
                gap = self.free[fullest]
                if gap < self.min_piece or rest - gap < self.min_piece:
                    self._close(fullest)
                    continue
                self._put(fullest, (doc, at, ids[at : at + gap], n))
                at += gap
                continue
            self._put(best, (doc, at, ids[at:], n))
            break


def _rows(window: list[tuple], sequence: int, with_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, n in window:
        raw = ids.astype("<u4").tobytes()
        out.append((doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, raw if with_ids else None))
        offset += len(ids)
    return out


def pack(
    df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = 1024, open_windows: int = 32, min_piece: int = 1, fan_in: int = 32, with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary (null unless with_ids)."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part int, open boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path, pattern), TaskContext.get().partitionId()
        done: list[list[tuple]] = []
        packer, count, of = Packer(length, open_windows, min_piece, done.append), 0, None

        def out(windows: list[list[tuple]], opened: bool) -> pa.RecordBatch:
            nonlocal count
            found = []
            for w in windows:
                found += _rows(w, (part << 32) + count, with_ids or opened)
                count += 1
            cols = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], of), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)], pa.array([part] * len(found), pa.int32()), pa.array([opened] * len(found))], ["_key", *PIECE, "part", "open"])

        for slice_, texts in chunks(batches, "_text"):
            of = slice_.column(0).type
            flat, lens = encoder.encode(texts)
            at = 0
            for doc, n in zip(slice_.column(0).to_pylist(), lens.tolist(), strict=True):
                packer.add(doc, np.append(flat[at : at + n], np.int32(end_id)))
                at += n
            if done:
                yield out(done, False)
                done.clear()
        if left := [w for w in packer.windows if w]:
            yield out(left, True)

    first = materialise(rows.mapInArrow(run, schema), "packed")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable")
        full = pdf.groupby("sequence_id")["length"].transform("sum")
        pdf = pdf.assign(full=full).sort_values(["full", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        windows: list[list[tuple]] = [[]]
        room = length
        for doc, start, raw, n in zip(pdf["_key"], pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True):
            ids = np.frombuffer(raw, "<u4")
            while len(ids):
                windows[-1].append((doc, start, ids[:room], n))
                taken = min(room, len(ids))
                ids, start, room = ids[taken:], start + taken, room - taken
                if not room:
                    windows.append([])
                    room = length
        names = sorted(pdf["sequence_id"].unique())  # free again, and no fewer than the windows now
        found = [r for name, w in zip(names, [x for x in windows if x]) for r in _rows(w, int(name), with_ids)]  # noqa: B905
        return pd.DataFrame(found, columns=["_key", *PIECE])

    merged = first.where("open").groupBy((F.col("part") / F.lit(fan_in)).cast("int").alias("_group")).applyInPandas(lambda pdf: merge(pdf), schema.split(", part int")[0])
    return first.where("not open").drop("part", "open").unionByName(merged).withColumnRenamed("_key", key)
