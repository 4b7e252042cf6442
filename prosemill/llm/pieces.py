"""Encoding of texts through a cache of their space-separated pieces.

The pattern that byte-level BPE splits text with never joins what stands before a single space to what stands after it, so a text's ids are those of
its pieces, each but the first with the space before it. Texts where white space meets that space take the plain path as one piece."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides U+0020, as the Unicode property has it, and where such a run lies across the end of a piece; NUL marks first pieces.
_BLANKS = r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ACROSS = rf"[{_BLANKS}] [{_BLANKS}]|[{_BLANKS}] $|  |\x00"


def flat_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder:
    """encode_many: ids of each text of a list, as one flat array and the lengths. The cache is emptied when it holds max_pieces."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_pieces: int = 700_000):
        self.encode_many, self.max_pieces = encode_many, max_pieces
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lens, self.ids, self.n_ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def _add(self, keys: list[str]) -> None:
        at = len(self.index)
        ids, lens = self.encode_many([k[1:] if k[:1] == "\0" else " " + k for k in keys])
        while at + len(keys) > len(self.lens):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.lens[at : at + len(keys)] = lens
        self.starts[at : at + len(keys)] = self.n_ids + np.cumsum(lens) - lens
        self.n_ids += len(ids)
        self.index.update(zip(keys, range(at, at + len(keys)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each.

        Arrow splits the texts and tells the distinct pieces, so that Python looks up each of those once a call."""
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, _ACROSS).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), column, pa.scalar("", pa.large_string()))
        split = pc.split_pattern(marked.filter(pa.array(~whole)), " ")
        pieces = pa.concat_arrays([split.flatten(), marked.filter(pa.array(whole))]).dictionary_encode()
        keys = pieces.dictionary.to_pylist()
        if new := [k for k in keys if k not in self.index]:
            if len(self.index) + len(new) > self.max_pieces:
                self._clear()
                new = keys
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[pieces.indices.to_numpy()]
        counts = np.ones(len(texts), np.int64)
        counts[~whole] = pc.list_value_length(split).to_numpy()
        if whole.any():  # pieces in the order of texts again
            firsts = np.empty(len(texts), np.int64)
            firsts[~whole] = np.cumsum(counts[~whole]) - counts[~whole]
            firsts[whole] = len(split.flatten()) + np.arange(whole.sum())
            at = at[flat_index(firsts, counts)]
        lens = self.lens[at]
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        return self.ids[flat_index(self.starts[at], lens)], total[ends] - total[ends - counts]
