"""Token ids of text pieces: every distinct piece of a step is encoded once, and a bounded memory keeps frequent ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quirefold.llm.common import ragged

#: Distinct pieces kept between steps; beyond it the memory starts anew, which changes no result.
KEPT_PIECES = 300_000


class PieceTable:
    """Ids of distinct pieces, by slot. `encode` gives, for a list of pieces, their ids one after another and the counts.

    A piece that matches `plain`, letters and then one full stop or comma, is taken as the piece without that mark and
    the mark's own id (`marks`): no token holds both. `folded` lower-cases A-Z of plain pieces, for encoders that do so.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], plain: str, marks: dict[str, int], folded: bool, kept: int = KEPT_PIECES):
        self.encode, self.plain, self.marks, self.folded, self.kept = encode, plain, marks, folded, kept
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint16), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each piece has."""
        coded = pieces.dictionary_encode()
        bases, mark = self._without_mark(coded.dictionary)
        again = bases.dictionary_encode()
        distinct = again.dictionary.to_pylist()
        if len(self.slots) + len(distinct) > self.kept:
            self.clear()
        known = self.slots
        new = [p for p in distinct if p not in known]
        if new:
            self._add(new)
        slot = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[again.indices.to_numpy()]
        marked = mark >= 0
        sizes = self.sizes[slot] + marked
        # The ids of the distinct pieces of this step, marks included, then those of all pieces in their order.
        ids = np.zeros(int(sizes.sum()), np.uint16)
        starts = np.cumsum(sizes) - sizes
        ids[ragged(starts, self.sizes[slot])] = self.ids[ragged(self.starts[slot], self.sizes[slot])]
        ids[(starts + sizes - 1)[marked]] = mark[marked]
        row = coded.indices.to_numpy()
        return ids[ragged(starts[row], sizes[row])], sizes[row]

    def _without_mark(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        plain = pc.match_substring_regex(distinct, self.plain)
        kept = pc.ascii_lower(distinct) if self.folded else distinct
        base = pc.if_else(plain, pc.utf8_rtrim(kept, "".join(self.marks)), distinct)
        mark = np.full(len(distinct), -1, np.int64)
        for text, token in self.marks.items():
            mark[pc.and_(plain, pc.ends_with(distinct, text)).to_numpy(zero_copy_only=False)] = token
        return base, mark

    def _add(self, new: list[str]) -> None:
        ids, sizes = self.encode(new)
        first, n = len(self.slots), len(new)
        self.slots.update(zip(new, range(first, first + n)))
        self.starts, self.sizes = _grown(self.starts, first + n), _grown(self.sizes, first + n)
        self.ids = _grown(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[first : first + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.n_ids += len(ids)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def split_at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces between spaces and line feeds, and their number in each text. For encoders that drop white space."""
    parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
    return pc.list_flatten(parts), pc.list_value_length(parts).to_numpy().astype(np.int64)
