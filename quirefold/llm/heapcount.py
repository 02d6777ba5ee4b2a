"""Token counts by heap merging (operator 13).

A word is a linked list of its bytes' symbols and a heap of its adjacent pairs by rank. The pair of the lowest rank is
popped and merged, leftmost first, until no pair has a rank; the count is the number of symbols less the merges. No
identifier leaves this module. Texts are cut where no token can lie across, and each distinct part is counted once.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import release_memory, steps, utf8

#: Bytes of text that a task takes at once; a text may be longer, a part of it between two cuts is not.
STEP = 1 << 21
#: Distinct parts whose counts a task remembers in each of two generations, some 25 MB each. Which are kept changes no
#: result.
KEPT_PARTS = 200_000
#: Tokens that a text may have before it counts as over the limit.
LIMIT = 512

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: Last bytes of characters of two or three bytes that are white space.
_LAST = np.zeros(256, bool)
_LAST[[0x85, 0xA0, 0x80, *range(0x81, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xE1, 0xE2, 0xE3]] = True


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class HeapCounter:
    """Counts the tokens of words under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        how = spec["pre_tokenizer"]
        if how["type"] != "ByteLevel" or how["add_prefix_space"] or not how["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without normaliser and leading space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(set(s) & set(" \n.,;:!?") for s in self.special):
            raise ValueError("texts are cut at blanks and marks, which a special token of this vocabulary holds")
        vocab = spec["model"]["vocab"]
        # The letters that stand for bytes, as byte-level vocabularies write them, and the symbols of bytes.
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        self.symbol = [vocab[c] for c in byte_letters()]
        self.size = max(vocab.values()) + 1
        # The rank of a pair of symbols, by the first of them, and the symbol that it makes. `none` follows and is followed
        # by nothing: it stands for merged and missing symbols.
        self.none = max(vocab.values()) + 1
        nothing: dict[int, int] = {}
        self.follow = [nothing] * (self.none + 1)
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if self.follow[vocab[a]] is nothing:
                self.follow[vocab[a]] = {}
            self.follow[vocab[a]].setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        """Tokens of one word."""
        n = len(word)
        if n == 1:
            return 1
        follow, made, none, pop, push = self.follow, self.made, self.none, heapq.heappop, heapq.heappush
        # Long runs of letters are words too: their lists are packed. An entry of the heap holds rank and place.
        bits, pack = (13, list) if n < 1 << 13 else (40, lambda values: array("l", values))
        mask = (1 << bits) - 1
        # The place behind the word, which is also that before it, holds no symbol.
        symbols = pack([*map(self.symbol.__getitem__, word), none])
        after, before = pack(range(1, n + 1)), pack(range(-1, n))
        heap = [r << bits | i for i in range(n - 1) if (r := follow[symbols[i]].get(symbols[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            entry = pop(heap)
            i, r = entry & mask, entry >> bits
            j = after[i]
            if follow[symbols[i]].get(symbols[j]) != r:
                # Stale: one of the two has been merged since.
                continue
            merged = symbols[i] = made[r]
            symbols[j] = none
            left -= 1
            after[i] = k = after[j]
            before[k] = i
            if (r := follow[merged].get(symbols[k])) is not None:
                push(heap, r << bits | i)
            h = before[i]
            if (r := follow[symbols[h]].get(merged)) is not None:
                push(heap, r << bits | h)
        return left

    def text(self, text: str) -> int:
        """Tokens of a text: one for each special token in it, the others those of its words."""
        if not any(s in text for s in self.special):
            return sum(map(self.word, self.words(text)))
        rest, total = [text], 0
        while rest:
            part = rest.pop()
            hits = [(at, -len(s), s) for s in self.special if (at := part.find(s)) >= 0]
            if hits:
                at, _, s = min(hits)
                total += 1
                rest += [part[at + len(s) :], part[:at]]
            elif part:
                total += sum(map(self.word, self.words(part)))
        return total

    def words(self, part: str) -> list[bytes]:
        """The words of a part as the vocabulary's own splitter cuts them. Letters after at most one space are one."""
        bare = part[1:] if part[:1] == " " else part
        if bare.isalpha() and max(bare) < "\u0250":
            return [part.encode()]
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(part)]

    def counts(self, parts: pa.Array) -> np.ndarray:
        """Tokens of each part; a distinct part is counted once."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.young) + len(distinct) > KEPT_PARTS:
            # Frequent parts come over from the old generation as they are met again.
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for p in distinct:
            if p not in young:
                n = old.get(p)
                young[p] = self.text(p) if n is None else n
        return np.fromiter(map(young.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def forget(self) -> None:
        self.young, self.old = {}, {}


def cuts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Positions from lo to hi at which no token lies across, whatever stands around: a space or line feed behind a
    character that is no white space, and a mark behind an ASCII letter."""
    first = max(lo, 3)
    if first >= hi:
        return np.zeros(0, np.int64)
    now, prior = data[first:hi], data[first - 1 : hi - 1]
    # Behind characters beyond ASCII only where no white space has such bytes.
    wide = (prior >= 0x80) & ~(_LAST[prior] & ((data[first - 2 : hi - 2] == 0xC2) | _LEAD[data[first - 3 : hi - 3]]))
    solid = ((prior > 0x20) & (prior < 0x7F)) | wide
    return np.flatnonzero((((now == 0x20) | (now == 0x0A)) & solid) | (_MARK[now] & _LETTER[prior])) + first


def parts(data: np.ndarray, offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The texts cut into parts, about `step` bytes of them at once, and the start of each part. One part is never cut."""
    n, open_at = len(data), 0
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        texts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)]
        starts = np.concatenate([[open_at], texts, cuts(data, lo, hi)])
        starts.sort(kind="stable")
        starts = starts[np.diff(starts, prepend=-1) > 0]
        ends = np.append(starts, n) if hi == n else starts
        open_at = int(starts[-1])
        if len(ends) > 1:
            at = (ends - ends[0]).astype(np.int64)
            yield pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data[ends[0] : ends[-1]])), ends[:-1]


_COUNTERS: dict[str, HeapCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of docs (doc_id, text).

    Null and empty texts have no bytes and no tokens; repeated rows are each counted; ids may be null. Other columns
    are not read. A text of any length is cut at blanks and marks; memory is bounded by its longest stretch without any
    (a run of letters is merged as one word, about 60 bytes of memory for each of its bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = HeapCounter(path)
        counter = _COUNTERS[path]
        for batch in steps(batches, "text", STEP):
            data, offsets = utf8(batch.column("text"))
            total = np.zeros(batch.num_rows, np.int64)
            for part, starts in parts(data, offsets):
                row = np.searchsorted(offsets, starts, side="right") - 1
                total += np.bincount(row, counter.counts(part), batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter.forget()
        release_memory()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
