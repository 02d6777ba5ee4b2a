"""Byte-level BPE by speculation and verification (operator 5).

A distinct word is first cut greedily into the longest tokens (one automaton pass over all words of a step). A BPE
encoding is right exactly when every token is the encoding of its own bytes and every adjacent pair of tokens is the
encoding of the pair's bytes; those pair checks run on arrays of distinct pairs. Words with a failing pair, and no
others, are merged exactly, lowest rank first.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import ragged, release_memory, steps, utf8
from quirefold.llm.words import PieceTable

#: Rank of a token that no merge makes, and of a pair that no merge joins.
NEVER = np.int64(1 << 40)
#: Bytes of text that a task encodes at once.
STEP = 1 << 20
#: Bytes of a text from which on it is encoded part by part.
LONG = 1 << 22
#: Distinct pieces of text kept between steps; two workers share an executor with the JVM.
KEPT_PIECES = 200_000


#: Pairs remembered between steps; beyond them the memory starts anew, which changes no result.
KEPT_PAIRS = 1 << 19


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not known.size:
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """A byte-level BPE vocabulary: exact merging of one word, and speculation with verification for many."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(merges)))}
        # What made a token: its parts and rank; a single byte has none.
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.full(size, NEVER)
        for (a, b), rank in self.ranks.items():
            if (t := self.vocab.get(a + b)) is not None and rank < self.made[t]:
                self.left[t], self.right[t], self.made[t] = self.vocab[a], self.vocab[b], rank
        keys = np.array([self.vocab[a] * size + self.vocab[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.letters = byte_letters()
        by_letter = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes = [b""] * size
        for text, t in self.vocab.items():
            self.token_bytes[t] = bytes(by_letter[c] for c in text)
        for text, t in self.special.items():
            self.token_bytes[t] = text.encode()
        self.long = ahocorasick.Automaton()
        for text, t in self.vocab.items():
            self.long.add_word(text, t)
        self.long.make_automaton()
        self.n_bytes = np.array([len(b) for b in self.token_bytes], np.int64)
        # A token is its own encoding if merging its bytes gives it back; others are never proposed unverified.
        self.own = np.array([len(b) == 1 for b in self.token_bytes], bool)
        self.tried = self.own.copy()
        self.good_pairs, self.bad_pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        how = spec["pre_tokenizer"]
        if how["type"] != "ByteLevel":
            raise ValueError("a byte-level vocabulary is needed")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=how["add_prefix_space"], use_regex=how["use_regex"])
        self.exact_words = self.all_words = 0

    def merge(self, word: str) -> list[int]:
        """Exact BPE of one word (in byte letters): of all adjacent pairs the lowest rank merges first, leftmost first."""
        import heapq

        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((a + b, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, parts[h], a + b))
        return [self.vocab[p] for p in parts if p is not None]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a then b leaves the two apart.

        A part x on the right edge of a lives from its own merge until the merge that swallows it, likewise a part y on
        the left edge of b. The pair is broken if some x and y that live at once have a merge of a lower rank than
        both ends; at equal ranks the leftmost goes first, which is a's own merge, but comes before that of b.
        """
        broken = np.zeros(len(a), bool)
        x, x_end = a.copy(), np.full(len(a), NEVER)
        while (live := np.flatnonzero((x >= 0) & ~broken)).size:
            y, y_end = b[live], np.full(len(live), NEVER)
            row, lx, lx_end = live, x[live], x_end[live]
            while row.size:
                rank = self._rank(lx, y)
                hit = (rank < NEVER) & (rank < lx_end) & (rank <= y_end)
                broken[row[hit]] = True
                keep = ~hit & (self.left[y] >= 0)
                row, lx, lx_end, y_end, y = row[keep], lx[keep], lx_end[keep], self.made[y[keep]], self.left[y[keep]]
            x_end = np.where(x >= 0, self.made[x], NEVER)
            x = np.where(x >= 0, self.right[x], -1)
        return ~broken

    def _pairs_hold(self, keys: np.ndarray) -> np.ndarray:
        """compatible() of pairs given as keys, remembered; the memory starts anew when large."""
        distinct, back = np.unique(keys, return_inverse=True)
        good, bad = _in_sorted(distinct, self.good_pairs), _in_sorted(distinct, self.bad_pairs)
        new = distinct[~good & ~bad]
        if new.size:
            holds = self.compatible(new // self.size, new % self.size)
            if len(self.good_pairs) + len(self.bad_pairs) > KEPT_PAIRS:
                self.good_pairs, self.bad_pairs = distinct[good], distinct[bad]
            self.good_pairs = np.union1d(self.good_pairs, new[holds])
            self.bad_pairs = np.union1d(self.bad_pairs, new[~holds])
            good = _in_sorted(distinct, self.good_pairs)
        return good[back]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (in byte letters), one after another, and their number for each word."""
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        # Ends and ids go straight into an array: no list of all tokens is built.
        found = np.fromiter(self.long.iter_long("\n".join(words)), np.dtype((np.int64, 2)))
        at, ids = found[:, 0], found[:, 1]
        size = self.n_bytes[ids]
        word = np.searchsorted(ends, at, side="right")
        covered = np.bincount(word, size, len(words)) == np.diff(ends, prepend=0) - 1
        for t in np.unique(ids[~self.tried[ids]]):
            self.own[t], self.tried[t] = self.merge("".join(self.letters[x] for x in self.token_bytes[t])) == [t], True
        fails = ~covered
        fails[word[~self.own[ids]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        fails[word[inner[~self._pairs_hold(ids[inner] * self.size + ids[inner + 1])]]] = True
        counts = np.bincount(word, minlength=len(words))
        self.all_words, self.exact_words = self.all_words + len(words), self.exact_words + int(fails.sum())
        if not fails.any():
            return ids, counts
        again = np.flatnonzero(fails)
        exact = [self.merge(words[i]) for i in again.tolist()]
        sizes = counts.copy()
        sizes[again] = [len(e) for e in exact]
        out = np.zeros(int(sizes.sum()), np.int64)
        starts = np.cumsum(sizes) - sizes
        out[ragged(starts[~fails], counts[~fails])] = ids[~fails[word]]
        out[ragged(starts[fails], sizes[fails])] = [t for e in exact for t in e]
        return out, sizes

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text pieces: special tokens apart, then words as the vocabulary's own splitter cuts them."""
        words: dict[str, int] = {}
        parts: list[int] = []
        sizes = np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            n = len(parts)
            for text, special in self._apart(piece):
                if special is not None:
                    parts.append(-1 - special)
                else:
                    parts += [words.setdefault(w, len(words)) for w in self._split(text)]
            sizes[k] = len(parts) - n
        ids, counts = self.encode_words(list(words)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        part = np.array(parts, np.int64)
        # A special token stands for itself: one id kept behind those of the words.
        ids = np.concatenate([ids, -1 - part[part < 0]])
        starts = np.concatenate([np.cumsum(counts) - counts, len(ids) - int((part < 0).sum()) + np.arange(int((part < 0).sum()))])
        counts = np.concatenate([counts, np.ones(int((part < 0).sum()), np.int64)])
        part[part < 0] = len(words) + np.arange(int((part < 0).sum()))
        per_part = counts[part]
        per_piece = np.bincount(np.repeat(np.arange(len(pieces)), sizes), per_part, len(pieces)).astype(np.int64)
        return ids[ragged(starts[part], per_part)].astype(np.uint16), per_piece

    def _split(self, text: str) -> list[str]:
        """Words of a text in byte letters. Letters after at most one space are one word."""
        bare = text[1:] if text[:1] == " " else text
        if bare.isascii() and bare.isalpha():
            return [text.replace(" ", self.letters[32])]
        return [w for w, _ in self.splitter.pre_tokenize_str(text)]

    def _apart(self, piece: str) -> Iterator[tuple[str, int | None]]:
        """The piece cut at special tokens, the leftmost first."""
        while piece:
            hits = [(piece.find(s), -len(s), s) for s in self.special if s in piece]
            if not hits:
                yield piece, None
                return
            at, _, s = min(hits)
            if at:
                yield piece[:at], None
            yield s, self.special[s]
            piece = piece[at + len(s) :]


def cut_before_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces that begin with a space or line feed after another character, and their number in each text.

    The splitter's words never go on from a non-blank into a blank, and look no further back, so each piece can be
    split apart. That needs the character before the cut not to be white space: a text with two white-space
    characters in a row, or with white space other than space and line feed, stays one piece.
    """
    a = pc.fill_null(texts, "").cast(pa.large_string())
    whole = pc.match_substring_regex(a, r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|\x00")
    marked = pc.replace_substring(pc.replace_substring(a, " ", "\0 "), "\n", "\0\n")
    parts = pc.split_pattern(pc.if_else(whole, pa.scalar("", pa.large_string()), marked), "\0")
    values, sizes = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy().astype(np.int64)
    rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if rows.size:
        # The single empty part of such a text is replaced by the whole of it.
        at = (np.cumsum(sizes) - sizes)[rows]
        mask = np.zeros(len(values), bool)
        mask[at] = True
        values = pc.replace_with_mask(values, pa.array(mask), a.take(pa.array(rows)))
    return values, sizes


def long_parts(data: np.ndarray) -> Iterator[pa.Array]:
    """A long text in parts of about STEP bytes, each an array of one string, cut where a space or line feed follows a
    printable ASCII character: no word of the splitter goes on from there, none looks further back, and no special token
    holds a blank. A stretch without such a place is not cut."""
    inside = (data[1:] == 0x20) | (data[1:] == 0x0A)
    at = np.flatnonzero(inside & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
    start = 0
    while start < len(data):
        k = int(np.searchsorted(at, start + STEP, side="right")) - 1
        if k < 0 or at[k] <= start:
            k = int(np.searchsorted(at, start, side="right"))
        stop = int(at[k]) if k < len(at) and start + STEP < len(data) else len(data)
        yield pa.array([data[start:stop].tobytes().decode()], pa.large_string())
        start = stop


_TABLES: dict = {}


def _loaded(path: str) -> tuple[BytePairs, PieceTable, pa.Array, pa.Array]:
    """The vocabulary, a table of pieces, and the tokens' bytes and decimal texts; once per worker process."""
    if path not in _TABLES:
        pairs = BytePairs(path)
        _TABLES[path] = pairs, PieceTable(pairs.encode_pieces, "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]$", {m: pairs.vocab[m] for m in ".,"}, folded=False, kept=KEPT_PIECES), pa.array(pairs.token_bytes, pa.large_binary()), pa.array([b"%d," % t for t in range(pairs.size)], pa.large_binary())
        release_memory()
    return _TABLES[path]


def _cut(taken: pa.Array, ends: np.ndarray) -> list[memoryview]:
    """Concatenated bytes of the values up to each end, as one view a text."""
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    body = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")
    cuts = offsets[np.concatenate([[0], ends])].tolist()
    return [body[x:y] for x, y in zip(cuts, cuts[1:])]


def encoded_steps(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Step by step: the rows, the ids of all their texts one after another, and where each text ends among them."""
    table = _loaded(path)[1]
    for batch in steps(batches, "text", STEP):
        data, offsets = utf8(batch.column("text"))
        if batch.num_rows == 1 and len(data) > LONG:
            ids = np.concatenate([table.ids_of(cut_before_blanks(part)[0])[0] for part in long_parts(data)])
            yield batch, ids, np.array([len(ids)])
            continue
        pieces, per_text = cut_before_blanks(batch.column("text"))
        ids, per_piece = table.ids_of(pieces)
        yield batch, ids, np.concatenate([[0], np.cumsum(per_piece)])[np.cumsum(per_text)]
    table.clear()
    release_memory()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds `ids`, the token ids of each whole text, and drops nothing; a null text has no ids. A column of that name
    is replaced."""
    kept = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded_steps(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "ids"])

    schema = kept.withColumn("ids", F.expr("cast(null as array<int>)")).schema
    return kept.mapInArrow(run, schema)


def decode_bytes(ids: np.ndarray, ends: np.ndarray, path: str) -> list[memoryview]:
    """Bytes of the tokens of each text."""
    return _cut(_loaded(path)[2].take(pa.array(ids)), ends)


def _digests(ids: np.ndarray, path: str) -> tuple[list[str], list[str]]:
    """The digests of round_trip for the ids of one long text, part by part."""
    listed, decoded, reader = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for lo in range(0, len(ids), STEP):
        part = ids[lo : lo + STEP]
        text = bytes(_cut(_loaded(path)[3].take(pa.array(part)), np.array([len(part)]))[0])
        listed.update(text if lo + STEP < len(ids) else text[:-1])
        decoded.update(reader.decode(bytes(decode_bytes(part, np.array([len(part)]), path)[0]), lo + STEP >= len(ids)).encode())
    return [listed.hexdigest()], [decoded.hexdigest()]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, and of the text decoded from them
    (bytes that are no UTF-8 become U+FFFD). One row for each row; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = _loaded(path)[3]
        for batch, ids, ends in encoded_steps(batches, path):
            if len(ends) == 1 and len(ids) > STEP:
                listed, decoded = _digests(ids, path)
            else:
                listed = [hashlib.sha256(v[:-1]).hexdigest() for v in _cut(decimal.take(pa.array(ids)), ends)]
                decoded = [hashlib.sha256(str(v, "utf-8", "replace").encode()).hexdigest() for v in decode_bytes(ids, ends, path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(listed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
