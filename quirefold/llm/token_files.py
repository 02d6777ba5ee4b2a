"""Token-id files with Elias-Fano document boundaries (operator 10).

A shard holds the ids of its documents in ascending doc_id order, one after another. Layout, little-endian:

    magic "EFTOK001" | header of eight uint64: documents, ids, bits of an id (16 or 32), low bits, bytes of the low part,
    words of the high part, select samples, bytes of the doc_id part
    ids          uint16 or uint32 each
    low part     the `low` lowest bits of every end offset, packed
    high part    uint64 words; for end offset i the bit (offset >> low) + i is set
    select       uint32: word and rank of the set bit of every SAMPLE-th document
    doc_ids      null bitmap and varint differences of ascending doc_ids

The end offset of document i is (select1(i) - i) << low | low part i; only the documents asked for are decoded. The
boundaries take about 2 + log2(ids / documents) bits a document, without a table of 64-bit offsets.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import filesystem, ragged, release_memory, shared_dir, steps, stored

MAGIC = b"EFTOK001"
#: A select sample for every so many documents.
SAMPLE = 64
#: Bytes of ids in a shard after which the writer begins a new one; a reader holds one shard's boundaries, never all ids.
SHARD_BYTES = 1 << 26
#: Documents in a shard after which the writer begins a new one.
SHARD_DOCS = 1 << 18
#: Ids that a reader takes from a file at once, unless a single document is longer.
READ_IDS = 1 << 21

MANIFEST = "first_id long, first_row long, part int, path string, n_docs long, n_ids long, file_bytes long, boundary_bytes long"


class EliasFano:
    """A non-decreasing sequence below `universe` in about 2 + log2(universe / n) bits an element."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = (int(at[-1]) // 64 + 1) if n else 0
        flags = np.zeros(words * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        word = at[::SAMPLE] // 64
        samples = np.stack([word, np.arange(0, n, SAMPLE) - before[word]], axis=1).astype(np.uint32) if n else np.zeros((0, 2), np.uint32)
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), high, samples)

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1, read from the sample before `first` on."""
        if last <= first:
            return np.zeros(0, np.int64)
        s = first // SAMPLE
        word, skip = (int(x) for x in self.samples[s])
        end = int(self.samples[-(-last // SAMPLE)][0]) + 1 if -(-last // SAMPLE) < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[word:end].view(np.uint8), bitorder="little"))
        skip += first - s * SAMPLE
        high = ones[skip : skip + last - first] + word * 64 - np.arange(first, last)
        if not self.low_bits:
            return high
        begin, stop = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-stop // 8)], bitorder="little")[begin % 8 :][: stop - begin]
        low = bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return high << self.low_bits | low

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def _varints(values: np.ndarray) -> bytes:
    out = bytearray()
    for v in values.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _from_varints(data: bytes, n: int) -> np.ndarray:
    """Inverse of _varints, vectorised: a byte below 128 ends a number."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)[:n]
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    group = np.repeat(np.arange(n), ends - starts + 1)
    shift = (np.arange(len(group)) - starts[group]).astype(np.uint64) * np.uint64(7)
    out = np.zeros(n, np.uint64)
    np.add.at(out, group, (b[: len(group)].astype(np.uint64) & np.uint64(127)) << shift)
    return out


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> tuple[list[bytes], int]:
    """The parts of a shard's file, and the bytes of its boundaries."""
    ends = EliasFano.of(np.cumsum(sizes))
    null = np.array([d is None for d in doc_ids], bool)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    # Differences of ascending ids; the first one is offset so that negative ids fit.
    gaps = np.diff(known.astype(np.uint64), prepend=np.uint64(1 << 63)) if len(known) else np.zeros(0, np.uint64)
    names = np.packbits(null, bitorder="little").tobytes() + _varints(gaps)
    head = np.array([len(doc_ids), len(ids), ids.dtype.itemsize * 8, ends.low_bits, ends.low.nbytes, len(ends.high), len(ends.samples), len(names)], np.uint64)
    return [MAGIC, head.tobytes(), ids.tobytes(), ends.low.tobytes(), ends.high.tobytes(), ends.samples.tobytes(), names], ends.n_bytes


class Shard:
    """A shard opened for reading: boundaries and doc_ids in memory, ids read from the file on demand."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(8) != MAGIC:
            raise ValueError("not a token shard")
        n, n_ids, width, low_bits, low, words, samples, names = (int(x) for x in np.frombuffer(file.read(64), np.uint64))
        self.n, self.n_ids, self.dtype = n, n_ids, np.dtype(np.uint16 if width == 16 else np.uint32)
        file.seek(72 + n_ids * self.dtype.itemsize)
        self.ends = EliasFano(n, low_bits, np.frombuffer(file.read(low), np.uint8), np.frombuffer(file.read(8 * words), np.uint64), np.frombuffer(file.read(8 * samples), np.uint32).reshape(-1, 2))
        tail = file.read(names)
        self.null = np.unpackbits(np.frombuffer(tail[: -(-n // 8)], np.uint8), bitorder="little")[:n].astype(bool)
        gaps = _from_varints(tail[-(-n // 8) :], n - int(self.null.sum()))
        self.doc_ids = (np.cumsum(gaps, dtype=np.uint64) + np.uint64(1 << 63)).astype(np.int64)

    def starts(self, first: int, last: int) -> np.ndarray:
        """Offsets first..last of document starts; the end of `last - 1` is the last one."""
        return np.concatenate([[0] if not first else self.ends.select(first - 1, first), self.ends.select(first, last)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(72 + start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((stop - start) * self.dtype.itemsize), self.dtype)


def _encoder(tokenizer_path: str):
    """Ids of pieces by the tokenizers library; one per worker process."""
    if tokenizer_path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        from quirefold.llm.words import PieceTable

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        # Words of lower-case letters are what they are after normalising and splitting: many of them go in one call,
        # and the ids that end a word tell them apart.
        letters = Tokenizer.from_file(tokenizer_path)
        letters.no_truncation()
        letters.no_padding()
        letters.normalizer = normalizers.Sequence([])
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        last = np.zeros(1 << 16, bool)
        last[[t for w, t in vocab.items() if w.endswith("</w>")]] = True
        lower = re.compile("[a-zà-öø-ÿ]{1,64}").fullmatch

        def flat(encoded: list) -> tuple[np.ndarray, np.ndarray]:
            lists = [e.ids for e in encoded]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint16, int(sizes.sum())), sizes

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            simple = np.array([lower(p) is not None for p in pieces], bool)
            words = [p for p, s in zip(pieces, simple.tolist()) if s]
            one, _ = flat(letters.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False))
            two, two_sizes = flat(tokenizer.encode_batch_fast([p for p, s in zip(pieces, simple.tolist()) if not s], add_special_tokens=False))
            sizes = np.zeros(len(pieces), np.int64)
            sizes[simple] = np.diff(np.flatnonzero(last[one]) + 1, prepend=0)
            sizes[~simple] = two_sizes
            out, starts = np.zeros(int(sizes.sum()), np.uint16), np.cumsum(sizes) - sizes
            out[ragged(starts[simple], sizes[simple])] = one
            out[ragged(starts[~simple], sizes[~simple])] = two
            return out, sizes

        _ENCODERS[tokenizer_path] = PieceTable(encode, "^[A-Za-zà-öø-ÿ]+[.,]?$", {m: vocab[f"{m}</w>"] for m in ".,"}, folded=True)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
    return _ENCODERS[tokenizer_path]


_ENCODERS: dict = {}


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends `end_id`, and writes shards in ascending doc_id order; returns their manifest.

    A null text is empty: it has the end id alone. Null doc_ids come first; equal doc_ids stay in one shard sequence,
    in the order of their texts. Other columns are not read. A task writes under a name of its own attempt, and only
    the manifest of the attempt that succeeded names its files, so retries leave no wrong shard. An empty table has
    no shard. The encoder must drop white space and have no token across it (as word-level BPE does); pieces between
    blanks are then encoded apart, each distinct one once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quirefold.llm.words import split_at_blanks

        table = _encoder(tokenizer_path)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        names, sizes, ids, held, nth = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, sizes, ids, held, nth
            blocks, boundary = shard_bytes(names, np.concatenate(sizes), np.concatenate(ids))
            path = f"{root}/shard-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(path) as out:
                for block in blocks:
                    out.write(block)
            known = [d for d in names if d is not None]
            row = [[known[0] if known else None], [nth], [part], [path], [len(names)], [int(sum(map(len, ids)))], [sum(map(len, blocks))], [boundary]]
            names, sizes, ids, held = [], [], [], 0
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4])], names=[f.split()[0] for f in MANIFEST.split(", ")])

        for batch in steps(batches, "text"):
            pieces, per_text = split_at_blanks(batch.column("text"))
            found, per_piece = table.ids_of(pieces)
            ends = np.concatenate([[0], np.cumsum(per_piece)])[np.cumsum(per_text)]
            found = np.insert(found, ends, end_id)
            names += batch.column("doc_id").to_pylist()
            sizes.append(np.diff(ends, prepend=0) + 1)
            ids.append(found)
            held += found.nbytes
            if held >= SHARD_BYTES or len(names) >= SHARD_DOCS:
                yield flush()
        if names:
            yield flush()
        table.clear()
        release_memory()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds to every shard the ids before it: running sums inside a writing task, and over the tasks."""
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("task_ids"))
    # One row for each writing task of the whole job: metadata, not data.
    tasks = tasks.withColumn("task_start", F.sum("task_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("inside", inside).join(tasks, "part").withColumn("start", F.coalesce("inside", F.lit(0)) + F.coalesce("task_start", F.lit(0))).drop("inside", "task_start", "task_ids")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (over the ids as little-endian 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, inside = filesystem(path)
                with fs.open_input_file(inside) as file:
                    shard = Shard(file)
                    known = np.cumsum(~shard.null) - 1
                    first = 0
                    while first < shard.n:
                        last = min(first + 4096, shard.n)
                        starts = shard.starts(first, last)
                        last = first + max(1, int(np.searchsorted(starts, starts[0] + READ_IDS, side="right")) - 1)
                        starts = starts[: last - first + 1]
                        body = memoryview(shard.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                        cuts = ((starts - starts[0]) * 4).tolist()
                        crc = [zlib.crc32(body[a:b]) for a, b in zip(cuts, cuts[1:])]
                        ids = pa.array(shard.doc_ids[known[first:last]] if len(shard.doc_ids) else np.zeros(last - first, np.int64), pa.int64(), mask=shard.null[first:last])
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    n = max(1, manifest.count())
    return with_starts(manifest).select("path", "start").repartition(min(n, 1 << 16)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the token files of `docs` and reads every document's place, length and checksum back from them."""
    return read_documents(write_shards(docs, folder or shared_dir(docs.sparkSession, "token-files"), tokenizer_path, end_id))
