"""Language identification by compression (operator 8).

Each language has a raw-content zstandard dictionary of sample texts. A text is cut into blocks, each block is
compressed with every dictionary, and the language with the fewest bytes over all blocks wins. A narrow margin between
the two best is a rejection. Texts and samples are compressed in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import steps

#: Bound of the fitting sample: texts of a language, and bytes of its dictionary. Only fitting is bounded by it.
SAMPLE_TEXTS, DICTIONARY_BYTES = 96, 112_640
SALTS = 64
#: Bytes of a block; all blocks of a text count. Small enough that the dictionary, not the text, explains a block.
BLOCK_BYTES = 512
LEVEL = 6
#: A text is rejected if the second language needs as few bytes as the best, or less than MARGIN_PERCENT more, not
#: counting the first FREE_BYTES of the best: of a few words one byte is margin enough.
MARGIN_PERCENT, FREE_BYTES = 1.0, 64
UNKNOWN = "und"


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary bytes of each language, from (text, lang). The sample of a language is its SAMPLE_TEXTS distinct texts
    of the smallest hash, so that copies count once. Rows without text or language teach nothing; without any row there
    is no language. At most languages x DICTIONARY_BYTES reach the driver. The languages come with the most taught first:
    that is the order in which ties go."""
    rows = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'").select("lang", F.xxhash64("text").alias("h"), "text")
    # First the least of each of SALTS shares of a language, then the least of those: no task ranks a whole language.
    some = rows.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("nth") <= SAMPLE_TEXTS)
    # At most SAMPLE_TEXTS rows a language: small enough to send to every task.
    chosen = F.broadcast(some.select("lang", "h"))
    piece = DICTIONARY_BYTES // SAMPLE_TEXTS
    # Of a sample text a slice from its middle goes into the dictionary.
    middle = F.greatest(F.lit(1), ((F.length("text") - piece) / 2).cast("int"))
    found = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.col("text").substr(middle, F.lit(piece))).alias("piece")).orderBy("lang", "h").collect()
    counts = dict(rows.groupBy("lang").count().collect())
    parts: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in found:
        parts[r["lang"]].append(r["piece"].lower().encode())
    # Each piece gets its share of the bytes, so that all of them fit whatever the letters.
    cut = lambda b, n: b[:n].decode(errors="ignore").encode()
    return {lang: b"\n".join(cut(b, DICTIONARY_BYTES // len(p) - 1) for b in p) for lang, p in parts.items()}


def _compressors(dictionaries: dict[str, bytes]) -> list:
    import zstandard

    out = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def sizes(text: bytes, compressors: list) -> list[int]:
    """Compressed bytes of all blocks of a text, for each language."""
    blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def decide(size: list[int], languages: list[str]) -> tuple[str, float, bool]:
    """The language, a score from 0 to 1 and whether the margin is wide enough. Ties go to the first language."""
    order = sorted(range(len(size)), key=size.__getitem__)
    best = size[order[0]]
    # A byte more counts as one bit of evidence.
    score = 1 / sum(math.exp2(-min(s - best, 1000)) for s in size)
    accepted = len(size) == 1 or (size[order[1]] - best >= 1 and (size[order[1]] - best) * 100 >= MARGIN_PERCENT * max(0, best - FREE_BYTES))
    return languages[order[0]], score, accepted


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Adds lang_pred, lang_score and lang_accepted to every row, from its whole text alone.

    `und`, 0.0 and false where the text is null or has no letter, or no language was learned. Columns of these names
    are replaced; all others stay.
    """
    added = ["lang_pred", "lang_score", "lang_accepted"]
    kept = docs.drop(*added)
    names = kept.columns
    languages = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    has_letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for batch in steps(batches, "text"):
            found = []
            for text, letter in zip(batch.column("text").to_pylist(), batch.column("__letter").to_pylist()):
                found.append(decide(sizes(text.lower().encode(), compressors), languages) if letter and languages else (UNKNOWN, 0.0, False))
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(columns[0]), pa.array(columns[1], pa.float64()), pa.array(columns[2])], names=[*names, *added])

    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_accepted")).schema
    return kept.withColumn("__letter", has_letter).mapInArrow(run, schema)
