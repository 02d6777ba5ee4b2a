"""Order MinHash fingerprints (operator 3), in DataFrame functions only.

The k-mers of a text are numbered by occurrence, so that repeats count, and hashed. One permutation of the hashes is cut
into BINS ranges; of each range the SKETCH smallest k-mers are kept, put back in text order and hashed as a tuple. Two
texts agree in a range only if they have the same small k-mers in the same order: the share of agreeing ranges falls
with edits, moves included, where plain MinHash would not see a move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, ranges (a power of two), and k-mers kept of a range.
KMER, BINS, SKETCH = 3, 32, 2
#: Characters after which a long run without blanks is cut: those of scripts that write no blanks, and some of others.
_CUT = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}aeiouAEIOU0-4/+=._-"
#: A run of up to 16 characters is a word. A longer one is cut behind such characters, after 16 others at the latest: the
#: cuts depend on the characters around them, so an insertion changes the words next to it and no others.
WORD = rf"(?<!\S)\S{{1,16}}(?!\S)|[^\s{_CUT}]{{0,15}}[{_CUT}]|[^\s{_CUT}]{{1,16}}"
#: Packed numbers: a position takes the lowest bits, a hash those above.
POSITION_BITS = 30
_POSITION = (1 << POSITION_BITS) - 1
_BIN_SHIFT = 63 - int(math.log2(BINS))


def _index(n: Column) -> Column:
    """0..n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hash_part(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _next(firsts: Column, r: Column, n: Column) -> Column:
    return F.coalesce(F.get(firsts, r + 1), n)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`, an array of one number per non-empty range: the range above 32 bits of the tuple's hash.

    A text of fewer than KMER words is one k-mer; a text without words (null, empty, blank) has an empty array. Equal
    texts have equal arrays; white space counts only where it parts words.
    """
    w, s, firsts, n = (f"__{name}_{x}" for x in "wsfn")
    c = F.col

    def kmer(i: Column) -> Column:
        return F.xxhash64(*[F.get(c(w), i + j) for j in range(KMER)])

    def packed(h: Column, position: Column) -> Column:
        return h.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(position.cast("long"))

    def numbered(r: Column) -> Column:
        """The k-mers of one run of equal hashes: hash of k-mer and occurrence, with the position."""
        first = F.get(c(firsts), r)
        return F.transform(
            F.sequence(first, _next(c(firsts), r, c(n)) - 1),
            lambda i: packed(F.shiftrightunsigned(F.xxhash64(_hash_part(F.get(c(s), i)), i - first), 1), F.get(c(s), i).bitwiseAND(F.lit(_POSITION))),
        )

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, _BIN_SHIFT)

    def tuple_hash(r: Column) -> Column:
        """The kept k-mers of one range in text order, hashed, below the number of the range."""
        first = F.get(c(firsts), r)
        mine = F.slice(c(s), first + 1, _next(c(firsts), r, c(n)) - first)
        by_position = F.sort_array(F.transform(mine, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 63 - POSITION_BITS).bitwiseOR(_hash_part(x))))
        hashes = F.transform(by_position, lambda x: x.bitwiseAND(F.lit((1 << 63 - POSITION_BITS) - 1)))
        return F.shiftleft(bin_of(F.get(c(s), first)), 32).bitwiseOR(F.xxhash64(hashes).bitwiseAND(F.lit((1 << 32) - 1)))

    def change(part) -> Column:
        """Indices at which `part` differs from the element before."""
        return F.filter(_index(c(n)), lambda i: (i == 0) | (part(F.get(c(s), i)) != part(F.get(c(s), i - 1))))

    words = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(WORD), F.lit(0))
    d = df.withColumn(w, words).withColumn(n, F.when(F.size(w) > 0, F.greatest(F.lit(1), F.size(w) - (KMER - 1))).otherwise(0))
    d = d.withColumn(s, F.sort_array(F.transform(_index(c(n)), lambda i: packed(kmer(i), i)))).drop(w)
    d = d.withColumn(firsts, change(_hash_part))
    d = d.withColumn(s, F.sort_array(F.flatten(F.transform(_index(F.size(firsts)), numbered))))
    d = d.withColumn(s, F.filter(c(s), lambda x, i: (i < SKETCH) | (bin_of(F.get(c(s), i - SKETCH)) != bin_of(x)))).withColumn(n, F.size(s))
    d = d.withColumn(firsts, change(bin_of))
    return d.withColumn(name, F.transform(_index(F.size(firsts)), tuple_hash)).drop(s, firsts, n)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing ranges among those that either text fills; 1 for two texts without words."""
    filled = F.size(F.array_distinct(F.concat(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32)))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), "-")


def bucket_of(id_col: Column, bounds: list) -> Column:
    """Number of ascending bounds that are not above the id, found in two steps; 0 for a null id."""
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.array(*map(F.lit, bounds[step - 1 :: step])), F.array(*map(F.lit, bounds))
    if not bounds:
        return F.lit(0)
    blocks = F.size(F.filter(coarse, lambda b: b <= id_col))
    rest = F.size(F.filter(F.slice(fine, blocks * step + 1, F.lit(step)), lambda b: b <= id_col))
    return F.when(id_col.isNull(), 0).otherwise(blocks * step + rest)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the row of the next doc_id, after the last one the first.

    Repeated ids follow each other in the order of their text's hash; rows without id come first. The rows are dealt to
    buckets of neighbouring ids by approximate quantiles; the first row of each bucket also goes to the bucket before,
    as its end. `docs` has doc_id, text_hash and the carried columns.
    """
    spark = docs.sparkSession
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    found = docs.select(F.percentile_approx("doc_id", cuts, 10 * n_buckets).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    own = docs.withColumn("__bucket", bucket_of(F.col("doc_id"), bounds))
    # One row a bucket: a bound on what is sent to all tasks, whatever the number of documents.
    firsts = own.groupBy("__bucket").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"))
    before = F.lag("__bucket").over(Window.orderBy("__bucket"))
    last = F.max("__bucket").over(Window.partitionBy(F.lit(0)))
    ends = firsts.select(F.coalesce(before, last).alias("__before"), F.col("f.doc_id").alias("__id"), F.col("f.text_hash").alias("__hash"))
    marked = own.join(F.broadcast(ends), own.doc_id.eqNullSafe(F.col("__id")) & (own.text_hash == F.col("__hash")), "left")
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("end")), F.struct(F.col("__before").alias("b"), F.lit(True).alias("end")))
    dealt = marked.withColumn("__p", F.explode(F.filter(places, lambda p: p["b"].isNotNull())))
    follow = Window.partitionBy("__p.b").orderBy("__p.end", "doc_id", "text_hash")
    out = dealt.select("*", *[F.lead(x).over(follow).alias(f"next_{x}") for x in carried])
    return out.where(~F.col("__p.end")).drop("__p", "__bucket", "__before", "__id", "__hash")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_chars, the SHA-256 of the edited text (its last quarter replaced by the start of
    the next document), both fingerprints, and their likeness to each other and of the own to the next document's.

    A null text is empty. A single row is its own next one; an empty table gives none.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    followed = with_next(with_fingerprint(own, "text", "print"), ["text", "print"])
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = followed.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - tail), F.col("next_text").substr(F.lit(1), tail))).drop("text", "next_text")
    d = with_fingerprint(edited, "edited", "edited_print")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
