"""Personal data by bootstrapped contextual extraction (operator 6).

Base patterns find identifiers of a strict form. Those are the seeds: the words beside them make lexical patterns, and
the patterns also stand beside strings of any other form that an identifier may take. On the graph of patterns and
instances Spark goes on in turns, until nothing is added: a pattern is sure by the share of its instances that are
believed, an instance is believed beside a sure pattern, and then supports other patterns. Believed instances become new
spans; base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import steps, stored

KINDS = ["email", "ip", "card", "phone"]
#: Fixed: the base form of each kind.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms in which an unseen identifier may be written; only a confident context makes one a span.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[._/ ][0-9]{4}){3}"),
    "phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
#: Any other run of a kind: addresses with any letters, blanks or words for the signs; IPv6 and spelt dots; and any run of
#: so many digits, however grouped. Runs are entered at their start only, which keeps the search linear.
OPEN = {
    "email": re.compile(r"(?<![^\s@<>()\[\],;:\"'])[^\s@<>()\[\],;:\"']++ ?@ ?[^\s@<>()\[\],;:\"']++|(?<![\w.%+-])[\w.%+-]++ at [\w-]++(?: dot [\w-]++)++", re.I),
    "ip": re.compile(r"(?<![\w:])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![\w:])|(?<!\d)\d{1,3}(?: ?(?:\.|,|\(dot\)|\[dot\]|dot) ?\d{1,3}){3}(?!\d)", re.I),
    "card": re.compile(r"[0-9](?:[ ._/-]{0,2}[0-9])++"),
    "phone": re.compile(r"[+(]?[0-9](?:[ ._/()-]{0,2}[0-9])++"),
}
#: Digits of a run that may be a card or a phone.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
_LOOSE_SIGN = re.compile(r"[\[(]at[\])]|[0-9]\[\.\]|[0-9]{3}\)?[ .-][0-9]{3}|[0-9]{4}[._/ ][0-9]{4}")
_OPEN_SIGN = re.compile(r"@| at |::|[0-9]", re.I)
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns need so many different believed instances, and this share of them, to add instances.
SUPPORT, CONFIDENCE = 5, 0.8
#: Bytes of text that a task takes at once.
STEP = 1 << 20
SPAN = "struct<kind:int,first:int,last:int>"
ROW = f"doc_id long, text_hash long, base array<{SPAN}>, found array<struct<kind:int,first:int,last:int,instance:string,seed:boolean,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, first, last) of the base form, by kind and place; last is exclusive."""
    found = []
    if "@" in text:
        # From each @ back to the start of its run of local characters, not before the end of the last match.
        done, at = 0, text.find("@")
        while at >= 0:
            first = at
            while first > done and EMAIL_LOCAL.match(text[first - 1]):
                first -= 1
            m = EMAIL.match(text, first) if first < at else None
            if m:
                found.append((0, first, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def contexts(text: str, first: int, last: int) -> list[str]:
    """Lexical patterns of a span: the two words before it, the word before with the one after, the two after."""
    before = [w.lower() for w in _WORD.findall(text[max(0, first - 60) : first])][-2:]
    after = [w.lower() for w in _WORD.findall(text[last : last + 60])][:2]
    out = []
    if len(before) == 2:
        out.append("L " + " ".join(before))
    if before and after:
        out.append(f"M {before[-1]} {after[0]}")
    if len(after) == 2:
        out.append("R " + " ".join(after))
    return out


def extract(text: str) -> tuple[list, list]:
    """Base spans, and with the candidates of loose and open forms that overlap none of them everything a pattern may
    stand beside."""
    base = base_spans(text)
    found = [(k, a, b, text[a:b].lower(), True) for k, a, b in base]
    if _OPEN_SIGN.search(text) or _LOOSE_SIGN.search(text):
        of_base = bytearray(len(text))
        for _, a, b in base:
            of_base[a:b] = b"\1" * (b - a)
        for k, kind in enumerate(KINDS):
            taken = bytearray(of_base)
            for form in (LOOSE, OPEN):
                if form is LOOSE and not _LOOSE_SIGN.search(text):
                    continue
                for m in form[kind].finditer(text):
                    a, b = m.span()
                    least, most = DIGITS.get(kind, (0, b)) if form is OPEN else (0, b)
                    if 1 not in taken[a:b] and least <= sum(c.isdigit() for c in m.group()) <= most:
                        found.append((k, a, b, m.group().lower(), False))
                        taken[a:b] = b"\1" * (b - a)
    return base, [(k, a, b, i, s, contexts(text, a, b)) for k, a, b, i, s in found]


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): its base spans, and seeds and candidates with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
        item = pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
        for batch in steps(batches, "text", STEP):
            base, found = [], []
            for text in batch.column("text").to_pylist():
                b, f = extract(text) if text else ([], [])
                base.append([dict(zip(("kind", "first", "last"), x)) for x in b])
                found.append([dict(zip(("kind", "first", "last", "instance", "seed", "patterns"), x)) for x in f])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(item))], names=["doc_id", "text_hash", "base", "found"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, ROW)


def confident_instances(found: DataFrame) -> DataFrame:
    """kind, instance of candidates (row, kind, instance, seed, patterns) that the scored graph believes.

    Seeds are believed. A pattern is sure if it holds SUPPORT different believed instances and they are CONFIDENCE of its
    instances of any form; an instance beside a sure pattern is believed, and supports others, until nothing is added.
    """
    edges = found.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    seeds = stored(edges.where("seed").select("kind", "instance").distinct(), "pii-believed")
    believed, n = seeds, seeds.count()
    while True:
        on = edges.join(believed.withColumn("sure", F.lit(1)), ["kind", "instance"], "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
        patterns = on.groupBy("kind", "pattern").agg(F.avg("sure").alias("confidence"), F.sum("sure").alias("support"))
        sure = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("kind", "pattern")
        believed = stored(seeds.union(edges.join(sure, ["kind", "pattern"], "left_semi").select("kind", "instance")).distinct(), "pii-believed")
        before, n = n, believed.count()
        if n == before:
            return believed


def spans(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, base and spans, sorted arrays of (kind, first, last) in code points.

    `spans` holds the base spans and the believed candidates. A null or empty text has none; every row gives one row.
    """
    rows = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
    found = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    believed = confident_instances(found)
    new = found.where("not seed").join(believed, ["kind", "instance"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("kind", "first", "last")).alias("new"))
    joined = rows.select("row", "doc_id", "text_hash", "base").join(new, "row", "left")
    return joined.select("doc_id", "text_hash", "base", F.array_sort(F.array_union("base", F.coalesce("new", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def as_text(a):
    """kind:first:last, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, the digest of their list, and the list of all spans."""
    found = spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, each span of `text` replaced by its kind in angle brackets; overlapping spans are one,
    named after the first. Rows of one id and text have the same spans."""
    found = spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__h"])
    joined = docs.withColumn("__own", F.xxhash64("text")).join(found, (F.col("__own") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if own:
                    parts, done = [], 0
                    for s in sorted(own, key=lambda s: (s["first"], s["kind"])):
                        if s["first"] >= done:
                            parts += [text[done : s["first"]], f"<{KINDS[s['kind']].upper()}>"]
                        done = max(done, s["last"])
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return joined.select(*names, "__spans").mapInArrow(run, docs.schema)

