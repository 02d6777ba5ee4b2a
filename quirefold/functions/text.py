"""Text columns: white space, headings, paragraphs, long-paragraph splitting, name repair.

All helpers take and return Columns and stay inside the JVM. Paragraph building works on the lines of
one text value with regular expressions only, so its cost is linear in the text and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed as v


def jre(pattern: str) -> str:
    """A fixed pattern with its end anchor made strict ($ also matches before a final line feed in Java)."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def fill(wording: str, *values: Column) -> Column:
    """A fixed wording with its `{}` replaced by values in order; null if a value is null."""
    texts = wording.split("{}")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(v.WS))


def normalize_whitespace(c: Column) -> Column:
    s = F.regexp_replace(c, r"\r\n?", "\n")
    s = F.translate(s, "\u00a0\u3000\t\f\x0b", "     ")
    s = F.regexp_replace(s, " {2,}", " ")
    s = F.replace(s, F.lit(" \n"), F.lit("\n"))
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def split_chunks(c: Column) -> Column:
    return F.split(normalize_whitespace(c), "\n{2,}")


def chunk_lines(chunk: Column) -> Column:
    return F.filter(F.transform(F.split(chunk, "\n"), trim), lambda t: t != "")


def _is_heading(t: Column) -> Column:
    caps = (
        (F.length(t) <= v.HEADING_CAPS_MAX)
        & t.rlike(jre(v.HEADING_CAPS))
        & ~t.rlike(jre(v.HEADING_BAD_END))
        & (F.upper(t) == t)
    )
    return (
        (t != "")
        & (F.length(t) <= v.HEADING_MAX)
        & (
            t.rlike(v.HEADING_NUMBERED)
            | t.rlike("(?i)" + v.HEADING_ENGLISH + "(?![A-Za-z0-9_])")
            | t.rlike(jre(v.HEADING_CHINESE))
            | caps
        )
    )


def looks_like_heading(line: Column) -> Column:
    return _is_heading(trim(line))


def is_list_line(line: Column) -> Column:
    return line.rlike(v.LIST_LINE)


def has_math(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(v.MATH)


# The characters that are neither a sentence mark nor LF, as positive ranges: the regex engine tests these about
# one and a half times faster than the negated class.
_PLAIN = r"@-\u3001\x0B-\x20\x22-\x3A\x3C-\x3E\x00-\x09\u3003-\uFF00\uFF02-\uFF1A\uFF1C-\uFF1E\uFF20-\x{10FFFF}"
_SENTENCE = rf"[{_PLAIN}]+[{v.SENTENCE_MARKS}]?|\n"
_PACK = (
    rf"\G(?:[\s\S]{{1,{v.SPLIT_AT}}}(?:(?<=[{v.SENTENCE_MARKS}\n])|(?=\n)|\z)"
    rf"|[{_PLAIN}]+[{v.SENTENCE_MARKS}]?|\n)"
)


def split_long(c: Column) -> Column:
    """Pieces of one paragraph: whole when short, else sentences packed greedily up to the limit."""
    kept = F.array_join(F.regexp_extract_all(c, F.lit(_SENTENCE), F.lit(0)), "")
    pieces = F.filter(F.transform(F.regexp_extract_all(kept, F.lit(_PACK), F.lit(0)), trim), lambda p: p != "")
    whole = (F.length(c) <= int(v.SPLIT_AT * v.SPLIT_FACTOR)) | ~c.rlike(f"[{_PLAIN}\\n]")
    return F.when(whole, F.array(c)).otherwise(pieces)


# A line is written as LF + code + line: B is a blank line, H and L are blocks of their own, T is text, and P
# is text that starts a paragraph. At a join, S and C mark where a long enough paragraph ends (else they become
# a space and nothing).
_LONG = rf"\G((?:\nS|(?:\nC)?[^\n]){{{v.PARAGRAPH_MIN + 1}}}[\s\S]*?)\n[SC]"
# The join patterns begin with the literal LF, so that the scan only stops at line ends.
_PDF_JOINS = [
    (rf"\nT(?<=；\nT)|\nT(?<![{v.HARD_END}]\nT)(?=[^\n]*[{v.CJK}](?:\n|\z))", ""),
    (rf"\nT(?<![{v.HARD_END}]\nT)", " "),
]
_TXT_JOINS = [
    (rf"\nT(?<=[{v.SENTENCE_END}]\nT)(?=[{v.HAN}])", "\nC"),
    (rf"\nT(?<=[{v.SENTENCE_END}]\nT)(?=[A-Z])", "\nS"),
    (rf"\nT(?<=[{v.CJK}]\nT)|\nT(?=[{v.CJK}])", ""),
    (r"\nT", " "),
]


def _coded_line(t: Column) -> Column:
    kind = (
        F.when(t == "\n", "B")
        .when((F.length(t) <= v.HEADING_BLOCK_MAX) & _is_heading(t), "H")
        .when(is_list_line(t), "L")
        .otherwise("T")
    )
    return F.concat(F.lit("\n"), kind, F.when(t == "\n", "").otherwise(t))


def _coded(text: Column, mode: str) -> Column:
    lines = F.transform(F.split(normalize_whitespace(text), "\n"), lambda r: F.when(r == "", "\n").otherwise(trim(r)))
    coded = F.array_join(F.transform(F.filter(lines, lambda t: t != ""), _coded_line), "")
    coded = F.regexp_replace(F.concat(F.lit("\nB"), coded), r"(\n[BHL][^\n]*)\nT", "$1\nP")
    for pattern, to in (_PDF_JOINS if mode == "pdf" else []) + _TXT_JOINS:
        coded = F.regexp_replace(coded, pattern, to)
    return F.replace(coded, F.lit("\nB"), F.lit(""))


def _paragraphs(unit: Column) -> Column:
    """One coded unit -> array of (type, text)."""
    body = F.substring(unit, 2, 2147483647)
    body = F.when(body.contains("\nS") | body.contains("\nC"), F.regexp_replace(body, _LONG, "$1\nP")).otherwise(body)
    done = F.split(F.replace(F.replace(body, F.lit("\nS"), F.lit(" ")), F.lit("\nC"), F.lit("")), "\nP")
    first = F.left(unit, F.lit(1))
    kind = F.when(first == "H", "heading").when(first == "L", "list").otherwise("paragraph")
    return F.transform(done, lambda t: F.struct(kind.alias("type"), t.alias("text")))


def coalesce_lines(text: Column, mode: str = "txt") -> Column:
    """Lines of a whole text joined into headings, lists and paragraphs: array<struct<type,text>>."""
    units = F.filter(F.split(_coded(text, mode), "\n(?=[PHL])"), lambda u: u != "")
    return F.flatten(F.transform(units, _paragraphs))


def segment(text: Column, mode: str = "txt") -> Column:
    """The whole text path: coalesced lines with long paragraphs split; array<struct<type,text>>."""
    pieces = F.transform(
        coalesce_lines(text, mode),
        lambda b: F.transform(split_long(b["text"]), lambda t: F.struct(b["type"].alias("type"), t.alias("text"))),
    )
    return F.filter(F.flatten(pieces), lambda b: b["text"] != "")


def fix_filename(c: Column) -> Column:
    """Undo UTF-8 bytes read as Latin-1; unchanged when the bytes are not valid UTF-8."""
    s = F.coalesce(c, F.lit(""))
    latin = s.rlike(r"[\x{80}-\x{ff}]") & s.rlike(r"^[\x{00}-\x{ff}]*\z")
    raw = F.encode(F.when(latin, s), "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(latin & ~F.coalesce(fixed, F.lit("\ufffd")).contains("\ufffd"), fixed).otherwise(s)


def looks_mojibake(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\x{c0}-\x{ff}]{2,}")


def repair_title(c: Column) -> Column:
    fixed = fix_filename(c)
    return F.when(looks_mojibake(c) & ~looks_mojibake(fixed), fixed).otherwise(c)


def heading_level(style: Column, outline: Column) -> Column:
    """Heading level of a named paragraph style, else of its outline level, else 0."""
    s = F.coalesce(style, F.lit(""))
    ws = f"[{v.WS}]*"
    digit = F.coalesce(
        *[
            F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
            for p in (
                rf"(?i)^heading{ws}([1-9])\z",
                rf"^标题{ws}([1-9])\z",
                r"^([1-9])\z",
                rf"(?i)^berschrift{ws}([1-9])\z",
            )
        ]
    ).cast("int")
    return (
        F.when(digit.isNotNull(), digit)
        .when(s.rlike(r"(?i)^(title|标题|文档标题)\z"), 1)
        .when(outline.between(0, 5), outline.cast("int") + 1)
        .otherwise(0)
    )


def strip_math(c: Column) -> Column:
    s = F.regexp_replace(c, r"\$\$([^$]+)\$\$", "$1")
    s = F.regexp_replace(s, r"\$([^$]+)\$", "$1")
    return F.regexp_replace(s, "\n+", " ")


def safe_name(c: Column) -> Column:
    named = F.when(F.coalesce(c, F.lit("")) == "", "document").otherwise(c)
    return F.substring(F.regexp_replace(named, v.UNSAFE_NAME, "_"), 1, 80)
