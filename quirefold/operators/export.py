"""Export shaping: Markdown, JSON and print rows. Documents are made of ordered fragments, which can be joined to
one value each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed as v
from quirefold.functions import tables as tb
from quirefold.functions.text import fill
from quirefold.operators import ordered, threads
from quirefold.session import materialize

ORDER = ["section", "item_no", "qa_no", "line"]


def block_markdown(type_: Column, text: Column, rows: Column, urls: Column) -> Column:
    """A table as a Markdown table, an image block as its links, anything else as its text."""
    links = F.array_join(
        F.transform(urls, lambda u, i: fill(v.IMAGE_LINK, i + 1, u)), "\n\n"
    )
    return (
        F.when(type_ == "table", F.coalesce(tb.table_markdown(rows), F.lit("")))
        .when(type_ == "image", F.coalesce(links, F.lit("")))
        .otherwise(F.coalesce(text, F.lit("")))
    )


END = 1 << 40


def _labelled(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Answered item rows with cite, the label of the cited ids ('' when none)."""
    qa = items.filter(F.col("qa_no").isNotNull())
    labels = threads.cite_labels(qa, ["doc_id", "block_id", "seq"], blocks)
    return qa.join(labels, ["doc_id", "block_id", "seq"], "left").withColumn("cite", F.coalesce("label", F.lit(""))).drop("label")


def _fragment(section: int, item, qa, line: int, body: Column) -> Column:
    num = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(num(section).alias("section"), num(item).alias("item_no"), num(qa).alias("qa_no"), num(line).alias("line"), body.alias("body"))


def _explode(df: DataFrame, *fragments: Column) -> DataFrame:
    """All fragments of each row in one pass; null ones are left out."""
    rows = F.filter(F.array(*fragments), lambda f: f.isNotNull())
    return df.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def markdown_fragments(docs: DataFrame, blocks: DataFrame, messages: DataFrame, include_original: bool = True) -> DataFrame:
    """doc_id, section, item_no, qa_no, line, body: fragments that make the Markdown when joined by line feeds.

    docs(doc_id, title, filename, pages); blocks(.., page, rows, urls) with optional rows and urls.
    """
    pairs = materialize(threads.pair_messages(messages), "pairs")
    numbered = threads.number_questions(threads.to_items(blocks, pairs, only_answered=True))
    summary = threads.summarize(docs, blocks, pairs, messages)
    pages = F.when(F.coalesce("pages", F.lit(0)) > 0, fill(v.MD_PAGES, F.col("pages"))).otherwise("")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit(v.PASTED))
    no_records = F.when(F.col("answered") == 0, f"\n{v.NO_RECORDS}\n").otherwise("")
    titled = fill(v.MD_HEAD, F.col("title"), name, F.col("blocks"), pages, F.col("questions"))
    head = F.concat(titled, no_records, F.lit(f"\n{v.MD_ORIGINAL}\n" if include_original else ""))
    # A document without a question has no list fragments, so its closing note belongs to the list title.
    out = _explode(summary, _fragment(0, 0, 0, 0, head), _fragment(2, 0, 0, 0, F.concat(F.lit(f"{v.MD_LIST}\n"), no_records)))

    qa = _labelled(numbered, blocks)
    answer = F.when(F.col("answer") == "", v.NO_ANSWER).otherwise(F.col("answer"))
    cite = F.when(F.col("cite") == "", "").otherwise(F.concat(F.lit(" "), "cite"))
    place = F.when(F.col("type") == "cross", v.MD_CROSS).otherwise(fill(v.MD_PLACE, F.col("idx") + 1))
    listed = fill(v.MD_LISTED, F.col("q_no"), place, cite, F.col("question"), answer)
    below = fill(v.MD_BELOW, cite, F.col("question"), answer)
    item, rule = F.col("item_no"), F.lit("---\n")
    of_qa = [_fragment(2, item, F.col("qa_no"), 1, listed)]
    if include_original:
        opens = (F.col("type") == "cross") & (F.col("qa_no") == 0)
        cross_title = F.lit(v.MD_CROSS_TITLE.format(v.CROSS_TEXT))
        of_qa += [
            _fragment(1, item, F.col("qa_no"), 0, below),
            F.when(opens, _fragment(1, item, -1, 0, cross_title)),
            F.when(opens, _fragment(1, item, END, 0, rule)),
        ]
        flat = blocks
        for c, t in (("rows", "array<array<string>>"), ("urls", "array<string>")):
            if c not in blocks.columns:
                flat = flat.withColumn(c, F.lit(None).cast(t))
        kind = F.lit(v.MD_LABEL_OTHER)
        for t, label in v.MD_LABELS.items():
            kind = F.when(F.col("type") == t, label).otherwise(kind)
        page = F.when(F.coalesce("page", F.lit(0)) > 0, fill(v.MD_PAGE, F.col("page"))).otherwise("") if "page" in blocks.columns else F.lit("")
        body = block_markdown(F.col("type"), F.col("text"), F.col("rows"), F.col("urls"))
        quoted = F.when(F.col("type").isin("image", "table"), body).otherwise(F.concat(F.lit("> "), F.regexp_replace(body, "\n+", " ")))
        title = fill(v.MD_BLOCK_TITLE, kind, F.col("idx") + 1, page, quoted)
        out = out.unionByName(_explode(flat, _fragment(1, F.col("idx"), -1, 0, title), _fragment(1, F.col("idx"), END, 0, rule)))
    return out.unionByName(_explode(qa, *of_qa))


def build_markdown(docs: DataFrame, blocks: DataFrame, messages: DataFrame, include_original: bool = True) -> DataFrame:
    """doc_id, body: one Markdown text per document."""
    fragments = materialize(markdown_fragments(docs, blocks, messages, include_original), "fragments")
    return ordered.assemble(fragments, ["doc_id"], ORDER, "body", "\n")


def json_fragments(docs: DataFrame, blocks: DataFrame, messages: DataFrame, include_original: bool = True, include_unanswered: bool = False) -> DataFrame:
    """Fragments that make one JSON object per document when joined: head, items with their pairs, closing brackets."""
    pairs = materialize(threads.pair_messages(messages), "pairs")
    items = materialize(threads.to_items(blocks, pairs, only_answered=not (include_original or include_unanswered)), "items")
    summary = threads.summarize(docs, blocks, pairs, messages)
    none = F.array().cast("array<string>")
    head = F.concat(
        F.lit('{"document":'), F.to_json(F.struct("doc_id", "title", "filename", "format", "blocks", "questions", "answered")), F.lit(',"items":['),
    )
    firsts = items.groupBy("doc_id").agg(F.min("item_no").alias("first_item"))
    cross = F.col("type") == "cross"
    # The first row of an item (its first pair, or the row without one) also writes the item itself.
    opens = F.coalesce("qa_no", F.lit(0)) == 0
    fields = [
        F.col("block_id").alias("paragraphId"), F.when(~cross, F.col("idx") + 1).alias("paragraphNumber"), F.col("page"), F.coalesce("type", F.lit("paragraph")).alias("type"), cross.alias("crossParagraph"),
        *([F.col("text")] if include_original else []), F.when(cross, F.coalesce("cited", none)).alias("citedParagraphIds"),
    ]
    opened = F.to_json(F.struct(*fields))
    comma = F.when(F.col("item_no") == F.col("first_item"), "").otherwise(",")
    opening = F.concat(comma, F.left(opened, F.length(opened) - 1), F.lit(',"qa":['))
    pair = F.to_json(F.struct("question", F.nullif("answer", F.lit("")).alias("answer"), F.nullif("error", F.lit("")).alias("error"), F.coalesce("cited", none).alias("citedParagraphIds")))
    item, qa = F.col("item_no"), F.col("qa_no")
    of_item = _explode(
        items.join(firsts, "doc_id"),
        F.when(opens, _fragment(1, item, -1, 0, opening)),
        F.when(qa.isNotNull(), _fragment(1, item, qa, 0, F.concat(F.when(qa > 0, ",").otherwise(""), pair))),
        F.when(opens, _fragment(1, item, END, 0, F.lit("]}"))),
    )
    return _explode(summary, _fragment(0, 0, 0, 0, head), _fragment(2, 0, 0, 0, F.lit("]}"))).unionByName(of_item)


def build_json(docs: DataFrame, blocks: DataFrame, messages: DataFrame, include_original: bool = True, include_unanswered: bool = False) -> DataFrame:
    fragments = materialize(json_fragments(docs, blocks, messages, include_original, include_unanswered), "fragments")
    return ordered.assemble(fragments, ["doc_id"], ORDER, "body", "")


def print_view(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Numbered question rows in print order: answered blocks first, then the cross thread; failed answers shown."""
    pairs = threads.pair_messages(messages, show_errors=True)
    items = threads.to_items(blocks, pairs, only_answered=True)
    numbered = threads.number_questions(items)
    labels = threads.cite_labels(numbered, ["doc_id", "block_id", "seq"], blocks, style="print")
    return numbered.join(labels, ["doc_id", "block_id", "seq"], "left").select(
        "doc_id", "q_no", "block_id", F.coalesce("label", F.lit("")).alias("cited"), "question", "answer"
    )
