"""SQL text for the DuckDB counterparts: expressions, and named common table expressions with what they need.

Written apart from the Spark plans: paragraphs and packing are list folds here, numbering is plain windows.
"""

from __future__ import annotations

from quirefold.functions import fixed as v

LF = "chr(10)"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {s(v.WS)})"


def norm(x: str) -> str:
    for pat, to in [(r"\r\n?", LF), (" ", "' '"), ("　", "' '"), (r"[\t\f\v]+", "' '"), (" {2,}", "' '"), (r" +\n", LF), (r"\n{3,}", f"{LF}||{LF}")]:
        x = f"regexp_replace({x}, {s(pat)}, {to}, 'g')"
    return x


def rx(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {s(pattern)}{', ' + s(flags) if flags else ''})"


def heading(t: str) -> str:
    """t is trimmed."""
    return (
        f"({t} <> '' AND length({t}) <= {v.HEADING_MAX} AND ({rx(t, v.HEADING_NUMBERED)} OR {rx(t, '(?i)' + v.HEADING_ENGLISH + chr(92) + 'b')}"
        f" OR {rx(t, v.HEADING_CHINESE)} OR (length({t}) <= {v.HEADING_CAPS_MAX} AND NOT {rx(t, v.HEADING_BAD_END)}"
        f" AND NOT {rx(t, '[' + v.CJK + ']')} AND {rx(t, v.HEADING_CAPS)} AND upper({t}) = {t})))"
    )


def is_list(t: str) -> str:
    return rx(t, v.LIST_LINE)


def has_math(t: str) -> str:
    return rx(t, v.MATH)


def cjk(t: str) -> str:
    return f"length(regexp_replace({t}, {s('[^' + v.CJK_TOKEN + ']')}, '', 'g'))"


def cost(c: str, o: str) -> str:
    return f"CAST(ceil(({c}) * CAST(0.75 AS DOUBLE) + ({o}) * CAST(0.3 AS DOUBLE)) + 4 AS BIGINT)"


def tokens(t: str) -> str:
    return f"(CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE {cost(cjk(t), f'length({t}) - {cjk(t)}')} END)"


def fit(t: str, limit: str) -> str:
    """Longest prefix found by testing every length from the longest that could fit."""
    suf = s(v.FIT_SUFFIX)
    top = f"least(length({t}), greatest(CAST(ceil(({limit}) / 0.3) AS INTEGER), 0))"
    ok = f"list_filter(range(0, CAST({top} + 1 AS BIGINT)), lambda n: {cost(cjk(f'left({t}, n) || {suf}'), f'length(left({t}, n) || {suf}) - {cjk(f'left({t}, n) || {suf}')}')} <= ({limit}))"
    return f"(CASE WHEN {tokens(t)} <= ({limit}) THEN {t} ELSE left({t}, coalesce(list_max({ok}), 0)) || {suf} END)"


P = "STRUCT(ty VARCHAR, tx VARCHAR)[]"


def _flush(b: str) -> str:
    return f"(CASE WHEN {b} = '' THEN CAST([] AS {P}) ELSE [{{'ty': 'paragraph', 'tx': {b}}}] END)"


def _fold(mode: str) -> str:
    cj = lambda x: rx(x, f"[{v.CJK}]")
    acc = lambda o, b: f"{{'o': {o}, 'b': {b}, 'l': ''}}"
    own = lambda kind: acc(f"list_concat(list_concat(a.o, {_flush('a.b')}), [{{'ty': '{kind}', 'tx': x.l}}])", "''")
    pdf = ""
    if mode == "pdf":
        open_ = f"NOT {rx('a.b', '[' + v.HARD_END + ']$')}"
        pdf = (
            f"WHEN {open_} AND NOT {cj('right(x.l, 1)')} AND NOT {rx('a.b', '[' + v.PDF_NO_SPACE_END + ']$')} THEN {acc('a.o', chr(39).join(['a.b || ', ' ', ' || x.l']))} "
            f"WHEN {open_} THEN {acc('a.o', 'a.b || x.l')} "
        )
    return (
        f"(CASE WHEN length(x.l) <= {v.HEADING_BLOCK_MAX} AND {heading('x.l')} THEN {own('heading')} "
        f"WHEN {is_list('x.l')} THEN {own('list')} WHEN a.b = '' THEN {acc('a.o', 'x.l')} {pdf}"
        f"WHEN {rx('a.b', '[' + v.SENTENCE_END + ']$')} AND {rx('x.l', '^[A-Z' + v.HAN + ']')} AND length(a.b) > {v.PARAGRAPH_MIN} "
        f"THEN {acc('list_concat(a.o, ' + _flush('a.b') + ')', 'x.l')} "
        f"WHEN {cj('right(a.b, 1)')} OR {cj('left(x.l, 1)')} THEN {acc('a.o', 'a.b || x.l')} "
        f"ELSE {acc('a.o', chr(39).join(['a.b || ', ' ', ' || x.l']))} END)"
    )


def split_long(t: str) -> str:
    step = "(CASE WHEN a.b <> '' AND length(a.b || x.b) > 900 THEN {'o': list_append(a.o, " + trim("a.b") + "), 'b': x.b} ELSE {'o': a.o, 'b': a.b || x.b} END)"
    sent = f"regexp_extract_all({t}, {s(v.SENTENCE)})"
    first = "{'o': CAST([] AS VARCHAR[]), 'b': ''}"
    folded = f"list_reduce(list_transform(CASE WHEN len({sent}) = 0 THEN [{t}] ELSE {sent} END, lambda q: {{'o': CAST([] AS VARCHAR[]), 'b': q}}), lambda a, x: {step}, {first})"
    return f"(CASE WHEN length({t}) <= 1260 THEN [{t}] ELSE list_filter(list_transform([{folded}], lambda r: list_append(r.o, {trim('r.b')}))[1], lambda p: p <> '') END)"


def coalesced(src: str, out: str, mode: str = "txt") -> str:
    """CTEs from src(doc_id, text) to out(doc_id, ch, k, ty, tx): coalesced lines of every chunk."""
    first = f"{{'o': CAST([] AS {P}), 'b': '', 'l': ''}}"
    return f"""{out}_chunks AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS ch FROM (SELECT doc_id, regexp_split_to_array({norm('text')}, {s(chr(92) + 'n{2,}')}) AS cs FROM {src})),
{out}_lines AS (SELECT doc_id, ch, list_filter(list_transform(string_split(chunk, {LF}), lambda l: {trim('l')}), lambda l: l <> '') AS ls FROM {out}_chunks),
{out}_fold AS (SELECT doc_id, ch, list_reduce(list_transform(ls, lambda l: {{'o': CAST([] AS {P}), 'b': '', 'l': l}}), lambda a, x: {_fold(mode)}, {first}) AS r FROM {out}_lines),
{out}_all AS (SELECT doc_id, ch, list_concat(r.o, {_flush('r.b')}) AS bs FROM {out}_fold),
{out} AS (SELECT doc_id, ch, unnest(bs).ty AS ty, unnest(bs).tx AS tx, generate_subscripts(bs, 1) AS k FROM {out}_all)"""


def segmented(src: str, out: str) -> str:
    return f"""{coalesced(src, out + '_c')},
{out}_p AS (SELECT doc_id, ch, k, ty, unnest(ps) AS text, generate_subscripts(ps, 1) AS j FROM (SELECT doc_id, ch, k, ty, {split_long('tx')} AS ps FROM {out}_c)),
{out} AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ch, k, j) - 1 AS INTEGER) AS idx, ty AS type, text, {has_math('text')} AS rich,
 'p' || row_number() OVER (PARTITION BY doc_id ORDER BY ch, k, j) AS block_id FROM {out}_p)"""


STUDY = f"replace(replace(text, '. ', '。 '), '.' || {LF}, '。' || {LF})"
CTES: dict[str, tuple[list[str], str]] = {
    "docs": ([], f"""docs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {STUDY} WHEN 1 THEN replace({STUDY}, {LF}, {LF}||{LF})
 ELSE 'Abstract' || {LF} || replace({STUDY}, {LF}, {LF}||{LF}||'2.1 Section'||{LF}||'- point one'||{LF}) END AS text,
 'Study ' || doc_id || ' ' || source AS title, source || '-' || doc_id || '.txt' AS filename, CASE WHEN doc_id % 4 = 0 THEN 'pdf' ELSE 'text' END AS format, CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars // 2000 + 1 AS INTEGER) END AS pages, n_chars AS size,
 doc_id * 60 + 1700000000 AS created_at, doc_id * 60 + 1700000000 + doc_id * 7919 % 100000 AS updated_at FROM documents)"""),
    "blocks": (["docs"], segmented("docs", "blocks")),
        "messages": ([], f"""messages AS (SELECT conv_id AS doc_id, CASE WHEN conv_id % 5 = 4 THEN '{v.CROSS}' WHEN turn >= 4 THEN 'p2' ELSE 'p1' END AS thread_key, turn AS seq, role, text AS content,
 CASE WHEN role = 'assistant' AND length(text) % 7 = 0 THEN 'timeout' END AS error, role = 'assistant' AND length(text) % 11 = 0 AS interrupted,
 CASE WHEN role = 'user' THEN CASE length(text) % 3 WHEN 1 THEN ['p2'] WHEN 2 THEN ['p3', 'p1', 'p9999'] END END AS cited,
 CASE WHEN role = 'assistant' THEN ['p1', 'p2'] END AS included, conv_id * 100 + turn + 1700100000 AS created_at FROM conversations)"""),
    "questions": ([], f"""questions AS (SELECT conv_id AS q_id, conv_id AS doc_id, turn, CASE conv_id % 10 WHEN 7 THEN '{v.CROSS}' WHEN 9 THEN 'p9999' ELSE 'p1' END AS block_id, text AS question,
 coalesce(CASE length(text) % 3 WHEN 1 THEN ['p2'] WHEN 2 THEN ['p3', 'p1', 'p9999'] END, CAST([] AS VARCHAR[])) AS cited,
 CASE conv_id % 4 WHEN 2 THEN 'neighbors' WHEN 3 THEN 'paragraph' ELSE 'full' END AS mode, conv_id % 6 * 700 + 2000 AS budget, repeat('请简洁回答。', CAST(1 + conv_id % 200 AS BIGINT)) AS system_prompt
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1)"""),
}


def typed(src: str, out: str) -> str:
    kind = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '$') THEN 'formula' WHEN length(text) % 13 = 0 THEN 'image' ELSE type END"
    return f"""{out} AS (SELECT doc_id, idx, block_id, text, rich, kind AS type, idx // 5 + 1 AS page, CASE WHEN kind = 'heading' THEN CAST(length(text) % 4 + 1 AS INTEGER) END AS level,
 CASE WHEN kind = 'table' THEN list_transform(string_split(text, '。 '), lambda r: string_split(r, ' | ')) END AS rows, CASE WHEN kind = 'image' THEN ['img/' || block_id || '.png'] END AS urls
 FROM (SELECT *, {kind} AS kind FROM {src}))"""


CTES["typed"] = (["blocks"], typed("blocks", "typed"))


def terms(q: str) -> str:
    han = f"regexp_replace({q}, {s('[^' + v.HAN + ']')}, '', 'g')"
    pairs = f"(CASE WHEN length({han}) = 1 THEN [{han}] ELSE list_transform(range(1, greatest(length({han}), 1)), lambda i: substr({han}, i, 2)) END)"
    raw = f"list_concat(list_concat(list_transform(regexp_extract_all({q}, {s(v.LATIN_TERM)}), lambda w: lower(w)), regexp_extract_all({q}, {s(v.NUMBER_TERM)})), {pairs})"
    # first occurrences, in order
    return f"list_transform([{raw}], lambda z: list_filter(z, lambda t, i: list_position(z, t) = i))[1]"


def score(text: str, ts: str) -> str:
    hits = f"list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform({ts}, lambda t: CASE WHEN contains(lower({text}), t) THEN CASE WHEN {rx('t', '[A-Za-z0-9]')} THEN CAST(1.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END)), lambda a, b: a + b)"
    return f"({hits} / sqrt(greatest(40, length(lower({text}))) / CAST(40 AS DOUBLE)))"


CTES["rounds"] = (["messages", "questions"], """talk AS (SELECT q.q_id, m.seq, m.role, m.content, m.error, m.interrupted, lead(m.role) OVER w AS r2, lead(m.content) OVER w AS c2, lead(m.error) OVER w AS e2, lead(m.interrupted) OVER w AS i2
 FROM messages m JOIN questions q ON m.doc_id = q.q_id AND m.seq < q.turn WHERE m.role IN ('user', 'assistant') WINDOW w AS (PARTITION BY q.q_id ORDER BY m.seq)),
rounds AS (SELECT * FROM (SELECT q_id, seq, content AS question, c2 AS answer, row_number() OVER (PARTITION BY q_id ORDER BY seq DESC) AS round_no FROM talk
 WHERE role = 'user' AND r2 = 'assistant' AND c2 <> '' AND coalesce(e2, '') = '' AND NOT i2) WHERE round_no <= 10)""")
CTES["targets"] = (["questions", "blocks"], f"""targets AS (SELECT *, CASE WHEN q = '' THEN {s(v.ERR_EMPTY)} WHEN length(q) > 4000 THEN {s(v.ERR_LONG)} WHEN target_idx IS NULL AND block_id <> '{v.CROSS}' THEN {s(v.ERR_TARGET)}
 WHEN block_id = '{v.CROSS}' AND len(cited_idx) = 0 THEN {s(v.ERR_CITED)} END AS err0 FROM (
 SELECT q.* EXCLUDE (question), {trim('question')} AS q, (SELECT max(idx) FROM blocks b WHERE b.doc_id = q.doc_id AND b.block_id = q.block_id) AS target_idx,
 list_transform(list_filter(list_transform(cited, lambda c: {{'c': c, 'i': m.ids[c]}}), lambda z: z.i IS NOT NULL), lambda z: z.i) AS cited_idx
 FROM questions q LEFT JOIN (SELECT doc_id, map_from_entries(list((block_id, idx))) AS ids FROM blocks GROUP BY doc_id) m ON m.doc_id = q.doc_id))""")
CTES["fixedq"] = (["targets"], f"""fixed0 AS (SELECT *, {s(v.RULES + v.STYLE_PREFIX)} || {fit('system_prompt', 'least(3000, budget * CAST(0.2 AS DOUBLE))')} AS system FROM targets),
fixed1 AS (SELECT *, {tokens('system')} + 6 + {tokens('q')} + 6 + 8 + 160 AS fixed FROM fixed0),
fixedq AS MATERIALIZED (SELECT *, coalesce(err0, CASE WHEN fixed > budget - 350 THEN {s(v.ERR_FIXED)} END) AS err FROM fixed1)""")
CTES["hist"] = (["fixedq", "rounds"], f"""histk AS (SELECT q.q_id, r.round_no, r.question, r.answer, c, sum(c) OVER (PARTITION BY q.q_id ORDER BY r.round_no) <= least(CAST(8000 AS DOUBLE), (q.budget - q.fixed) * CAST(0.3 AS DOUBLE)) AS keep
 FROM fixedq q JOIN (SELECT *, {tokens('question')} + 6 + {tokens('answer')} + 6 + 8 AS c FROM rounds) r ON r.q_id = q.q_id),
hist AS (SELECT q_id, list({{'u': question, 'a': answer}} ORDER BY round_no DESC) FILTER (keep) AS kept, CAST(coalesce(sum(c) FILTER (keep), 0) AS BIGINT) AS history_tokens, count(*) FILTER (NOT keep) > 0 AS history_truncated FROM histk GROUP BY q_id)""")
CTES["prep"] = (["hist", "fixedq"], f"""prep0 AS (SELECT q.*, coalesce(h.kept, []) AS kept, coalesce(h.history_tokens, 0) AS history_tokens, coalesce(h.history_truncated, false) AS history_truncated FROM fixedq q LEFT JOIN hist h ON h.q_id = q.q_id),
prep1 AS (SELECT *, budget - fixed - history_tokens AS available, list_filter(list_concat([target_idx], cited_idx), lambda i: i IS NOT NULL) AS req0,
 q || ' ' || (CASE WHEN len(kept) = 0 THEN '' ELSE kept[len(kept)].u || ' ' || kept[len(kept)].a END) AS qtext FROM prep0),
prep AS MATERIALIZED (SELECT *, list_filter(req0, lambda r, i: list_position(req0, r) = i) AS req, {terms('qtext')} AS terms FROM prep1)""")
CTES["cand"] = (["prep", "blocks"], f"""scored AS MATERIALIZED (SELECT p.q_id, p.doc_id, b.idx, b.type, max(b.idx) OVER (PARTITION BY p.q_id) + 1 AS n, {score('b.text', 'p.terms')} AS score FROM prep p JOIN blocks b ON b.doc_id = p.doc_id WHERE p.mode = 'full'),
tiers AS (SELECT q_id, doc_id, unnest(req) AS idx, 0 AS tier, CAST(0 AS DOUBLE) AS w, generate_subscripts(req, 1) AS a, 0 AS b FROM prep
 UNION ALL SELECT q_id, doc_id, idx + d, 1, -score, idx, CASE d WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END FROM scored, (VALUES (0), (-1), (1)) t(d) WHERE score > 0 AND idx + d BETWEEN 0 AND n - 1
 UNION ALL SELECT q_id, doc_id, idx, 2, 0, idx, 0 FROM scored WHERE type = 'heading'
 UNION ALL SELECT q_id, doc_id, idx, 3, 0, idx, 0 FROM scored WHERE idx < 4 OR idx >= n - 4
 UNION ALL SELECT q_id, doc_id, idx, 4, 0, idx, 0 FROM scored
 UNION ALL SELECT r.q_id, r.doc_id, b.idx, 1, 0, r.a, CASE WHEN b.idx < r.idx THEN 1 ELSE 2 END FROM (SELECT q_id, doc_id, unnest(req) AS idx, generate_subscripts(req, 1) AS a FROM prep WHERE mode = 'neighbors') r JOIN blocks b ON b.doc_id = r.doc_id AND abs(b.idx - r.idx) = 1),
cand AS MATERIALIZED (SELECT q_id, doc_id, idx, tier, row_number() OVER (PARTITION BY q_id ORDER BY tier, w, a, b) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY q_id, idx ORDER BY tier, w, a, b) AS rn FROM tiers) WHERE rn = 1)""")
_ROW = "STRUCT(idx INTEGER, mandatory BOOLEAN, text VARCHAR, cost BIGINT, cut BOOLEAN)[]"
_fitx = fit("x.raw", "room")
CTES["packed"] = (["cand"], f"""craw AS (SELECT c.*, p.available, p.cap, '[第' || (c.idx + 1) || '段]' || CASE WHEN c.idx = p.target_idx THEN ' ★当前提问段落' ELSE '' END || {LF} || b.text AS raw
 FROM cand c JOIN (SELECT *, floor(available / CAST(len(req) AS DOUBLE)) - 10 AS cap FROM prep) p ON p.q_id = c.q_id JOIN blocks b ON b.doc_id = c.doc_id AND b.idx = c.idx),
ccost AS MATERIALIZED (SELECT *, {tokens('raw')} + 8 AS cost FROM craw),
RECPACK,
packed AS MATERIALIZED (SELECT q_id, doc_id, idx, tier = 0 AS mandatory, text, cost, cut FROM steps WHERE taken)""")
# Packing walks the candidates one by one: a recursive step per place.
_room = "greatest(35, least(c.cap, c.available - s.used - 8))"
CTES["packed"] = (
    ["cand"],
    CTES["packed"][1]
    .replace("packed AS MATERIALIZED", "packed AS MATERIALIZED")
    .replace(
        "RECPACK",
        f"""steps AS (WITH RECURSIVE walk AS (
 SELECT q_id, doc_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, -1 AS idx, 9 AS tier, '' AS text, CAST(0 AS BIGINT) AS cost, false AS cut, false AS taken FROM prep
 UNION ALL
 SELECT q_id, doc_id, place, used + CASE WHEN taken THEN {tokens('text')} + 8 ELSE 0 END, idx, tier, text, CASE WHEN taken THEN {tokens('text')} + 8 ELSE 0 END, taken AND text <> raw, taken FROM (
  SELECT s.q_id, s.doc_id, c.place, s.used, c.idx, c.tier, c.raw, c.tier = 0 OR s.used + c.cost <= c.available AS taken, CASE WHEN c.tier = 0 THEN {fit('c.raw', _room)} ELSE c.raw END AS text
  FROM walk s JOIN ccost c ON c.q_id = s.q_id AND c.place = s.place + 1))
 SELECT * FROM walk)""",
    ),
)
CTES["pairs"] = (["messages"], """pairs AS (SELECT doc_id, thread_key, seq, question, CASE WHEN r2 = 'assistant' THEN coalesce(c2, '') ELSE '' END AS answer, CASE WHEN r2 = 'assistant' THEN coalesce(e2, '') ELSE '' END AS error, created_at, cited,
 row_number() OVER (PARTITION BY doc_id, thread_key ORDER BY seq) - 1 AS qa_no FROM (
 SELECT doc_id, thread_key, seq, role, content AS question, created_at, cited, lead(role) OVER w AS r2, lead(content) OVER w AS c2, lead(error) OVER w AS e2 FROM messages WHERE role IN ('user', 'assistant')
 WINDOW w AS (PARTITION BY doc_id, thread_key ORDER BY seq)) WHERE role = 'user')""")


def items(src: str, out: str) -> str:
    return f"""{out} AS (SELECT b.doc_id, b.block_id, b.idx, b.type, b.text, b.idx AS item_no, p.seq, p.qa_no, p.question, p.answer, p.error, p.cited FROM {src} b LEFT JOIN pairs p ON p.doc_id = b.doc_id AND p.thread_key = b.block_id
 UNION ALL SELECT doc_id, thread_key, -1, 'cross', {s(v.CROSS_TEXT)}, 2147483647, seq, qa_no, question, answer, error, cited FROM pairs WHERE thread_key = '{v.CROSS}' AND doc_id IN (SELECT doc_id FROM {src}))"""


CTES["items"] = (["blocks", "pairs"], items("blocks", "items"))
CTES["numbered"] = (["items"], """numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_no, qa_no) AS q_no, CASE WHEN type = 'cross' THEN -1 ELSE dense_rank() OVER (PARTITION BY doc_id ORDER BY item_no) - 1 END AS anchor
 FROM items WHERE qa_no IS NOT NULL)""")


def cites(src: str, keys: str, blocks: str, style: str = "export") -> str:
    """SELECT of keys, label from src(keys, cited) with keys including doc_id."""
    known, unknown, sep = ("'[段落 ' || (b.idx + 1) || ']'", "'[' || c.id || ']'", "' '") if style == "export" else ("'第 ' || (b.idx + 1) || ' 段'", "c.id", "'、'")
    k = [x.strip() for x in keys.split(",")]
    cols = ", ".join("c." + x for x in k)
    return (
        f"(SELECT {cols}, string_agg(CASE WHEN b.idx IS NULL THEN {unknown} ELSE {known} END, {sep} ORDER BY c.pos) AS label FROM "
        f"(SELECT {keys}, unnest(cited) AS id, generate_subscripts(cited, 1) AS pos FROM {src}) c LEFT JOIN {blocks} b ON b.doc_id = c.doc_id AND b.block_id = c.id GROUP BY {cols})"
    )


def compose(needs: str, select: str) -> str:
    """The named common table expressions with all they need, then the select."""
    done: list[str] = []

    def visit(name):
        if name in done:
            return
        for n in CTES[name][0]:
            visit(n)
        done.append(name)

    for name in needs.split():
        visit(name)
    return ("WITH " + ",\n".join(CTES[n][1] for n in done) + "\n" + select) if done else select
