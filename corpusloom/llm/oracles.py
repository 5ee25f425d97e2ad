"""DuckDB SQL for the problems that SQL can express on whole tables at the size of the correctness check."""

from __future__ import annotations

import functools
import unicodedata

from corpusloom.llm import forms

_WS = r"\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _many(expr: str) -> str:
    for c in "…㎎ﬁ":
        expr = f"replace({expr}, {quoted(c)}, {quoted(unicodedata.normalize('NFKC', c))})"
    return expr


@functools.cache
def _maps(lower: bool) -> tuple[str, str]:
    """Characters with one other form (to skeleton, or to plain form), then those that are dropped."""
    changed, dropped = [], []
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        c = chr(cp)
        if unicodedata.combining(c):
            continue
        to = forms.plain(c) if lower else unicodedata.normalize("NFC", forms.skeleton(c))
        if lower and not to and unicodedata.category(c) != "Cf":  # invisible characters go before accents are composed
            continue
        if len(to) == 1 and to != c:
            changed.append((c, to))
        elif not to and unicodedata.category(c) == "Cf":
            dropped.append(c)
    return "".join(a for a, _ in changed) + "".join(dropped), "".join(b for _, b in changed)


def plain_sql(expr: str) -> str:
    a, b = _maps(True)
    return f"regexp_replace(lower(nfc_normalize(translate(nfc_normalize({_many(expr)}), {quoted(a)}, {quoted(b)}))), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def skeleton_sql(expr: str) -> str:
    a, b = _maps(False)
    return f"nfc_normalize(translate(nfc_normalize({_many(expr)}), {quoted(a)}, {quoted(b)}))"


def canonical_sql(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '[{_WS}\\p{{P}}\\p{{Z}}]+', '', 'g'))"


def _pairs_sql(texts: str, condition: str, columns: str) -> str:
    """Pairs of ``texts`` (tbl, id, ev, plain) with a likeness of 0.6, by an inverted index of runs of three."""
    return f"""
WITH t AS MATERIALIZED ({texts}),
g AS MATERIALIZED (SELECT DISTINCT tbl, id, ev, substring(plain, i, 3) AS gram FROM (SELECT *, unnest(range(1, CAST(length(plain) AS BIGINT) - 1)) AS i FROM t WHERE length(plain) >= 3)),
n AS (SELECT tbl, id, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT a.tbl, a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.tbl = b.tbl AND a.gram = b.gram AND {condition} GROUP BY 1, 2, 3)
SELECT DISTINCT {columns} FROM c JOIN n x ON x.tbl = c.tbl AND x.id = c.a JOIN n y ON y.tbl = c.tbl AND y.id = c.b WHERE s >= 0.6 * (x.n + y.n - s) - 1e-9"""


def p1_found() -> str:
    texts = f"""SELECT 'qa_records' AS tbl, record_id AS id, split <> 'train' AS ev, {plain_sql('query')} AS plain FROM qa_records WHERE split IN ('train', 'development', 'heldout') GROUP BY ALL
UNION ALL SELECT 'chat_samples', sample_id, split <> 'train', {plain_sql("list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'human')[1].value")} FROM chat_samples WHERE split IN ('train', 'development', 'heldout') GROUP BY ALL"""
    return _pairs_sql(texts, "a.ev AND NOT b.ev", "c.tbl, least(c.a, c.b) AS id_a, greatest(c.a, c.b) AS id_b")


def p1_report() -> str:
    """Likeness by an inverted index, coverage by the windows of ten characters that training texts hold too."""
    human = plain_sql("list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'human')[1].value")
    return f"""
WITH r AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'qa_records' AS tbl, record_id AS id, split, source, {plain_sql('query')} AS plain FROM qa_records
UNION ALL SELECT 'chat_samples', sample_id, split, source, {human} FROM chat_samples) WHERE split IN ('train', 'development', 'heldout') AND plain <> ''),
t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tbl, ev, plain) AS id FROM (SELECT DISTINCT tbl, split <> 'train' AS ev, plain FROM r)),
g AS MATERIALIZED (SELECT DISTINCT tbl, id, ev, substring(plain, i, 3) AS gram FROM (SELECT *, unnest(range(1, CAST(length(plain) AS BIGINT) - 1)) AS i FROM t WHERE length(plain) >= 3)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.tbl = b.tbl AND a.gram = b.gram AND a.ev AND NOT b.ev GROUP BY 1, 2),
l AS (SELECT a AS id, count(*) AS links FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE s >= 0.6 * (x.n + y.n - s) - 1e-9 GROUP BY 1),
w AS MATERIALIZED (SELECT DISTINCT tbl, id, ev, i, substring(plain, i, 10) AS gram FROM (SELECT *, unnest(range(1, CAST(length(plain) AS BIGINT) - 8)) AS i FROM t WHERE length(plain) >= 10)),
h AS (SELECT id, i FROM w WHERE ev AND (tbl, gram) IN (SELECT tbl, gram FROM w WHERE NOT ev)),
v AS (SELECT id, count(DISTINCT i + k) AS covered FROM h, range(0, 10) AS u(k) GROUP BY 1)
SELECT r.tbl, r.split, r.source, count(*) AS records, count(*) FILTER (links > 0) AS leaked, CAST(coalesce(sum(links), 0) AS BIGINT) AS train_texts, count(*) FILTER (coalesce(covered, 0) / length(r.plain) >= 0.8) AS contained, round(avg(coalesce(covered, 0) / length(r.plain)), 6) AS mean_coverage
FROM r JOIN t ON t.tbl = r.tbl AND t.ev AND t.plain = r.plain LEFT JOIN l ON l.id = t.id LEFT JOIN v ON v.id = t.id WHERE r.split <> 'train' GROUP BY 1, 2, 3"""


def p2_found() -> str:
    both = plain_sql("coalesce(query, '')") + " || " + plain_sql("coalesce(response, '')")
    texts = f"SELECT 'qa' AS tbl, record_id AS id, true AS ev, {both} AS plain FROM qa_records GROUP BY ALL"
    return _pairs_sql(texts, "a.id < b.id", "c.a AS id_a, c.b AS id_b")


def p4_found() -> str:
    return f"""
WITH t AS MATERIALIZED (SELECT DISTINCT id, text, {skeleton_sql('text')} AS s FROM (SELECT record_id AS id, query AS text FROM qa_records UNION ALL SELECT req_no, text FROM api_requests) WHERE text IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.s = b.s AND a.id < b.id AND a.text <> b.text"""


def p5_found() -> str:
    value = "json_extract_string(payload, '$.\"' || k || '\"')"
    raw = f"list_transform(list_sort(json_keys(payload)), lambda k: k || chr(31) || CASE WHEN {value} IS NULL THEN 'null' WHEN regexp_matches({value}, '^-?[0-9]+(\\.[0-9]+)?$') THEN {value} ELSE {canonical_sql(value)} END)"
    return f"""
WITH k AS (SELECT DISTINCT 'qa' AS tbl, record_id AS id, coalesce({canonical_sql('query')}, chr(29)) || chr(30) || {canonical_sql('response')} AS form FROM qa_records WHERE response IS NOT NULL
UNION SELECT 'raw', line_id, array_to_string({raw}, chr(30)) FROM (SELECT line_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS payload FROM raw_records) WHERE payload IS NOT NULL AND coalesce(json_type(json_extract(payload, '$.response')), 'x') <> 'NULL'),
m AS (SELECT *, min(id) OVER (PARTITION BY tbl, form) AS keep_id FROM k)
SELECT keep_id, id AS copy_id FROM m WHERE id <> keep_id"""


def p6_found() -> str:
    def runs(t: str) -> str:
        return f"SELECT DISTINCT id, substring(p, i, 60) AS run FROM (SELECT id, p, unnest(range(1, CAST(length(p) AS BIGINT) - 58)) AS i FROM {t} WHERE length(p) >= 60)"

    return f"""
WITH i AS MATERIALIZED (SELECT DISTINCT id, {plain_sql('t')} AS p FROM (SELECT item_id AS id, reference AS t FROM test_results UNION ALL SELECT item_id, m.content FROM (SELECT item_id, split, unnest(messages) AS m FROM prompt_messages) WHERE split IN ('development', 'heldout') AND m.role = 'user') WHERE t IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id AS id, {plain_sql('text')} AS p FROM documents WHERE text IS NOT NULL),
ri AS MATERIALIZED ({runs('i')}), rd AS MATERIALIZED ({runs('d')})
SELECT DISTINCT rd.id AS doc_id, ri.id AS item_id FROM rd JOIN ri USING (run)"""


def p6_clean() -> str:
    return f"SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({p6_found()}))"


def p5_collapsed() -> str:
    found = p5_found()
    head, _, _ = found.rpartition("SELECT keep_id")
    return f"{head} SELECT keep_id AS id, CAST(count(*) AS BIGINT) AS copies FROM m GROUP BY tbl, form, keep_id"
