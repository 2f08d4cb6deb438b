"""SQL that the training-data queries are checked against."""

from __future__ import annotations

from .naturalness import COMMON

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[a-z0-9]+')"


def _content(table: str, key: str, split: bool = True) -> str:
    """One row per record: its text or, where that is null, the pieces of its ids."""
    return f"""d0 AS (SELECT {key} AS id, any_value(split) AS split, any_value(source) AS source, any_value(text) AS text, any_value(ids) AS ids FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}),
dt AS (SELECT id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS i FROM d0 WHERE text IS NULL),
dm AS (SELECT id, string_agg(piece, '' ORDER BY i) AS made FROM dt JOIN token_vocab USING (token_id) WHERE token_id <> 50256 GROUP BY id),
d AS (SELECT id, split, source, coalesce(text, made) AS text FROM d0 LEFT JOIN dm USING (id))"""


_RUNS3 = f"""w AS (SELECT id, split, {_WORDS} AS l FROM d WHERE text IS NOT NULL),
g AS (SELECT DISTINCT id, split, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS r FROM (SELECT id, split, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) >= 20)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""

_P1 = f"""WITH RECURSIVE d AS (SELECT rec_id AS id, any_value(split) AS split, any_value(text) AS text FROM general_purpose_prepare WHERE rec_id IS NOT NULL GROUP BY rec_id),
{_RUNS3},
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.r = b.r AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * s >= x.n + y.n - s),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(a, b) AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT a AS rec_a, b AS rec_b FROM c WHERE a < b"""

_CLASSES = _P1.removesuffix("\nSELECT a AS rec_a, b AS rec_b FROM c WHERE a < b") + f""",
m AS (SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT d.id AS rec_id, least(d.id, coalesce(m.b, d.id)) AS class_id, CAST(len(regexp_extract_all({_LOW.replace("text", "d.text")}, '[a-z0-9]+')) AS INTEGER) AS n_words FROM d LEFT JOIN m ON m.a = d.id WHERE d.text IS NOT NULL"""

_P2 = f"""WITH d AS (SELECT rec_id AS id, any_value(text) AS text FROM general_purpose_prepare WHERE rec_id IS NOT NULL AND text IS NOT NULL GROUP BY rec_id),
w AS (SELECT id, {_WORDS} AS l FROM d),
g AS (SELECT id, i, l[i:i + 4] AS r FROM (SELECT id, l, unnest(range(1, len(l) - 3)) AS i FROM w WHERE len(l) >= 20)),
f AS (SELECT id, i FROM (SELECT id, i, row_number() OVER (PARTITION BY id, r ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM f) GROUP BY id)
SELECT id AS rec_id FROM c JOIN w USING (id) WHERE c.n * 10 >= len(l) * 3"""

_SHARES = f"""WITH d AS (SELECT rec_id AS id, any_value(text) AS text FROM general_purpose_prepare WHERE rec_id IS NOT NULL AND text IS NOT NULL GROUP BY rec_id),
w AS (SELECT id, {_WORDS} AS l FROM d),
g AS (SELECT id, i, l[i:i + 4] AS r FROM (SELECT id, l, unnest(range(1, len(l) - 3)) AS i FROM w)),
f AS (SELECT id, i FROM (SELECT id, i, row_number() OVER (PARTITION BY id, r ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM f) GROUP BY id)
SELECT id AS rec_id, CAST(len(l) AS INTEGER) AS n_words, CAST(coalesce(n, 0) AS INTEGER) AS n_repeated, round(coalesce(n, 0)::DOUBLE / greatest(len(l), 1), 9) AS rep_share FROM w LEFT JOIN c USING (id)"""

_KNOWN = ", ".join(f"'{w}'" for w in COMMON)
_STATS = f"""WITH d AS (SELECT rec_id, any_value(text) AS text FROM general_purpose_prepare WHERE rec_id IS NOT NULL GROUP BY rec_id),
w AS (SELECT rec_id, text, {_WORDS} AS l, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS ls FROM d),
s AS (SELECT *, length(text) AS n, len(l) AS m FROM w)
SELECT rec_id, n AS n_chars, m AS n_words, round(length(array_to_string(l, ''))::DOUBLE / greatest(m, 1), 9) AS mean_word_len,
    round(length(regexp_replace(text, '[A-Za-z0-9\\t\\n\\x0b\\f\\r ]', '', 'g'))::DOUBLE / greatest(n, 1), 9) AS symbol_share, round(length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(n, 1), 9) AS digit_share,
    round(len(list_filter(ls, lambda x: contains('.!?;:,"'')', right(x, 1))))::DOUBLE / greatest(len(ls), 1), 9) AS punct_line_share, round(len(list_filter(l, lambda x: x IN ({_KNOWN})))::DOUBLE / greatest(m, 1), 9) AS common_share FROM s"""

_LEAKS = f"""{_content("general_purpose_prepare", "rec_id")},
w AS (SELECT id, {_WORDS} AS l FROM d WHERE split = 'train' AND text IS NOT NULL),
g AS (SELECT id, i, array_to_string(l[i:i + 12], ' ') AS r FROM (SELECT id, l, unnest(range(1, len(l) - 11)) AS i FROM w WHERE len(l) >= 13)),
v AS (SELECT item_id, {_WORDS} AS l FROM (SELECT DISTINCT item_id, text FROM heldout_items WHERE item_id IS NOT NULL AND text IS NOT NULL)),
h AS (SELECT DISTINCT item_id, array_to_string(l[i:i + 12], ' ') AS r FROM (SELECT item_id, l, unnest(range(1, len(l) - 11)) AS i FROM v WHERE len(l) >= 13)),
q AS (SELECT id AS rec_id, item_id, i FROM g JOIN h USING (r)),
m AS (SELECT DISTINCT rec_id, item_id FROM q)"""

_OVERLAPS = f"""{_content("owt_prepare", "web_id")}, {_RUNS3},
s AS (SELECT a.id AS t, b.id AS e, count(*) AS s FROM g a JOIN g b ON a.r = b.r WHERE a.split = 'train' AND b.split IN ('val', 'test') GROUP BY 1, 2),
o AS (SELECT t, e, s, x.n + y.n - s AS u FROM s JOIN n x ON x.id = t JOIN n y ON y.id = e WHERE 2 * s >= x.n + y.n - s)"""

_PAIRS = f"""WITH {_OVERLAPS},
p AS (SELECT id, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS r, i FROM (SELECT id, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) >= 20)),
v AS (SELECT t, e, count(DISTINCT k) AS covered FROM (SELECT DISTINCT o.t, o.e, unnest(range(p.i, p.i + 3)) AS k FROM o JOIN p ON p.id = o.e JOIN g ON g.id = o.t AND g.r = p.r) GROUP BY t, e)
SELECT t AS train_id, e AS eval_id, o.s AS shared_runs, o.u AS runs, covered AS covered_words, CAST(len(l) AS BIGINT) AS eval_words FROM o JOIN v USING (t, e) JOIN w ON w.id = o.e"""

# texts as an alternation of words and what separates them; pieces from a leaked window's first word to its last go
_CLEAN = f"""WITH {_LEAKS}, b AS (SELECT id, text, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS l FROM d WHERE split = 'train'),
k AS (SELECT id, l[j] AS piece, j FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS j FROM b)),
j AS (SELECT *, sum(CASE WHEN regexp_matches(piece, '[A-Za-z0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY j) AS at FROM k),
x AS (SELECT id, j FROM j SEMI JOIN (SELECT rec_id AS id, unnest(range(i, i + 13)) AS at FROM q) y ON y.id = j.id AND y.at = j.at AND regexp_matches(j.piece, '[A-Za-z0-9]')
    UNION SELECT j.id, j.j FROM j JOIN (SELECT DISTINCT rec_id AS id, unnest(range(i, i + 12)) AS at FROM q) y ON y.id = j.id AND y.at = j.at),
t AS (SELECT id, string_agg(piece, '' ORDER BY j) AS kept FROM k ANTI JOIN x USING (id, j) GROUP BY id),
r AS (SELECT id, text, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS kept FROM b LEFT JOIN t USING (id)),
z AS (SELECT id, kept, CASE WHEN length(text) > 0 THEN 1 - length(kept)::DOUBLE / length(text) ELSE 0 END AS share FROM r)
SELECT id AS rec_id, kept AS text, round(share, 9) AS removed_share FROM z WHERE share <= 0.5"""

_SPANS = """d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 150 GROUP BY doc_id),
p AS (SELECT doc_id, i, substr(text, i + 1, 150) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM d)),
h AS (SELECT s FROM p GROUP BY s HAVING min(doc_id) <> max(doc_id)),
q AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 150 THEN 0 ELSE 1 END AS fresh FROM p SEMI JOIN h USING (s)),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM q),
f AS (SELECT doc_id, CAST(min(i) AS BIGINT) AS span_start, CAST(max(i) + 150 AS BIGINT) AS span_end FROM r GROUP BY doc_id, k)"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p1_classes": _CLASSES,
    "p2_shares": _SHARES,
    "p3_stats": _STATS,
    "p4_items": f"WITH {_LEAKS} SELECT item_id, count(DISTINCT rec_id) AS n_records, count(*) AS n_windows FROM q GROUP BY item_id",
    "p4_clean": _CLEAN,
    "p5_overlaps": _PAIRS,
    "p4_found": f"WITH {_LEAKS} SELECT rec_id, item_id FROM m",
    "p5_found": f"WITH {_OVERLAPS} SELECT least(t, e) AS web_a, greatest(t, e) AS web_b FROM o",
    "p5_report": f"WITH {_OVERLAPS} SELECT split, source, count(*) AS n_pairs, count(DISTINCT e) AS n_records FROM o JOIN d ON d.id = e GROUP BY split, source",
    "p8_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM f",
    "p8_coverage": f"""WITH {_SPANS}, t AS (SELECT doc_id, sum(span_end - span_start) AS n FROM f GROUP BY doc_id)
SELECT doc_id, length(x.text) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars, CASE WHEN length(x.text) > 0 THEN coalesce(n, 0)::DOUBLE / length(x.text) WHEN length(x.text) = 0 THEN 0.0::DOUBLE END AS shared_share
FROM (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id) x LEFT JOIN t USING (doc_id)""",
}
