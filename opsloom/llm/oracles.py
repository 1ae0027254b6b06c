"""SQL that must give the same rows as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from opsloom.llm.rules import RULES, STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _rule(r) -> str:
    parts = [f"{r.metric} >= {r.low}"] if r.low is not None else []
    parts += [f"{r.metric} <= {r.high}"] if r.high is not None else []
    return f"(n_words < {r.min_words} OR ({' AND '.join(parts)}))"


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP4 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM w),
h AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS k FROM g),
c AS (SELECT rid, k FROM h GROUP BY rid, k HAVING count(*) > 1),
v AS (SELECT rid, count(DISTINCT at_) AS n FROM (SELECT h.rid, unnest(range(h.i, h.i + 5)) AS at_ FROM h JOIN c ON c.rid = h.rid AND c.k = h.k) AS x GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    CAST(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, CAST(len(l) AS bigint) AS n_lines, coalesce(v.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stops FROM w LEFT JOIN v ON v.rid = w.rid),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS marks_per_word, CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS bigint) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS bigint) AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept FROM r"""

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM d WHERE len(w) >= 5
    UNION ALL SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, at_) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.at_)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(at_) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def _crc_table() -> str:
    """What a byte does to a running crc32, as a list literal (from the polynomial)."""

    def of(b: int) -> int:
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return b

    return "[" + ", ".join(str(of(b)) for b in range(256)) + "]::bigint[]"


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text."""
    digits, hexed = "'0123456789ABCDEF'", f"hex(encode({text}))"
    octet = f"CAST(16 * (strpos({digits}, substr({hexed}, 2 * i + 1, 1)) - 1) + strpos({digits}, substr({hexed}, 2 * i + 2, 1)) - 1 AS bigint)"
    octets = f"list_prepend(4294967295::bigint, list_transform(range(CAST(length({hexed}) // 2 AS bigint)), lambda i: {octet}))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


OP11 = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS varchar), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT id, w, count(*) AS n FROM r GROUP BY id, w),
h AS (SELECT w, n, {_crc32("id || ':' || w")} AS h FROM g),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS bigint) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
k AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) AS x),
p AS (SELECT x.word, y.word AS near, y.n FROM k AS x JOIN k AS y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM k AS x JOIN v AS y ON y.word = x.a || x.b UNION SELECT y.word, x.word, x.n FROM k AS x JOIN v AS y ON y.word = x.a || x.b),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
e(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT e.word, f.form FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL),
z AS (SELECT e.word, e.root FROM e JOIN f ON f.word = e.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN z ON z.word = f.word"""

OP13 = rf"""
WITH t AS (SELECT CAST(conv_id AS bigint) AS c, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(k ORDER BY turn NULLS FIRST, role, k, n) AS k, list(n ORDER BY turn NULLS FIRST, role, k, n) AS n, {_crc32("CAST(c AS varchar)")} % 9 AS h FROM t GROUP BY c),
b AS (SELECT o.c, list_concat(coalesce(x.k, [])[1:o.h], o.k[o.h + 1:]) AS k, list_concat(coalesce(x.n, [])[1:o.h], o.n[o.h + 1:]) AS n FROM o LEFT JOIN o AS x ON x.c = o.c - o.c % 5),
p AS (SELECT c, d, array_to_string(k[1:d], '') AS p, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS n, d = len(k) AS ends FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM b) AS x),
m AS (SELECT p, d, min(c) AS c, count(*) AS n_convs, min(n) AS n, sha256(coalesce(string_agg(CAST(c AS varchar), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY p, d),
q AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1),
a AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN q ON q.p = m.p),
u AS (SELECT substr(p, 1, 32 * e) AS p, sum(CAST(n_children = 0 AS bigint)) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a) AS x GROUP BY 1)
SELECT a.c AS conv_id, CAST(a.d AS bigint) AS depth, y.c AS parent_conv_id, a.n_convs, a.n_children, CAST(u.n_leaves AS bigint) AS n_leaves, CAST(u.saved AS bigint) AS saved_tokens, a.ends_sha256
FROM a JOIN u ON u.p = a.p LEFT JOIN m AS y ON a.d > 0 AND y.p = substr(a.p, 1, 32 * (a.d - 1))"""
