"""DuckDB SQL for the subpackage's queries that SQL can express, written out from the contracts."""

_LOWER = ("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = r"""
WITH rules(name, verdict, host_rule, regex, ord) AS (VALUES
  ('net/', 'block', true, '^([^/]*\.)?net/', 0),
  ('example.net/en/', 'allow', true, '^([^/]*\.)?example\.net/en/', 1),
  ('example.com/de/', 'block', true, '^([^/]*\.)?example\.com/de/', 2),
  ('org/fr/', 'allow', true, '^([^/]*\.)?org/fr/', 3),
  ('cheap-pills', 'block', false, '^[^/]*(^|[.-])cheap-pills([.-]|$|/)', 4),
  ('casino', 'block', false, '^[^/]*(^|[.-])casino([.-]|$|/)', 5),
  ('free-money', 'block', false, '(^|[./-])free-money([./-]|$)', 6),
  ('wp-login', 'block', false, '/wp-login\.php$', 7),
  ('win-prize', 'block', false, '[./-]win-(a-)?prize([./-]|$)', 8)),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3)
  ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS rn, page_id, """ + _LOWER.format(r"regexp_extract(rest, '^[^/?#]*')") + r""" AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT rn, first(struct_pack(name, verdict, host_rule) ORDER BY host_rule DESC, length(name) DESC, ord) AS b
  FROM parts JOIN rules ON regexp_matches(host || path, regex) GROUP BY rn)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  CASE WHEN b.host_rule THEN b.name END AS rule, coalesce(b.verdict, 'allow') AS verdict,
  CASE WHEN NOT b.host_rule THEN b.name END AS pattern
FROM parts LEFT JOIN best USING (rn)
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(""" + _WORDS.format("text") + r""", []) AS w FROM documents),
i AS (SELECT item_id, """ + _WORDS.format("text") + r""" AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[s:least(s + 9, len(w))] AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (SELECT rn, s, n, w[s:s + n - 1] AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT rn, s, n, item_id FROM places JOIN wins USING (win)),
words AS (SELECT rn, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) t(p) GROUP BY rn),
found AS (SELECT rn, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rn) LEFT JOIN found USING (rn)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
wins AS (SELECT doc_id, pos, array_to_string(l[pos + 1:pos + 3], chr(10)) AS win
  FROM d, unnest(range(0, len(l) - 2)) t(pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM wins
  WHERE regexp_matches(win, '\S')),
gone AS (SELECT DISTINCT doc_id, line FROM ranked, unnest(range(pos, pos + 3)) t(line) WHERE k > 1),
marks AS (SELECT doc_id, list(line) AS marked FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(marked), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN marked IS NULL THEN coalesce(text, '') ELSE array_to_string(
    [l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(marked, i)], chr(10)) END) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id)
"""


def _spans(kind: str, order: int, regex: str, good: str, score: str) -> str:
    """Spans of one kind: text pieces between matches give the offsets. `m` is the match, `near` the text round it."""
    return f"""
SELECT rn, '{kind}' AS kind, {order} AS ord, pos0 AS start, pos0 + length(m) AS stop, {score} AS score FROM (
  SELECT rn, m, pos0, lower(substr(text, greatest(pos0 - 40, 0) + 1, pos0 - greatest(pos0 - 40, 0) + 40 + length(m))) AS near
  FROM (SELECT rn, text, found[k] AS m, CAST(list_sum([length(x) FOR x IN pieces[1:k]])
      + coalesce(list_sum([length(x) FOR x IN found[1:k - 1]]), 0) AS BIGINT) AS pos0
    FROM (SELECT rn, text, regexp_extract_all(text, '{regex}') AS found, string_split_regex(text, '{regex}') AS pieces
      FROM d), unnest(range(1, len(found) + 1)) t(k))) WHERE {good}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE "
         f"(CAST(reverse({_DIGITS})[i] AS INT) * 2) // 10 + (CAST(reverse({_DIGITS})[i] AS INT) * 2) % 10 END "
         f"FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0")
_TURNED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_MOD97 = (f"CAST(array_to_string([CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END "
          f"FOR c IN string_split({_TURNED}, '')], '') AS HUGEINT) % 97 = 1")


def _score(own: float, words: str) -> str:
    return f"least(1.0, {own} + CASE WHEN regexp_matches(near, '{words}') THEN 0.3 ELSE 0.0 END)"


OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
s AS (""" + " UNION ALL ".join([
    _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true",
           _score(0.9, "mail|contact|write|address")),
    _spans("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "list_max([CAST(x AS DOUBLE) FOR x IN string_split(m, '.')]) <= 255",
           _score(0.6, "host|server|address|login|ip")),
    _spans("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
           _score(0.8, "card|visa|credit|payment|account")),
    _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15",
           _score(0.7, "call|phone|tel|mobile|fax")),
    _spans("iban", 4, r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
           f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}",
           _score(0.8, "iban|bank|account|transfer")),
    _spans("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
           _score(0.3, "ssn|social|security|tax") + " >= 0.5", _score(0.3, "ssn|social|security|tax")),
]) + r"""),
g AS (SELECT rn, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 4) AS base,
  count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip, count(*) FILTER (ord = 2) AS n_card,
  count(*) FILTER (ord = 3) AS n_phone, max(score) AS max_score FROM s GROUP BY rn)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(max_score, 0) AS DOUBLE) AS max_score
FROM d LEFT JOIN g USING (rn)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, encode(coalesce(text, '')) AS b FROM documents),
wins AS (SELECT rn, doc_id, i, array_slice(b, i, i + 49) AS win FROM d, unnest(range(1, octet_length(b) - 48)) t(i)),
low AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS before FROM wins JOIN low USING (win)
  WHERE doc_id > low),
marked AS (SELECT rn, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
  OVER (PARTITION BY rn ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM hits),
spans AS (SELECT rn, run, min(i) AS a, max(i) + 50 AS z FROM marked GROUP BY rn, run),
pieces AS (SELECT rn, coalesce(lag(z) OVER (PARTITION BY rn ORDER BY a), 1) AS f, a AS t FROM spans
  UNION ALL SELECT rn, max(z), NULL FROM spans GROUP BY rn),
kept AS (SELECT rn, string_agg(hex(array_slice(b, f, coalesce(t - 1, octet_length(b)))), '' ORDER BY f) AS h
  FROM pieces JOIN d USING (rn) WHERE f < coalesce(t, octet_length(b) + 1) GROUP BY rn),
sums AS (SELECT rn, sum(z - a) AS n, count(*) AS k FROM spans GROUP BY rn)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  coalesce(k, 0) AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (rn) LEFT JOIN kept USING (rn)
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, """ + "regexp_extract_all(" + _LOWER.format("text") + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

# CRC-32 by its rule: a table of the 256 bytes' remainders, then one look-up a byte
_CRC_TABLE = ("list_transform(range(256), lambda i: list_reduce([i::UINTEGER] || [0::UINTEGER FOR x IN range(8)], "
              "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UINTEGER) ELSE a >> 1 END))")


def _crc(text: str) -> str:
    """CRC-32 of a string column; the table is column `tab`."""
    return (f"xor(list_reduce([4294967295::UINTEGER] || [('0x' || hex(array_slice(encode({text}), i, i)))::UINTEGER "
            f"FOR i IN range(1, octet_length(encode({text})) + 1)], "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)")


OP11 = r"""
WITH crc AS MATERIALIZED (SELECT """ + _CRC_TABLE + r""" AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(""" + _WORDS.format("text") + r""", []) AS w FROM documents),
b AS (SELECT coalesce(""" + _WORDS.format("text") + r""", []) AS w FROM benchmark),
df AS MATERIALIZED (SELECT rn, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM d),
bf AS MATERIALIZED (SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM b),
names AS MATERIALIZED (SELECT f, CAST(""" + _crc("f") + r""" % 10000 AS INT) AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN names USING (f) GROUP BY bucket),
gain AS (SELECT g.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) g LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT rn, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM df JOIN names USING (f) JOIN gain USING (bucket) GROUP BY rn),
scored AS (SELECT rn, doc_id, len(w) AS n, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')),
    1, 8)) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (rn)),
ranked AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id, rn) AS r FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN r <= 25 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (rn)
"""


def _step(place: str, cost: str, letter: str) -> str:
    return f"struct_pack(c := {place}.c + {cost}, a := {place}.a || {letter})"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_INSERTED = (  # places after inserts: a2 after a user's row, a3 after an assistant's
    _least("p2", *[_step(p, "3", "'I'") for p in ("p0", "p1", "p3")]) + " AS a2, "
    + _least("p3", _step("p2", "3", "'I'"), _step("p0", "6", "'II'"), _step("p1", "6", "'II'")) + " AS a3")
_NEVER = "struct_pack(c := 1000000000::BIGINT, a := '')"


def _row(place: str, initial: str) -> str:
    """Keeping or reroling a row from a place."""
    return _step(place, f"CASE WHEN gone THEN 1000000000 ELSE extra + CASE WHEN ini = '{initial}' THEN 0 ELSE 3 END END",
                 f"CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END")


OP12 = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT """ + _CRC_TABLE + r""" AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, role, text, """ + _crc("key") + r""" % 20 AS code FROM k, crc),
dmg AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN ''
    WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM c, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS ini,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM dmg),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, ini, CASE WHEN tail = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
g AS MATERIALIZED (SELECT conv_id, i, ini, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM f),
w(conv_id, i, p0, p1, p2, p3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := ''), """ + f"{_NEVER}, {_NEVER}, {_NEVER}" + r""" FROM conversations
  UNION ALL
  SELECT conv_id, i, """ + ", ".join([
    _step("p0", "4", "'D'"),
    _least(_step("p1", "4", "'D'"), _step("p0", "CASE WHEN gone OR ini <> 's' THEN 1000000000 ELSE extra END", "'K'")),
    _least(_step("a2", "4", "'D'"), _row("p0", "u"), _row("p1", "u"), _row("a3", "u")),
    _least(_step("a3", "4", "'D'"), _row("a2", "a"))]) + r"""
  FROM (SELECT g.*, p0, p1, """ + _INSERTED + r""" FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1)),
e AS (SELECT conv_id, """ + _least("p0", "a3") + r""" AS best FROM (SELECT conv_id, p0, """ + _INSERTED + r""" FROM w
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
l AS (SELECT conv_id, j, best.a[j] AS letter, len(replace(left(best.a, j), 'I', '')) AS i,
  len(replace(left(best.a, j), 'D', '')) AS nth FROM e, unnest(range(1, len(best.a) + 1)) u(j)),
lines AS (SELECT l.conv_id, j, nth, letter, role, text, ini FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id
  AND f.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
heads AS (SELECT conv_id, bool_or(nth = 1 AND letter = 'K' AND ini = 's') AS system FROM lines GROUP BY conv_id),
fixed AS (SELECT lines.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth % 2 = 1) = system THEN 'assistant'
    ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM lines JOIN heads ON heads.conv_id IS NOT DISTINCT FROM lines.conv_id GROUP BY lines.conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(body) AS text_sha256 FROM d WINDOW w AS (PARTITION BY body)
"""

LLM_ORACLES = {
    "op11_importance": OP11,
    "op12_conversation_repair": OP12,
    "op13_exact_dedup": OP13,
    "op3_suffix_dedup": OP3,
    "op10_near_dup": OP10,
    "op4_url_filter": OP4,
    "op5_decontaminate": OP5,
    "op8_line_dedup": OP8,
    "op9_pii": OP9,
}
