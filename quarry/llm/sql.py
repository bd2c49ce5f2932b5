"""SQL of the corpus operators that DuckDB can run on whole tables."""

from __future__ import annotations

# Words are runs of other characters than these; A-Z count as a-z where texts are compared.
_BLANK = r"'[\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {_BLANK}), lambda t: t <> '')"


#: Sets of shingles, links by their common ones, and the smallest id that links reach.
OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.seen)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node) r USING (doc_id)"""

OP2 = f"""
WITH hashed AS (SELECT doc_id, sha256({_lower("coalesce(text, '')")}) AS text_sha256 FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM hashed JOIN grouped USING (text_sha256)"""

#: Every window of 100 bytes, the first place of those that repeat, and what the others cover.
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT w, min((doc_id, i)) AS place FROM x GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM x JOIN f USING (w) WHERE (doc_id, i) <> place),
run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later),
grp AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run),
cut AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM grp GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM cut),
rest AS (SELECT gap.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS lead, max(b) AS stop, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE concat(lead, substring(h, 2 * stop + 1)) END)) AS kept_sha256 FROM d LEFT JOIN rest USING (doc_id)"""


def _any(texts: tuple[str, ...]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def op8() -> str:
    """Base counts, and the rules of each line by the lists that the operator has."""
    from quarry.llm import quality as Q

    count = lambda x: f"len({_words(x)})"
    sizes = f"list_sum(list_transform({_words('line')}, lambda t: length(t)))"
    marks = lambda chars: "[" + "".join("\\" + c if ord(c) < 128 else c for c in chars).replace("'", "''") + "]"
    closing, terminal = marks(Q.CLOSING), marks(Q.TERMINAL)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) t WHERE times > 1),
cover AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) c GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
bare AS (SELECT doc_id, line, {sizes} AS chars, {count("line")} AS words, {_lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS b FROM lines WHERE {count("line")} > 0),
seen AS (SELECT *, regexp_matches(b, '{terminal}{closing}*$') AS closed, length(regexp_replace(b, '[^|»›→·•<>]', '', 'g')) + 1 AS items FROM bare),
judged AS (SELECT *, (items > 2 AND words <= {Q.MENU_ITEM_WORDS} * items)
  OR (NOT closed AND words <= 6 AND len(list_filter([{_any(Q.MENU_WORDS)}], lambda m: starts_with(b, m))) > 0)
  OR (words <= 40 AND len(list_filter([{_any(Q.BOILERPLATE)}], lambda m: contains(b, m))) > 0)
  OR (NOT closed AND (words < {Q.SHORT_LINE} OR NOT regexp_matches(b, '[.,;:!?]'))) AS fails FROM seen),
per AS (SELECT doc_id, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines,
  CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS lost_chars, count(*) FILTER (fails) AS lost_lines FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars, coalesce(lost_lines, 0) AS lost_lines
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= {Q.MOST_LOST} * word_chars AS kept, lost_chars, lost_lines FROM base"""


OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS ts, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(ts) AS n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(ts[:a], '') AS pre, array_to_string(ts[a + 1:b], '') AS mid, array_to_string(ts[b + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, q, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + v) AS p FROM x),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200"""
