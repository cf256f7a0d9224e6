"""SQL that must give the same rows as the registered queries, with all constants written out."""

from __future__ import annotations

from catalogq.llm import license_scan

GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

_SECRETS = {
    "assign": (
        0,
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (2, r"[0-9a-f]+", 0, 32),
    "private_key": (3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "github": (4, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "slack": (5, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "stripe": (6, r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
    "google": (7, r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    "jwt": (8, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    "login_url": (9, r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0, 1),
}

_HITS = "\nUNION ALL\n".join(
    f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS hits,
  regexp_extract_all(t, '{pattern}', {group}) AS parts, string_split_regex(t, '{pattern}') AS gaps
FROM d WHERE regexp_matches(t, '{pattern}')"""
    for kind, (rank, pattern, group, least) in _SECRETS.items()
)

SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_HITS}),
n AS (SELECT rid, kind, rank, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT rid, kind, rank, length(hits[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM n WHERE length(parts[i]) >= least
),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank)
      FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
),
w AS (
  SELECT *, regexp_extract_all(t, '{WORD}+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], chr(32)) AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, sum(step) AS n_repeat
  FROM (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS step FROM twice)
  GROUP BY rid
),
f AS (
  SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '{GAP}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS capitals,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS stutter,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid
),
measure AS (
  SELECT rid, doc_id, stratum, unnest([
    {{'rule': 1, 'x': n_symbols / greatest(word_chars, 1)}},
    {{'rule': 2, 'x': capitals / greatest(word_chars, 1)}},
    {{'rule': 3, 'x': shouts / greatest(n_words, 1)}},
    {{'rule': 4, 'x': stutter / greatest(n_words, 1)}},
    {{'rule': 5, 'x': n_dup_lines / greatest(n_lines, 1)}},
    {{'rule': 6, 'x': n_repeat_words / greatest(n_words, 1)}}
  ]) AS m FROM f
),
grid AS (
  SELECT rule, generate_subscripts(cuts, 1) AS place, unnest(cuts) AS cut FROM (VALUES
    (1, [0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.06, 0.03]::DOUBLE[]), (2, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2]::DOUBLE[]),
    (3, [2.0, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1]::DOUBLE[]), (4, [0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1]::DOUBLE[]),
    (5, [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]::DOUBLE[]), (6, [0.3, 0.25, 0.2, 0.15, 0.1, 0.05]::DOUBLE[])
  ) AS g(rule, cuts)
),
known AS (
  SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
),
tested AS (
  SELECT stratum, rule, place, cut, count(*) FILTER (good) AS good, count(*) FILTER (good AND m.x >= cut) AS good_hit,
    count(*) FILTER (NOT good) AS bad, count(*) FILTER (NOT good AND m.x >= cut) AS bad_hit
  FROM measure JOIN known USING (doc_id) JOIN grid ON m.rule = grid.rule GROUP BY ALL
),
tail AS (
  SELECT *, CASE WHEN good_hit >= good * (0.05 / 6) THEN 1 ELSE list_sum(list_transform(range(0, good_hit + 1),
      lambda i: exp((lgamma(good + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(good - i + 1))
        + i * ln(0.05 / 6) + (good - i) * ln(1 - 0.05 / 6)))) END
    <= 0.05 / (6 * (SELECT count(DISTINCT stratum) FROM tested WHERE good > 0)) AS ok
  FROM tested WHERE good > 0
),
passed AS (
  SELECT * FROM (SELECT *, min(ok::INT) OVER (PARTITION BY stratum, rule ORDER BY place) AS all_ok FROM tail)
  WHERE all_ok = 1 AND bad_hit > 0
),
best AS (
  SELECT stratum, rule, cut FROM passed
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_hit / bad - good_hit / good DESC, place) = 1
),
beyond AS (
  SELECT DISTINCT rid FROM measure JOIN best ON measure.stratum = best.stratum AND m.rule = best.rule WHERE m.x >= cut
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM beyond) AS kept
FROM judged
"""

HTML_MAIN = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts
  FROM pages
),
b AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(
    x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM a
),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}+') AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(words[i:i + 4], chr(32)) AS k
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.x
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
),
least AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, size, m, unnest(range(1, size - m + 2)) AS i FROM c, (VALUES (2), (3)) AS parts(m) WHERE m < size)
),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score
FROM least LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000
"""

# The templates are fixed values of the operator's module; the rule over them is written out here.
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_TEMPLATES = ",\n  ".join(
    f"({i}, {_QUOTED(t.label)}, {t.exact}, string_split({_QUOTED(' '.join(t.words))}, ' '))"
    for i, t in enumerate(license_scan.templates())
)

LICENSES = rf"""
WITH t(tid, label, exact, w) AS (VALUES
  {_TEMPLATES}
),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
grams AS (
  SELECT tid, exact, k, unnest(range(0, len(w) - k + 1)) AS place, len(w) AS length, w
  FROM (SELECT *, least(4, len(w)) AS k FROM t)
),
votes AS (
  SELECT rid, tid, pos, place, k, exact, length, pos - place AS diagonal
  FROM (
    SELECT rid, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (4)) AS sizes(k) WHERE len(w) >= k)
  ) JOIN (SELECT * EXCLUDE (w), array_to_string(w[place + 1:place + k], ' ') AS gram FROM grams) USING (k, gram)
),
lines AS (
  SELECT rid, tid, diagonal, exact, min(pos) AS first, max(pos + k) AS last FROM votes GROUP BY ALL
),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS part FROM (
    SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER s > 3 OR first - lag(last) OVER s > 12
      OR lag(first) OVER s - last > 12, true) THEN 1 ELSE 0 END AS fresh
    FROM lines WINDOW s AS (PARTITION BY rid, tid ORDER BY diagonal)
  )
),
spans AS (
  SELECT rid, tid, part, min(diagonal) AS start, count(DISTINCT word) / any_value(length) AS cover
  FROM (
    SELECT rid, tid, diagonal, length, unnest(range(place, place + k)) AS word FROM votes
  ) JOIN numbered USING (rid, tid, diagonal) GROUP BY rid, tid, part
),
found AS (
  SELECT rid, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word,
    max(start) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR cover >= 0.8) AS labels, max(cover) AS score
  FROM spans JOIN t USING (tid) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (rid)
"""
