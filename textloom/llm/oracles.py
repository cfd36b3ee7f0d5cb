"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .toxicity import EXCEPTIONS, FLOOR_CHARS, GAIN, LEAST_DOCS, LEXICON, LONGEST, NATS, SHORTEST, THRESHOLD

_ALIKE = {
    "a": "аα@４ɑ4æ", "b": "вьЬ８β8", "c": "сϲ¢", "d": "ԁđ", "e": "еєε€3", "f": "ƒ", "g": "ɡ", "h": "һнħ", "i": "іιїӏ1l|¡１ıł", "j": "ј", "k": "кκ", "m": "м",
    "n": "ոпη", "o": "оοօ0０σøœ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ$５5ß", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝωш", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
#: Lower case, no marks, look-alikes and digits as letters, one space between words, runs of three or more as one letter.
_RUNS = [chr(c) for c in range(0x61, 0x7B) if chr(c) != "l"]


def _folded(column: str) -> str:
    a, b = "".join(_ALIKE.values()), "".join(k * len(v) for k, v in _ALIKE.items())
    out = f"regexp_replace(translate(strip_accents(lower(regexp_replace({column}, '[\\p{{M}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]', '', 'g'))), '{a}', '{b}'), '[^a-z0-9]+', ' ', 'g')"
    for c in _RUNS:
        out = f"regexp_replace({out}, '{c}{{3,}}', '{c}', 'g')"
    return f"trim({out})"


def _toxicity() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hand = ", ".join(f"({quoted(lang)}, {quoted(term)}, {weight})" for (lang, term), weight in LEXICON.items())
    phrases = ", ".join(f"({quoted(x)})" for x in EXCEPTIONS)
    singles = "folded"
    for c in _RUNS:
        singles = f"replace({singles}, '{c}{c}', '{c}')"
    levels, above = [], ""
    for k in range(LONGEST, SHORTEST - 1, -1):
        own = f"SELECT lang, p, gain FROM gains WHERE length(p) = {k}"
        rest = f"SELECT lang, substr(p, 1, {k}) AS p, sum(v) AS rest FROM {above} GROUP BY ALL" if above else "SELECT lang, p, 0.0 AS rest FROM gains WHERE false"
        above = f"best{k}"
        levels.append(f"{above} AS (SELECT lang, p, coalesce(gain, 0) > coalesce(rest, 0) + 1e-6 AS own, greatest(coalesce(gain, 0), coalesce(rest, 0)) AS v FROM ({own}) FULL JOIN ({rest}) USING (lang, p))")
    every = " UNION ALL ".join(f"SELECT lang, p FROM best{k} WHERE own" for k in range(SHORTEST, LONGEST + 1))
    return f"""
WITH folded AS (SELECT doc_id, coalesce(lang, '') AS lang, length(text) AS n, {_folded("text")} AS f FROM documents WHERE text IS NOT NULL),
listed AS (SELECT doc_id, lang, n, f, string_split(f, ' ') AS words FROM folded WHERE f <> ''),
unnested AS (SELECT doc_id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
words AS (SELECT doc_id, lang, w, CAST(1 + coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM unnested),
marks AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
marked AS (SELECT doc_id, lang, toxic, w FROM words JOIN marks USING (doc_id)),
longest AS (SELECT doc_id, lang, toxic, arg_min(w, (-length(w), w)) AS family FROM marked GROUP BY ALL),
firsts AS (SELECT min(doc_id) AS doc_id FROM longest GROUP BY lang, toxic, family),
counts AS (SELECT lang, w, sum(toxic) AS t, sum(1 - toxic) AS c FROM (SELECT DISTINCT m.* FROM marked m JOIN firsts USING (doc_id)) GROUP BY ALL),
totals AS (SELECT lang, sum(t) AS nt, sum(c) AS nc FROM counts GROUP BY 1 HAVING sum(t) > 0 AND sum(c) > 0),
begun AS (SELECT lang, unnest([substr(w || ' ', 1, k) FOR k IN range({SHORTEST}, least({LONGEST}, length(w) + 1) + 1)]) AS p, t, c FROM counts),
rates AS (SELECT lang, p, sum(t) AS t, any_value(nt) AS nt, sum(t) / any_value(nt) AS rt, (sum(c) + 1) / any_value(nc) AS rc FROM begun JOIN totals USING (lang) GROUP BY lang, p HAVING sum(t) >= {LEAST_DOCS}),
gains AS (SELECT lang, p, ln(rt / rc) / {NATS} AS weight, round(t * ln(rt / rc) - nt * (rt - rc) - {GAIN}, 6) AS gain FROM rates WHERE rt > rc AND t * ln(rt / rc) - nt * (rt - rc) - {GAIN} > 0),
{", ".join(levels)},
owned AS ({every}),
learnt AS (SELECT lang, p, weight FROM owned o JOIN gains USING (lang, p) WHERE NOT EXISTS (SELECT 1 FROM owned x WHERE x.lang = o.lang AND length(x.p) < length(o.p) AND starts_with(o.p, x.p))),
given AS (SELECT lang, {_folded("term")} AS folded, weight FROM (VALUES {hand}) v(lang, term, weight)),
forms AS (SELECT lang, weight, folded AS form FROM given UNION SELECT lang, weight, {singles} FROM given),
terms AS (
  SELECT lang, weight, form FROM forms UNION SELECT lang, weight, array_to_string(string_split(form, ''), ' ') FROM forms WHERE length(form) > 3 AND NOT contains(form, ' ')
),
padded AS (SELECT doc_id, f || ' ' AS f FROM listed),
hits AS (
  SELECT w.doc_id, pos, pos + length(form) AS stop, weight FROM words w JOIN terms t ON w.w = string_split(form, ' ')[1] AND (t.lang = '' OR t.lang = w.lang) JOIN padded USING (doc_id) WHERE substr(f, pos, length(form) + 1) = form || ' '
  UNION ALL SELECT doc_id, pos, pos + length(w), weight FROM words w JOIN learnt l ON l.lang = w.lang AND starts_with(w.w || ' ', l.p)
),
best AS (SELECT doc_id, pos, arg_max(stop, (weight, stop)) AS stop, max(weight) AS weight FROM hits GROUP BY ALL),
phrases AS (SELECT {_folded("x")} AS phrase FROM (VALUES {phrases}) v(x)),
safe AS (SELECT w.doc_id, pos, pos + length(phrase) AS stop FROM words w JOIN phrases ON w.w = string_split(phrase, ' ')[1] JOIN padded USING (doc_id) WHERE substr(f, pos, length(phrase) + 1) = phrase || ' '),
counted AS (SELECT doc_id, weight FROM best b WHERE NOT EXISTS (SELECT 1 FROM safe s WHERE s.doc_id = b.doc_id AND s.pos <= b.pos AND b.stop <= s.stop)),
scored AS (SELECT doc_id, 1000.0 * sum(weight) / greatest(any_value(n), {FLOOR_CHARS}) AS score, count(*) AS hits FROM counted JOIN folded USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, CAST(hits AS BIGINT) AS hits FROM scored WHERE score >= {THRESHOLD}"""


EXACT = """
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL)
SELECT doc_id, first_id, copies, doc_id <> first_id AS is_copy FROM g WHERE copies > 1"""


ARC = r"""
WITH a AS (
  SELECT page_id, CAST(coalesce(page_id, 0) AS BIGINT) AS number, CAST(coalesce(page_id, 0) // 256 AS BIGINT) AS an, coalesce(html, '') AS body,
    regexp_replace(coalesce(nullif(url, ''), 'unknown:'), '[ \t\r\n\x0B\f]', '%20', 'g') AS url FROM pages
), b AS (
  SELECT *, 'crawl-' || lpad(CAST(an AS VARCHAR), 8, '0') || '.arc' AS archive, strftime(make_timestamp((978307200 + number % 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body AS block FROM a
), c AS (SELECT *, sha256(block) AS digest, sha256(body) AS payload, chr(13) || chr(10) AS nl FROM b),
d AS (SELECT *, sha256(archive || chr(10) || number || chr(10) || url || chr(10) || date || chr(10) || digest) AS h FROM c),
e AS (SELECT *, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS record_id FROM d)
SELECT page_id, archive, number, CAST(an % 2 + 1 AS INT) AS version, 'response' AS warc_type, record_id, url AS target_uri, date AS warc_date, '192.0.2.1' AS ip,
  'application/http; msgtype=response' AS content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || digest AS block_digest, 'sha256:' || payload AS payload_digest, 'text/html' AS payload_type,
  false AS truncated,
  'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <' || record_id || '>' || nl || 'WARC-Date: ' || date || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-IP-Address: 192.0.2.1' || nl
  || 'WARC-Payload-Digest: sha256:' || payload || nl || 'WARC-Identified-Payload-Type: text/html' || nl || 'WARC-Block-Digest: sha256:' || digest || nl || 'Content-Type: application/http; msgtype=response' || nl
  || 'Content-Length: ' || strlen(block) || nl || nl || block || nl || nl AS record
FROM e"""

MERKLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT doc_id, i, length(line) AS n, regexp_matches(line, '^[ \t\r\f\v]*$') AS blank, substr(sha256('p' || line), 1, 32) AS leaf FROM lines
), cut AS (
  SELECT *, coalesce(sum(CASE WHEN blank OR leaf LIKE '0%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM hashed
), para AS (
  SELECT doc_id, n, leaf, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS s FROM cut WHERE NOT blank
), sect AS (SELECT doc_id, s, substr(sha256('s' || string_agg(leaf, '' ORDER BY k)), 1, 32) AS hash FROM para GROUP BY doc_id, s),
longest AS (SELECT doc_id, leaf FROM (SELECT doc_id, leaf, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, leaf) AS r FROM para) WHERE r = 1),
docs AS (
  SELECT d.doc_id, d.text IS NULL AS missing, substr(sha256('r' || coalesce(x.all_hashes, '')), 1, 32) AS root, coalesce(x.n, 0) AS n_sections, coalesce(y.n, 0) AS n_paragraphs, coalesce(l.leaf, '') AS leaf
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg(hash, '' ORDER BY s) AS all_hashes, count(*) AS n FROM sect GROUP BY 1) x USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM para GROUP BY 1) y USING (doc_id) LEFT JOIN longest l USING (doc_id)
), based AS (
  SELECT a.*, b.base_id, c.root AS base_root FROM docs a LEFT JOIN (SELECT leaf, min(doc_id) AS base_id FROM docs WHERE NOT missing GROUP BY 1) b ON a.leaf = b.leaf AND NOT a.missing LEFT JOIN docs c ON c.doc_id = b.base_id
), differ AS (SELECT doc_id, base_id FROM based WHERE root <> base_root AND NOT missing),
own AS (
  SELECT d.doc_id, d.base_id, t.s FROM differ d JOIN sect t ON t.doc_id = d.doc_id WHERE NOT EXISTS (SELECT 1 FROM sect o WHERE o.doc_id = d.base_id AND o.hash = t.hash)
), theirs AS (
  SELECT d.doc_id, d.base_id, t.s FROM differ d JOIN sect t ON t.doc_id = d.base_id WHERE NOT EXISTS (SELECT 1 FROM sect o WHERE o.doc_id = d.doc_id AND o.hash = t.hash)
), changed AS (
  SELECT o.doc_id, p.k FROM own o JOIN para p ON p.doc_id = o.doc_id AND p.s = o.s WHERE NOT EXISTS (SELECT 1 FROM para q WHERE q.doc_id = o.base_id AND q.leaf = p.leaf)
), removed AS (
  SELECT o.doc_id, p.k FROM theirs o JOIN para p ON p.doc_id = o.base_id AND p.s = o.s WHERE NOT EXISTS (SELECT 1 FROM para q WHERE q.doc_id = o.doc_id AND q.leaf = p.leaf)
)
SELECT b.doc_id, CASE WHEN missing THEN NULL ELSE b.root END AS root, CASE WHEN missing THEN NULL ELSE CAST(n_sections AS INT) END AS n_sections, CASE WHEN missing THEN NULL ELSE CAST(n_paragraphs AS INT) END AS n_paragraphs,
  b.base_id, CASE WHEN missing THEN NULL ELSE b.root = base_root END AS equal,
  CASE WHEN missing THEN NULL ELSE coalesce(x.v, '') END AS changed_sections, CASE WHEN missing THEN NULL ELSE coalesce(y.v, '') END AS changed_paragraphs, CASE WHEN missing THEN NULL ELSE coalesce(z.v, '') END AS removed_paragraphs
FROM based b LEFT JOIN (SELECT doc_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS v FROM own GROUP BY 1) x USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS v FROM changed GROUP BY 1) y USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS v FROM removed GROUP BY 1) z USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_toxicity": _toxicity(), "op4_exact_dedup": EXACT, "op8_arc_to_warc": ARC, "op10_merkle": MERKLE}
