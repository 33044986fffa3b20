"""SQL twins of the training-data queries, for those that SQL can express.

The others have fitted models, searches or links that need brute force over all pairs; their
tests compare them with it on small tables.
"""

from __future__ import annotations

from runtally.llm import licenses
from runtally.llm.secrets import RULES, Rule


def _spans(rule: Rule, rank: int) -> str:
    """Spans of one rule: the stretches before a match and the matches before it add up."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {str(rule.base).lower()} AS base,
         unnest([{{
           'at': CAST(list_sum([length(x) for x in p[1:i]]) AS BIGINT)
                 + coalesce(CAST(list_sum([length(x) for x in m[1:i - 1]]) AS BIGINT), 0),
           'size': length(m[i]), 'part': length(g[i])}} for i in range(1, len(m) + 1)]) AS s, {rule.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
               string_split_regex(t, '{pattern}') AS p FROM docs)"""


_JOINED = "string_agg(kind || ':' || s.at || ':' || (s.at + s.size), ',' ORDER BY s.at, rank)"

#: CRC-32 of the decimal conv_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END))"""

#: Every prefix with its members; a subtree is found by comparing the prefixes themselves.
_TRIE = f"""WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT c, turns, {_CRC} % 6 AS h FROM own),
built AS (
  SELECT s.c, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
  FROM sized s LEFT JOIN own b ON b.c = s.c - s.c % 100),
prefixes AS (SELECT c, len(turns) AS n, d, turns[1:d] AS p FROM built, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
nodes AS MATERIALIZED (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(p[1:d - 1]) AS parent,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT parent AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY parent),
counted AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN children USING (p)),
below AS (
  SELECT y.p[1:a.d] AS p, sum(CASE WHEN y.k = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum(CASE WHEN y.d = 0 THEN 0 ELSE (y.n_convs - 1) * length(y.p[y.d].t) END) AS saved
  FROM counted y, LATERAL (SELECT unnest(range(0, y.d + 1)) AS d) a GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, CASE WHEN n.d > 0 THEN m.conv_id END AS parent_conv_id, n.n_convs,
       CAST(n.k AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       n.ends_sha256
FROM counted n JOIN below b USING (p) LEFT JOIN nodes m ON m.p = n.parent AND m.d = n.d - 1"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _licenses() -> str:
    """Every block compared with every template, without filters."""
    templates = ", ".join(
        f"('{t.label}', {licenses.width_of(t)}, {licenses.need_of(len(words), 0.9)}, {_quoted(words)})"
        for t in licenses.TEMPLATES
        for words in [licenses.template_words(t.text)]
    )
    places = " UNION ALL ".join(
        f"SELECT row_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase))
        + ")) - 1 AS place FROM docs"
        for phrase, label in licenses.PHRASES
    )
    return f"""WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
templates(label, width, need, words) AS (VALUES {templates}),
widths AS (SELECT DISTINCT width FROM templates),
blocks AS (
  SELECT row_id, width, list_distinct(w[b + 1:b + 2 * width]) AS held
  FROM (SELECT row_id, width, w, unnest(range(0, len(w), width)) AS b FROM docs, widths)),
matched AS (
  SELECT row_id, label, len(list_intersect(held, words)) / len(words) AS share
  FROM blocks JOIN templates USING (width) WHERE len(list_intersect(held, words)) >= need),
places AS ({places}),
phrases AS (
  SELECT row_id, count(*) AS n, min(place) AS first, max(place) AS last, list(DISTINCT label) AS labels FROM places GROUP BY row_id),
found AS (SELECT row_id, count(*) AS n, max(share) AS score, list(DISTINCT label) AS labels FROM matched GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_base, CAST(p.first AS BIGINT) AS first_word,
       CAST(p.last AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(p.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(f.labels, [])))), ','), '')
         AS labels, CAST(coalesce(f.score, 0) AS DOUBLE) AS score, coalesce(f.n, 0) AS n_blocks
FROM docs d LEFT JOIN phrases p USING (row_id) LEFT JOIN found f USING (row_id)"""


def _centroids(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Lloyd's rounds, each vector compared with each centroid."""
    gap = "list_sum(list_transform(list_zip(v.g, c.g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT row_id, min({{'d': CAST({gap} AS BIGINT), 'c': c.c}}) AS best FROM v, c{i} c GROUP BY row_id)"
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.g, c{i}.g) AS g FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS g
    FROM (SELECT a.best.c AS c, j, sum(v.g[j]) AS s, count(*) AS n
          FROM a{i} a JOIN v USING (row_id), range(1, {width + 1}) r(j) GROUP BY 1, 2)
    GROUP BY c) m ON m.c = c{i}.c)"""
            )
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS g
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), g) - 1 AS c, g
  FROM v ORDER BY sha256('3:' || vec_id), g LIMIT {k}),
{", ".join(steps)}
SELECT v.vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(e.g, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row_id) JOIN c{rounds} e ON e.c = best.c"""


ORACLES: dict[str, str] = {
    "op5_secrets": f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_spans(rule, rank) for rank, rule in enumerate(RULES))}),
kept AS (SELECT * FROM found WHERE s.part >= least),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {_JOINED} FILTER (base) AS base_spans, {_JOINED} AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per_doc USING (doc_id)""",
    "op11_trie": _TRIE,
    "op12_licenses": _licenses(),
    "op13_centroids": _centroids(),
}
