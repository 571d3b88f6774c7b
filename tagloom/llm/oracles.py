"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tagloom.llm.linededup import PRIME
from tagloom.llm.secrets import PARTS

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
        SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM again)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS gone, count(*) AS spans
    FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS i, len(s) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
g AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT % {PRIME} AS g FROM l),
c AS (SELECT *, ((g + coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31) % {PRIME}) % 3 = 0 OR i = n - 1 AS cut FROM g),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ix FROM c),
h AS (SELECT doc_id, ix, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, ix),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, t ORDER BY doc_id, ix) > 1 AS gone FROM h)
SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS n_removed_lines, count(*) FILTER (gone) AS n_removed_chunks,
    sha256(coalesce(string_agg(t, chr(10) ORDER BY ix) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


def _secrets(scope: int = 256) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = {name: k for k, (name, *_) in enumerate(PARTS)}
    inside = lambda *names: f"rank IN ({', '.join(str(kinds[n]) for n in names)})"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, unnest(range(len(m))) AS i, m, p, t, {least} AS least FROM (SELECT doc_id, regexp_extract_all(text, {quote(rule)}) AS m, "
        f"regexp_extract_all(text, {quote(rule)}, {group}) AS t, string_split_regex(text, {quote(rule)}) AS p FROM docs)"
        for k, (_, rule, least, group) in enumerate(PARTS)
    )
    names = "[" + ", ".join(quote(n) for n in kinds) + "]"
    joined = lambda what: f"coalesce(string_agg(said, ',' ORDER BY s, rank) FILTER ({what}), '')"
    strong = inside("assign", "access", "hex")
    linked = "((" + inside("identifier") + " AND secrets) OR (" + inside("token") + " AND ids) OR (" + inside("endpoint") + " AND ids AND secrets))"
    near = f"OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT doc_id, rank, i, length(m[i + 1]) AS n, least, t[i + 1] AS t, sum(length(p[i + 1]) + length(m[i + 1])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM found),
spans AS (SELECT doc_id, rank, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed WHERE length(t) >= least AND (rank <> {kinds['token']} OR regexp_matches(t, '[0-9]'))),
free AS (SELECT doc_id, rank, s, e FROM (SELECT *,
        coalesce(max(CASE WHEN {strong} THEN e END) OVER (PARTITION BY doc_id ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) > s
        OR coalesce(min(CASE WHEN {strong} THEN s END) OVER (PARTITION BY doc_id ORDER BY s, rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4611686018427387904) < e AS covered
    FROM spans) WHERE {strong} OR NOT covered),
near AS (SELECT *, ({names})[rank + 1] || ':' || s || ':' || e AS said,
    sum(({inside('access', 'identifier')})::INT) {near} > 0 AS ids, sum(({inside('assign', 'hex', 'token')})::INT) {near} > 0 AS secrets FROM free),
done AS (SELECT doc_id, {', '.join(f'count(*) FILTER ({inside(n)}) AS n_{n}' for n in ('assign', 'access', 'hex'))}, {joined(strong)} AS base, {joined(f'{strong} OR {linked}')} AS spans, count(*) FILTER ({linked}) AS n_linked FROM near GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in ('assign', 'access', 'hex'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN done USING (doc_id)
"""


SECRETS = _secrets()
