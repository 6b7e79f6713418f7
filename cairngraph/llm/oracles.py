"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from cairngraph.llm.ball_kmeans import DIMS, K, LARGEST, ROUNDS, SCALE
from cairngraph.llm.ball_kmeans import SEED as CLUSTER_SEED
from cairngraph.llm.decontaminate import WINDOW
from cairngraph.llm.quality import COVERAGE_LIMITS, LINE_LIMIT, SYMBOLS
from cairngraph.llm.secret_scan import RULES, dashed
from cairngraph.llm.substring_dedup import WINDOW as LONG_WINDOW
from cairngraph.llm.warc import LEAST_SHARED_BYTES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"


def quality() -> str:
    lengths = ", ".join(f"({k})" for k in COVERAGE_LIMITS)
    leads = ", ".join(f"lead(word, {j}) OVER (PARTITION BY r ORDER BY i)" for j in range(1, max(COVERAGE_LIMITS)))
    symbols = " + ".join(f"(length(t) - length(replace(t, '{chr(c)}', '')))" for c in SYMBOLS)
    chars = ", ".join(f"coalesce(sum(chars) FILTER (k = {k}), 0)::BIGINT AS chars_{k}" for k in COVERAGE_LIMITS)
    over = " OR ".join(f"100 * chars_{k} > {p} * word_chars" for k, p in COVERAGE_LIMITS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_BLANK}') AS ws FROM d),
x AS (SELECT r, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t10 AS (SELECT *, [word, {leads}] AS run FROM x),
g AS (SELECT r, k, i, word, n, run[1:k] AS gram FROM t10, (VALUES {lengths}) AS lengths(k)),
c AS (SELECT *, i + k - 1 <= n AND count(*) FILTER (i + k - 1 <= n) OVER (PARTITION BY r, k, gram) > 1 AS again FROM g),
m AS (
  SELECT r, k, length(word) AS chars, coalesce(bool_or(again) OVER (
    PARTITION BY r, k ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS any_near, i,
    list(again) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS near
  FROM c
),
v AS (SELECT r, k, chars FROM m WHERE any_near AND list_contains(near[greatest(1, len(near) - k + 1):], true)),
s AS (SELECT r, {chars}, count(*) FILTER (k = 5) AS repeat_words FROM v GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '{_BLANK}') GROUP BY r, line),
ls AS (SELECT r, sum(n - 1)::BIGINT AS dup, (sum(n * length(line)) FILTER (n > 1))::BIGINT AS again, sum(n * length(line))::BIGINT AS chars FROM lc GROUP BY r),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda q: length(q))), 0)::BIGINT AS word_chars,
    ({symbols})::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(again, 0)::BIGINT AS dup_line_chars, coalesce(ls.chars, 0) AS line_chars, {", ".join(f"coalesce(chars_{k}, 0)::BIGINT AS chars_{k}" for k in COVERAGE_LIMITS)}
  FROM w LEFT JOIN s USING (r) LEFT JOIN ls USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * dup_line_chars > {LINE_LIMIT} * line_chars OR {over}) AS kept,
  dup_line_chars, {", ".join(f"chars_{k}" for k in COVERAGE_LIMITS)}
FROM f
"""


def decontamination() -> str:
    words = lambda t: f"regexp_extract_all({_LOWER.format(t)}, '{_ALNUM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words("coalesce(text, '')")} AS ws FROM benchmark),
bw AS (
  SELECT item, least(len(ws), {WINDOW}) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), {WINDOW}) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' '))) AS gram
  FROM b WHERE len(ws) > 0
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
  FROM d, ks WHERE len(ws) >= k
),
m AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
""".replace(" COLLATE C", "")


def secrets() -> str:
    parts = []
    closed = [(n, rule) for n, rule in enumerate(RULES) if rule.closes]
    for n, rule in ((n, r) for n, r in enumerate(RULES) if not r.closes):
        p = rule.pattern.replace("'", "''")
        group = f", {rule.group}" if rule.group else ""
        parts.append(
            f"SELECT r, {n} AS o, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}'{group})) AS g,"
            f" unnest(string_split_regex(t, '{p}')[:-2]) AS gap, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i, {rule.least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        )
    pairs = []
    for n, rule in closed:
        p = dashed(rule)
        all_of = lambda g: f"unnest(regexp_extract_all(t, '{p}', {g}))"  # noqa: B023, E731
        pairs.append(
            f"SELECT r, {n} AS o, {str(rule.base).lower()} AS base, '{rule.kind}' AS kind, CASE WHEN closing THEN next_e ELSE e END AS e, e - length(m) + length(more) AS b FROM ("
            f"SELECT *, lead(e) OVER (PARTITION BY r ORDER BY i) AS next_e, lead(length(shut) > 0) OVER (PARTITION BY r ORDER BY i) AS closing FROM ("
            f"SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e FROM (SELECT r, {all_of(0)} AS m, {all_of(1)} AS opens, {all_of(2)} AS more, {all_of(3)} AS shut,"
            f" unnest(string_split_regex(t, '{p}')[:-2]) AS gap, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{p}')))) WHERE length(opens) > 0"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY r, o ORDER BY i))::BIGINT AS e FROM a),
s AS (SELECT r, o, base, kind, e, e - length(m) AS b FROM p WHERE length(g) >= least {"".join(f" UNION ALL {x}" for x in pairs)}),
j AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (base) AS bs, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS sp
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nc, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


def warc() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN last END AS refers_to, true AS intact
FROM (SELECT *, payload_bytes >= {LEAST_SHARED_BYTES} AND n > 1 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS revisit FROM q)
"""


def substrings() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents),
i AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {LONG_WINDOW} + 2)) AS i FROM d),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + {LONG_WINDOW} - 1], ' ') AS gram FROM i),
f AS (SELECT gram, min(doc_id) AS first FROM w GROUP BY gram HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + {LONG_WINDOW})) AS p FROM w JOIN f USING (gram) WHERE first < doc_id) GROUP BY r),
k AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)) AS stay FROM d LEFT JOIN g USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(stay))::BIGINT AS n_removed, sha256(array_to_string(list_transform(stay, lambda p: ws[p]), ' ')) AS kept_sha256
FROM k
"""


def clusters() -> str:
    """Every round compares every vector with every centroid."""
    steps = []
    for n in range(ROUNDS + 1):
        apart = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, q, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT r, vec_id, q, k, {apart} AS d FROM v, c{n}) GROUP BY r, vec_id, q)")
        if n < ROUNDS:
            steps.append(
                f"s{n} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{n}) GROUP BY k, i),"
                f" c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY k) m ON m.k = c.k)"
            )
    joined = "array_to_string(list_transform(c, lambda x: x::VARCHAR), ',')"
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings WHERE len(embedding) = {DIMS}),
v AS MATERIALIZED (
  SELECT r, vec_id, list_transform(v, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM e
  WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x) AND abs({SCALE} * x::DOUBLE) < {LARGEST})) = {DIMS}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT q, sha256('{CLUSTER_SEED}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {K})
),
{", ".join(steps)},
t AS (SELECT k, sum(d)::BIGINT AS t, count(*) AS n FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, a.k::INT AS cluster, d AS distance, t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM t) AS inertia, sha256({joined}) AS centroid_sha256, n AS members
FROM a{ROUNDS} a JOIN t ON t.k = a.k JOIN c{ROUNDS} c ON c.k = a.k
"""


SQL = {"op1_quality": quality(), "op5_decontamination": decontamination(), "op6_secrets": secrets(), "op10_warc": warc(), "op11_substrings": substrings(), "op12_clusters": clusters()}
