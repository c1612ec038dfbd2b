"""SQL of the registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tastelake.llm.decontamination import WINDOW
from tastelake.llm.queries import PROBE, RULES, SUFFIXES
from tastelake.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS l),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
words AS (SELECT doc_id, count(*) AS h FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) AS x GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

OP3 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
s AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, '<', '')) AS size,
  length(role) + length(role) - length(replace(replace(replace(role, chr(92), ''), '<', ''), chr(10), '')) AS role_size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  CAST(8 + sum(size + CASE WHEN before = role THEN 6 ELSE 7 + role_size + CASE WHEN before IS NULL THEN 0 ELSE 8 END END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
         for h, p, v in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))]


def _level(name: str, key: str, parent: str, parent_key: str) -> str:
    return f"""
{name}_m AS (SELECT c.*, p.mean AS m FROM {name} AS c LEFT JOIN {parent} AS p ON c.{parent_key} = p.{parent_key}),
{name}_t AS (SELECT sum(round(n * (good / n - m) * (good / n - m), 9)) AS q, sum(round(m * (1 - m), 9)) AS b,
  sum(round(m * (1 - m) * (n - 1), 9)) AS r FROM {name}_m),
{name}_r AS (SELECT CASE WHEN r > 0 THEN (q - b) / r ELSE 0 END AS rho FROM {name}_t),
{name}_s AS (SELECT CASE WHEN rho <= 1.0::DOUBLE / 1001 THEN 1000 WHEN rho >= 0.5 THEN 1 ELSE 1 / rho - 1 END AS s FROM {name}_r),
{name}_p AS (SELECT x.*, s * m + good AS a, s * (1 - m) + n - good AS b, (s * m + good) / (s + n) AS mean FROM {name}_m AS x, {name}_s)"""


def _bound(a: str, b: str) -> str:
    return f"{a} / ({a} + {b}) + 1.645 * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"


_SUFFIX = " + ".join(["1"] + [f"CASE WHEN labels[-2:] = ['{s.split('.')[0]}', '{s.split('.')[1]}'] THEN 1 ELSE 0 END" for s in SUFFIXES])


def _prior(mean: str, levels: str) -> str:
    """Bound of Beta(s m, s (1 - m)) where 1 / (s + 1) comes from the levels up to the known one."""
    return _bound(f"(({levels}) / (1 - ({levels})) * {mean})", f"(({levels}) / (1 - ({levels})) * (1 - {mean}))")


_LEFT = [f"({name}_s.s / ({name}_s.s + 1))" for name in ("hosts", "domains", "ends")]

OP8 = f"""
WITH p AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT host, string_split(host, '.') AS labels FROM (SELECT DISTINCT host FROM p) AS x),
sized AS (SELECT *, {_SUFFIX} AS k FROM parts),
named AS (SELECT host, array_to_string(labels[-(k + 1):], '.') AS domain, array_to_string(labels[-k:], '.') AS suffix FROM sized),
hosts AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n,
  sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS good
  FROM p JOIN named USING (host) JOIN labels ON p.page_id = labels.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
ends AS (SELECT suffix, 'all' AS whole, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix),
top AS (SELECT 'all' AS whole, (sum(good) + 1) / (sum(n) + 2) AS mean FROM ends),
{_level("ends", "suffix", "top", "whole")},
{_level("domains", "domain", "ends_p", "suffix")},
{_level("hosts", "host", "domains_p", "domain")},
by_host AS (SELECT host, {_bound("a", "b")} AS bound FROM hosts_p),
judged AS (SELECT p.*, coalesce(by_host.bound, {_prior("domains_p.mean", _LEFT[0])}, {_prior("ends_p.mean", " * ".join(_LEFT[:2]))},
  {_prior("top.mean", " * ".join(_LEFT))}) AS bound
  FROM p JOIN named USING (host) LEFT JOIN by_host ON p.host = by_host.host LEFT JOIN domains_p ON named.domain = domains_p.domain
  LEFT JOIN ends_p ON named.suffix = ends_p.suffix, top, hosts_s, domains_s, ends_s)
SELECT page_id, url, host, path, CASE {" ".join(f"WHEN {fits} THEN '{text}'" for fits, text, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {fits} THEN '{verdict}'" for fits, _, verdict in _FITS)} WHEN round(bound, 9) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

#: the least size of a repeated run, stated on its own (characters)
_RUN = 50

OP9 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
li AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
nb AS (SELECT doc_id, i, l[i] AS line, length(trim(l[i])) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM li WHERE trim(l[i]) <> ''),
sums AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM nb),
ends AS (SELECT doc_id, k,
  min(k) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN greatest({_RUN} - n, 0) FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
  max(k) OVER (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN UNBOUNDED PRECEDING AND greatest({_RUN} - n, 0) PRECEDING) AS behind FROM sums),
win AS (SELECT doc_id, k AS x, ahead AS y FROM ends WHERE ahead IS NOT NULL UNION SELECT doc_id, behind, k FROM ends WHERE behind IS NOT NULL),
whole AS (SELECT doc_id, list(line ORDER BY k) AS lines, list(i ORDER BY k) AS row_of FROM nb GROUP BY doc_id),
seen AS (SELECT win.doc_id, x, y, row_of, row_number() OVER (PARTITION BY array_to_string(lines[x:y], chr(10)) ORDER BY win.doc_id, x) AS turn
  FROM win JOIN whole ON win.doc_id = whole.doc_id),
marked AS (SELECT DISTINCT doc_id, row_of, unnest(range(x, y + 1)) AS k FROM seen WHERE turn > 1),
ahead AS (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nk FROM marked),
gone AS (SELECT doc_id, unnest(range(row_of[k], CASE WHEN nk = k + 1 THEN row_of[k + 1] ELSE row_of[k] + 1 END)) AS i FROM ahead),
runs AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
per AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN before = i - 1 THEN 0 ELSE 1 END) AS r FROM runs GROUP BY doc_id),
kept AS (SELECT li.doc_id, string_agg(l[li.i], chr(10) ORDER BY li.i) AS text FROM li LEFT JOIN gone ON li.doc_id = gone.doc_id AND li.i = gone.i
  WHERE gone.i IS NULL GROUP BY li.doc_id)
SELECT d.doc_id, len(l) AS n_lines, coalesce(n, 0) AS n_deleted, CAST(coalesce(r, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def _assigned(name: str, books: str) -> str:
    """Nearest entry of every part: the squared distance, then the index decides."""
    return f"""
{name} AS (SELECT vec_id, label, p, arg_min(e, far * {ENTRIES} + e) AS e, min(far) AS far, any_value(y) AS y
  FROM (SELECT parts.*, b.e, list_sum(list_transform(range(1, len(b.y) + 1), lambda i: (parts.y[i] - b.y[i]) * (parts.y[i] - b.y[i]))) AS far
    FROM parts JOIN {books} AS b ON parts.p = b.p) AS x GROUP BY vec_id, label, p),"""


def _replaced(name: str, assigned: str, books: str) -> str:
    """The floored mean of the parts of each entry."""
    return f"""
{name}m AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, CAST(floor(sum(v)::DECIMAL(38, 0) / count(*)) AS BIGINT) AS m
  FROM (SELECT p, e, unnest(y) AS v, unnest(range(len(y))) AS i FROM {assigned}) AS x GROUP BY p, e, i) AS z GROUP BY p, e),
{name} AS (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM {books} AS b LEFT JOIN {name}m AS m ON b.p = m.p AND b.e = m.e),"""


OP11 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
parts AS (SELECT vec_id, label, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS y FROM v, (SELECT unnest(range({PARTS})) AS p) AS q),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, y) - 1 AS e, y FROM parts QUALIFY e < {ENTRIES}),
{"".join(_assigned(f"a{r}", f"b{r}") + _replaced(f"b{r + 1}", f"a{r}", f"b{r}") for r in range(ROUNDS))}
{_assigned("done", f"b{ROUNDS}")}
codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM done GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM codes"""


def sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op3_chat_formatting": OP3, "op8_url_filter": OP8, "op9_line_dedup": OP9, "op11_vector_codes": OP11}
