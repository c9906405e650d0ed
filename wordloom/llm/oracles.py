"""DuckDB SQL for the secret scan and the quality rules."""

from __future__ import annotations

from wordloom.llm import rules, secret_scan


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan_sql(documents: str = "documents") -> str:
    """Spans by the gaps that a split leaves, scores by the trained table.

    Stretches of a run are a fold over its pairs of characters, in plain terms:
    sums since the last reset, their best and its place, and what was told.
    """
    pats = (secret_scan.ASSIGN, secret_scan.ACCESS_LONG, secret_scan.HEX_LONG)
    cut = lambda k, p, v: f"regexp_extract_all(t, {_quoted(p)}, 0) AS m{k}, regexp_extract_all(t, {_quoted(p)}, {v}) AS v{k}, regexp_split_to_array(t, {_quoted(p)}) AS s{k}"
    found = ", ".join(cut(k, p, 2 if k == 0 else 0) for k, p in enumerate(pats))
    start = "coalesce(list_sum(list_transform(s{k}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)"
    item = lambda k: f"list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': CAST({start.format(k=k)} AS BIGINT), 'k': {k}, 'n': length(m{k}[i]), 'v': v{k}[i]}}) AS a{k}"
    table = "[" + ", ".join(map(str, secret_scan.train(secret_scan.default_samples()))) + "]"
    width, each, least = len(secret_scan.ALPHABET), int(secret_scan.LEAST_EACH * secret_scan.SCALE), int(secret_scan.LEAST_NATS * secret_scan.SCALE)
    names = "[" + ", ".join(map(_quoted, secret_scan.KINDS)) + "]"
    joined = f"array_to_string(list_transform(list_sort({{}}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    bare = "list_transform({}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + x.n}})"
    told = f"CASE WHEN a.best + {each} * (a.upto - a.since) >= {least} THEN list_append(a.told, {{'f': a.since, 'g': a.upto}}) ELSE a.told END"
    kept = "{{'x': 0::BIGINT, 'i': {i}, 's': {s}, 'since': {since}, 'best': {best}, 'upto': {upto}, 'told': {told}}}"
    reset = kept.format(i="a.i + 1", s="0::BIGINT", since="a.i + 1", best="0::BIGINT", upto="a.i + 1", told=told)
    more = kept.format(i="a.i + 1", s=f"a.s + b.x - {each}", since="a.since", best=f"greatest(a.best, a.s + b.x - {each})", upto=f"CASE WHEN a.s + b.x - {each} > a.best THEN a.i + 2 ELSE a.upto END", told="a.told")
    fold = f"list_reduce(list_transform(c, lambda x: {kept.format(i='0::BIGINT', s='0::BIGINT', since='0::BIGINT', best='0::BIGINT', upto='0::BIGINT', told='[]::STRUCT(f BIGINT, g BIGINT)[]').replace('0::BIGINT', 'x', 1)}), lambda a, b: CASE WHEN a.s + b.x - {each} <= 0 OR a.best - (a.s + b.x - {each}) >= {least} THEN {reset} ELSE {more} END, {kept.format(i='0::BIGINT', s='0::BIGINT', since='0::BIGINT', best='0::BIGINT', upto='0::BIGINT', told='[]::STRUCT(f BIGINT, g BIGINT)[]')})"
    return f"""
WITH f AS (SELECT doc_id, t, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM {documents})),
g AS (SELECT doc_id, t, {", ".join(map(item, range(3)))} FROM f),
h AS (SELECT row_number() OVER () AS rid, doc_id, t, {bare.format(f"list_concat(list_concat(list_filter(a0, lambda x: length(x.v) >= {secret_scan.ASSIGN_LEAST}), a1), a2)")} AS fixed FROM g),
i AS (SELECT rid, doc_id, fixed, CASE WHEN len(fixed) = 0 THEN t ELSE array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN len(list_filter(fixed, lambda x: x.s < i AND i <= x.e)) > 0 THEN ' ' ELSE c END), '') END AS t FROM h),
j AS (SELECT rid, doc_id, fixed, {cut(3, secret_scan.RUN, 0)} FROM i),
k AS (SELECT rid, r.s AS pos, r.v AS v, list_transform(string_split(r.v, ''), lambda c: instr({_quoted(secret_scan.ALPHABET)}, c)) AS q, {table} AS tab FROM (SELECT rid, unnest(a3) AS r FROM (SELECT rid, {item(3)} FROM j))),
l AS (SELECT rid, pos, v, list_transform(range(1, len(q)), lambda i: CAST(tab[(q[i] - 1) * {width} + q[i + 1]] AS BIGINT)) AS c FROM k),
m AS (SELECT rid, pos, v, {fold} AS a, list_sum(c) >= greatest({least}, length(v) * {each}) AS whole FROM l),
n AS (SELECT rid, pos, v, whole, unnest(CASE WHEN whole THEN [{{'f': 0::BIGINT, 'g': length(v)}}] ELSE {told} END) AS p FROM m),
o AS (SELECT DISTINCT rid, pos, CASE WHEN whole THEN 0 ELSE p.f - length(regexp_extract(reverse(substr(v, 1, p.f)), '^[A-Za-z0-9+]*')) END AS f, CASE WHEN whole THEN p.g ELSE p.g + length(regexp_extract(substr(v, p.g + 1), '^[A-Za-z0-9+]*')) END AS g FROM n),
r AS (SELECT rid, list({{'s': pos + f, 'k': 3, 'e': pos + g}}) AS rand FROM o WHERE g - f >= {secret_scan.LEAST_RUN} GROUP BY rid)
SELECT doc_id, CAST(len(list_filter(fixed, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(fixed, lambda x: x.k = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(fixed, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256({joined.format('fixed')}) AS base_sha256,
  {joined.format('list_concat(fixed, coalesce(rand, []))')} AS spans
FROM j LEFT JOIN r USING (rid)"""


def quality_rules_sql(alpha: float = rules.ALPHA, delta: float = rules.DELTA) -> str:
    """Measures, certified steps and verdicts."""
    gone = "length(x) - length(regexp_replace(x, '{}', '', 'g'))"
    share = lambda r: f"CASE WHEN {rules.RULES[r][1]} > 0 THEN {rules.RULES[r][0]} / {rules.RULES[r][1]} ELSE 0.0 END"
    path = ", ".join(f"({g}, " + ", ".join(f"CAST({rules.PATH[r][g]} AS DOUBLE)" for r in rules.RULES) + ")" for g in range(rules.STEPS))
    over = " OR ".join(f"{share(r)} > c_{r}" for r in rules.RULES)
    failed = ", ".join(f"CASE WHEN {share(r)} > c_{r} THEN {_quoted(r)} END" for r in rules.RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents)),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, x, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({gone.format('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
  {gone.format('[A-Z]')} AS n_capitals, {gone.format('!')} AS n_exclaims, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
path(g, {", ".join("c_" + r for r in rules.RULES)}) AS (VALUES {path}),
good AS (SELECT DISTINCT ON (lang, x) * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
strata AS (SELECT lang, count(*) >= {rules.LEAST_GOOD} AS own FROM good GROUP BY lang),
tried AS (SELECT s.own, CASE WHEN s.own THEN s.lang END AS stratum, g, count(*) AS n, count(*) FILTER (WHERE {over}) AS k
  FROM good d JOIN strata s ON s.lang IS NOT DISTINCT FROM d.lang, path GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k > n * {alpha!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) END AS tail FROM tried),
steps AS (SELECT own, stratum, max(g) FILTER (WHERE tail <= {delta!r} / (SELECT count(*) FROM (SELECT DISTINCT own, stratum FROM tried))) AS step FROM tails GROUP BY ALL),
judged AS (SELECT v.*, coalesce(s.own, false) AS has_own, s.step AS own_step FROM v LEFT JOIN (SELECT * FROM steps WHERE own) s ON s.stratum IS NOT DISTINCT FROM v.lang),
cut AS (SELECT j.*, path.* FROM judged j LEFT JOIN path ON path.g = CASE WHEN has_own THEN own_step ELSE (SELECT step FROM steps WHERE NOT own) END),
told AS (SELECT *, concat_ws(',', {failed}) AS failed_rules FROM cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM told"""
