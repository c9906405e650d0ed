"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from wordloom.config import Knobs, fuzzy_limit, multi_term_prefix_limit
from wordloom.plans.queries import PART_SEARCHES, PROBE, SEARCHES

WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokens(text: str) -> str:
    """The token list of a text expression."""
    return (
        f"list_filter(list_transform(regexp_split_to_array({text}, '{WHITE}'), "
        r"lambda w: lower(regexp_replace(w, '[^\p{L}\p{M}\p{Nd}]', '', 'g'))), lambda w: w <> '' AND w NOT IN ('a', 'the', 'and'))"
    )


def postings(table: str, key: str, fields: dict[str, int]) -> str:
    """CTEs tok, post and vocab of a table."""
    lists = ", ".join(f"{tokens(f)} AS t{i}" for i, f in enumerate(fields))
    total = " + ".join(f"len(t{i}) * {w}" for i, w in enumerate(fields.values()))
    union = " UNION ALL ".join(f"SELECT id, unnest(t{i}) AS term, greatest(1, ({100000 * w}) // total) AS s FROM tot" for i, w in enumerate(fields.values()))
    return f"""tok AS (SELECT CAST({key} AS VARCHAR) AS id, {lists} FROM {table}),
tot AS (SELECT *, {total} AS total FROM tok WHERE {total} > 0),
post AS (SELECT id, term, CAST(sum(s) AS BIGINT) AS score FROM ({union}) GROUP BY id, term),
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


DOCS = postings("documents", "doc_id", {"text": 1})
PARTS = postings("part", "p_partkey", {"p_name": 3, "p_type": 1, "p_brand": 1})
# The tokens of a conversation are those of all its turns.
TALKS = postings("(SELECT conv_id, string_agg(text, ' ') AS text FROM conversations GROUP BY conv_id)", "conv_id", {"text": 1})
DELETES = "SELECT term, df, unnest(list_distinct(list_append(list_transform(range(1, length(term) + 1), lambda i: term[1:i-1] || term[i+1:length(term)]), term))) AS key FROM vocab WHERE length(term) >= 4"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _exact(group: int, t: str) -> str:
    return f"SELECT {group} AS g, 0 AS r, term, {Knobs.exact_match_boost} AS boost FROM vocab WHERE term = {_quoted(t)}"


def _prefix(group: int, t: str, cap: int) -> str:
    return f"SELECT {group}, row_number() OVER (ORDER BY df DESC, term) AS r, term, 1 FROM vocab WHERE starts_with(term, {_quoted(t)}) AND term <> {_quoted(t)} QUALIFY r <= {cap}"


def _fuzzy_rows(t: str) -> str:
    keys = [t] + ([t[:i] + t[i + 1 :] for i in range(len(t))] if len(t) > 1 else [])
    values = ", ".join(f"({i}, {_quoted(k)})" for i, k in enumerate(keys))
    return f"SELECT term, df, min(pos) AS pos FROM (VALUES {values}) AS q(pos, key) JOIN ({DELETES}) AS d USING (key) WHERE term <> {_quoted(t)} GROUP BY term, df"


def _fuzzy(group: int, t: str, cap: int, only: str = "") -> str:
    return f"SELECT {group}, row_number() OVER (ORDER BY pos, df DESC, term) AS r, term, 1 FROM ({_fuzzy_rows(t)}) WHERE true {only} QUALIFY r <= {cap}"


def candidates(words: list[str]) -> str:
    if not words:
        return "SELECT 0 AS g, 0 AS r, '' AS term, 1 AS boost WHERE false"
    if len(words) == 1:
        t = words[0]
        only = f"AND NOT EXISTS (SELECT 1 FROM vocab WHERE starts_with(term, {_quoted(t)}))"
        parts = [_exact(0, t), _prefix(0, t, Knobs.single_term_max_prefix_tokens), _fuzzy(0, t, Knobs.single_term_max_fuzzy_tokens, only)]
    else:
        parts = []
        for g, t in enumerate(words[:-1]):
            parts += [_exact(g, t), _fuzzy(g, t, fuzzy_limit(t))]
        g, t = len(words) - 1, words[-1]
        parts += [_exact(g, t), _prefix(g, t, multi_term_prefix_limit(t))]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def search(base: str, words: list[str], k: int, allowed: str = "", popularity: str = "") -> str:
    """Ranked hits over the CTEs of ``postings``."""
    pop = f"LEFT JOIN ({popularity}) p USING (id)" if popularity else ""
    score = "score + coalesce(p.popularity, 0)" if popularity else "score"
    return f"""WITH {base},
cand AS ({candidates(words)}),
grp AS (SELECT g, id, arg_min(score * boost, r) AS s FROM post JOIN cand USING (term) GROUP BY g, id),
hit AS (SELECT id, CAST(sum(s) AS BIGINT) AS score FROM grp GROUP BY id HAVING count(*) = {len(words)}),
fin AS (SELECT id, {score} AS score FROM hit {pop} {f"WHERE id IN ({allowed})" if allowed else ""})
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM fin QUALIFY rank <= {k}"""


def _allowed(table: str, key: str, spec: dict[str, list[str]] | None) -> str:
    if not spec:
        return ""
    tests = [f"CAST({f} AS VARCHAR) IN ({', '.join(map(_quoted, v))})" if v else "false" for f, v in spec.items()]
    return f"SELECT CAST({key} AS VARCHAR) FROM {table} WHERE {' AND '.join(tests)}"


def _words(text: str) -> list[str]:
    """Tokens of the registered ASCII queries."""
    cleaned = ("".join(c for c in w.lower() if c.isalnum()) for w in text.split())
    return [w for w in cleaned if w and w not in ("a", "the", "and")]


def _cosine(v: str) -> str:
    return f"(list_dot_product(CAST({v} AS DOUBLE[]), probe) / (sqrt(list_dot_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))) * sqrt(list_dot_product(probe, probe))))"


_PROBE = f"CAST([{', '.join(str(x) for x in PROBE)}] AS DOUBLE[]) AS probe"


def _topk(rows: str, k: int) -> str:
    return f"""WITH s AS (SELECT id, {_cosine('embedding')} AS sim FROM (SELECT *, {_PROBE} FROM ({rows}))),
t AS (SELECT id, CAST(trunc(sim * 1000000) AS BIGINT) AS score FROM s WHERE sim > 0)
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM t QUALIFY rank <= {k}"""


_EMB = "SELECT CAST(vec_id AS VARCHAR) AS id, 'c' || label AS name, embedding FROM embeddings"
_SUMS = f"SELECT name, i - 1 AS pos, sum(CAST(embedding[i] AS DOUBLE)) AS total, count(*) AS n FROM ({_EMB}), range(1, 65) AS r(i) GROUP BY name, i"
_LOG = """SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, lang, 1 AS version FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, 'update ' || text, 'xx', 2 FROM documents WHERE doc_id % 3 = 0"""
_GONE = "SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 0"

ORACLES: dict[str, str] = {
    "tokenize_documents": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "tokenize_pages": f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT page_id, {tokens('html')} AS t FROM pages)",
    "stopword_drop": f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda w: w <> '')) AS BIGINT) AS n_words, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens FROM documents",
    "weighted_scores": f"WITH {PARTS} SELECT id, term, score FROM post",
    "postings_build": f"WITH {DOCS} SELECT term, id, score FROM post",
    "vocab_df": f"WITH {DOCS} SELECT term, df FROM vocab",
    "prefix_table_top64": f"WITH {DOCS}, p AS (SELECT term, df, unnest(list_transform(range(1, length(term)), lambda i: term[1:i])) AS prefix FROM vocab) SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS INTEGER) AS rank, term, df FROM p QUALIFY rank <= 64",
    "prefix_lookup": f"WITH {DOCS} SELECT CAST(row_number() OVER (ORDER BY df DESC, term) AS INTEGER) AS rank, term, df FROM vocab WHERE starts_with(term, 'tha') AND term <> 'tha' QUALIFY rank <= 64",
    "delete_keys": f"WITH {DOCS} SELECT term, count(*) AS n_keys, min(key) AS first_key, max(key) AS last_key FROM ({DELETES}) GROUP BY term",
    "fuzzy_candidates": f"WITH {DOCS} " + " UNION ALL ".join(f"SELECT {_quoted(t)} AS token, term, CAST(row_number() OVER (ORDER BY pos, df DESC, term) AS INTEGER) AS rank FROM ({_fuzzy_rows(t)}) QUALIFY rank <= 30" for t in ("tihng", "thqle", "thatt", "for", "enre")),
    "filter_array": search(TALKS, ["that"], 100, "SELECT DISTINCT CAST(conv_id AS VARCHAR) FROM conversations WHERE role IN ('assistant', 'system')"),
    "upsert_last_wins": f"SELECT id, CAST(version AS BIGINT) AS version, lang, length(text) AS n_chars FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1",
    "delete_anti": f"SELECT lang, count(*) AS n FROM ({_LOG}) WHERE id NOT IN ({_GONE}) GROUP BY lang",
    "compact_stats": f"SELECT count(*) AS stored_before, count(*) FILTER (WHERE doc_id % 7 <> 0) AS stored_after, count(*) FILTER (WHERE doc_id % 7 <> 0) AS active_after, CAST(0 AS BIGINT) AS removed_versions FROM documents",
    "index_stats": f"WITH {DOCS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM vocab) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents) AS filter_keys, CAST(0 AS BIGINT) AS popular",
    "batch_equivalence": f"WITH {DOCS} SELECT term, count(*) AS df, CAST(sum(score) AS BIGINT) AS score FROM post GROUP BY term",
    "cosine_topk": _topk(_EMB, 25),
    "vector_functions": f"SELECT id, round(list_dot_product(CAST(embedding AS DOUBLE[]), probe), 6) AS dot, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, CAST(trunc(round({_cosine('embedding')}, 9) * 1000000) AS BIGINT) AS score FROM (SELECT *, {_PROBE} FROM ({_EMB}))",
    "centroid_sum": f"SELECT name, CAST(pos AS INTEGER) AS pos, round(total, 6) AS total, n FROM ({_SUMS})",
    "category_probe_topk": _topk(
        f"SELECT * FROM ({_EMB}) WHERE name IN (SELECT name FROM (SELECT name, CAST(trunc({_cosine('c')} * 1000000) AS BIGINT) AS s FROM (SELECT name, list(total ORDER BY pos) AS c, {_PROBE} FROM ({_SUMS}) GROUP BY name)) ORDER BY s DESC, name LIMIT 3)", 25
    ),
    "vector_filtered": _topk(f"SELECT * FROM ({_EMB}) WHERE name IN ('c1', 'c2')", 25),
    "hybrid_append": f"SELECT 0 AS part, *, false AS ai FROM ({search(DOCS, ['that', 'with'], 10)}) UNION ALL SELECT 1, *, true FROM ({_topk(_EMB, 10)})",
    "embed_content": "SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), CAST(p_size AS VARCHAR), nullif(p_brand, '')) AS content FROM part",
    "snapshot_roundtrip": f"WITH {PARTS} SELECT term, count(*) AS df, CAST(sum(score) AS BIGINT) AS score FROM post GROUP BY term",
    "json_ingest": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS BIGINT) AS p_size FROM part",
    "json_array_ingest": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS BIGINT) AS p_size FROM part",
    "single_document_upsert": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part WHERE p_partkey <> 1 UNION ALL VALUES ('1', 'upserted 1'), ('new', 'upserted new')",
    "bulk_repeated_ids": "SELECT CAST(doc_id % 100 AS VARCHAR) AS id, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY doc_id % 100",
    "early_stop": f"WITH {DOCS} SELECT least(5, count(*)) AS n, least(5, count(*)) AS n_match FROM post WHERE term = 'that'",
    "deleted_never_found": search(postings("(SELECT * FROM documents WHERE doc_id % 7 <> 0)", "doc_id", {"text": 1}), ["that", "with"], 30),
    "word_file": "SELECT DISTINCT p_brand AS word FROM part",
    "zero_vectors_rejected": "SELECT count(*) FILTER (WHERE vec_id % 10 <> 0) AS ok, count(*) FILTER (WHERE vec_id % 10 = 0) AS failed FROM embeddings",
    "centroid_subtract": f"SELECT name, CAST(pos AS INTEGER) AS pos, round(total, 6) AS total, n FROM ({_SUMS.replace(_EMB, _EMB + ' WHERE vec_id % 3 <> 0')})",
    "vector_state_roundtrip": f"SELECT name, max(n) AS members, max(n) AS count, round(sqrt(sum(total * total)), 6) AS norm, 0.6::DOUBLE AS threshold FROM ({_SUMS}) GROUP BY name",
    "csv_ingest": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part",
    "latency_nearest_rank": "SELECT event_type AS mode, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "status_counts": "SELECT event_type AS mode, count(*) AS n, count(*) FILTER (WHERE value > 100) AS errors FROM events GROUP BY event_type",
    "vocab_extract": f"SELECT term, min(doc_id) AS ord, CAST(arg_min(pos, (doc_id, pos)) AS BIGINT) AS pos FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)) GROUP BY term",
    "doc_token_pools": f"SELECT doc_id AS id, CAST(len(list_distinct(t)) AS BIGINT) AS n_tokens, t[1] AS first_token FROM (SELECT doc_id, {tokens('text')} AS t FROM documents) WHERE len(list_distinct(t)) >= 2",
    "live_terms_stream": f"SELECT lang, count(*) AS n FROM (SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) GROUP BY lang",
    "rank_all_terms": f"WITH {DOCS}, top AS (SELECT term FROM vocab ORDER BY df DESC, term LIMIT 100) SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM post WHERE term IN (SELECT term FROM top) QUALIFY rank <= 3",
}
ORACLES |= {name: search(DOCS, _words(text), k, _allowed("documents", "doc_id", spec)) for name, (text, k, spec) in SEARCHES.items()}
_POPULAR = "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(trunc(p_retailprice) AS BIGINT) AS popularity FROM part WHERE trunc(p_retailprice) > 0"
ORACLES |= {name: search(PARTS, _words(text), k, _allowed("part", "p_partkey", spec), _POPULAR) for name, (text, k, spec) in PART_SEARCHES.items()}
_HITS = f"SELECT h.*, p_name, p_size, false AS ai FROM ({search(PARTS, ['small', 'red'], 20, popularity=_POPULAR)}) h JOIN part ON CAST(p_partkey AS VARCHAR) = h.id"
ORACLES["search_with_data"] = _HITS
ORACLES["search_response"] = f"SELECT 'success' AS status, 200 AS statusCode, 'parts' AS index, 'small red' AS query, rank - 1 AS at, id, p_name, score, ai FROM ({_HITS})"
# The batch: candidates of each query by its two tokens.
ORACLES["search_batch_benchmark"] = f"""WITH {DOCS},
bt AS (SELECT item_id, t FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark) WHERE len(t) >= 2),
q AS (SELECT item_id AS query_id, t[1] AS a, t[len(t)][1:greatest(length(t[len(t)]) - 1, 1)] AS b FROM bt),
q2 AS (SELECT query_id, list_filter([a, b], lambda w: w NOT IN ('a', 'the', 'and')) AS w FROM q),
del AS ({DELETES}),
probe AS (SELECT query_id, w[1] AS token, unnest(list_concat([w[1]], CASE WHEN length(w[1]) > 1 THEN list_transform(range(1, length(w[1]) + 1), lambda i: w[1][1:i-1] || w[1][i+1:length(w[1])]) ELSE [] END)) AS key, unnest(range(length(w[1]) + 1)) AS pos FROM q2),
fz AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), df DESC, term) AS r, token FROM probe JOIN del USING (key) WHERE key IS NOT NULL AND term <> token GROUP BY query_id, token, term, df),
single AS (SELECT query_id, w[1] AS t FROM q2 WHERE len(w) = 1),
pre1 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY df DESC, term) AS r, term FROM single JOIN vocab ON starts_with(term, t) AND term <> t QUALIFY r <= 3),
ex1 AS (SELECT query_id, 0 AS r, term FROM single JOIN vocab ON term = t),
pre2 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY df DESC, term) AS r, term, CASE WHEN strlen(w[2]) <= 2 THEN 50 WHEN strlen(w[2]) <= 5 THEN 40 ELSE 30 END AS cap FROM q2 JOIN vocab ON len(w) = 2 AND starts_with(term, w[2]) AND term <> w[2]),
cand AS (
  SELECT query_id, 1 AS ng, 0 AS g, r, term, 10 AS boost FROM ex1
  UNION ALL SELECT query_id, 1, 0, r, term, 1 FROM pre1
  UNION ALL SELECT query_id, 1, 0, r, term, 1 FROM fz WHERE r <= 2 AND query_id IN (SELECT query_id FROM single) AND query_id NOT IN (SELECT query_id FROM pre1 UNION ALL SELECT query_id FROM ex1)
  UNION ALL SELECT query_id, 2, 0, 0, term, 10 FROM q2 JOIN vocab ON len(w) = 2 AND term = w[1]
  UNION ALL SELECT query_id, 2, 0, r, term, 1 FROM fz WHERE query_id IN (SELECT query_id FROM q2 WHERE len(w) = 2) AND r <= CASE WHEN strlen(token) <= 4 THEN 30 WHEN strlen(token) <= 6 THEN 20 ELSE 10 END
  UNION ALL SELECT query_id, 2, 1, 0, term, 10 FROM q2 JOIN vocab ON len(w) = 2 AND term = w[2]
  UNION ALL SELECT query_id, 2, 1, r, term, 1 FROM pre2 WHERE r <= cap),
grp AS (SELECT query_id, ng, g, id, arg_min(score * boost, r) AS s FROM post JOIN cand USING (term) GROUP BY query_id, ng, g, id),
hit AS (SELECT query_id, id, CAST(sum(s) AS BIGINT) AS score FROM grp GROUP BY query_id, ng, id HAVING count(*) = ng)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM hit QUALIFY rank <= 10"""
