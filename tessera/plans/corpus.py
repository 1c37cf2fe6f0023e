"""Queries over ``documents``, ``pages``, ``benchmark`` and ``labels``: text functions, chunks, duplicates, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import chunking, dedup, security
from tessera.operators.graph import saved
from tessera.plans.common import r6, table


def _docs(spark, d):
    return table(spark, d, "documents")


def _complexity(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", X.complexity(c).alias("v1"), X.snippet_complexity(c).alias("v2"), X.dedup_complexity(c).alias("v3"), X.rule_complexity(c).alias("v4"))


def _features(spark, d):
    return _docs(spark, d).select("doc_id", X.language_features(F.col("text")).alias("f")).select("doc_id", "f.*")


def _language(spark, d):
    return _docs(spark, d).groupBy(X.language_of_content(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


def _paths_language(spark, d):
    return table(spark, d, "pages").groupBy(X.language_of_path(F.regexp_replace("url", r"[?#].*$", "")).alias("language")).agg(F.count("*").alias("n"))


def _language_stats(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_files"))


def _project_metrics(spark, d):
    p = chunking.parsed(_docs(spark, d).select("source", "text"))
    return p.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"), F.count_distinct("hash").alias("n_distinct"))


def _rolling(spark, d):
    return table(spark, d, "part").select("p_partkey", X.rolling_hash(F.col("p_name")).alias("h"))


def _analysis(spark, d):
    q = F.lower("text")
    rows = table(spark, d, "benchmark").select("item_id", q.alias("q"), X.keywords(q).alias("words"), X.entities(q).alias("found"))
    return rows.select("item_id", X.query_type(F.col("q")).alias("type"), X.intent(F.col("q")).alias("intent"), F.size("words").cast("long").alias("n_words"), F.array_join(F.slice("words", 1, 3), " ").alias("first_words"), F.size("found").cast("long").alias("n_entities"), r6(X.query_complexity(F.col("q"), F.col("words"), F.col("found"))).alias("complexity"))


def _cleaned(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(X.cleaned_query(F.col("text"))).alias("cleaned"))


def _cache(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.cache_key(F.col("text"), F.lit("p"), F.lit("{}")).alias("key"))


def _chunks(compat):
    def run(spark, d):
        got = chunking.line_chunks(_docs(spark, d), compat=compat)
        return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("digest"))

    return run


def _exact(spark, d):
    return dedup.exact_marks(_docs(spark, d)).select("doc_id", "kept")


def _savings(spark, d):
    return dedup.savings(dedup.exact_marks(_docs(spark, d)))


def _semantic(spark, d):
    return dedup.semantic_marks(_docs(spark, d)).select("doc_id", "kept")


def _fuzzy(spark, d):
    return dedup.fuzzy(_docs(spark, d)).select(F.col("id").alias("doc_id"), "kept")


def _pairs(spark, d):
    """Pairs between the first documents of equal word sets."""
    return dedup.similar_pairs(dedup.word_sets(_docs(spark, d)), 80, firsts=True).select("a", "b", "shared", r6("similarity").alias("similarity"))


def _copies(spark, d):
    """The first document of each one's word set."""
    return dedup.copies_of(dedup.word_sets(_docs(spark, d)))


def _known(spark, d):
    """Documents whose text some other document has too."""
    digest = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    n = digest.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return digest.join(n, "h", "left_semi").select("doc_id")


def _pages_path(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    return p.select("page_id", r6(S.path_proximity(F.col("path"), F.lit("blog.ththan.example.com/en/1"))).alias("near"))


def _structural(spark, d):
    f = X.semantic_features(X.preprocess(F.col("text")), F.col("lang"), F.size(F.split(F.col("text"), "\n")))
    rows = saved(_docs(spark, d).select("doc_id", f.alias("f")))  # both sides read the features, which take longer than the join
    a, b = rows.alias("a"), rows.select((F.col("doc_id") - 1).alias("doc_id"), "f").alias("b")
    return a.join(b, "doc_id").select("doc_id", r6(S.structural(F.col("a.f"), F.col("b.f"))).alias("similarity"))


def _snippet_valid(spark, d):
    return _docs(spark, d).select("doc_id", X.valid_snippet(F.col("text"), F.lit("logic_block"), F.lit("javascript")).alias("valid"))


def _nodes(spark, d):
    return chunking.syntax_nodes(table(spark, d, "pages"), "page_id", "html", lines=False).groupBy("type").agg(F.count("*").alias("n"))


def _node_summary(spark, d):
    got = chunking.node_summary(chunking.syntax_nodes(_docs(spark, d), lines=False))
    return got.select("doc_id", "n_nodes", F.size("by_type").cast("long").alias("n_types"))


def _marked(spark, d):
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("// @example "), x)).otherwise(x)), "\n")
    got = chunking.marked_snippets(_docs(spark, d).select("doc_id", lines.alias("text")))
    return got.select("doc_id", "marker_line", F.md5("content").alias("digest"))


def _scan(spark, d):
    return security.scan(table(spark, d, "pages"))


def _flows(spark, d):
    return security.flows(_docs(spark, d), "doc_id", "text")


def _secrets(spark, d):
    return security.secrets(_docs(spark, d), "doc_id", "text")


def _secrets_short(spark, d):
    """Those of texts of up to 1000 lines: the cap is the feature."""
    return security.secrets(_docs(spark, d), "doc_id", "text", 1000)


def findings(spark, d):
    """Labels as findings: toxic is an error, poor quality a warning."""
    l = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "source", "lang"), "doc_id")  # noqa: E741
    severity = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARNING").otherwise("INFO")
    return l.select(F.col("doc_id").alias("finding_id"), F.col("source").alias("file"), severity.alias("severity"), F.concat_ws("-", "lang", severity).alias("rule"))


_FINDINGS = """f AS (SELECT doc_id AS finding_id, source AS file, CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
  lang || '-' || CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' ELSE 'INFO' END AS rule FROM labels JOIN documents USING (doc_id))"""


def _rollup(spark, d):
    return findings(spark, d).rollup("severity", "rule").agg(F.count("*").alias("n"))


def _risk(spark, d):
    got = security.overall_risk(findings(spark, d))
    return got.withColumn("ratio", r6("ratio"))


QUERIES = {
    "complexity_variants": _complexity, "language_features": _features, "language_by_content": _language, "language_by_path": _paths_language, "language_stats": _language_stats,
    "project_metrics": _project_metrics, "rolling_hash": _rolling, "query_analysis": _analysis, "query_cleanup": _cleaned, "query_cache_key": _cache,
    "chunk_lines": _chunks(False), "chunk_lines_compat": _chunks(True), "dedup_exact": _exact, "dedup_savings": _savings, "dedup_semantic": _semantic, "dedup_fuzzy": _fuzzy,
    "jaccard_pairs": _pairs, "jaccard_copies": _copies, "duplicate_check": _known, "path_proximity": _pages_path, "structural_similarity": _structural, "snippet_validity": _snippet_valid,
    "syntax_nodes": _nodes, "node_summary": _node_summary, "marked_snippets": _marked,
    "security_scan": _scan, "security_flows": _flows, "security_secrets": _secrets, "security_secrets_short": _secrets_short,
    "findings_summary": lambda s, d: security.by(findings(s, d), "file", "severity"),
    "findings_top_rules": lambda s, d: security.top_rules(findings(s, d)),
    "high_risk_files": lambda s, d: security.high_risk_files(findings(s, d)),
    "severity_rollup": _rollup, "overall_risk": _risk,
    "same_rule_elsewhere": lambda s, d: security.same_rule(findings(s, d)),
    "finding_cvss": lambda s, d: findings(s, d).select("finding_id", r6(security.cvss(F.col("finding_id") % 4, F.col("severity"))).alias("cvss")),
}

_KEY = r"'\b(if|else|for|while|switch|case|try|catch)\b|\?\.|&&|\|\|'"
_N = "len(regexp_extract_all(text, {}))"
_PREP = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '(?m)//.*$', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'), '(?m)#.*$', '', 'g'))"
_FILLED = r"len([l FOR l IN string_split(text, chr(10)) IF length(trim(l)) > 0])"
_V2 = f"""floor(1 + {_N.format(r"'\b(?:if|else|for|while|switch|case|try|catch|finally)\b'")} + {_N.format(r"'&&|\|\|'")} + {_N.format(r"'[{}\[\]()]'")} * 0.5::DOUBLE
  + CASE WHEN regexp_matches(trim(text), '^\\w+\\([^)]*\\);?$') THEN 0 ELSE {_N.format(r"'\w+\s*\('")} * 0.3::DOUBLE END + 0.5)::BIGINT"""
_V3 = r"floor(1 + len(regexp_extract_all({t}, '(?i)\b(if|else|elif|for|while|do|switch|case|try|catch|except|finally)\b')) + len(regexp_extract_all({t}, '(&&|\|\||and|or|\?|\?\.)')) * 0.5::DOUBLE + 0.5)::BIGINT"
_HAS = lambda w: f"regexp_matches(p, '(?i)\\b({w})\\b')"
_FEATS = f"""p AS (SELECT doc_id, lang, text, {_PREP} AS p, len(string_split(text, chr(10))) AS nl FROM documents), ft AS (SELECT doc_id, length(text) AS n_text, lang, nl::DOUBLE AS nl, length(p) / greatest(1, nl)::DOUBLE AS al,
  {_HAS('for|while|do')} AS b1, {_HAS('if|else|switch|case')} AS b2, {_HAS('function|def|func|=>')} AS b3, {_HAS('class|interface|struct')} AS b4, {_HAS('return|yield')} AS b5, {_HAS('try|catch|throw|except')} AS b6,
  len(regexp_extract_all(p, '[{{}}]'))::DOUBLE AS k1, len(regexp_extract_all(p, '[()]'))::DOUBLE AS k2, len(regexp_extract_all(p, ';'))::DOUBLE AS k3, {_V3.format(t='p')}::DOUBLE AS k4 FROM p)"""
_WORDS = r"w AS (SELECT doc_id AS id, list_distinct(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+')) AS ws FROM documents), e AS (SELECT id, unnest(ws) AS t FROM w), n AS (SELECT id, len(ws) AS n FROM w)"
_SECRET_LINES = "l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_FIRST_WORDS = _WORDS.replace("w AS (", "w0 AS (", 1).replace("FROM documents)", "FROM documents), w AS (SELECT min(id) AS id, ws FROM (SELECT id, list_sort(ws) AS ws FROM w0) GROUP BY ws)", 1)
_CHUNK = """WITH RECURSIVE l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS nl FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS begin_line, -1::BIGINT AS n, 0::BIGINT AS chunk, false AS emit, 0::BIGINT AS b, 0::BIGINT AS e FROM documents
  UNION ALL
  SELECT s.doc_id, l.i, CASE WHEN s.n + 1 + length(l.line) >= 1000 OR l.i = l.nl THEN l.i ELSE s.begin_line END,
    CASE WHEN s.n + 1 + length(l.line) >= 1000 OR l.i = l.nl THEN -1 ELSE s.n + 1 + length(l.line) END,
    s.chunk + CASE WHEN (s.n + 1 + length(l.line) >= 1000 OR l.i = l.nl) AND (s.n + 1 + length(l.line) >= 100 OR (l.i = l.nl AND s.chunk = 0)) THEN 1 ELSE 0 END,
    (s.n + 1 + length(l.line) >= 1000 OR l.i = l.nl) AND (s.n + 1 + length(l.line) >= 100 OR (l.i = l.nl AND s.chunk = 0)), s.begin_line, l.i
  FROM s JOIN l ON l.doc_id = s.doc_id AND l.i = s.i + 1
)
SELECT s.doc_id, s.chunk - 1 AS chunk, (b + 1 - CASE WHEN {compat} AND s.chunk > 1 THEN 1 ELSE 0 END)::BIGINT AS start_line, (e - CASE WHEN {compat} AND s.chunk > 1 THEN 1 ELSE 0 END)::BIGINT AS end_line,
  md5(array_to_string(string_split(text, chr(10))[b + 1:e], chr(10))) AS digest FROM s JOIN documents USING (doc_id) WHERE emit"""
_CONTENT = "CASE " + " ".join("WHEN regexp_matches(text, '{}') THEN '{}'".format(p.replace("'", "''"), n) for p, n in X.BY_CONTENT) + " ELSE 'javascript' END"
_RX = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in ps) + ")"
_SCAN, _k = [], 0
for _issue, _sev, _ps in security.PATTERNS:
    for _p in _ps:
        _q = _p.replace("'", "''")
        _SCAN.append(f"SELECT page_id, '{_issue}' AS issue, '{_sev}' AS severity, {_k} AS pattern, line_no, line, regexp_extract(line, '(?i){_q}') AS hit FROM l WHERE regexp_matches(line, '(?i){_q}')")
        _k += 1
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_KEYWORDS = f"list_distinct([w FOR w IN [regexp_replace(x, '[^A-Za-z0-9_]', '', 'g') FOR x IN string_split_regex(q, '[ \\t\\n\\x0B\\f\\r]+')] IF length(w) > 2 AND NOT list_contains({_LIST(X.STOP_WORDS)}, w)])"
_ORDERED = "list_filter({k}, lambda x, i: list_position({k}, x) = i)"
_NODES = " UNION ALL ".join("SELECT {k}, '{t}' AS type, unnest(regexp_extract_all({c}, '{p}')) AS node FROM {f}".replace("{t}", t).replace("{p}", p.replace("'", "''")) for t, p in chunking.NODE_PATTERNS)
_NODES_OF = lambda k, c, f: _NODES.replace("{k}", k).replace("{c}", c).replace("{f}", f)
SQL = {
    "syntax_nodes": f"WITH x AS ({_NODES_OF('page_id', 'html', 'pages')}) SELECT type, count(*)::BIGINT AS n FROM x GROUP BY type",
    "node_summary": f"WITH x AS ({_NODES_OF('doc_id', 'text', 'documents')}) SELECT doc_id, count(*)::BIGINT AS n_nodes, count(DISTINCT type)::BIGINT AS n_types FROM x GROUP BY doc_id",
    "marked_snippets": """WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS nl FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)), m AS (SELECT doc_id, i, nl, CASE WHEN (i - 1) % 3 = 0 THEN '// @example ' || line ELSE line END AS line FROM l),
k AS (SELECT *, regexp_matches(line, '(?i)@snippet|@code|@example|SNIPPET:|EXAMPLE:') AS mark FROM m), e AS (SELECT a.doc_id, a.i, min(b.i) AS stop FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.i > a.i AND (b.mark OR trim(b.line) = '') WHERE a.mark GROUP BY ALL)
SELECT e.doc_id, e.i AS marker_line, md5(string_agg(k.line, chr(10) ORDER BY k.i)) AS digest FROM e JOIN k ON k.doc_id = e.doc_id AND k.i > e.i AND k.i < coalesce(e.stop, 1000000000) GROUP BY ALL""",
    "complexity_variants": f"SELECT doc_id, CASE WHEN length(text) < 10 THEN 1 ELSE 1 + {_N.format(_KEY)} END::BIGINT AS v1, {_V2} AS v2, {_V3.format(t='text')} AS v3, ({_FILLED} + greatest(1, {_N.format(chr(39) + r'\b(if|else|for|while|switch|case|try|catch|finally)\b' + chr(39))}))::BIGINT AS v4 FROM documents",
    "language_features": r"""SELECT doc_id, regexp_matches(text, '\basync\b') AND regexp_matches(text, '\bawait\b') AS "usesAsync", regexp_matches(text, '\bfunction\*\b') OR regexp_matches(text, '\byield\b') AS "usesGenerators",
  regexp_matches(text, '[{\[]\s*\w+') OR regexp_matches(text, '=\s*[{\[]') AS "usesDestructuring", contains(text, '...') AS "usesSpread", regexp_matches(text, '`[^`]*\$\{[^}]*\}[^`]*`') AS "usesTemplateLiterals" FROM documents""",
    "language_by_content": f"SELECT {_CONTENT} AS language, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "language_by_path": "WITH x AS (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9+]+)$', 1)) AS e FROM pages) SELECT coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.EXTENSIONS.items()) + "}, e)[1], 'unknown') AS language, count(*)::BIGINT AS n FROM x GROUP BY 1",
    "language_stats": "SELECT lang, count(*)::BIGINT AS n_files FROM documents GROUP BY lang",
    "project_metrics": f"SELECT source, count(*)::BIGINT AS n_files, sum({_FILLED})::BIGINT AS loc, sum(CASE WHEN length(text) < 10 THEN 1 ELSE 1 + {_N.format(_KEY)} END)::BIGINT AS complexity, count(DISTINCT sha256(text))::BIGINT AS n_distinct FROM documents GROUP BY source",
    "rolling_hash": "SELECT p_partkey, list_reduce(list_concat([0::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(p_name, '')]), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM part",
    "query_analysis": f"""WITH b AS (SELECT item_id, lower(text) AS q FROM benchmark), k AS (SELECT *, [regexp_replace(x, '[^A-Za-z0-9_]', '', 'g') FOR x IN string_split_regex(q, '[ \\t\\n\\x0B\\f\\r]+')] AS k0 FROM b),
k2 AS (SELECT *, [w FOR w IN k0 IF length(w) > 2 AND NOT list_contains({_LIST(X.STOP_WORDS)}, w)] AS k1 FROM k), w AS (SELECT *, {_ORDERED.format(k='k1')} AS words,
  (regexp_extract(q, '{X.FILE_NAME}', 1) <> '')::INT + (regexp_extract(q, '{X.FUNCTION_NAME}', 1) || regexp_extract(q, '{X.FUNCTION_NAME}', 2) <> '')::INT + (regexp_extract(q, '{X.CLASS_NAME}', 1) <> '')::INT + len([c FOR c IN {_LIST(X.CONCEPTS)} IF contains(q, c)]) AS ne FROM k2)
SELECT item_id, CASE WHEN {_RX('q', X.STRUCTURAL)} AND {_RX('q', X.SEMANTIC)} THEN 'mixed' WHEN {_RX('q', X.STRUCTURAL)} THEN 'structural' WHEN {_RX('q', X.SEMANTIC)} THEN 'semantic' ELSE 'keyword' END AS type,
  CASE {' '.join(f"WHEN regexp_matches(q, '{p}') THEN '{n}'" for p, n in X.INTENTS)} ELSE 'search' END AS intent, len(words)::BIGINT AS n_words, array_to_string(words[1:3], ' ') AS first_words, ne::BIGINT AS n_entities,
  round(least(1.0::DOUBLE, least(length(q) / 100.0::DOUBLE, 0.3) + least(len(words) / 10.0::DOUBLE, 0.3) + least(ne / 5.0::DOUBLE, 0.2) + CASE WHEN contains(q, 'and') OR contains(q, 'or') THEN 0.1 ELSE 0 END + CASE WHEN contains(q, 'where') OR contains(q, 'filter') THEN 0.1 ELSE 0 END), 6) AS complexity FROM w""",
    "query_cleanup": "SELECT item_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(lower(text), 'please', ''), 'can you', ''), 'could you', ''), 'help me', ''), 'show me', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS cleaned FROM benchmark",
    "query_cache_key": "SELECT item_id, sha256(trim(lower(text)) || '|p|{}') AS key FROM benchmark",
    "chunk_lines": _CHUNK.replace("{compat}", "false"),
    "chunk_lines_compat": _CHUNK.replace("{compat}", "true"),
    "dedup_exact": f"SELECT doc_id, length(text) < 50 OR row_number() OVER (PARTITION BY CASE WHEN length(text) >= 50 THEN {_PREP} END ORDER BY doc_id) = 1 AS kept FROM documents",
    "dedup_savings": f"WITH k AS (SELECT text, length(text) < 50 OR row_number() OVER (PARTITION BY CASE WHEN length(text) >= 50 THEN {_PREP} END ORDER BY doc_id) = 1 AS kept FROM documents) SELECT count(*)::BIGINT AS n_chunks, count(*) FILTER (WHERE NOT kept)::BIGINT AS n_removed, coalesce(sum(length(text)) FILTER (WHERE NOT kept), 0)::BIGINT AS chars_saved FROM k",
    "dedup_semantic": f"WITH {_FEATS} SELECT doc_id, n_text < 50 OR row_number() OVER (PARTITION BY n_text >= 50, lang, nl, al, b1, b2, b3, b4, b5, b6, k1, k2, k3, k4 ORDER BY doc_id) = 1 AS kept FROM ft",
    "jaccard_copies": f"WITH {_FIRST_WORDS} SELECT w0.id, w.id AS first_id FROM w0 JOIN w ON list_sort(w0.ws) = w.ws",
    "dedup_fuzzy": f"""WITH RECURSIVE {_WORDS}, i AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY ALL), pr AS (SELECT a, b FROM i JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 95 * (p.n + q.n - k)),
o AS (SELECT id, list(a) FILTER (WHERE a IS NOT NULL) AS earlier, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id, NULL AS a FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY id),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT o.k, CASE WHEN list_has_any(coalesce(o.earlier, []), g.kept) THEN g.kept ELSE list_append(g.kept, o.id) END FROM g JOIN o ON o.k = g.k + 1)
SELECT id AS doc_id, id NOT IN (SELECT id FROM o) OR list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), id) AS kept FROM w""",
    "jaccard_pairs": f"WITH {_FIRST_WORDS}, i AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY ALL) SELECT a, b, k::BIGINT AS shared, round(k / (p.n + q.n - k)::DOUBLE, 6) AS similarity FROM i JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)",
    "duplicate_check": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "path_proximity": """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/?[^/]*$', '') AS x FROM pages), c AS (SELECT *, list_max(list_concat([0], [k FOR k IN range(1, 27) IF k <= length(x) AND x[1:k] = 'blog.ththan.example.com/en'[1:k]])) AS k FROM p)
SELECT page_id, round(CASE WHEN x = 'blog.ththan.example.com/en' THEN 1.0 ELSE k / greatest(length(x), 26)::DOUBLE END, 6)::DOUBLE AS near FROM c""",
    "structural_similarity": f"""WITH {_FEATS} SELECT a.doc_id, round((list_sum([CASE WHEN greatest(x.a, x.b) > 0 THEN 1 - abs(x.a - x.b) / greatest(x.a, x.b) ELSE 1 END FOR x IN [{{'a': a.nl, 'b': b.nl}}, {{'a': a.al, 'b': b.al}}, {{'a': a.k1, 'b': b.k1}}, {{'a': a.k2, 'b': b.k2}}, {{'a': a.k3, 'b': b.k3}}, {{'a': a.k4, 'b': b.k4}}]])
  + (a.b1 = b.b1)::INT + (a.b2 = b.b2)::INT + (a.b3 = b.b3)::INT + (a.b4 = b.b4)::INT + (a.b5 = b.b5)::INT + (a.b6 = b.b6)::INT + (a.lang = b.lang)::INT) / 13.0::DOUBLE, 6) AS similarity FROM ft a JOIN ft b ON b.doc_id - 1 = a.doc_id""",
    "snippet_validity": rf"""SELECT doc_id, length(text) BETWEEN 5 AND 1500 AND length(regexp_replace(text, '[{{}}\[\]() \t\n\x0B\f\r;]', '', 'g')) >= 3 AND length(trim(regexp_replace(text, '(?m)//.*$|/\*[\s\S]*?\*/', '', 'g'))) > 0 AND regexp_matches(text, '{X.LOGIC["javascript"]}')
  AND len(list_distinct([t FOR t IN string_split_regex(text, '[ \t\n\x0B\f\r]+') IF length(t) > 1])) >= 3 AND {_FILLED} >= 3 AND length(text) >= 30 AS valid FROM documents""",
    "security_scan": "WITH l AS (SELECT page_id, i AS line_no, string_split(html, chr(10))[i] AS line FROM pages, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS u(i)), h AS (" + " UNION ALL ".join(_SCAN) + ") SELECT page_id, issue, severity, pattern, line_no, instr(line, hit)::BIGINT AS start_col, (instr(line, hit) + length(hit))::BIGINT AS end_col FROM h",
    "security_flows": f"SELECT doc_id, source_word AS source, sink FROM (SELECT doc_id, text, unnest({_LIST(security.SOURCES)}) AS source_word FROM documents) JOIN (SELECT unnest({_LIST(security.SINKS)}) AS sink) ON contains(text, sink) WHERE contains(text, source_word)",
    "security_secrets": f"WITH {_SECRET_LINES} SELECT doc_id, line_no, name FROM l JOIN (SELECT unnest({_LIST(security.SECRETS)}) AS name) ON contains(lower(line), name)",
    "security_secrets_short": f"WITH {_SECRET_LINES} SELECT doc_id, line_no, name FROM l JOIN (SELECT unnest({_LIST(security.SECRETS)}) AS name) ON contains(lower(line), name) WHERE n_lines <= 1000",
    "findings_summary": f"WITH {_FINDINGS} SELECT file, severity, count(*)::BIGINT AS n FROM f GROUP BY ALL",
    "findings_top_rules": f"WITH {_FINDINGS} SELECT rule, count(*)::BIGINT AS n FROM f GROUP BY rule ORDER BY n DESC, rule LIMIT 5",
    "high_risk_files": f"WITH {_FINDINGS} SELECT file, count(*)::BIGINT AS n_errors FROM f WHERE severity = 'ERROR' GROUP BY file HAVING count(*) >= 3",
    "severity_rollup": f"WITH {_FINDINGS} SELECT severity, rule, count(*)::BIGINT AS n FROM f GROUP BY ROLLUP (severity, rule)",
    "overall_risk": f"WITH {_FINDINGS}, a AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE severity = 'ERROR')::BIGINT AS n_errors, count(DISTINCT rule)::BIGINT AS n_rules FROM f), r AS (SELECT *, n_errors / n::DOUBLE AS x FROM a) SELECT n, n_errors, n_rules, round(x, 6) AS ratio, CASE WHEN x > 0.2 THEN 'high' WHEN x > 0.1 THEN 'medium-high' WHEN x > 0.05 THEN 'medium' WHEN x > 0.01 THEN 'low-medium' ELSE 'low' END AS risk, n_errors > 0 AS has_errors, n_rules > 5 AS many_rules FROM r",
    "same_rule_elsewhere": f"WITH {_FINDINGS}, o AS (SELECT DISTINCT f.finding_id, g.file AS other_file FROM f JOIN f g ON f.rule = g.rule AND f.file <> g.file) SELECT finding_id, other_file FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY other_file) AS r FROM o) WHERE r <= 5",
    "finding_cvss": f"WITH {_FINDINGS} SELECT finding_id, round(least(10.0, 0.5 * (finding_id % 4) + 5 * CASE severity WHEN 'ERROR' THEN 1.0 WHEN 'WARNING' THEN 0.7 ELSE 0.3 END), 6)::DOUBLE AS cvss FROM f",
}
