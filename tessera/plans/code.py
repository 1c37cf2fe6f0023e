"""Queries over source files made from ``part``: one file a part, so that code operators have rows at every scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking, graph, rules, security, structure
from tessera.plans.common import r6, table

#: A file's text; %k is the part's key, %m its key modulo 7, %z its size. Files of even keys have the second part too.
FIRST = """import { a%m } from 'mod%m';
// @example use f%k
f%k(1, 2);
const keep%k = run(x, y);

export class C%k extends B%m {
  size = %z;
  label: string;
  run(a, b) {
    const inner = a;
    if (a > b) {
      return inner;
    }
  }
}
async function f%k(x, y = 2): Promise {
  if (x > %z && y) {
    return items.filter(i => i.ok).map(i => i.id);
  }
  const total = await load(x);
}
"""
SECOND = """const h%m = (p, q) => p + %z;
function input%k(req) {
  query('SELECT a FROM b WHERE c=' + req.body);
  document.write(req.body);
  password%z = h%m(1, 2);
  f%k(req, 1);
}
try { f%k(3) } catch (e) { throw new Error(e); }
class D%k {
  go() {
    h%m(2, 3);
  }
}
"""
_VALUES = {"%k": ("p_partkey", "p_partkey"), "%m": ("p_partkey % 7", "p_partkey % 7"), "%z": ("p_size", "p_size")}


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(whether it is an expression, text or expression) in order."""
    out, rest = [], template
    while rest:
        at, name = min(((rest.find(n), n) for n in _VALUES if n in rest), default=(len(rest), ""))
        out.append((False, rest[:at]))
        if name:
            out.append((True, _VALUES[name][0]))
        rest = rest[at + len(name) :]
    return out


def _parts(spark, d):
    """What texts are made of, dealt out over all cores before they are made: a small ``part`` is one split."""
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


def code(spark, d):
    """(id, text)."""
    made = lambda t: F.concat(*[F.expr(x).cast("string") if e else F.lit(x) for e, x in _pieces(t)])
    text = F.concat(made(FIRST), F.when(F.expr("p_partkey % 2 = 0"), made(SECOND)).otherwise(""))
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), text.alias("text"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _made(template: str) -> str:
    return " || ".join(f"({x})" if e else _literal(x) for e, x in _pieces(template))


CODE = f"code AS (SELECT p_partkey AS id, {_made(FIRST)} || CASE WHEN p_partkey % 2 = 0 THEN {_made(SECOND)} ELSE '' END AS text FROM part)"


def units(spark, d):
    return chunking.code_units(code(spark, d), "id")


def _units(spark, d):
    return units(spark, d).select("id", "type", "name", F.array_join("parameters", ",").alias("parameters"), "return_type", "base", "n_methods", "n_properties", "complexity", "start_line", "end_line", F.md5("content").alias("digest"))


def nodes(spark, d, lines=False):
    return chunking.syntax_nodes(code(spark, d), "id", lines=lines)


def _kinds(spark, d):
    return chunking.count_kinds(code(spark, d), "id")


def _summary(spark, d):
    deep = code(spark, d).select("id", chunking.depth(F.col("text")).cast("long").alias("max_depth"))
    return chunking.node_summary(nodes(spark, d), "id").join(deep, "id").select("id", "n_nodes", F.size("by_type").cast("long").alias("n_types"), "max_depth")


def _rules(spark, d):
    return rules.match(nodes(spark, d)).groupBy("rule", "type").agg(F.count("*").alias("n"))


def _snippets(spark, d):
    found = rules.snippets(nodes(spark, d)).select("id", F.col("seq").cast("long").alias("seq"), "rule", F.col("node").alias("content"))
    kept = chunking.distinct_snippets(found, ["id", "seq", "rule"])
    return kept.select("id", "seq", "rule", F.md5("content").alias("digest"))


RULE = """
rule "GuardedBranch" {
  description: "Branches that compare and go on"
  target: "if_statement"

  condition {
    contentPattern: contains("> ")
    complexity: greaterThan(4)
  }

  action {
    type: extract
    parameters: { includeComments: true }
  }
}
"""


def _custom(spark, d):
    texts = spark.createDataFrame([("guarded", 1, "rule"), ("guarded", 2, RULE)], "name string, version int, source string")
    rule = rules.parse(rules.versioned(texts).first().source)  # one row
    return nodes(spark, d).where(rules.custom(rule)).select("id", F.md5("node").alias("digest"))


SCANNED = [
    {"id": "js-document-write", "severity": "WARNING", "message": "writes into the page", "pattern": r"document\.write\("},
    {"id": "js-sql-concat", "severity": "ERROR", "message": "builds a statement from input", "pattern": r"query\([^)]*\+"},
    {"id": "js-hardcoded-password", "severity": "ERROR", "message": "sets a password", "pattern": r"(?i)password\w*\s*="},
]


def _scanned(spark, d):
    return rules.scan(code(spark, d), SCANNED, "id").select("id", "rule", "severity", "line_no")


def _generated(spark, d):
    """Rules made for the function and the class of each part, over all files."""
    p = table(spark, d, "part")
    kinds = [("call", "f"), ("definition", "f"), ("definition", "C"), ("assignment", "keep"), ("text", "D")]
    named = p.select(F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.concat(F.lit(n), "p_partkey").alias("name")) for t, n in kinds])).alias("x")).select("x.*")
    return rules.scan_table(code(spark, d), rules.generated(named), "id").select("id", "rule", "severity", "line_no")


#: Of each rule for expressions what it takes (parts of even keys) and what is near it (odd keys).
TAKEN = """const t%k = `a ${x%k} b`;
const { a%k, b: c } = load(%z);
const o%k = { first: 1, second: 2 };
const list%k = [1, 2, %z];
total%k = a * %z + b;
i%k = 0, j = run(%z);
{
  let n%k = %z;
  if (n) go(n);
  return n;
}
squares%k = [x * x for x in range(%z)]
names%k.stream().filter(n -> n.ok()).map(N::id);
run%k((a, b) -> a + b);
go work%k(ch)
ch <- v%k
type Store%k interface {
  Get(k string) string
}
  implementation 'org.x:y%k:1'
  runs-on: linux%k
"""
NEAR = """const t%k = `plain`;
const { } = %z;
const o%k = {};
const list%k = [%z];
total%k = a;
i%k = 0, j;
{
  skip%k
}
squares%k = [x, for_x, in_x]
names%k.stream().count();
run%k(() -> { });
gone work%k(ch)
ch < v%k
type Store%k interface {
}
  repositories { y%k }
  name: linux%k
"""


def expressions(spark, d):
    """(id, text): the one or the other for each part."""
    made = lambda t: F.concat(*[F.expr(x).cast("string") if e else F.lit(x) for e, x in _pieces(t)])
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), F.when(F.expr("p_partkey % 2 = 0"), made(TAKEN)).otherwise(made(NEAR)).alias("text"))


def _expression_rules(spark, d):
    nodes = chunking.syntax_nodes(expressions(spark, d), "id", patterns=chunking.EXPRESSIONS, lines=False)
    return rules.match(nodes, rules.EXPRESSION_RULES).select("id", "rule", "type", F.md5("node").alias("digest"))


def _pure(spark, d):
    f = units(spark, d).where("type = 'function'").select("id", X.has_side_effects(F.col("content")).alias("own"), X.has_page_effects(F.col("content")).alias("page"))
    share = lambda c: r6(F.avg(F.when(F.col(c), 0.0).otherwise(1.0))).alias(f"pure_by_{c}")
    return f.groupBy((F.col("id") % 10).alias("bucket")).agg(F.count("*").alias("n_functions"), share("own"), share("page"))


def _affected(spark, d):
    p = table(spark, d, "part")
    imports = p.select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 97).alias("imported"))
    return chunking.affected(p.where("p_size = 7").select(F.col("p_partkey").alias("path")), imports)


def _sites(spark, d):
    lines = code(spark, d).select(F.col("id").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "line_text"))
    return lines.select("file", (F.col("i") + 1).cast("long").alias("line"), F.regexp_extract("line_text", r"^\s+(\w+)\(", 1).alias("name")).where("name <> ''")


def _functions(spark, d):
    """(file, name, complexity, start_line, end_line), written down once: what follows reads it several times."""
    return graph.saved(units(spark, d).where("type = 'function'").select(F.col("id").alias("file"), "name", "complexity", "start_line", "end_line"))


def _resolved(spark, d, functions):
    return graph.resolved_calls(_sites(spark, d), functions.withColumn("seq", F.struct("file", "start_line")))


def _calls(spark, d):
    return _resolved(spark, d, _functions(spark, d))


def _metrics(spark, d):
    """Lines, functions, classes and issues of each project (keys modulo 10), and complexity a function."""
    by = lambda df: df.groupBy((F.col("id") % 10).alias("project"))
    c = code(spark, d).withColumn("u", chunking.count_units(F.col("text")))
    a = by(c).agg(F.sum(X.filled_lines(F.col("text"))).alias("loc"), F.sum(X.complexity(F.col("text"))).alias("complexity"), F.sum("u.n_functions").alias("n_functions"), F.sum("u.n_classes").alias("n_classes"))
    i = by(security.scan(code(spark, d), "id", "text")).agg(F.count("*").alias("n_issues"))
    got = a.where("n_functions + n_classes > 0").join(i, "project", "left")
    return got.select("project", "loc", "n_functions", "n_classes", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), r6(F.col("complexity") / F.col("n_functions")).alias("complexity_a_function"))


def _cyclomatic(spark, d):
    """Of each file's functions as nodes and calls as edges."""
    functions = _functions(spark, d)
    f = functions.groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_functions"), F.sum("complexity").alias("complexity"))
    e = _resolved(spark, d, functions).groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_calls"))
    both = f.join(e, "id", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    return both.select("id", "n_functions", "complexity", graph.cyclomatic(F.col("n_functions"), F.col("n_calls")).alias("cyclomatic"))


def _security(spark, d):
    from tessera.operators import findings

    c = code(spark, d)
    return findings.security_summary(security.scan(c, "id", "text"), security.flows(c, "id", "text"))


def _marked(spark, d):
    got = chunking.marked_snippets(code(spark, d), "id")
    return got.select("id", "marker_line", F.md5("content").alias("content"), F.md5("around").alias("around"))


def _searched(spark, d):
    found = chunking.search_nodes(nodes(spark, d), "//class_declaration", None, "7")
    return found.select("id", "node")


#: Texts whose strings, comments, template texts, heads and blocks mislead whoever counts braces or reads line by line.
SCRIPT = """import { a%m, b } from "mod%m";
/* class No { function no() { */
const quote%k = "}{ function no() {", mark = /[{"'`]/;
export default class Cart%k extends base.Shop%m {
  size = %z; // }
  static label: string = '{';
  async add(item, n = { k: [1, 2] }, ...rest) {
    const text = `}${ rest.map(r => `{${r.id}}`).join("}") } {`;
    if (n > %z && mark.test(text)) {
      for (const x of rest) { log(x); }
    }
  }
  get total() { return this.sum(function (p) { return p; }); }
}
export async function
  load%k(
    path,
    // not ) yet {
    options = "{",
  ): Promise<string> {
  const read = async (p: string): Promise<void> => {
    try { go(p) } catch (e) { fail(e, "}"); }
  };
  return read(path);
}
const twice = (x) =>
  x * %z;
"""
INDENTED = '''import os
from pack%m.mod import name
LIMIT = %z
class Cart%k(Shop%m, metaclass=Meta):
    """A class: and def no(self): in its text.

  class No:
    """
    size: int = %z

    def add(self, item, n={"k": [1, 2]}, *rest) -> "list[int]":
        text = "def no():" + \'"""\'
        if n and (
            item
        ):
            for x in rest: log(x)
  # a comment that ends nothing
        return [f"{i}" for i in rest]

    async def total(self): return self.sum(lambda p: p)

def load%k(
    path,
    options="(",
):
    def read(p):
        try:
            go(p)
        except OSError as e:
            fail(e)
    return read(path)
done%k = load%k(1)
'''
TYPED = """package shop%m;
import java.util.Map;
// class No {
public class Cart%k extends Shop%m implements A, B {
  private final int size = %z;
  static Map<String, int[]> label;
  public Cart%k(int n) { this.size = n; }
  @Override
  protected String add(final Item item,
      int n) throws IOException {
    char c = '{'; String s = "}\\"{";
    if (n > %z) {
      while (item.next()) { log(item); }
    }
    return s;
  }
  interface Part%k { }
}
"""
LANGUAGES = {"javascript": SCRIPT, "python": INDENTED, "java": TYPED}


def source(spark, d):
    """(id, language, text): one of the three a part."""
    made = lambda t: F.concat(*[F.expr(x).cast("string") if e else F.lit(x) for e, x in _pieces(t)])
    pick = F.expr("p_partkey % 3")
    text, name = (reduce(lambda c, k: c.when(pick == k, f(k)), range(1, 3), F.when(pick == 0, f(0))) for f in (lambda k: made([*LANGUAGES.values()][k]), lambda k: F.lit([*LANGUAGES][k])))
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), name.alias("language"), text.alias("text"))


def _source_units(spark, d):
    u = chunking.code_units(source(spark, d), "id", language=F.col("language"), methods=True)
    return u.select("id", "type", "name", F.array_join("parameters", "|").alias("parameters"), "return_type", "base", "n_methods", "n_properties", "start_line", "end_line", F.md5("content").alias("digest"))


def _source_tree(spark, d):
    nodes = structure.tree(source(spark, d), "id", language=F.col("language"))
    return nodes.select("id", "seq", "parent", "depth", "last", "type", "name", "start_line", "end_line")


def _source_paths(spark, d):
    nodes = structure.tree(source(spark, d), "id", language=F.col("language"))
    return structure.find_all(nodes, PATHS).groupBy("query", "name").agg(F.count("*").alias("n"))


PATHS = ("//class/method", "//class//if", "//method/if/for/call", "//function//function", "/class/property[size]", "//class//call[log]", "/*/try")


def _source_symbols(spark, d):
    return chunking.symbols(source(spark, d), "id", language=F.col("language"), methods=True)


def _source_summary(spark, d):
    s = structure.summary(structure.tree(source(spark, d), "id", language=F.col("language")), "id")
    return s.select("id", "n_nodes", "max_depth", F.to_json("by_type").alias("by_type"))


QUERIES = {
    "source_units": _source_units,
    "source_tree": _source_tree,
    "source_paths": _source_paths,
    "source_symbols": _source_symbols,
    "source_summary": _source_summary,
    "code_marked": _marked,
    "node_search": _searched,
    "compare_files": lambda s, d: chunking.compare(nodes(s, d), 1, 2, "id"),
    "code_units": _units,
    "symbol_table": lambda s, d: chunking.symbols(code(s, d), "id"),
    "syntax_node_lines": lambda s, d: nodes(s, d, lines=True).select("id", "type", F.md5("node").alias("digest"), "start_line"),
    "nodes_by_kind": _kinds,
    "code_summary": _summary,
    "snippet_rules": _rules,
    "expression_rules": _expression_rules,
    "code_snippets": _snippets,
    "custom_rule": _custom,
    "regex_rule_scan": _scanned,
    "generated_rule_scan": _generated,
    "pure_functions": _pure,
    "affected_files": _affected,
    "resolved_calls": _calls,
    "code_metrics": _metrics,
    "cyclomatic_by_file": _cyclomatic,
    "security_summary": _security,
    "code_flows": lambda s, d: security.flows(code(s, d), "id", "text"),
    "code_secrets": lambda s, d: security.secrets(code(s, d), "id", "text"),
}

# ---- the same in SQL

#: What units look like in the texts of ``code``, a line each; for the SQL alone, as the operators read any text.
FUNCTION_HEAD = r"\bfunction\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*([^{]*[^{\s]))?\s*\{"
ARROW_HEAD = r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*([^=]*[^=\s]))?\s*=>"
CLASS_HEAD = r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?"
METHOD = r"(?m)^\s+(?:async\s+|static\s+)*\w+\s*\([^)]*\)\s*\{"
BRANCH = r"(?m)^\s+(?:if|for|while|switch|catch)\s*\([^)]*\)\s*\{"
PROPERTY = r"(?m)^\s+\w+\s*(?::\s*\w+\s*)?(?:=\s*[^=>\s][^\n]*)?;$"
VARIABLE = r"\b(?:const|let|var)\s+(\w+)"
_q = lambda p: p.replace("'", "''")
_FH, _AH, _CH = (_q(p) for p in (FUNCTION_HEAD, ARROW_HEAD, CLASS_HEAD))
_n = lambda c, p: f"len(regexp_extract_all({c}, '{_q(p)}'))"
_COMPLEX = rf"CASE WHEN length(content) < 10 THEN 1 ELSE 1 + {_n('content', X.CONTROL)} END::BIGINT"
_LINES = f"""{CODE}, ll AS (SELECT id, text, string_split(text, chr(10)) AS ls, [{_n('x', '[{]')} - {_n('x', '[}]')} FOR x IN string_split(text, chr(10))] AS ds FROM code),
li AS (SELECT id, ls, ds, i, ls[i] AS line FROM ll, unnest(range(1, len(ls) + 1)) AS t(i))"""
_UNITS = f"""{_LINES}, hs AS (SELECT *, CASE WHEN regexp_matches(line, '{_CH}') THEN 'class' WHEN regexp_matches(line, '{_FH}') OR regexp_matches(line, '{_AH}') THEN 'function' END AS type FROM li),
he AS (SELECT *, coalesce([j FOR j IN range(i, len(ls) + 1) IF list_sum(ds[i:j]) <= 0][1], len(ls)) AS j FROM hs WHERE type IS NOT NULL),
hc AS (SELECT *, array_to_string(ls[i:j], chr(10)) AS content, CASE WHEN regexp_matches(line, '{_FH}') THEN regexp_extract(line, '{_FH}', ['a', 'b', 'c']) ELSE regexp_extract(line, '{_AH}', ['a', 'b', 'c']) END AS g FROM he),
units AS (SELECT id, type, CASE WHEN type = 'class' THEN regexp_extract(line, '{_CH}', 1) ELSE g.a END AS name,
  CASE WHEN type = 'function' THEN [p FOR p IN [trim(regexp_replace(x, '[:=].*$', '')) FOR x IN string_split(g.b, ',')] IF p <> ''] END AS parameters,
  CASE WHEN type = 'function' THEN CASE WHEN g.c = '' THEN 'unknown' ELSE g.c END END AS return_type, CASE WHEN type = 'class' THEN nullif(regexp_extract(line, '{_CH}', 2), '') END AS base,
  CASE WHEN type = 'class' THEN {_n('content', METHOD)} - {_n('content', BRANCH)} END::BIGINT AS n_methods, CASE WHEN type = 'class' THEN {_n('content', PROPERTY)} END::BIGINT AS n_properties,
  {_COMPLEX} AS complexity, i::BIGINT AS start_line, j::BIGINT AS end_line, content FROM hc)"""
_NODES = CODE + ", nodes AS (" + " UNION ALL ".join(
    f"SELECT id, '{t}' AS type, {k} AS no, k, hits[k] AS node, (1 + list_sum([length(x) - length(replace(x, chr(10), '')) FOR x IN parts[1:k]]) + coalesce(list_sum([length(x) - length(replace(x, chr(10), '')) FOR x IN hits[1:k - 1]]), 0))::BIGINT AS start_line "
    f"FROM (SELECT id, regexp_extract_all(text, '{_q(p)}') AS hits, string_split_regex(text, '{_q(p)}') AS parts FROM code) AS x{k}, unnest(range(1, len(hits) + 1)) AS t{k}(k)"
    for k, (t, p) in enumerate(chunking.NODE_PATTERNS)
) + "), seqs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY no, k) - 1 AS seq FROM nodes)"
_FILLED = "len([l FOR l IN string_split({}, chr(10)) IF length(trim(l)) > 0])"


def _test(test: tuple, c: str) -> str:
    kind, *rest = test
    match kind:
        case "has":
            return f"regexp_matches({c}, '{_q(rest[0])}')"
        case "twice":
            return f"{_n(c, rest[0])} >= 2"
        case "lines":
            return f"{_FILLED.format(c)} > {rest[0]}"
        case "longer":
            return f"length({c}) > {rest[0]}"
        case "not":
            return f"NOT ({_test(rest[0], c)})"
    return "(" + (" AND " if kind == "all" else " OR ").join(_test(t, c) for t in rest) + ")"


_RULES = f"{_NODES}, tests AS (" + " UNION ALL ".join(
    "SELECT id, type, seq, node, '{}' AS rule FROM seqs WHERE type IN ({}) AND {}".format(name, ", ".join(f"'{t}'" for t in types), _test(test, "node")) for name, (types, test) in rules.RULES.items()
) + ")"
_EXPRESSION_NODES = f"code AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN {_made(TAKEN)} ELSE {_made(NEAR)} END AS text FROM part), seqs AS (" + " UNION ALL ".join(
    f"SELECT id, '{t}' AS type, unnest(regexp_extract_all(text, '{_q(p)}')) AS node FROM code" for t, p in chunking.EXPRESSIONS
) + ")"
_EXPRESSION_RULES = f"WITH {_EXPRESSION_NODES} " + " UNION ALL ".join(
    "SELECT id, '{}' AS rule, type, md5(node) AS digest FROM seqs WHERE type IN ({}) AND {}".format(name, ", ".join(f"'{t}'" for t in types), _test(test, "node")) for name, (types, test) in rules.EXPRESSION_RULES.items()
)
_BARE = r"trim(regexp_replace({}, '(?m)//.*$|/\*[\s\S]*?\*/', '', 'g'))"
_BLOCK = r"(?:if|for|while|switch)\s*\([^)]*\)\s*\{([\s\S]*)\}"
_VALID = rf"""length(node) BETWEEN 30 AND 1500 AND {_FILLED.format('node')} >= 3 AND length(regexp_replace(node, '[{{}}\[\]() \t\n\x0B\f\r;]', '', 'g')) >= 3 AND {_BARE.format('node')} <> ''
  AND CASE rule WHEN 'control_structure' THEN regexp_matches(node, '(?:if|for|while|switch|try|catch|finally)\b') AND NOT (regexp_matches(node, '{_BLOCK}') AND {_BARE.format(f"regexp_extract(node, '{_BLOCK}', 1)")} = '')
    WHEN 'error_handling' THEN regexp_matches(node, '(?:try|catch|finally|throw)\b') ELSE true END
  AND regexp_matches(node, '{X.LOGIC["javascript"]}') AND len(list_distinct([t FOR t IN string_split_regex(node, '[ \t\n\x0B\f\r]+') IF length(t) > 1])) >= 3"""
_V2 = rf"""floor(1 + {_n('node', r'\b(?:if|else|for|while|switch|case|try|catch|finally)\b')} + {_n('node', r'&&|\|\|')} + {_n('node', r'[{}\[\]()]')} * 0.5::DOUBLE
  + CASE WHEN regexp_matches(trim(node), '^\w+\([^)]*\);?$') THEN 0 ELSE {_n('node', r'\w+\s*\(')} * 0.3::DOUBLE END + 0.5)::BIGINT"""
_CALLED = f"""{_UNITS}, fn AS (SELECT id AS file, name, start_line, end_line FROM units WHERE type = 'function'), sites AS (SELECT id AS file, i::BIGINT AS line, regexp_extract(line, '^\\s+(\\w+)\\(', 1) AS name FROM li),
last AS (SELECT name, arg_max(file || '#' || name, (file, start_line)) AS callee FROM fn GROUP BY name),
inner_fn AS (SELECT file, line, caller FROM (SELECT s.file, s.line, s.file || '#' || f.name AS caller, row_number() OVER (PARTITION BY s.file, s.line ORDER BY f.start_line, f.name) AS r FROM (SELECT DISTINCT file, line FROM sites WHERE name <> '') s JOIN fn f ON s.file = f.file AND s.line BETWEEN f.start_line AND f.end_line) WHERE r = 1),
calls AS (SELECT file, line, caller, callee FROM sites JOIN last USING (name) JOIN inner_fn USING (file, line))"""
_SCANS = f"{_LINES}, scans AS (" + " UNION ALL ".join(
    f"SELECT id, i AS line_no, '{issue}' AS issue, '{severity}' AS severity FROM li WHERE regexp_matches(line, '(?i){_q(p)}')" for issue, severity, ps in security.PATTERNS for p in ps
) + ")"
_WORD = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_FLOWS = f"flows AS (SELECT id, source, sink FROM (SELECT id, text, unnest({_WORD(security.SOURCES)}) AS source FROM code) JOIN (SELECT unnest({_WORD(security.SINKS)}) AS sink) ON contains(text, sink) WHERE contains(text, source))"
_WRITES = rf"""regexp_matches(c, '{"|".join(_q(p) for p in X.EFFECTS)}') OR len([l FOR l IN [trim(x) FOR x IN string_split(c, chr(10))] IF contains(l, '=') AND NOT regexp_matches(l, '{"|".join(_q(p) for p in X.PURE_LINES)}')
  AND CASE WHEN regexp_matches(l, '{X.DECLARES}') THEN regexp_matches(l, '{X.DECLARES_NAME}') AND NOT regexp_matches(trim(string_split(l, '=')[2]), '{"|".join(_q(p) for p in X.PURE_VALUES)}') ELSE regexp_matches(l, '{X.ASSIGNS}') END]) > 0"""
SQL = {
    "code_marked": f"""WITH {_LINES}, k AS (SELECT *, coalesce([j FOR j IN range(i + 1, len(ls) + 1) IF trim(ls[j]) = '' OR regexp_matches(ls[j], '{chunking.MARKER}')][1], len(ls) + 1) AS stop FROM li WHERE regexp_matches(line, '{chunking.MARKER}'))
SELECT id, i AS marker_line, md5(array_to_string(ls[i + 1:stop - 1], chr(10))) AS content, md5(array_to_string(list_concat(ls[greatest(i - 1, 1):i], ls[stop:stop + 1]), chr(10))) AS around FROM k WHERE stop > i + 1""",
    "node_search": f"WITH {_NODES} SELECT id, node FROM nodes WHERE type = 'class_declaration' AND contains(node, '7')",
    "compare_files": f"WITH {_NODES}, c AS (SELECT id, count(*) FILTER (WHERE type IN ('function_declaration', 'function_expression')) AS f, count(*) FILTER (WHERE type = 'class_declaration') AS k FROM nodes WHERE id IN (1, 2) GROUP BY id) SELECT (max(f) - min(f))::BIGINT AS functions, (max(k) - min(k))::BIGINT AS classes FROM c",
    "code_units": f"WITH {_UNITS} SELECT id, type, name, array_to_string(parameters, ',') AS parameters, return_type, base, n_methods, n_properties, complexity, start_line, end_line, md5(content) AS digest FROM units",
    "symbol_table": f"""WITH {_UNITS}, sy AS (SELECT id, type AS kind, name, start_line AS line FROM units UNION ALL SELECT id, 'variable', regexp_extract(line, '{VARIABLE}', 1), i FROM li WHERE regexp_matches(line, '{VARIABLE}') AND NOT regexp_matches(line, '{_AH}'))
SELECT sy.id, kind, sy.name, line::BIGINT AS line, arg_max(u.name, u.start_line) AS scope FROM sy LEFT JOIN units u ON u.id = sy.id AND sy.line > u.start_line AND sy.line <= u.end_line GROUP BY ALL""",
    "syntax_node_lines": f"WITH {_NODES} SELECT id, type, md5(node) AS digest, start_line FROM nodes",
    "nodes_by_kind": f"WITH {_NODES} SELECT id, kind, count(*)::BIGINT AS n FROM nodes JOIN (VALUES ('functions', 'function_declaration'), ('functions', 'function_expression'), ('classes', 'class_declaration'), ('imports', 'import_statement'), ('exports', 'export_statement')) AS v(kind, type) USING (type) GROUP BY ALL",
    "code_summary": f"""WITH {_NODES}, s AS (SELECT id, [CASE x WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END FOR x IN string_split(regexp_replace(text, '[^{{}}]', '', 'g'), '')] AS ss FROM code), dp AS (SELECT id, greatest(0, list_max([list_sum(ss[1:k]) FOR k IN range(1, len(ss) + 1)]))::BIGINT AS max_depth FROM s)
SELECT id, count(*)::BIGINT AS n_nodes, count(DISTINCT type)::BIGINT AS n_types, any_value(max_depth) AS max_depth FROM nodes JOIN dp USING (id) GROUP BY id""",
    "expression_rules": _EXPRESSION_RULES,
    "snippet_rules": f"WITH {_RULES} SELECT rule, type, count(*)::BIGINT AS n FROM tests GROUP BY ALL",
    "code_snippets": f"WITH {_RULES} SELECT id, seq::BIGINT AS seq, rule, md5(node) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id, seq, rule) AS r FROM tests WHERE {_VALID} AND length(node) BETWEEN 20 AND 1000 AND {_V2} BETWEEN 1 AND 15) WHERE r = 1",
    "custom_rule": f"WITH {_NODES} SELECT id, md5(node) AS digest FROM nodes WHERE type = 'if_statement' AND contains(node, '> ') AND {_V2.replace('CASE WHEN regexp_matches(trim(node), ' + chr(39) + r'^\w+\([^)]*\);?$' + chr(39) + ') THEN 0 ELSE', '').replace(' END + 0.5', ' + 0.5')} > 4",
    "regex_rule_scan": f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT id, '{r['id']}' AS rule, '{r['severity']}' AS severity, i AS line_no FROM li WHERE regexp_matches(line, '{_q(r['pattern'])}')" for r in SCANNED),
    "generated_rule_scan": f"""WITH {_LINES}, w AS (
  SELECT id, i, unnest(regexp_extract_all(line, '\\b(f\\d+)\\s*\\(', 1)) AS name, 'call' AS template, 'WARNING' AS severity FROM li
  UNION ALL SELECT id, i, unnest(regexp_extract_all(line, '\\b(?:function|class|def)\\s+([fC]\\d+)\\b', 1)), 'definition', 'INFO' FROM li
  UNION ALL SELECT id, i, unnest(regexp_extract_all(line, '\\b(keep\\d+)\\s*=[^=]', 1)), 'assignment', 'WARNING' FROM li
  UNION ALL SELECT id, i, unnest([regexp_extract(line, '(D\\d+)', 1)[1:k] FOR k IN range(2, 12) IF k <= length(regexp_extract(line, '(D\\d+)', 1))]), 'text', 'INFO' FROM li WHERE regexp_matches(line, 'D\\d+'))
SELECT DISTINCT id, template || '-' || name AS rule, severity, i AS line_no FROM w JOIN part ON substr(name, CASE WHEN name LIKE 'keep%' THEN 5 ELSE 2 END) = p_partkey::VARCHAR""",
    "pure_functions": f"WITH {_UNITS}, e AS (SELECT id, ({_WRITES}) AS own, regexp_matches(c, '{'|'.join(X.PAGE_EFFECTS)}') AS page FROM (SELECT id, content AS c FROM units WHERE type = 'function')) SELECT id % 10 AS bucket, count(*)::BIGINT AS n_functions, round(avg((NOT own)::INT), 6) AS pure_by_own, round(avg((NOT page)::INT), 6) AS pure_by_page FROM e GROUP BY 1",
    "affected_files": "SELECT p_partkey AS path FROM part WHERE p_size = 7 OR p_partkey % 97 IN (SELECT p_partkey FROM part WHERE p_size = 7)",
    "resolved_calls": f"WITH {_CALLED} SELECT * FROM calls",
    "code_metrics": f"""WITH {_UNITS}, scans AS ({_SCANS.split('scans AS (', 1)[1]}, a AS (SELECT id % 10 AS project, sum({_FILLED.format('text')})::BIGINT AS loc, sum(CASE WHEN length(text) < 10 THEN 1 ELSE 1 + {_n('text', X.CONTROL)} END) AS c FROM code GROUP BY 1),
u AS (SELECT id % 10 AS project, count(*) FILTER (WHERE type = 'function')::BIGINT AS n_functions, count(*) FILTER (WHERE type = 'class')::BIGINT AS n_classes FROM units GROUP BY 1), s AS (SELECT id % 10 AS project, count(*)::BIGINT AS n_issues FROM scans GROUP BY 1)
SELECT project, loc, n_functions, n_classes, coalesce(n_issues, 0) AS n_issues, round(c / n_functions::DOUBLE, 6) AS complexity_a_function FROM a JOIN u USING (project) LEFT JOIN s USING (project)""",
    "cyclomatic_by_file": f"WITH {_CALLED}, f AS (SELECT id, count(*)::BIGINT AS n_functions, sum(complexity)::BIGINT AS complexity FROM units WHERE type = 'function' GROUP BY id), e AS (SELECT file AS id, count(*)::BIGINT AS n FROM calls GROUP BY 1) SELECT id, n_functions, complexity, coalesce(n, 0) - n_functions + 2 AS cyclomatic FROM f LEFT JOIN e USING (id)",
    "security_summary": f"""WITH {_SCANS}, {_FLOWS} SELECT a.*, b.* FROM (SELECT {', '.join(f"count(*) FILTER (WHERE severity = '{s}')::BIGINT AS {s}" for s in ('critical', 'high', 'medium', 'low'))}, count(*)::BIGINT AS n_issues, count(DISTINCT issue)::BIGINT AS n_kinds FROM scans) a, (SELECT count(DISTINCT source)::BIGINT AS taint_sources, count(DISTINCT sink)::BIGINT AS taint_sinks FROM flows) b""",
    "code_flows": f"WITH {CODE}, {_FLOWS} SELECT * FROM flows",
    "code_secrets": f"WITH {_LINES} SELECT id, i AS line_no, name FROM li JOIN (SELECT unnest({_WORD(security.SECRETS)}) AS name) ON contains(lower(line), name)",
}

# ---- the trees of the texts with traps, written out: language, seq, parent, depth, last, type, name, parameters,
# return type, base, first and last line, methods, properties

EXPECTED = """
javascript|0||0|0|import|mod%m||||1|1|0|0
javascript|1||0|1|variable|quote%k||||3|3|0|0
javascript|2||0|2|variable|mark||||3|3|0|0
javascript|3||0|19|class|Cart%k|||base.Shop%m|4|14|2|2
javascript|4|3|1|4|property|size||||5|5|0|0
javascript|5|3|1|5|property|label||||6|6|0|0
javascript|6|3|1|16|method|add|item,n,...rest|unknown||7|12|0|0
javascript|7|6|2|7|object|||||7|7|0|0
javascript|8|6|2|8|variable|text||||8|8|0|0
javascript|9|6|2|10|call|rest.map||||8|8|0|0
javascript|10|9|3|10|lambda||r|unknown||8|8|0|0
javascript|11|6|2|11|call|join||||8|8|0|0
javascript|12|6|2|16|if|||||9|11|0|0
javascript|13|12|3|13|call|mark.test||||9|9|0|0
javascript|14|12|3|16|for|||||10|10|0|0
javascript|15|14|4|15|variable|x||||10|10|0|0
javascript|16|14|4|16|call|log||||10|10|0|0
javascript|17|3|1|19|method|total||unknown||13|13|0|0
javascript|18|17|2|19|call|this.sum||||13|13|0|0
javascript|19|18|3|19|lambda||p|unknown||13|13|0|0
javascript|20||0|26|function|load%k|path,options|Promise<string>||15|25|0|0
javascript|21|20|1|25|function|read|p|Promise<void>||21|23|0|0
javascript|22|21|2|23|try|||||22|22|0|0
javascript|23|22|3|23|call|go||||22|22|0|0
javascript|24|21|2|25|catch|||||22|22|0|0
javascript|25|24|3|25|call|fail||||22|22|0|0
javascript|26|20|1|26|call|read||||24|24|0|0
javascript|27||0|27|function|twice|x|unknown||26|27|0|0
python|0||0|0|import|os||||1|1|0|0
python|1||0|1|import|pack%m.mod||||2|2|0|0
python|2||0|2|variable|LIMIT||||3|3|0|0
python|3||0|11|class|Cart%k|||Shop%m|4|20|2|1
python|4|3|1|4|property|size||||9|9|0|0
python|5|3|1|9|method|add|self,item,n,*rest|"list[int]"||11|18|0|0
python|6|5|2|6|variable|text||||12|12|0|0
python|7|5|2|9|if|||||13|16|0|0
python|8|7|3|9|for|||||16|16|0|0
python|9|8|4|9|call|log||||16|16|0|0
python|10|3|1|11|method|total|self|unknown||20|20|0|0
python|11|10|2|11|call|self.sum||||20|20|0|0
python|12||0|18|function|load%k|path,options|unknown||22|31|0|0
python|13|12|1|17|function|read|p|unknown||26|30|0|0
python|14|13|2|15|try|||||27|28|0|0
python|15|14|3|15|call|go||||28|28|0|0
python|16|13|2|17|except|||||29|30|0|0
python|17|16|3|17|call|fail||||30|30|0|0
python|18|12|1|18|call|read||||31|31|0|0
python|19||0|20|variable|done%k||||32|32|0|0
python|20|19|1|20|call|load%k||||32|32|0|0
java|0||0|0|import|java.util.Map||||2|2|0|0
java|1||0|10|class|Cart%k|||Shop%m|4|18|2|2
java|2|1|1|2|property|size||||5|5|0|0
java|3|1|1|3|property|label||||6|6|0|0
java|4|1|1|4|method|Cart%k|int n|unknown||7|7|0|0
java|5|1|1|9|method|add|final Item item,int n|unknown||9|16|0|0
java|6|5|2|9|if|||||12|14|0|0
java|7|6|3|9|while|||||13|13|0|0
java|8|7|4|8|call|item.next||||13|13|0|0
java|9|7|4|9|call|log||||13|13|0|0
java|10|1|1|10|class|Part%k||||17|17|0|0
"""
_NUMBERS = {1, 2, 3, 4, 10, 11, 12, 13}
_VALUE = lambda k, x: (x or "NULL::BIGINT") + ("::BIGINT" if x else "") if k in _NUMBERS else _literal(x)
_ROWS = ", ".join("(" + ", ".join(_VALUE(k, x) for k, x in enumerate(row.split("|"))) + ")" for row in EXPECTED.split("\n") if row)
_FILL = lambda c: f"replace(replace({c}, '%k', p_partkey::VARCHAR), '%m', (p_partkey % 7)::VARCHAR)"
_SOURCE = f"""expected AS (SELECT * FROM (VALUES {_ROWS}) AS v(language, seq, parent, depth, last, type, name, parameters, returns, base, start_line, end_line, n_methods, n_properties)),
source AS (SELECT p_partkey, p_partkey AS id, CASE p_partkey % 3 {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LANGUAGES))} END AS language, CASE p_partkey % 3 {' '.join(f"WHEN {k} THEN {_made(x)}" for k, x in enumerate(LANGUAGES.values()))} END AS text FROM part),
tree AS (SELECT id, p_partkey, text, seq, parent, depth, last, type, {_FILL('name')} AS name, parameters, returns, {_FILL('base')} AS base, start_line, end_line, n_methods, n_properties FROM source JOIN expected USING (language))"""
_ABOVE = f"""{_SOURCE}, up AS (SELECT id, seq, parent AS above, 1 AS steps FROM tree WHERE parent IS NOT NULL UNION ALL SELECT u.id, u.seq, t.parent, steps + 1 FROM up u JOIN tree t ON t.id = u.id AND t.seq = u.above WHERE t.parent IS NOT NULL),
pairs AS (SELECT u.id, u.seq, u.steps, a.seq AS above, a.type, a.name, a.depth FROM up u JOIN tree a ON a.id = u.id AND a.seq = u.above)"""
SQL |= {
    "source_units": f"""WITH {_SOURCE} SELECT id, type, name, CASE WHEN type <> 'class' THEN replace(parameters, ',', '|') END AS parameters, nullif(returns, '') AS return_type, nullif(base, '') AS base,
  CASE WHEN type = 'class' THEN n_methods END AS n_methods, CASE WHEN type = 'class' THEN n_properties END AS n_properties, start_line, end_line, md5(array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10))) AS digest
FROM tree WHERE type IN ('function', 'class', 'method')""",
    "source_tree": f"WITH {_SOURCE} SELECT id, seq, parent, depth, last, type, name, start_line, end_line FROM tree",
    "source_symbols": f"""WITH RECURSIVE {_ABOVE} SELECT t.id, t.type AS kind, t.name, t.start_line AS line, arg_max(p.name, p.depth) AS scope FROM tree t LEFT JOIN pairs p ON p.id = t.id AND p.seq = t.seq AND p.type IN ('function', 'class', 'method')
WHERE t.type IN ('function', 'class', 'method', 'variable', 'property') GROUP BY t.id, t.seq, t.type, t.name, t.start_line""",
    "source_summary": f"WITH {_SOURCE}, b AS (SELECT id, type, count(*) AS n, max(depth) AS d FROM tree GROUP BY id, type) SELECT id, sum(n)::BIGINT AS n_nodes, max(d) AS max_depth, '{{' || string_agg('\"' || type || '\":' || n, ',' ORDER BY type) || '}}' AS by_type FROM b GROUP BY id",
    "source_paths": f"""WITH RECURSIVE {_ABOVE}, hits AS (
  SELECT '//class/method' AS query, t.name FROM tree t JOIN pairs p USING (id, seq) WHERE t.type = 'method' AND p.type = 'class' AND steps = 1
  UNION ALL SELECT '//class//if', t.name FROM tree t WHERE t.type = 'if' AND EXISTS (SELECT 1 FROM pairs p WHERE p.id = t.id AND p.seq = t.seq AND p.type = 'class')
  UNION ALL SELECT '//method/if/for/call', t.name FROM tree t JOIN pairs a USING (id, seq) JOIN pairs b USING (id, seq) JOIN pairs c USING (id, seq) WHERE t.type = 'call' AND a.steps = 1 AND a.type = 'for' AND b.steps = 2 AND b.type = 'if' AND c.steps = 3 AND c.type = 'method'
  UNION ALL SELECT '//function//function', t.name FROM tree t WHERE t.type = 'function' AND EXISTS (SELECT 1 FROM pairs p WHERE p.id = t.id AND p.seq = t.seq AND p.type = 'function')
  UNION ALL SELECT '/class/property[size]', t.name FROM tree t JOIN pairs p USING (id, seq) WHERE t.type = 'property' AND t.name = 'size' AND p.type = 'class' AND t.depth = 1
  UNION ALL SELECT '//class//call[log]', t.name FROM tree t WHERE t.type = 'call' AND t.name = 'log' AND EXISTS (SELECT 1 FROM pairs p WHERE p.id = t.id AND p.seq = t.seq AND p.type = 'class')
  UNION ALL SELECT '/*/try', t.name FROM tree t WHERE t.type = 'try' AND t.depth = 1)
SELECT query, name, count(*)::BIGINT AS n FROM hits GROUP BY ALL""",
}
