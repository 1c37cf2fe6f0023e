"""Chunks, syntax nodes and snippets of source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import structure

MOST, LEAST = 1000, 100


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, least: int = LEAST, compat: bool = False) -> DataFrame:
    """(key, chunk, content, start_line, end_line): lines gathered until they reach ``most`` characters.

    A rest under ``least`` characters is dropped unless nothing came before it. With ``compat`` every chunk but the
    first is numbered from one line early. The fold sees line lengths only; the texts are sliced after it.
    """
    ls = F.split(F.col(text), "\n")
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(-1).cast("long").alias("n"), F.array().cast("array<struct<b:int,e:int>>").alias("out"))

    def step(s: Column, length: Column) -> Column:
        n = s["n"] + 1 + length
        last = s["at"] == F.size(F.split(F.col(text), "\n")) - 1
        close = (n >= most) | last
        emit = close & ((n >= least) | (last & (F.size(s["out"]) == 0)))
        piece = F.array(F.struct(s["begin"].alias("b"), s["at"].alias("e")))
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(close, s["at"] + 1).otherwise(s["begin"]).alias("begin"),
            F.when(close, F.lit(-1).cast("long")).otherwise(n).alias("n"),
            F.when(emit, F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"),
        )

    cut = F.aggregate(F.transform(ls, lambda x: F.length(x).cast("long")), state, step, lambda s: s["out"])
    got = docs.select(key, ls.alias("_ls"), F.posexplode(cut).alias("chunk", "c"))
    first = F.col("c.b") + 1 - (F.when(F.col("chunk") > 0, 1).otherwise(0) if compat else 0)
    size = F.col("c.e") - F.col("c.b") + 1
    return got.select(key, "chunk", F.array_join(F.slice("_ls", F.col("c.b") + 1, size), "\n").alias("content"), first.alias("start_line"), (first + size - 1).alias("end_line"))


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the hash, the non-blank lines and the complexity of the text."""
    c = F.col(text)
    return docs.withColumns({"hash": F.sha2(c, 256), "loc": X.filled_lines(c).cast("long"), "complexity": X.complexity(c)})


#: Node types and the patterns that find them.
NODE_PATTERNS = (
    ("if_statement", r"\bif\s*\([^)]*\)\s*(\{[^}]*\}|[^\n;]*;?)"),
    ("else_clause", r"\belse\s*(\{[^}]*\}|[^\n;]*;?)"),
    ("for_statement", r"\bfor\s*\([^)]*\)\s*(\{[^}]*\}|[^\n;]*;?)"),
    ("while_statement", r"\bwhile\s*\([^)]*\)\s*(\{[^}]*\}|[^\n;]*;?)"),
    ("do_statement", r"\bdo\s*(\{[^}]*\}|[^\n;]*;?)\s*while\s*\([^)]*\);?"),
    ("switch_statement", r"\bswitch\s*\([^)]*\)\s*\{[^}]*\}"),
    ("try_statement", r"\btry\s*\{[^}]*\}\s*catch\s*\([^)]*\)\s*\{[^}]*\}\s*(?:finally\s*\{[^}]*\})?"),
    ("try_statement", r"\btry\s*\{[^}]*\}[\s\S]*?catch\s*\([^)]*\)\s*\{[^}]*\}"),
    ("try_statement", r"\btry\s*\{[^}]*\}"),
    ("throw_statement", r"\bthrow\s+[^;\n]*;?"),
    ("call_expression", r"\w+(?:\.\w+)*\([^)]*\)(?:\s*\.\s*\w+\([^)]*\))+"),
    ("call_expression", r"\w+(?:\.\w+)*\([^)]*\)"),
    ("function_declaration", r"function\s+\w+"),
    ("function_expression", r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\s*\("),
    ("class_declaration", r"class\s+\w+"),
    ("import_statement", r"import\s+.*?from\s+['\"`][^'\"`]+['\"`]"),
    ("export_statement", r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+\w+"),
    ("comment", r"(?i)//.*?(?:@snippet|@code|@example|SNIPPET:|EXAMPLE:)"),
    ("comment", r"(?i)/\*[\s\S]*?(?:@snippet|@code|@example|SNIPPET:|EXAMPLE:)[\s\S]*?\*/"),
)
FUNCTION_TYPES = ("function_declaration", "function_expression")


#: The node types that count as functions, classes, imports and exports.
KINDS = {"functions": FUNCTION_TYPES, "classes": ("class_declaration",), "imports": ("import_statement",), "exports": ("export_statement",)}


#: Expressions, and constructs of other languages and of build and pipeline files, each as the language writes it.
EXPRESSIONS = (
    ("template_string", r"`[^`]*`"),
    ("destructuring", r"\b(?:const|let|var)\s+[\[{][^=;]*=\s*[^;\n]+;?"),
    ("object", r"=\s*\{[^{}]*\}"),
    ("array", r"=\s*\[[^\[\]]*\]"),
    ("assignment", r"(?m)^[ \t]*[\w.]+\s*[-+*/%]?=\s*[^=\s][^\n;]*;"),
    ("declaration", r"\b(?:const|let|var)\s+\w+\s*=\s*[^\n;]*;"),
    ("sequence", r"(?m)^[ \t]*[\w.]+\s*=\s*\w+\s*,\s*[^\n;]+;|\bfor\s*\([^;)]*,[^;)]*;"),
    ("block", r"(?m)^\{[^{}]*\}"),
    ("comprehension", r"[\[{][^\[\]{}\n]*\bfor\s[^\[\]{}\n]*\bin\s[^\[\]{}\n]*[\]}]"),
    ("stream", r"\.stream\(\)(?:\s*\.\s*\w+\([^()]*(?:\([^()]*\)[^()]*)*\))+"),
    ("thin_arrow", r"(?:\([^()\n]*\)|\b\w+)\s*->\s*[^;\n]+"),
    ("goroutine", r"\bgo\s+(?:func\([^)]*\)\s*\{[^}]*\}\s*\([^)]*\)|\w+(?:\.\w+)*\([^)]*\))"),
    ("channel", r"\w+\s*<-\s*\w+|\bmake\(chan\b[^)]*\)"),
    ("go_interface", r"\btype\s+\w+\s+interface\s*\{[^}]*\}"),
    ("build_line", r"(?m)^[ \t]*(?:implementation|api|testImplementation|compileOnly|repositories|plugins)\b[^\n]*|<(?:dependency|plugin|artifactId|version)>"),
    ("pipeline_line", r"(?m)^[ \t-]*(?:on|name|runs-on|uses|stages|jobs|script|steps)[ \t]*:[^\n]*"),
)


def syntax_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns=NODE_PATTERNS, lines: bool = True) -> DataFrame:
    """(key, type, seq, node, start_line): the flat node list, in order of pattern and place; lines count from 1.

    A node's line follows from the line feeds in what stands between the matches and in the matches before it; each
    text is searched once more for it. Without ``lines`` there is no start_line, and one search a pattern.
    """
    c = F.col(text)
    feeds = lambda xs: F.transform(xs, lambda x: F.regexp_count(x, F.lit("\n")))
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  (worked out once, however often it is used)

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit(X.ascii_edges(pattern)), F.lit(0))

    def lined(kind: str, pattern: str) -> Column:
        node = lambda h, k, between, inside: F.struct(F.lit(kind).alias("type"), h.alias("node"), (1 + total(between, k + 1) + total(inside, k)).cast("long").alias("line"))
        between = feeds(F.split(c, X.ascii_edges(pattern)))
        made = lambda hits: bind(F.struct(between.alias("b"), feeds(hits).alias("i")), lambda s: F.transform(hits, lambda h, k: node(h, k, s["b"], s["i"])))
        return bind(found(pattern), lambda hits: F.when(F.size(hits) > 0, made(hits)).otherwise(F.array().cast("array<struct<type:string,node:string,line:bigint>>")))

    def plain(kind: str, pattern: str) -> Column:
        return F.transform(found(pattern), lambda h: F.struct(F.lit(kind).alias("type"), h.alias("node")))

    lists = [(lined if lines else plain)(kind, pattern) for kind, pattern in patterns]
    got = docs.select(key, F.posexplode(F.concat(*lists)).alias("seq", "n"))
    return got.select(key, F.col("n.type").alias("type"), "seq", F.col("n.node").alias("node"), *([F.col("n.line").alias("start_line")] if lines else []))


def nodes_of(nodes: DataFrame, kind: str) -> DataFrame:
    """The functions, classes, imports or exports among the nodes."""
    return nodes.where(F.col("type").isin(*KINDS[kind]))


def count_kinds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, n): how many functions, classes, imports and exports a text has, where it has any: one pass over the texts, by the patterns of these kinds alone."""
    wanted = {t for types in KINDS.values() for t in types}
    nodes = syntax_nodes(docs, key, text, [(t, p) for t, p in NODE_PATTERNS if t in wanted], lines=False)
    kinds = F.array(*[F.when(F.col("type").isin(*types), F.lit(kind)) for kind, types in KINDS.items()])
    found = nodes.select(key, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return found.groupBy(key, "kind").agg(F.count("*").alias("n"))


# ---- functions and classes

#: The types of nodes that are units, and what they count as.
UNITS = {"function": "function", "class": "class"}


def code_units(docs: DataFrame, key: str = "doc_id", text: str = "text", language: Column | str = "javascript", methods: bool = False) -> DataFrame:
    """(key, type, name, parameters, return_type, base, n_methods, n_properties, complexity, start_line, end_line, content).

    Functions with a name and classes, by the tree of the text; their content is whole lines, from the line of the head
    to that of the end. ``methods`` adds the methods of classes and objects.
    """
    kinds = [*UNITS, *(["method"] if methods else [])]
    name = F.lit(language) if isinstance(language, str) else language
    ls = X.lines(F.col(text))
    nodes = F.filter(structure.nodes(F.col(text), name), lambda n: n["type"].isin(kinds))
    # Lines are taken inside the row, so that each unit carries its own and no other.
    cut = F.transform(nodes, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(ls, n["start_line"].cast("int"), (n["end_line"] - n["start_line"] + 1).cast("int")), "\n").alias("content")))
    rows = docs.select(key, F.explode(cut).alias("u")).select(key, "u.n.*", F.col("u.content").alias("content"))
    is_class = F.col("type") == "class"
    return rows.select(
        key, "type", "name", "parameters", F.col("returns").alias("return_type"), "base",
        *[F.when(is_class, F.col(c)).alias(c) for c in ("n_methods", "n_properties")],
        X.complexity(F.col("content")).alias("complexity"), "start_line", "end_line", "content",
    )


def count_units(text: Column, language: Column | str = "javascript") -> Column:
    """How many functions and classes ``code_units`` finds in a text, as a struct (n_functions, n_classes): nothing but types leaves Python."""
    types = structure.types(text, F.lit(language) if isinstance(language, str) else language)
    n = lambda ts, unit: F.size(F.filter(ts, lambda t: t == unit)).cast("long")
    return F.element_at(F.transform(F.array(types), lambda ts: F.struct(n(ts, "function").alias("n_functions"), n(ts, "class").alias("n_classes"))), 1)


def symbols(docs: DataFrame, key: str = "doc_id", text: str = "text", language: Column | str = "javascript", methods: bool = False) -> DataFrame:
    """(key, kind, name, line, scope): functions, classes and variables with the innermost unit around them; a unit is not its own scope. ``methods`` makes methods units and properties symbols too."""
    units = [*UNITS, *(["method"] if methods else [])]
    kinds = [*units, "variable", *(["property"] if methods else [])]
    nodes = structure.tree(docs, key, text, language).where(F.col("type").isin(kinds))
    return nodes.select(key, F.col("type").alias("kind"), "name", F.col("start_line").alias("line"), structure.enclosing(tuple(units)).alias("scope"))


def affected(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """(path): the changed files (path) and those that import one of them (path, imported)."""
    direct = imports.join(changed.select(F.col("path").alias("imported")), "imported", "left_semi").select("path")
    return changed.select("path").union(direct).distinct()


def node_summary(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_nodes, by_type)."""
    by = nodes.groupBy(key, "type").agg(F.count("*").alias("n"))
    return by.groupBy(key).agg(F.sum("n").alias("n_nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def depth(text: Column) -> Column:
    """How deep braces are nested, at most."""
    signs = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, state, step, lambda s: s["most"])


def search_nodes(nodes: DataFrame, type: str | None = None, name: str | None = None, contains: str | None = None) -> DataFrame:
    """Nodes by ``//type`` or type, by a name in their text, by a text."""
    if type:
        nodes = nodes.where(F.col("type") == type.removeprefix("//"))
    if name:
        nodes = nodes.where(F.col("node").rlike(rf"(?:function|class)\s+{name}\b"))
    return nodes.where(F.contains("node", F.lit(contains))) if contains else nodes


def compare(nodes: DataFrame, a, b, key: str = "doc_id") -> DataFrame:
    """How far two files' numbers of functions and of classes are apart."""
    n = lambda f, *kinds: F.count_if((F.col(key) == f) & F.col("type").isin(*kinds))
    return nodes.where(F.col(key).isin(a, b)).agg(F.abs(n(a, *FUNCTION_TYPES) - n(b, *FUNCTION_TYPES)).alias("functions"), F.abs(n(a, "class_declaration") - n(b, "class_declaration")).alias("classes"))


MARKER = r"(?i)@snippet|@code|@example|SNIPPET:|EXAMPLE:"


def marked_snippets(docs: DataFrame, key: str = "doc_id", text: str = "text", marker: str = MARKER, context: int = 2) -> DataFrame:
    """(key, marker_line, content, around): the lines after a marker up to a blank line or the next marker, and two lines on either side."""
    ls = F.split(F.col(text), "\n")
    rows = docs.select(key, ls.alias("_ls"), F.posexplode(ls).alias("i", "line")).where(F.col("line").rlike(marker))
    after = F.slice("_ls", F.col("i") + 2, F.greatest(F.size("_ls") - F.col("i") - 1, F.lit(0)))
    ends = F.filter(F.transform(after, lambda x, k: F.when((F.trim(x) == "") | x.rlike(marker), k)), lambda k: k.isNotNull())
    n = F.coalesce(F.get(ends, F.lit(0)), F.size(after))
    got = rows.select(key, "_ls", "i", n.alias("n"), F.slice(after, 1, n).alias("body")).where("n > 0")
    first = F.greatest(F.col("i") + 1 - context, F.lit(0))
    before = F.slice("_ls", first + 1, F.col("i") + 1 - first)
    behind = F.slice("_ls", F.col("i") + 2 + F.col("n"), F.lit(context))
    return got.select(key, (F.col("i") + 1).cast("long").alias("marker_line"), F.array_join("body", "\n").alias("content"), F.array_join(F.concat(before, behind), "\n").alias("around"))


def distinct_snippets(snippets: DataFrame, order: list[str], text: str = "content") -> DataFrame:
    """Snippets of complexity 1 to 15 and 20 to 1000 characters, of equal texts the first; a text that many share is reduced on the map side."""
    ok = snippets.where(X.snippet_complexity(F.col(text)).between(1, 15) & F.length(text).between(20, 1000))
    rest = [c for c in snippets.columns if c not in order]
    first = ok.groupBy(F.sha2(text, 256).alias("_d")).agg(F.min(F.struct(*order, *rest)).alias("_s"))
    return first.select(*[F.col(f"_s.{c}").alias(c) for c in snippets.columns])
