"""Snippet rules and custom rules: node type and content tests as Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.graph import saved

CONTROL = ("if_statement", "else_clause", "for_statement", "while_statement", "do_statement", "switch_statement")
CALLS = ("call_expression",)
FUNCTIONS = ("function_declaration", "function_expression")
IMPORTS = ("import_statement", "export_statement")
CODE = (*FUNCTIONS, "class_declaration", *CALLS, *IMPORTS)

# A test is a tuple: ("has", pattern), ("not", test), ("all", tests ...), ("any", tests ...), ("lines", n) for more than
# n lines that are not blank, ("longer", n) for more than n characters, ("twice", pattern) for two places at least.


def has(*patterns: str) -> tuple:
    """Whether one of the patterns is found."""
    return ("any", *(("has", p) for p in patterns))


def column(test: tuple, c: Column) -> Column:
    """A test as a Column over a text."""
    kind, *rest = test
    match kind:
        case "has":
            return c.rlike(X.ascii_edges(rest[0]))
        case "twice":
            return X.count(c, rest[0]) >= 2
        case "lines":
            return X.filled_lines(c) > rest[0]
        case "longer":
            return F.length(c) > rest[0]
        case "not":
            return ~column(rest[0], c)
        case "all":
            return reduce(lambda a, b: a & b, [column(t, c) for t in rest])
        case "any":
            return reduce(lambda a, b: a | b, [column(t, c) for t in rest])
    raise ValueError(f"no test {kind!r}")


def framework(*names: str, types: tuple[str, ...] = CODE) -> tuple:
    """A rule for code that uses a framework: it names one of its modules, decorators or calls."""
    return types, has(*names)


#: Control structures that are trivial, and calls that are simple.
TRIVIAL_CONTROL = (
    r"if\s*\([^)]*\)\s*\w+;\s*$",
    r"if\s*\([^)]*\)\s*\{\s*\w+;\s*\}",
    r"for\s*\(;;\)\s*\{\s*\}",
    r"while\s*\([^)]*\)\s*;",
)
SIMPLE_CALLS = (
    r"^[a-zA-Z_]\w*\(\s*\)$",
    r"^[a-zA-Z_]\w*\(\s*[a-zA-Z_]\w*\s*\)$",
    r"console\.(log|error|warn|info)\(",
    r"return\s+[a-zA-Z_]\w*\(\s*\);?$",
)

#: rule: (node types, test of the node's text). Rules for frameworks name what their own documentation introduces them by.
RULES = {
    "control_structure": (CONTROL, ("all", ("any", ("lines", 1), has(r"&&", r"\|\|", r"\?\s*:")), ("not", has(*TRIVIAL_CONTROL)))),
    "error_handling": (("try_statement", "throw_statement"), has(r"\b(try|throw)\b")),
    "function_call_chain": (CALLS, ("all", ("not", has(*SIMPLE_CALLS)), ("any", has(r"\)\s*\.\s*\w+\s*\(", r"\([^()]*[,{\[.][^()]*\)", r"\bawait\b", r"\bPromise\b", r"=>", r"\bfunction\b"), ("all", has(r"\."), ("longer", 15))))),
    "comment_marked": (("comment",), has(r"(?i)@snippet|@code|@example|SNIPPET:|EXAMPLE:")),
    "async_pattern": ((*CALLS, *FUNCTIONS), has(r"\basync\b", r"\bawait\b", r"\.then\(", r"\.catch\(", r"\bPromise\.(all|any|race|allSettled)\(")),
    "decorator_pattern": (("class_declaration",), has(r"@\w+")),
    "functional_programming": ((*CALLS, "function_expression"), ("any", has(r"\.(map|reduce|flatMap)\("), ("twice", r"\.filter\(|=>|\blambda\b"))),
    "generic_pattern": (("class_declaration",), has(r"<\s*[A-Z]\w*(\s+extends\s+\w+)?\s*[,>]")),
    "react_component": framework(r"\bfrom\s+['\"]react['\"]", r"\buse[A-Z]\w*\(", r"\bReactDOM\.", r"\bextends\s+(React\.)?(Pure)?Component\b"),
    "vue_component": framework(r"\bfrom\s+['\"]vue['\"]", r"\b(defineComponent|createApp)\(", r"\bwatchEffect\("),
    "angular_component": framework(r"@angular/\w+", r"@(Component|Injectable|NgModule)\("),
    "express_route": framework(r"\bexpress\(\)", r"\bexpress\.Router\(", r"\b(app|router)\.(get|post|put|patch|delete|use)\(", types=(*CALLS, *FUNCTIONS, *IMPORTS)),
    "django_model": framework(r"\bdjango\b", r"\bmodels\.\w+Field\(", r"\burlpatterns\b", types=(*CALLS, *IMPORTS)),
    "fastapi_route": framework(r"\b[Ff]ast[Aa][Pp][Ii]\b", r"\bAPIRouter\(", r"\bDepends\(", types=(*CALLS, *IMPORTS)),
    "data_manipulation": framework(r"\b(pandas|numpy)\b", r"\bDataFrame\(", r"\.(groupby|merge|pivot_table)\(", types=(*CALLS, *IMPORTS)),
    "pytorch_neural_network": framework(r"\btorch\b", r"\bnn\.(Module|Linear|Conv2d)\b", r"\.backward\(\)", types=(*CALLS, *IMPORTS)),
    "pytest_test": framework(r"\bpytest\b", r"\btest_\w+\(", types=(*CALLS, *IMPORTS)),
    "spring_boot_controller": framework(r"@(RestController|SpringBootApplication|Autowired)\b", r"@(Get|Post|Put|Delete|Request)Mapping\b", types=("class_declaration",)),
    "junit_test": framework(r"@(Test|BeforeEach|AfterEach)\b", r"\bassert(Equals|True|Throws)\(", types=("class_declaration", *CALLS)),
    "go_web_framework": framework(r"\b(gin|echo|fiber)\.New\(", r"\bgin\.Default\(", r"\bhttp\.(HandleFunc|ListenAndServe)\(", types=(*CALLS, *FUNCTIONS)),
    "docker_containerization": framework(r"\bFROM\s+\w+", r"\bdocker(file|-compose)?\b", types=("comment",)),
    "package_management": framework(r"\bpackage\.json\b", r"\b(npm|yarn|pnpm)\s+\w+", types=("comment",)),
}


#: Rules for expressions and for languages and files of other kinds, over the nodes of ``chunking.EXPRESSIONS``.
EXPRESSION_RULES = {
    "template_literal": (("template_string",), has(r"\$\{[^}]+\}")),
    "destructuring_assignment": (("destructuring",), has(r"[\[{]\s*[\w.]+\s*[,:=}\]]")),
    "object_array_literal": (("object", "array"), ("any", ("longer", 30), ("twice", r":|,"))),
    "arithmetic_logical": (("assignment", "declaration"), ("twice", r"[-+*/%]|&&|\|\||<=|>=")),
    "expression_sequence": (("sequence",), ("twice", r"[=(]")),
    "logic_block": (("block",), ("all", ("lines", 2), ("any", has(r"\breturn\b", r"\b(if|for|while|switch)\b", r"=")))),
    "python_comprehension": (("comprehension",), has(r"\bfor\s+[\w, ]+\s+in\b")),
    "java_stream": (("stream",), has(r"\.(map|filter|collect|reduce|flatMap|forEach|sorted)\(")),
    "java_lambda": (("thin_arrow",), ("not", has(r"->\s*\{\s*\}"))),
    "go_goroutine": (("goroutine", "channel"), ("any", has(r"<-", r"\bmake\(chan\b"), has(r"\bgo\s+\w"))),
    "go_interface": (("go_interface",), has(r"\n\s*\w+\([^)]*\)")),
    "java_build_systems": (("build_line",), has(r"\b(implementation|api|testImplementation|compileOnly)\b\s*[('\"]", r"<(dependency|plugin|artifactId)>")),
    "cicd_configuration": (("pipeline_line",), has(r"\b(runs-on|uses|stages|jobs|script|steps)\s*:")),
}


def match(nodes: DataFrame, rules: dict | None = None, text: str = "node") -> DataFrame:
    """``nodes`` times the rules that they meet: all rules are tested in one pass over the rows."""
    rules = rules or RULES
    tests = [F.when(F.col("type").isin(*types) & column(test, F.col(text)), F.lit(name)) for name, (types, test) in rules.items()]
    hit = F.filter(F.array(*tests), lambda r: r.isNotNull())
    return nodes.select("*", F.explode(hit).alias("rule"))


def snippets(nodes: DataFrame, language: Column | str = "javascript", rules: dict | None = None) -> DataFrame:
    """The matches that are valid snippets of their rule's type."""
    lang = F.lit(language) if isinstance(language, str) else language
    return match(nodes, rules).where(X.valid_snippet(F.col("node"), F.col("rule"), lang))


# ---- custom rules, given as data

FEATURES = {"async": "usesAsync", "generators": "usesGenerators", "destructuring": "usesDestructuring", "spread": "usesSpread", "templateLiterals": "usesTemplateLiterals"}
TESTS = {
    "equals": lambda c, v: c.cast("string") == str(v), "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))), "matches": lambda c, v: c.cast("string").rlike(str(v)),
    "greaterThan": lambda c, v: c.cast("double") > float(v), "lessThan": lambda c, v: c.cast("double") < float(v),
}


def custom(rule: dict, type: str = "type", text: str = "node") -> Column:
    """The predicate of a rule ``{"target", "conditions": [{"type", "operator", "value"}]}``: of each condition type the first counts."""
    c = F.col(text)
    subject = {"nodeType": lambda v: F.col(type), "contentPattern": lambda v: c, "complexity": lambda v: X.snippet_complexity(c, always_calls=True), "languageFeature": lambda v: X.language_features(c)[FEATURES[v]]}
    seen: dict[str, Column] = {}
    for x in rule["conditions"]:
        if x["type"] not in seen:
            value = "true" if x["type"] == "languageFeature" else x["value"]
            seen[x["type"]] = TESTS[x.get("operator", "equals" if x["type"] != "contentPattern" else "contains")](subject[x["type"]](x["value"]), value)
    target = [F.col(type) == rule["target"]] if rule.get("target") else []
    return reduce(lambda a, b: a & b, [*target, *seen.values()], F.lit(True))


def validate(rule: dict) -> list[str]:
    """What is wrong with a custom rule."""
    out = [f"{k} is missing" for k in ("name", "target", "conditions") if not rule.get(k)]
    for x in rule.get("conditions") or []:
        if x.get("type") not in ("nodeType", "contentPattern", "complexity", "languageFeature"):
            out.append(f"no condition type {x.get('type')!r}")
        if x.get("operator", "equals") not in TESTS:
            out.append(f"no operator {x.get('operator')!r}")
    return out


# ---- custom rules, given as text

_WORD = re.compile(r'"(?P<text>[^"]*)"|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[{}:(),.])|(?P<gap>[ \t\r\n]+)')


def parse(source: str) -> dict:
    """A rule text, ``rule "name" { description: target: condition { } action { } }``, as a rule for ``custom``.

    A condition is ``type: "value"`` or ``type: operator(value)``; an action has a type and parameters.
    """
    words, at = [], 0
    while at < len(source):
        m = _WORD.match(source, at)
        if not m:
            raise ValueError(f"unexpected character {source[at]!r}")
        if m.lastgroup != "gap":
            words.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    words.reverse()

    def take(*wanted: str) -> str:
        kind, word = words.pop() if words else ("end", "")
        if kind not in wanted and word.lower() not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)}, found {word!r}")
        return word

    def ahead(word: str) -> bool:
        return bool(words) and words[-1][1].lower() == word

    def named(word: str, kind: str = "text") -> str:
        take(word), take(":")
        return take(kind)

    def block(word: str, entry) -> list:
        take(word), take("{")
        found = []
        while not ahead("}"):
            found.append(entry())
        take("}")
        return found

    def condition() -> dict:
        kind = take("name")
        take(":")
        if words and words[-1][0] == "name":
            operator = take("name")
            take("(")
            value = take("text", "number")
            take(")")
            return {"type": kind, "operator": operator, "value": value}
        return {"type": kind, "operator": "equals", "value": take("text", "number")}

    def parameters() -> dict:
        def entry() -> tuple:
            key = take("name", "text")
            take(":")
            value = take("text", "number", "name")
            if ahead(","):
                take(",")
            return key, {"true": True, "false": False}.get(value, value)

        take("parameters"), take(":"), take("{")
        found = {}
        while not ahead("}"):
            key, value = entry()
            found[key] = value
        take("}")
        return found

    take("rule")
    rule = {"name": take("text")}
    take("{")
    rule |= {"description": named("description"), "target": named("target"), "conditions": block("condition", condition), "actions": []}
    while ahead("action"):
        take("action"), take("{")
        action = {"type": named("type", "name"), "parameters": {}}
        if ahead("parameters"):
            action["parameters"] = parameters()
        take("}")
        rule["actions"].append(action)
    take("}")
    return rule


def versioned(versions: DataFrame) -> DataFrame:
    """Of rule texts (name, version, source) the one of the largest version."""
    return versions.groupBy("name").agg(F.max("version").alias("version"), F.max_by("source", "version").alias("source"), F.count("*").alias("n_versions"))


def scan(docs: DataFrame, rules: list[dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, severity, message, line_no) of rules ``{"id", "severity", "message", "pattern"}``: each line that a pattern is found in. All rules are tested in one pass."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    tests = [F.when(F.col("line").rlike(X.ascii_edges(r["pattern"])), F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(r["message"]).alias("message"))) for r in rules]
    hit = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return lines.select(key, (F.col("n") + 1).cast("long").alias("line_no"), hit.alias("x")).select(key, "x.*", "line_no")


def required(pattern: str) -> str:
    """The longest text, in small letters, that all that the pattern finds must hold; "" if there is none to be seen."""
    best, run = "", ""

    def flush() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
            elif name == "AT":
                continue
            elif name == "SUBPATTERN":
                walk(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                flush()
                walk(value[2])
                flush()
            else:
                flush()

    walk(re._parser.parse(pattern))
    flush()
    return best


#: Letters that tell where a required text can begin; of its beginnings there are as many as the letters allow, however many rules there are.
HEAD = 2
#: Patterns that a task keeps compiled; equal ones come one after the other.
COMPILED = 4096


def scan_table(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, severity, message, line_no) of a table of rules (id, severity, message, pattern): as ``scan``, for thousands or millions of rules in one pass.

    A rule meets the lines that hold its required text, by a join: of a line, those pieces are looked up that begin as
    some required text does and are as long as one of those. Only the beginnings and lengths (``HEAD`` letters) go to
    the driver and every task. Rules that require nothing are tried on every line. Null texts hold nothing; a rule whose
    id is there twice counts twice.
    """
    need = F.pandas_udf(lambda ps: ps.map(required), "string")
    listed = saved(rules.select(F.col("id").alias("_id"), F.col("severity").alias("_severity"), F.col("message").alias("_message"), F.col("pattern").alias("_pattern"), need("pattern").alias("_need")))
    listed = listed.withColumn("_need", F.when(F.length("_need") >= HEAD, F.col("_need")))
    shapes = listed.where("_need IS NOT NULL").groupBy(F.substring("_need", 1, HEAD).alias("head")).agg(F.sort_array(F.collect_set(F.length("_need"))).alias("lengths"))
    lengths = {r.head: r.lengths for r in shapes.collect()}
    heads = re.compile("(?=(" + "|".join(map(re.escape, sorted(lengths))) + "))" if lengths else r"(?!)", re.DOTALL)

    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            for at in range(0, len(part), 256):
                yield pd.Series([[{"line": n, "piece": p} for n, line in enumerate((t or "").split("\n"), 1) for p in _pieces(line.lower(), heads, lengths)] for t in part[at : at + 256]], dtype=object)

    lines = docs.select(key, F.split(text, "\n").alias("_ls"), F.explode(F.pandas_udf(pieces, "array<struct<line:bigint,piece:string>>")(F.col(text))).alias("_x"))
    looks = lines.select(key, F.col("_x.line").alias("line_no"), F.get("_ls", (F.col("_x.line") - 1).cast("int")).alias("_line"), F.col("_x.piece").alias("_need"))
    met = looks.join(listed.where("_need IS NOT NULL").hint("merge"), "_need")  # neither side is sent whole to the driver
    every = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "_line")).select(key, (F.col("_n") + 1).cast("long").alias("line_no"), "_line")
    tried = every.crossJoin(listed.where("_need IS NULL").drop("_need"))  # as many as there are, since each can be found anywhere
    out = (key, F.col("_id").alias("rule"), F.col("_severity").alias("severity"), F.col("_message").alias("message"), "line_no")
    found = F.pandas_udf(_found, "boolean")("_pattern", "_line")
    return met.where(found).select(*out).unionByName(tried.where(found).select(*out))


def _pieces(line: str, heads: re.Pattern, lengths: dict[str, list[int]]) -> set[str]:
    """The parts of a line that begin with a head and are as long as some text of that head."""
    return {line[m.start() : m.start() + n] for m in heads.finditer(line) for n in lengths[m[1]] if m.start() + n <= len(line)}


def _found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether patterns are found in lines."""
    test = lru_cache(COMPILED)(lambda p: re.compile(p, re.ASCII).search)
    for patterns, lines in batches:
        yield pd.Series([test(p)(line) is not None for p, line in zip(patterns, lines, strict=True)], dtype=bool)


#: Templates of rules: what is made of a name. A name is taken as it is, whatever signs it holds.
TEMPLATES = {
    "call": ("WARNING", "calls {name}", r"\b{name}\s*\("),
    "definition": ("INFO", "defines {name}", r"\b(?:function|class|def)\s+{name}\b"),
    "assignment": ("WARNING", "assigns {name}", r"\b{name}\s*=[^=]"),
    "import": ("INFO", "imports {name}", r"\b(?:import|from|require)\b.*\b{name}\b"),
    "text": ("INFO", "mentions {name}", r"{name}"),
}


def generated(names: DataFrame) -> DataFrame:
    """(id, severity, message, pattern): a rule for each row (template, name)."""
    quoted = F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1")
    fill = lambda k, c: F.coalesce(*[F.when(F.col("template") == t, F.replace(F.lit(x[k]), F.lit("{name}"), c)) for t, x in TEMPLATES.items()])
    made = names.select(F.concat_ws("-", "template", "name").alias("id"), fill(0, F.lit("")).alias("severity"), fill(1, F.col("name")).alias("message"), fill(2, quoted).alias("pattern"))
    return made.where("pattern IS NOT NULL")


def check_rules(rules: DataFrame) -> DataFrame:
    """(id, problem) of rules (id, severity, message, pattern): what is missing, an unknown severity, a pattern that is none."""

    def broken(patterns: pd.Series) -> pd.Series:
        out = []
        for p in patterns:
            try:
                re.compile(p or "")
                out.append(None)
            except re.error as e:
                out.append(f"pattern: {e}")
        return pd.Series(out, dtype=object)

    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("id", "severity", "message", "pattern")]
    severity = F.when(~F.col("severity").isin("ERROR", "WARNING", "INFO"), F.lit("no such severity"))
    problems = F.filter(F.array(*missing, severity, F.pandas_udf(broken, "string")("pattern")), lambda x: x.isNotNull())
    return rules.select("id", F.explode(problems).alias("problem"))


def from_yaml(source: str) -> list[dict]:
    """The rules of a rule file that are plain patterns, for ``scan``; PyYAML is needed for it. Rules without a pattern of their own are left to other tools."""
    import yaml

    found = yaml.safe_load(source) or {}
    return [
        {"id": r["id"], "severity": r.get("severity", "INFO"), "message": r.get("message", ""), "pattern": r["pattern-regex"]}
        for r in found.get("rules", [])
        if "id" in r and "pattern-regex" in r
    ]
