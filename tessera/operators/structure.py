"""The structure of source texts as a tree of intervals: functions, classes, blocks, calls and names.

A lexer walks each text once: strings, template texts with code inside them, comments, expressions in slashes and
escapes are told from code, so that what they hold opens and closes nothing. Brackets (or indentation, in Python) feed
a stack of scopes; what stands before an opening brace tells what it opens, however many lines that takes. The result
is intervals that nest, and one pass over them in order of their starts gives each its parent, its depth and the last
of its descendants: everything below a node has a number between the two. The rest is DataFrame work on these rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDENTED = ("python",)
#: Languages in which a name with parameters and a body is a function only inside a class or an object.
SCRIPT = ("javascript", "typescript")
CLASS_WORDS = {"class", "interface", "enum", "struct", "trait"}
FUNCTION_WORDS = {"function", "func", "fn"}
HEADED, BARE = {"if", "for", "while", "switch", "catch", "with", "synchronized"}, {"else", "try", "do", "finally", "loop"}
MODIFIERS = {"export", "default", "async", "public", "private", "protected", "static", "final", "abstract", "const", "let", "var", "pub", "readonly", "override", "inline"}
#: Words that a bracket may follow without a call.
NO_CALL = HEADED | BARE | FUNCTION_WORDS | set("return new typeof await async def class elif except assert in not and or is throw yield case lambda del".split())

_BRACES = re.compile(
    r"""(?P<skip>[^\S\n]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?)
    |(?P<word>[\w$#@]+)|(?P<line>\n)|(?P<arrow>=>)|(?P<mark>[^\w\s])""",
    re.X,
)
#: As ``_BRACES``, each sign with the blanks behind it.
_SIGNS = re.compile(
    r"""(?P<skip>[^\S\n]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?:(?P<text>"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?)
    |(?P<word>[\w$#@]+)|(?P<line>\n)|(?P<arrow>=>)|(?P<mark>[^\w\s]))[^\S\n]*""",
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|\Z)")
_SLASHED = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_INDENT = re.compile(
    r"""(?P<skip>[^\S\n]+|\#[^\n]*|\\\n)|(?P<text>[A-Za-z]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?))
    |(?P<word>[\w@]+)|(?P<line>\n)|(?P<mark>->|[^\w\s])""",
    re.X,
)
_AHEAD = re.compile(r"\s*(\S?)").match
_NAME, _MEMBER = re.compile(r"[\w$]").match, re.compile(r"[\w$#]").match
_CLOSES = {")": "(", "]": "[", "}": "{"}


class _Frame:
    """An open scope: its bracket, its node (or None), the tokens of the statement at hand as (text, start, end)."""

    def __init__(self, mark: str, node: dict | None = None, kind: str = ""):
        self.mark, self.node, self.kind, self.tokens = mark, node, kind, []


def _parameters(text: str, tokens: re.Pattern) -> list[str]:
    """The names in a parameter list, with what stands before them; without comments, types behind a colon and values."""
    out, depth, one, open_ = [], 0, "", True
    for m in tokens.finditer(text + ","):
        x, last = m[0], m.end() > len(text)
        if m.lastgroup in ("skip", "line"):
            one += " " if open_ and not re.match(r"//|/\*|#", x) else ""
            continue
        depth += (x in ("(", "[", "{", "<")) - (x in (")", "]", "}", ">"))
        if x == "," and (depth <= 0 or last):
            out.append(re.sub(r"\s+", " ", one).strip())
            depth, one, open_ = 0, "", True
        elif x in (":", "=") and depth == 0:
            open_ = False
        elif open_:
            one += x
    return [p for p in out if p]


class _Reader:
    """Intervals of one text, as dicts of type, name, parameters, returns, base, start and end."""

    def __init__(self, text: str, language: str):
        self.text, self.script, self.found = text, language in SCRIPT, []

    def add(self, type: str, name: str, start: int, end: int = -1, **more) -> dict:
        node = {"type": type, "name": name, "parameters": None, "returns": None, "base": None, "start": start, "end": end} | more
        self.found.append(node)
        return node

    # -------- languages with braces

    def braces(self) -> list[dict]:
        text, n = self.text, len(self.text)
        stack = [_Frame("")]
        last = ""
        signs = _SIGNS.finditer(text)
        while m := next(signs, None):
            kind = m.lastgroup
            if kind == "skip":
                continue
            tok = m[kind]
            start, at = m.span(kind)
            top = stack[-1]
            if kind == "word":
                if last == "=>":
                    top = self._expression(stack, start)
                tokens = top.tokens
                if tokens and tokens[-1][0] in ("const", "let", "var") and top.mark in ("", "{", "(", "${"):
                    self.add("variable", tok, start, at)
                tokens.append((tok, start, at))
                last = tok
                continue
            if kind == "line":
                self._line(stack, start)
                last = last if last in ("return", "=>") or last and last in "(,=:[!&|?{;+-*%<>~^" else "\n"
                continue
            if tok == "`":
                if last == "=>":
                    self._expression(stack, start)
                signs = _SIGNS.finditer(text, self._template(stack, at))
                last = "`"
                continue
            if tok == "/" and (last == "" or last in "(,=:[!&|?{};+-*%<>~^\n" or last in ("return", "typeof", "=>", "case")) and (slashed := _SLASHED.match(text, start)):
                top.tokens.append(("/", start, slashed.end()))
                signs = _SIGNS.finditer(text, slashed.end())
                last = "/x/"
                continue
            if last == "=>" and kind in ("text", "mark") and tok != "{":
                top = self._expression(stack, start)
            if kind == "text":
                top.tokens.append(('"', start, at))
            elif tok in ("(", "["):
                stack.append(_Frame(tok))
                stack[-1].opened = start
            elif tok == "{":
                stack.append(self._open(stack, start))
            elif tok in _CLOSES:
                if (on := self._close(stack, tok, start, at)) != at:
                    signs = _SIGNS.finditer(text, on)
            elif tok == ";":
                self._end(stack, start)
            elif tok == "," and (top.mark in ("(", "[", "expr") or top.kind == "object" or self._declares(top)):
                while stack[-1].mark == "expr":
                    self._shut(stack, start)
                top = stack[-1]
                top.tokens = self._declares(top)
            else:
                top.tokens.append((tok, start, at))
            last = tok if kind != "text" else '"'
        while len(stack) > 1:
            self._shut(stack, n)
        self._statement(stack[0], n)
        return self.found

    @staticmethod
    def _declares(frame: _Frame) -> list:
        """What a further name behind a comma is declared by."""
        if frame.mark not in ("", "{", "${") or frame.kind == "object":
            return []
        k = next((k for k, t in enumerate(frame.tokens) if t[0] not in ("export", "declare")), 0)
        return frame.tokens[k : k + 1] if frame.tokens and frame.tokens[k][0] in ("const", "let", "var") else []

    def _template(self, stack: list[_Frame], at: int) -> int:
        """Behind a template text, or inside the code that it holds."""
        m = _TEMPLATE.match(self.text, at)
        if m[1] == "${":
            stack.append(_Frame("${"))
        else:
            stack[-1].tokens.append(('"', at, m.end()))
        return m.end()

    def _line(self, stack: list[_Frame], at: int) -> None:
        tokens = stack[-1].tokens
        tail = tokens[-1][0] if tokens else ""
        if stack[-1].mark == "expr":
            ahead = _AHEAD(self.text, at)[1]
            if tail and tail not in "=+-*/&|?:<>.," and ahead not in tuple(".?:&|+-*/"):
                while stack[-1].mark == "expr":
                    self._shut(stack, at)
        elif stack[-1].kind == "class" and tokens and tail not in ("=", ":", ",", "extends") and "()" not in [t[0] for t in tokens]:
            self._statement(stack[-1], at)
        elif tokens and tokens[0][0] == "import" and tail == '"':
            self._statement(stack[-1], at)

    def _end(self, stack: list[_Frame], at: int) -> None:
        while stack[-1].mark == "expr":
            self._shut(stack, at)
        self._statement(stack[-1], at)

    def _statement(self, frame: _Frame, at: int) -> None:
        """At the end of a statement without a body: imports, and properties of classes."""
        s = frame.tokens
        if s and s[0][0] == "import":
            where = next((t for t in reversed(s) if t[0] == '"'), None)
            name = self.text[where[1] + 1 : where[2] - 1] if where else "".join(t[0] for t in s[1:])
            self.add("import", name, s[0][1], s[-1][2])
        elif s and frame.kind == "class":
            k = 0
            while k + 1 < len(s) and s[k][0] in MODIFIERS:
                k += 1
            equals = next((j for j, t in enumerate(s) if t[0] == "="), len(s))
            if _MEMBER(s[k][0]) and "()" not in [t[0] for t in s[:equals]]:
                name = k if self.script else max(j for j in range(k, equals) if _NAME(s[j][0]))
                self.add("property", s[name][0], s[0][1], s[-1][2])
        frame.tokens = []

    def _expression(self, stack: list[_Frame], at: int) -> _Frame:
        """The body of an arrow function that is an expression."""
        stack.append(_Frame("expr", self._arrow(stack[-1].tokens[:-1])))
        return stack[-1]

    def _start(self, s: list, k: int) -> int:
        while k > 0 and s[k - 1][0] in MODIFIERS:
            k -= 1
        return s[k][1]

    def _named(self, s: list, k: int) -> tuple[str, int]:
        """The name that what begins at token k is assigned to, and where that statement begins."""
        if k > 0 and s[k - 1][0] == "async":
            k -= 1
        if k > 1 and s[k - 1][0] in ("=", ":") and _NAME(s[k - 2][0]):
            return s[k - 2][0], self._start(s, k - 2)
        if k > 3 and s[k - 1][0] == "=":  # a type between the name and the sign
            colon = next((j for j in range(k - 2, 0, -1) if s[j][0] == ":"), 0)
            if colon and s[colon - 1][0] not in ("?",) and colon > 1 and s[colon - 2][0] in MODIFIERS:
                return s[colon - 1][0], self._start(s, colon - 1)
        return "", self._start(s, k) if k < len(s) else s[-1][1]

    def _function(self, s: list, head: int, group: tuple | None, name: str, start: int, tail: int, type: str | None = None) -> dict:
        returns = re.sub(r"\s+", " ", self.text[group[2] : tail]).strip().removeprefix(":").removeprefix("->").strip() if group else ""
        returns = re.sub(r"\s*=>$", "", returns)
        if group:
            self._drop("call", group[1], group[2])
        self._drop("variable", start, s[-1][2], name)
        parameters = _parameters(self.text[group[1] + 1 : group[2] - 1], _BRACES) if group else []
        return self.add(type or ("function" if name else "lambda"), name, start, parameters=parameters, returns=returns or "unknown")

    def _drop(self, type: str, lo: int, hi: int, name: str | None = None) -> None:
        for k in range(len(self.found) - 1, max(-1, len(self.found) - 64), -1):
            f = self.found[k]
            if f["type"] == type and (f["end"] == hi if type == "call" else lo <= f["start"] < hi and f["name"] == name):
                del self.found[k]
                return

    def _arrow(self, s: list) -> dict:
        """``s`` ends before the arrow."""
        if not s:
            return self.add("lambda", "", 0)
        k = len(s) - 1
        group = next((j for j in range(k, -1, -1) if s[j][0] == "()"), None)
        if group is not None and group < k and s[group + 1][0] == ":":  # a type stands between the parameters and the arrow
            k = group
        name, start = self._named(s, k)
        if s[k][0] == "()":
            return self._function(s, k, s[k], name, start, s[-1][2])
        node = self._function(s, k, None, name, start, s[-1][2])
        node["parameters"] = [s[k][0]]
        return node

    def _open(self, stack: list[_Frame], at: int) -> _Frame:
        """The scope that a brace opens, by the statement in front of it."""
        top = stack[-1]
        s, top.tokens = top.tokens, top.tokens if top.mark in ("(", "[", "expr") or top.kind == "object" else []
        words = [t[0] for t in s]
        if not s:
            return _Frame("{", self.add("object" if top.mark in ("(", "[") else "block", "", at), "object" if top.mark in ("(", "[") else "")
        if words[-1] == "=>":
            return _Frame("{", self._arrow(s[:-1]))
        if words[0] in ("import", "export") and all(w in ("import", "export", "type", ",") or k == 1 for k, w in enumerate(words)) and words[-1] not in ("default", "{}"):
            top.tokens = s
            return _Frame("{", None, "object")
        k = next((k for k, w in enumerate(words[:-1]) if w in CLASS_WORDS and _NAME(words[k + 1]) and (k == 0 or words[k - 1] != ".")), None)
        if k is None and words[-1] == "class":
            k = len(words) - 1
        if k is not None and "()" not in words[k:]:
            base = None
            if "extends" in words[k:]:
                j = words.index("extends", k) + 1
                while j < len(words) and (words[j] == "." or words[j - 1] in (".", "extends")):
                    base, j = (base or "") + words[j], j + 1
            name = words[k + 1] if k + 1 < len(words) and words[k + 1] not in ("extends", "implements") else self._named(s, k)[0]
            return _Frame("{", self.add("class", name, self._start(s, k), base=base), "class")
        k = next((k for k, w in enumerate(words) if w in FUNCTION_WORDS and (w == "function" or not self.script)), None)
        if k is not None and "()" in words[k:]:
            groups = [j for j in range(k, len(words)) if words[j] == "()"]
            named = next((j for j in range(k + 1, len(words)) if _NAME(words[j])), None)
            group = next((j for j in groups if named is None or j > named), groups[0])
            if named is not None and named < group:
                return _Frame("{", self._function(s, k, s[group], words[named], self._start(s, k), at))
            name, start = self._named(s, k)
            return _Frame("{", self._function(s, k, s[groups[0]], name, start, at))
        if words[-1] in BARE:
            return _Frame("{", self.add(words[-1], "", s[-1][1]))
        group = next((j for j in range(len(words) - 1, 0, -1) if words[j] == "()"), None)
        if group is not None and words[group - 1] in HEADED and group == len(words) - 1:
            return _Frame("{", self.add(words[group - 1], "", s[group - 1][1]))
        if group is None and words[0] in HEADED:
            return _Frame("{", self.add(words[0], "", s[0][1]))
        if group is not None and _MEMBER(words[group - 1]) and "=" not in words[group:] and words[group - 1] not in NO_CALL and (top.kind in ("class", "object") or not self.script and "=" not in words and "." not in words):
            member = top.kind in ("class", "object")
            k = group - 1
            while not member and k > 0 and re.match(r"[\w$*&<>\[\]]", words[k - 1]):
                k -= 1
            node = self._function(s, group - 1, s[group], words[group - 1], self._start(s, k), at, "method" if member else None)
            if node["returns"] != "unknown" and not (self.script or node["returns"].startswith(":")):
                node["returns"] = "unknown"  # what follows the parameters there is no type
            return _Frame("{", node)
        thing = words[-1] in ("=", ":", "return", "?", "|", "&", "default", "extends")
        return _Frame("{", self.add("object" if thing else "block", "", at), "object" if thing else "")

    def _shut(self, stack: list[_Frame], at: int) -> None:
        frame = stack.pop()
        if frame.mark in ("", "{"):
            self._statement(frame, at)
        if frame.node is not None:
            frame.node["end"] = at

    def _close(self, stack: list[_Frame], tok: str, start: int, at: int) -> int:
        while stack[-1].mark == "expr":
            self._shut(stack, start)
        if tok == "}" and stack[-1].mark == "${":
            stack.pop()
            return self._template(stack, at)
        if not any(f.mark == _CLOSES[tok] for f in stack):
            return at  # closes nothing
        while stack[-1].mark != _CLOSES[tok]:
            self._shut(stack, start)
        if tok == "}" and stack[-1].mark == "{":
            self._statement(stack[-1], start)
        frame = stack[-1]
        self._shut(stack, at)
        top = stack[-1]
        if tok == "}":
            if frame.kind == "object" or frame.node is not None and frame.node["type"] == "lambda":
                top.tokens.append(("{}", start, at))
            else:
                top.tokens = []
                if top.mark == "expr":
                    self._shut(stack, at)
        else:
            self._group(top, tok, frame.opened, at)
        return at

    def _group(self, top: _Frame, tok: str, opened: int, at: int) -> None:
        s = top.tokens
        if tok == ")" and s and _NAME(s[-1][0]) and s[-1][0] not in NO_CALL and not (len(s) > 1 and s[-2][0] in FUNCTION_WORDS | {"def"}):
            k = len(s) - 1
            while k > 1 and s[k - 1][0] == "." and _NAME(s[k - 2][0]):
                k -= 2
            self.add("call", "".join(t[0] for t in s[k:]), s[k][1], at)
        s.append(("()" if tok == ")" else "[]", opened, at))

    # -------- languages with indentation

    def indented(self) -> list[dict]:
        text, stack, tokens, brackets, indent, begin, fresh = self.text, [], [], [], 0, 0, True
        filled = 0  # the end of the last line with code
        for m in _INDENT.finditer(text):
            kind, tok, start = m.lastgroup, m[0], m.start()
            if kind == "skip":
                continue
            if kind == "line":
                if not brackets and tokens:
                    self._block(stack, tokens, indent)
                    tokens = []
                begin, fresh = (start + 1, True) if not brackets else (begin, fresh)
                continue
            if fresh and not brackets:
                fresh, indent = False, len(text[begin:start].expandtabs(8))
                while stack and stack[-1][0] >= indent:
                    stack.pop()[1]["end"] = filled
            filled = m.end()
            if tok in ("(", "[", "{"):
                brackets.append((tok, start, len(tokens)))
                tokens.append((tok, start, filled))
            elif tok in _CLOSES and brackets and brackets[-1][0] == _CLOSES[tok]:
                _, opened, k = brackets.pop()
                del tokens[k:]
                if tok == ")":
                    frame = _Frame("(")
                    frame.tokens = tokens
                    self._group(frame, tok, opened, filled)
                else:
                    tokens.append((_CLOSES[tok] + tok, opened, filled))
            else:
                tokens.append((tok if kind != "text" else '"', start, filled))
            if tok == ";" and not brackets:
                self._block(stack, tokens[:-1] or tokens, indent)
                tokens = []
        if tokens:
            self._block(stack, tokens, indent)
        while stack:
            stack.pop()[1]["end"] = filled
        return self.found

    def _block(self, stack: list, s: list, indent: int) -> None:
        """A logical line: what it opens or names."""
        words = [t[0] for t in s]
        first = words[1] if words[0] == "async" and len(words) > 1 else words[0]
        end, node = s[-1][2], None
        colon = next((k for k, w in enumerate(words) if w == ":"), None)
        if first in ("def", "class") and colon is not None and len(words) > 2:
            k = words.index(first)
            k += words[k + 2] == "[]" and words[k + 3 : k + 4] == ["()"]  # parameters of types
            group = s[k + 2] if words[k + 2] == "()" else None
            name = words[words.index(first) + 1]
            if group:
                self._drop("call", group[1], group[2])
            if first == "class":
                bases = _parameters(self.text[group[1] + 1 : group[2] - 1], _INDENT) if group else []
                node = self.add("class", name, s[0][1], base=bases[0] if bases else None)
            else:
                inside = bool(stack) and stack[-1][1]["type"] == "class"
                arrow = words.index("->") if "->" in words[:colon] else None
                returns = self.text[s[arrow][2] : s[colon][1]].strip() if arrow else "unknown"
                node = self.add("method" if inside else "function", name, s[0][1], parameters=_parameters(self.text[group[1] + 1 : group[2] - 1], _INDENT) if group else [], returns=returns)
        elif first in ("if", "elif", "else", "for", "while", "with", "try", "except", "finally", "match", "case") and colon is not None and (first not in ("match", "case") or words[-1] == ":"):
            node = self.add(first, "", s[0][1])
        elif first in ("import", "from"):
            name = words[1:] if first == "import" else words[1 : words.index("import")] if "import" in words else words[1:]
            self.add("import", "".join(name), s[0][1], end)
        elif len(words) > 1 and re.match(r"[^\W\d]\w*$", first) and (words[1] == "=" and words[2:3] != ["="] or words[1] == ":"):
            inside = bool(stack) and stack[-1][1]["type"] == "class"
            self.add("property" if inside else "variable", first, s[0][1], end)
        if node is not None:
            if words[-1] == ":" or s[-1][0] == ":":
                stack.append((indent, node))
            else:
                node["end"] = end  # the body stands on the same line


def _nest(nodes: list[dict], text: str) -> list[dict]:
    """The nodes by their starts, with number, parent, depth, last descendant, lines and path."""
    feeds = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(feeds, at - 1) + 1
    nodes.sort(key=lambda n: (n["start"], -n["end"]))
    open_: list[dict] = []
    for k, n in enumerate(nodes):
        while open_ and open_[-1]["end"] <= n["start"]:
            open_.pop()
        above = open_[-1] if open_ else None
        n |= {"seq": k, "parent": above["seq"] if above else None, "depth": len(open_), "last": k, "n_methods": 0, "n_properties": 0}
        n |= {"start_line": line(n["start"]), "end_line": line(max(n["start"], n["end"] - 1))}
        n["path"] = (above["path"] if above else "") + f"/{n['type']}:{re.sub('[/:]', '.', n['name'])}"
        if above and n["type"] in ("method", "property"):
            above["n_methods" if n["type"] == "method" else "n_properties"] += 1
        for o in reversed(open_):
            o["last"] = k
        open_.append(n)
    return nodes


def _intervals(text: str, language: str) -> list[dict]:
    reader = _Reader(text, language)
    return reader.indented() if language in INDENTED else reader.braces()


def parse(text: str, language: str) -> list[dict]:
    return _nest(_intervals(text, language), text)


#: The fields of a node.
FIELDS = [(c, pa.int64()) for c in ("seq", "parent", "depth", "last")] + [("type", pa.string()), ("name", pa.string()), ("parameters", pa.list_(pa.string())), ("returns", pa.string()), ("base", pa.string())]
FIELDS += [(c, pa.int64()) for c in ("start", "end", "start_line", "end_line", "n_methods", "n_properties")] + [("path", pa.string())]
COLUMNS = tuple(c for c, _ in FIELDS)
_NODES = "array<struct<" + ",".join(f"{c}:{'bigint' if t == pa.int64() else 'string' if t == pa.string() else 'array<string>'}" for c, t in FIELDS) + ">>"
#: Characters of text whose nodes are held in Python at a time; a longer text is held alone.
HELD = 1 << 18


def _held(texts: pa.Array, languages: pa.Array) -> Iterator[list[tuple[str, str]]]:
    """Texts with their languages, as many at a time as have ``HELD`` characters, one at least."""
    some, size = [], 0
    for text, language in zip(texts, languages, strict=True):
        some.append((text.as_py() or "", language.as_py() or ""))
        size += len(some[-1][0])
        if size >= HELD:
            yield some
            some, size = [], 0
    if some:
        yield some


def _trees(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, languages in batches:
        for some in _held(texts, languages):
            found = [parse(t, x) for t, x in some]
            ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
            fields = [pa.array([n[c] for ns in found for n in ns], t) for c, t in FIELDS]
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=COLUMNS))


def nodes(text: Column, language: Column) -> Column:
    """The nodes of a text as an array of structs."""
    return F.arrow_udf(_trees, _NODES)(text, language)


def _types(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, languages in batches:
        for some in _held(texts, languages):
            yield pa.array([[n["type"] for n in _intervals(t, x)] for t, x in some], pa.list_(pa.string()))


def types(text: Column, language: Column) -> Column:
    """The types of the nodes of a text, one a node, in no order: for counts, which need no tree."""
    return F.arrow_udf(_types, "array<string>")(text, language)


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text", language: Column | str = "javascript") -> DataFrame:
    """(key, seq, parent, depth, last, type, name, parameters, returns, base, start, end, start_line, end_line, n_methods, n_properties, path): the nodes of each text.

    Numbers count from 0 in order of their starts; the descendants of a node are those from seq + 1 to last. Offsets
    are characters, end exclusive; lines count from 1. ``language`` is a name or a column of names.
    """
    name = F.lit(language) if isinstance(language, str) else language
    return docs.select(key, F.explode(nodes(F.col(text), name)).alias("n")).select(key, "n.*")


def _pattern(query: str) -> str:
    """The pattern over a node's path that a query stands for."""
    steps = re.findall(r"(//?)([\w*]+)(?:\[([^\]]*)\])?", query)
    if not steps or "".join(f"{a}{b}" + (f"[{c}]" if f"{a}{b}[{c}]" in query else "") for a, b, c in steps) != query:
        raise ValueError(f"path not understood: {query}")
    escape = lambda name: re.sub(r"([^\w])", r"\\\1", name)
    one = lambda type, name: f"/{'[^/:]*' if type == '*' else type}:{escape(name) if name else '[^/]*'}"
    return "^" + "".join((r"(?:/[^/]*)*" if gap == "//" else "") + one(type, name) for gap, type, name in steps) + "$"


def find(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes at the end of a path: ``/`` is a child, ``//`` any descendant, ``*`` any type, ``[name]`` asks for a name (``.`` for a slash or colon in it), as in ``//class[Cart]/method`` or ``//function//if``."""
    return nodes.where(F.col("path").rlike(_pattern(query)))


def find_all(nodes: DataFrame, queries: Iterable[str]) -> DataFrame:
    """``nodes`` times the paths (query) that they are at the end of: all paths are tested in one pass, so each text is parsed once."""
    tests = [F.when(F.col("path").rlike(_pattern(q)), F.lit(q)) for q in queries]
    return nodes.select("*", F.explode(F.filter(F.array(*tests), lambda q: q.isNotNull())).alias("query"))


def enclosing(types: tuple[str, ...]) -> Column:
    """The name of the innermost node of these types around a node, itself left out; null if there is none."""
    above = F.regexp_replace("path", r"/[^/]*$", "")
    found = F.regexp_extract(above, rf"^.*/(?:{'|'.join(types)}):([^/]*)", 1)
    return F.when(above.rlike(rf"/(?:{'|'.join(types)}):"), found)


def summary(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_nodes, max_depth, by_type)."""
    by = nodes.groupBy(key, "type").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    return by.groupBy(key).agg(F.sum("n").alias("n_nodes"), F.max("d").alias("max_depth"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))
