import ast
import inspect
import random

import argparse
import asyncio.events
import collections
import dataclasses
import decimal
import json.decoder
import logging
import re
import textwrap

import pytest
from pyspark.sql import functions as F
from tessera.operators import chunking, structure
from tessera.operators.structure import parse

MODULES = (argparse, asyncio.events, collections, dataclasses, decimal, json.decoder, logging, re, textwrap, inspect)


def by_ast(text):
    found = []

    def walk(node, path):
        for c in ast.iter_child_nodes(node):
            below = path
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                last = max(x.end_lineno for x in ast.walk(c) if hasattr(x, "end_lineno"))
                names = None
                if kind != "class":
                    a = c.args
                    names = [x.arg for x in a.posonlyargs + a.args] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                found.append((kind, c.name, c.lineno, last, names, path))
                below = [*path, c.name]
            walk(c, below)

    walk(ast.parse(text), [])
    return sorted(found, key=str)


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__)
def test_python_against_the_languages_own_parser(module):
    text = inspect.getsource(module)
    got, nodes = [], parse(text, "python")
    for n in nodes:
        if n["type"] in ("class", "method", "function"):
            above, path = n["parent"], []
            while above is not None:
                if nodes[above]["type"] in ("class", "method", "function"):
                    path.insert(0, nodes[above]["name"])
                above = nodes[above]["parent"]
            names = None if n["type"] == "class" else [p for p in n["parameters"] if p not in ("*", "/")]
            kind = n["type"] if n["type"] != "function" or not path or nodes[n["parent"]]["type"] != "class" else "method"
            got.append((kind, n["name"], n["start_line"], n["end_line"], names, path))
    strip = lambda rows: sorted((("f" if k == "method" else k[0], *rest) for k, *rest in rows), key=str)  # noqa: E731  (a def behind an if is a method to the one and a function to the other)
    assert strip(got) == strip(by_ast(text))


NOISE = ('"}{"', "'({['", "`a ${b.c} }`", "/[}{]/", "/* } class Q { */ 1", "f(x)", "`${`}`}{`", '"\\"}"', "[1, 2]")


class Maker:
    """Scripts whose structure is known as they are made."""

    def __init__(self, seed):
        self.r, self.want, self.n = random.Random(seed), [], 0

    def name(self):
        self.n += 1
        return f"n{self.n}"

    def noise(self):
        return self.r.choice(NOISE)

    def body(self, depth, path):
        lines = []
        for _ in range(self.r.randrange(1, 4)):
            kind = self.r.choice(["value", "function", "arrow", "class", "if", "call", "comment"] if depth < 4 else ["value", "call", "comment"])
            name = self.name()
            if kind == "value":
                self.want.append(("variable", name, path))
                lines += [f"{self.r.choice(['const', 'let'])} {name} = {self.noise()};"]
            elif kind == "call":
                lines += [f"use({self.noise()}, ({self.noise()}));"]
            elif kind == "comment":
                lines += [f"// {{ {name} ("]
            else:
                self.want.append(("function" if kind in ("function", "arrow") else kind, name if kind != "if" else "", path))
                below = [*path, ("function" if kind in ("function", "arrow") else kind, name if kind != "if" else "")]
                inner = self.members(depth + 1, below) if kind == "class" else self.body(depth + 1, below)
                gap = self.r.choice([" ", "\n", " /* { */ "])
                head = {"function": f"async function{gap}{name}{gap}(a, b = {self.noise()})", "arrow": f"const {name} ={gap}(a) =>", "class": f"class {name}{gap}extends Base", "if": f"if{gap}(x && y)"}[kind]
                lines += [f"{head} {{", *inner, "}" + (";" if kind == "arrow" else "")]
        return lines

    def members(self, depth, path):
        lines = []
        for _ in range(self.r.randrange(1, 3)):
            name = self.name()
            if self.r.random() < 0.4:
                self.want.append(("property", name, path))
                lines += [f"static {name} = {self.noise()};"]
            else:
                self.want.append(("method", name, path))
                lines += [f"{name}(a, b) {{", *self.body(depth + 1, [*path, ("method", name)]), "}"]
        return lines


@pytest.mark.parametrize("seed", range(60))
def test_scripts_made_with_a_known_structure(seed):
    m = Maker(seed)
    text = "\n".join(m.body(0, []))
    nodes, got = parse(text, "javascript"), []
    for n in nodes:
        if n["type"] in ("variable", "function", "class", "if", "property", "method"):
            path, above = [], n["parent"]
            while above is not None:
                if nodes[above]["type"] not in ("call", "object"):
                    path.insert(0, (nodes[above]["type"], nodes[above]["name"]))
                above = nodes[above]["parent"]
            got.append((n["type"], n["name"], path))
    assert sorted(got, key=str) == sorted(m.want, key=str)


def test_numbers_nest():
    m = Maker(99)
    nodes = parse("\n".join(m.body(0, [])), "javascript")
    for n in nodes:
        inside = [k["seq"] for k in nodes if n["start"] <= k["start"] and k["end"] <= n["end"] and k["seq"] > n["seq"]]
        assert inside == list(range(n["seq"] + 1, n["last"] + 1))


def test_texts_that_are_broken_empty_or_long(spark):
    texts = [None, "", "}", "((((", "class {", "const a = `${`", '"', "/*", "function f( {", "=> => {", "import", "export {", "a" * 100_000, "f(" * 5000, "{" * 5000, "`${" * 3000, "x = 1 /", "def f(", "class A:\n\tdef g(self):\n  pass", "'''", "if x:"]
    rows = [(i, t, x) for i, t in enumerate(texts) for x in ("javascript", "python", "java", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string").withColumn("seq", F.lit("x")).withColumn("a.b", F.lit("y"))
    nodes = structure.tree(docs, language=F.col("language"))
    for r in nodes.collect():
        assert 0 <= r.start <= r.end <= len(texts[r.doc_id]) and r.seq <= r.last
    assert structure.tree(docs.limit(0), language=F.col("language")).count() == 0


def test_paths(spark):
    text = "class A { m() { if (a) { go() } } size = 1; }\nfunction g() { function h() { if (b) { } } }\nimport x from 'a/b';"
    nodes = structure.tree(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    ask = lambda q: sorted((r.type, r.name) for r in structure.find(nodes, q).collect())
    assert ask("//class/method") == [("method", "m")] and ask("//method//call") == [("call", "go")] and ask("//if") == [("if", ""), ("if", "")]
    assert ask("/function/function") == [("function", "h")] and ask("/class[A]/property[size]") == [("property", "size")] and ask("/class[B]") == []
    assert ask("//function//if") == [("if", "")] and ask("/*") == [("class", "A"), ("function", "g"), ("import", "a/b")] and ask("/import[a.b]") == [("import", "a/b")]
    for bad in ("class", "//class[", "", "/a/"):
        with pytest.raises(ValueError):
            structure.find(nodes, bad)
    s = structure.summary(nodes).first()
    assert s.n_nodes == 9 and s.max_depth == 3 and s.by_type["if"] == 2


def test_units_and_symbols_of_methods(spark):
    text = "class A:\n  size = 1\n  def run(self):\n    x = 1\n    return x\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    units = {r.name: r for r in chunking.code_units(docs, language="python", methods=True).collect()}
    assert units["run"].content == "  def run(self):\n    x = 1\n    return x" and units["A"].n_methods == units["A"].n_properties == 1
    scope = {r.name: r.scope for r in chunking.symbols(docs, language="python", methods=True).collect()}
    assert scope == {"A": None, "size": "A", "run": "A", "x": "run"}
