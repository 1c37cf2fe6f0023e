import random
import re
from html.parser import HTMLParser

from tessera.llm import html as H


def test_layout():
    page = "<head><title>no</title></head><body>Top<p>one<p>two<br>three &amp; &copy x<ul><li>a<li>b<ol start=3><li>x<li>y <b>z</b></ol><li>c</ul><pre>  k\n   v</pre>end"
    assert H.text_of(page).split("\n") == ["Top", "", "one", "", "two", "three & © x", "", "- a", "- b", "  3. x", "  4. y z", "- c", "", "  k", "   v", "", "end"]


def test_tables_are_aligned():
    page = "<table><caption>Cap</caption><tr><th>name<th>n<tr><td>longer name<td>1<tr><td colspan=2>both<td>z<tr><td><p>two<p>lines<td>5</table>"
    assert H.text_of(page).split("\n") == ["Cap", "name         n", "longer name  1", "both            z", "two          5", "", "lines"]


def test_invisible_text_is_left_out():
    page = "<style>p{}</style><script>var t='</p>'</script><!-- c --><div hidden>a</div><p style='color:red; display: none'>b</p><noscript>d</noscript>e<template>f</template>"
    assert H.text_of(page) == "e"
    # Hidden from readers of the screen's text aloud, and on the screen all the same.
    assert H.text_of("<span aria-hidden=true>c</span>d") == "cd"


def test_odd_markup():
    cases = {"": "", "a < b <3": "a < b <3", "</p>x": "x", "<p>a</b>b</p>": "ab", "x<a href='": "x", "<b>x": "x", "x<!-- y": "x", "<td>1<td>2": "1\n2", "<script>x": "", "a&nbsp;b": "a b"}
    for page, text in cases.items():
        assert H.text_of(page) == text, page
    assert H.text_of(None) == ""
    deep = "<div><table><tr><td>" * 2000 + "x"
    assert H.text_of(deep).strip() == "x" and H.text_of("<ul><li>" * 3000 + "x").endswith("- x")


def test_head_ends_without_its_end_tag():
    cases = {
        "<html><head><title>T</title><body><p>text": "text",
        "<head><meta charset=x><link rel=y> <style>s</style><script>u</script><template><div>v</div></template><noscript>w</noscript>\n<p>a": "a",
        "<head><title>T</title> plain <b>bold</b>": "plain bold",
        "<head><title>T</title>&nbsp;x": "x",
        "<head><head><title>T</title></head><body>z": "z",
        "<head><html><body>y": "y",
    }
    for page, text in cases.items():
        assert H.text_of(page).strip() == text, page


def test_rows_keep_all_their_text():
    cases = {
        "<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c<td>d</table>": "a  b\nc  d",
        "<table><tr>text<td>b</table>": "text\nb",
        "<table><tr><div>c</div></tr></table>": "c",
        "<table><tr><div><b>x</b> y<td>k</td>z</div><td>l<td hidden>m</table>": "x y\nz\nk  l",
        "<table><tr><form hidden><td>a</td></form><td>b</table>": "b",
        "<table><tr><div><table><tr><td>in</table></div><td>out</table>": "in\nout",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page
    assert H.text_of("<table><tr>" + "<div>" * 3000 + "<td>x</td>") == "x"


def test_colgroup_ends_without_its_end_tag():
    for start in ("<tr><td>", "<td>", "<tbody><tr><td>", "<thead><tr><th>", "<tfoot><tr><td>", "<colgroup><col><tr><td>", "<caption>", "<p>", ""):
        assert H.text_of(f"<table><colgroup><col>\n{start}x") == "x", start
    assert H.text_of("<table><colgroup><col><col></colgroup><tr><td>a<td>b</table>") == "a  b"


def test_quotes_open_values_only_behind_equals():
    cases = {
        '<td width=10">Price</td> and "more"': "Price\nand \"more\"",
        "<p title=it's>text</p>don't": "text\n\ndon't",
        "<p \">a": "a",
        "<p title=\"x>y\" 'z>b": "b",
        "<p title = 'x>y'>c": "c",
        "<p a='1'b=\"2>\"c>d": "d",
        "<p a=>e": "e",
        "<p a==\"f>g": "g",
        "<div title=a'b hidden>h</div>i": "i",
        "<img alt=\"j>k\"/>": "j>k",
        "<img alt=l'm>": "l'm",
        "</p title='>'>n": "n",
        "o<a href=\"p>q": "o",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page
    assert H.text_of("<p" + " a='1'" * 20000 + " b" * 20000 + "=" * 20000 + ">x") == "x" and H.text_of("<p " + "\"'" * 20000 + ">x") == "x"


def test_displayed_elements_are_kept():
    cases = {
        "x <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> y": "x a=1 y",
        "a <svg viewBox='0 0'><title>t</title><defs><text>d</text></defs><path d=M0/><g><text>one <tspan>two</tspan></text><text>three</text></g>loose</svg> b": "a\none two\nthree\nb",
        "a <svg><path d='M0'/></svg>b": "a b",
        "a <svg/>b": "a b",
        "<svg><defs/><text>x</text><foreignObject><p>y</foreignObject></svg>": "x\n\ny",
        "<svg><path d=1><p>out": "out",
        "<textarea>\n a &amp; b\n  <b>c</textarea>d": " a & b\n  <b>c\nd",
        "<select><option>a<option label=l>b<optgroup label=g><option>c</select>d": "a\nl\ng\nc\nd",
        "<datalist><option>a</datalist>b": "b",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>a", 2), (2, None, 3), (1, "<p>a", 2)], "page_id long, html string, todo int")
    got = H.extract(pages)
    assert got.columns == ["page_id", "html", "todo", "text"] and sorted(r.text for r in got.collect()) == ["", "a", "a"]
    assert H.extract(pages.limit(0)).count() == 0


def test_cells_that_span_rows_and_columns():
    cases = {
        "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
        "<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tr><td>3<td>4</table>": "x  y  z\n1     2\n3     4",
        "<table><tr><td colspan=1000>wide<td>end<tr><td>1<td>2</table>": "wide     end\n1     2",
        "<table><tr><td rowspan=2 colspan=2>q<td>r<tr><td>s<tr><td>t<td>u<td>v</table>": "q     r\n      s\nt  u  v",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page
    assert H.text_of("<table><tr>" + "<td colspan=1000 rowspan=9>x" * 3000 + "<tr><td>y</table>").endswith("y")


def test_visibility_can_be_shown_again_and_objects_have_content():
    cases = {
        "<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c<img alt=d><hr></div>e": "b\n\ne",
        "<ol style='visibility:hidden'><li>a<li style='visibility:visible'>b</ol>": "2. b",
        "<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>": "b",
        "<div style='display:none'><b style='visibility:visible'>a</b></div>b": "b",
        "<object data=x><p>instead</object>": "instead",
        "visibility: hidden": "visibility: hidden",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page


def test_tables_in_tables_at_any_depth():
    page = "x"
    for _ in range(60):
        page = f"<table><tr><td>{page}</td><td>y</td></tr></table>"
    assert H.text_of(page).split() == ["x"] + ["y"] * 60 and "\n" not in H.text_of(page)


class Plain(HTMLParser):
    """A tree of well-formed markup: [tag, attributes, children]."""

    def __init__(self, page):
        super().__init__()
        self.open = [["", {}, []]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_lines(node, lists=()):
    """Lines and marks: 1 for a boundary with an empty line, 0 for one without; None ends a line by force."""
    tag, attrs, children = node
    if "hidden" in attrs or tag == "script":
        return []
    if tag == "br":
        return [None]
    if tag == "table":
        spots, rows = {}, [r for r in children if r[0] == "tr"]
        for y, row in enumerate(rows):
            x = 0
            for cell in row[2]:
                while (y, x) in spots:
                    x += 1
                for dy in range(int(cell[1].get("rowspan", 1))):
                    for dx in range(int(cell[1].get("colspan", 1))):
                        spots[y + dy, x + dx] = ""
                spots[y, x] = " ".join("".join(cell[2]).split())
        used = [x for x in range(40) if any(spots.get((y, x)) for y in range(len(rows)))]
        width = {x: max(len(spots.get((y, x), "")) for y in range(len(rows))) for x in used}
        text = ["  ".join(spots.get((y, x), "").ljust(width[x]) for x in used).rstrip() for y in range(len(rows))]
        return [1, *[(t,) for t in text if t], 1]
    lead, inner, n = "", lists, 0
    edge = {"p": 1, "h2": 1, "div": 0, "li": 0, "ul": int(not lists), "ol": int(not lists)}.get(tag)
    out = [] if edge is None else [edge]
    for c in children:
        if isinstance(c, str):
            out.append(c)
            continue
        if tag in ("ul", "ol"):
            n += 1
            lead = "- " if tag == "ul" else f"{n}. "
            for k, line in enumerate(flowed(plain_lines(c, (*lists, tag)))):
                out.append((" " * len(lead) + line if k else lead + line,))
        else:
            out += plain_lines(c, inner)
    return out + ([] if edge is None else [edge])


def flowed(parts):
    """Lines of inline text (strings), ready lines (tuples) and boundaries."""
    lines, now, gap = [], "", 0
    for p in [*parts, 0]:
        if isinstance(p, str):
            now += p
            continue
        text = " ".join(now.split())
        for line in ([text] if text or p is None else []) + ([p[0]] if isinstance(p, tuple) else []):
            lines += [""] * (gap if lines else 0) + [line]
            gap = 0
        now, gap = "", max(gap, p if isinstance(p, int) else 0)
    return lines


def test_against_a_plain_renderer():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 7)))
    words = lambda: " ".join(word() for _ in range(r.randint(1, 6)))

    def inline():
        return "".join(r.choice([words(), f"<b>{words()}</b>", f"{words()}<br>{words()}", f"<i hidden>{words()}</i>"]) + " " for _ in range(r.randint(1, 3)))

    def items(depth):
        tag = r.choice(["ul", "ol"])
        rows = "".join(f"<li>{words()}{items(depth + 1) if depth < 2 and r.random() < 0.3 else ''}</li>" for _ in range(r.randint(1, 4)))
        return f"<{tag}>{rows}</{tag}>"

    def cells():
        rows = "".join("<tr>" + "".join(f"<td rowspan={r.choice([1, 1, 2])} colspan={r.choice([1, 1, 2])}>{word()}</td>" for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(r.randint(1, 4)))
        return f"<table>{rows}</table>"

    def block():
        kind = r.randrange(6)
        return [f"<p>{inline()}</p>", f"<h2>{words()}</h2>", items(0), cells(), f"<div{r.choice(['', ' hidden'])}>{inline()}<p>{words()}</p></div>", f"<script>{word()}</script>"][kind]

    for _ in range(400):
        page = "".join(block() for _ in range(r.randint(1, 6)))
        assert H.text_of(page) == "\n".join(flowed(plain_lines(Plain(page).open[0]))), page


def test_extract_replaces_a_column_of_the_name(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old")], "page_id long, html string, text string")
    got = H.extract(pages)
    assert got.columns == ["page_id", "html", "text"] and got.first().text == "a"


def test_form_fields_show_their_values():
    page = "<form>Name <input value='Ada L'> <input type=Submit value='Go now'><input type=hidden value=h><input type=password value=p><input type=checkbox value=c>on<input type=image alt=pic value=v><input type=odd value=o></form>"
    assert H.text_of(page) == "Name Ada L Go now on pic o"
    assert H.text_of("a<input>b") == "ab" and H.text_of("<p style='visibility:hidden'>x<input value=y></p>z") == "z"


def test_numbers_of_lists():
    cases = {
        "<ol><li>a<li value=5>b<li>c</ol>": "1. a\n5. b\n6. c",
        "<ol reversed><li>a<li>b<li hidden>x<li>c</ol>": "3. a\n2. b\n1. c",
        "<ol type=a start=26><li>x<li>y</ol>": "z. x\naa. y",
        "<ol type=I><li>x<li value=14>y<li type=1>z</ol>": "I. x\nXIV. y\n15. z",
        "<ol start=-1><li>x<li>y<li>z</ol>": "-1. x\n0. y\n1. z",
        "<ol type=a><li value=0>x</ol>": "0. x",
        "<ul><li>x<ol><li>y</ol><li>z</ul>": "- x\n  1. y\n- z",
    }
    for page, text in cases.items():
        assert H.text_of(page) == text, page


def test_dialogs_styles_and_pre():
    assert H.text_of("<dialog>a</dialog><dialog open>b</dialog><dialog class=x>c</dialog>d") == "b\nd"
    assert H.text_of("<p style='x-display:none'>a</p><p style='color:red;display : none'>b</p><p style='display:none'>c</p><p style='display:nonesuch'>d</p>") == "a\n\nd"
    assert H.text_of("<p style='x-visibility:hidden'>a</p>") == "a"
    assert H.text_of("<pre>\nx\n y</pre>") == "x\n y" and H.text_of("<pre>\n\nx</pre>") == "\nx" and H.text_of("<pre>x</pre>") == "x"


def test_wide_characters_line_up():
    page = "<table><tr><td>日本</td><td>a</td></tr><tr><td>xyz</td><td>b</td></tr><tr><td>e\u0301</td><td>c</td></tr></table>"
    assert H.text_of(page) == "日本  a\nxyz   b\ne\u0301     c"
