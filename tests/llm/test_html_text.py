import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmart.llm import html_text
from lumenmart.llm.html_text import extract, render


def test_blocks_and_implied_tags():
    assert render("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert render("<h1>T</h1>x <b>y</b>\n  z<br>w") == "T\n\nx y z\nw"
    assert render("a</p>b") == "a\n\nb"
    assert render("<b>a<p>b</b>c") == "a\n\nbc"


def test_visibility():
    page = "<html><head><title>t</title><style>p{}</style></head><body>a<script>if (1 < 2) '<p>'</script><p hidden>no</p><div style='color:red; display: none'>no<div>no</div></div>"
    page += "<span aria-hidden=true>no</span><!-- no --><template>no</template><input hidden>b<dialog>no</dialog></body>c"
    assert render(page) == "ab\nc"


def test_lists():
    assert render("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n  4. y\n- c"
    assert render("<nav><ul><li><a href=x>One</a></li><li>Two</li></ul></nav>end") == "- One\n- Two\n\nend"


def test_tables():
    assert render("<table><caption>cap</caption><tr><th>k<th>value<tr><td>long key<td>1<tr><td>日本<td>2</table>z") == "cap\nk         value\nlong key  1\n日本      2\n\nz"
    assert render("<table><tr><td>a<br>b<td><p>c</p></table>") == "a  c\nb"


def test_pre_entities_and_broken():
    assert render("<pre>a\n  b\n\nc</pre>") == "a\n  b\n\nc"
    assert render("&lt;p&gt; &amp;&nbsp;x &copy;") == "<p> &\xa0x ©"
    assert render("a <!-- open") == "a" and render("1 < 2 and <3") == "1 < 2 and <3" and render(None) == render("") == ""
    assert render("<div>" * 5000 + "deep") == "deep"


def test_hidden_elements_end_where_shown_ones_do():
    assert render("<ul><li hidden>a<li>b<li>c</ul><p>rest</p>") == "- b\n- c\n\nrest"
    assert render("<p style=display:none>x<p>visible <b>too</b>") == "visible too"
    assert render("<table><tr hidden><td>a<tr><td hidden>b<td>c</table><dl><dt hidden>d<dd>e</dl>f") == "c\n\ne\n\nf"
    assert render("<div><span hidden>a<b>x</div>b") == "b" and render("<div><canvas>a</div>b") == "b"
    assert render("<div hidden><div>a</div>b<p>c</div>d") == "d" and render("<div>" * 300 + "<div hidden>a<div>b</div>c</div>d") == "d"


def test_only_attributes_that_hide_hide():
    assert render('<p class="btn hidden md">a</p><p title="a hidden gem">b</p><p data-x="display:none" title=\'aria-hidden="true"\'>c</p>') == "a\n\nb\n\nc"
    assert render("a<b HIDDEN=''>no</b><b style='DISPLAY : none !important; display:block'>no</b><b aria-hidden='TRUE'>no</b><b aria-hidden=false>b</b>") == "ab"
    assert render('<p style="background:url(x;display:none)">a<p style="display:none;display:inline">b<p style="x-display:none">c<p hidden style="display:block">d') == "a\n\nb\n\nc\n\nd"
    assert render("<div style='visibility:hidden'>no<b style='visibility:visible'>a</b>no</div>b") == "a\nb"
    assert render("<dialog class=open>no</dialog><dialog open>a</dialog>") == "a"


def test_formulas_drawings_and_forms():
    assert render("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math> holds") == "so x=1 holds"
    assert render("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>a</text><text>b <tspan>c</tspan></text></svg><p>d") == "a\nb c\n\nd"
    assert render("<svg><path d='M0'><p>a</p>") == "a" and render("<svg><foreignObject><p>a</p></foreignObject><text>b</text></svg>") == "a\n\nb"
    assert render("x<textarea>\na &lt;b> <i>\n c</textarea>y") == "x\na <b> <i>\n c\ny"
    assert render("In <select><option>a<option selected>b<option>c</select> now") == "In b now" and render("<select><option disabled>a<optgroup><option>b</select>") == "b"
    assert render("a<datalist><option>no<option>no</datalist>b<video><p>no</video>c") == "abc"
    assert render("<select multiple><option>a<option hidden>no<option>c</select>d") == "a\nc\nd" and render("<select><option hidden selected>a<option>b</select>") == "a"


def test_cells_without_a_row():
    assert render("<table><td>a<td>b<tr><td>c</table>d") == "a  b\nc\n\nd"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<div>", "</div>", "<br>", "<pre>", "</pre>", "x1 ", "y2", " z3"]), max_size=40))
def test_all_visible_text_comes_out_once(parts):
    words = lambda s: sorted(re.findall(r"[xyz]\d", s))
    assert words(render("".join(parts))) == words("".join(p for p in parts if "<" not in p))


def test_query(spark):
    pages = spark.createDataFrame([(1, "<p>a", 0), (1, "<p>a", 0), (None, None, 0), (3, "<p>" + "w " * 200_000, 0)], "page_id long, html string, text int")
    rows = sorted(extract(pages).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.n_lines, r.n_chars) for r in rows] == [(None, 0, 0), (1, 1, 1), (1, 1, 1), (3, 1, 399_999)]
    assert extract(pages.limit(0)).count() == 0


def test_long_pages_take_time_in_proportion():
    """Tags that never end, quotes that never close, names without an end: each a megabyte."""
    import time

    for page in ("<a " * 350_000, "<a x" * 250_000 + "'", "<a '\" " * 150_000 + ">", "<a<b" * 250_000 + " 'x>", "<!x" * 300_000):
        began = time.monotonic()
        html_text.parse(page)
        assert time.monotonic() - began < 20


def test_no_page_takes_or_gives_out_of_proportion():
    """About a megabyte each: raw text and styles that never end, many open elements, wide, tall and nested tables, deep lists. Letters are all kept."""
    import time

    pages = {
        "<script>" + "<script " * 125_000: 0, "<script>" + "</script " * 110_000: 0, "<p style='" + "(" * 1_000_000 + "'>x": 1, "<p style='" + "(;" * 500_000 + "'>x": 1,
        "<div hidden>" * 1990 + "<li>x" * 200_000: 0, "<ul><li><ul>" + "<b hidden>" * 1990 + "<li>x" * 200_000: 0,
        "<table><tr><td>" + "x " * 250_000 + "<td>y" + "<tr><td>x<td>y" * 36_000 + "</table>": 250_000 + 1 + 72_000,
        "<table><tr>" + "<td>x" * 50_000 + "<td>" + "x<br>" * 100_000 + "</table>": 150_000, "<table><tr>" + "<td>x" * 200 + "<tr><td>" * 90_000: 200,
        "<table><tr><td>x<td>" * 300 + "x" * 50_000: 50_300, "<ul><li>" * 198 + "x<li>" * 50_000: 50_000, "<textarea>" + "</textarea " * 90_000: 90_000,
    }
    for page, letters in pages.items():
        began = time.monotonic()
        text = render(page)
        assert time.monotonic() - began < 20, page[:40]
        assert len(text) <= 32 * len(page), page[:40]
        assert text.count("x") + text.count("y") == letters, page[:40]


def test_long_cells_are_wrapped():
    words = " ".join(f"w{k}" for k in range(100))
    lines = render(f"<table><tr><td>{words}<td>b<tr><td>a<td>c</table>").split("\n")
    assert lines[0].endswith("  b") and lines[-1].endswith("  c") and len({len(lines[0]), len(lines[-1])}) == 1
    assert max(map(len, lines)) <= 83 and " ".join(" ".join(lines).split()).replace(" b", "").removesuffix(" a c") == words
    assert html_text.wrapped("日" * 50) == ["日" * 40, "日" * 10] and html_text.wrapped("a" * 79 + "e\u0301x") == ["a" * 79 + "e\u0301", "x"]


def test_references_details_and_templates():
    assert render("&#0065;&#x41;&#" + "9" * 5000 + ";&#" + "0" * 5000 + "66;") == "AA\ufffdB"
    assert render("<details>no<summary>a</summary>no<p>no</details><details open><summary>b</summary>c</details>d") == "a\nb\nc\nd"
    assert render("a<template>no<template>no</template>no</template>b") == "ab" and render("<script>'<script </script>b") == "b"
    assert html_text.styles_of("background:url(x;display:none") == {} and html_text.styles_of("a:(b(c);display:none);display:block") == {"display": "block"}


def plain(tree, out):
    """By brute force: a list of lines for trees of blocks, lists and tables that hold words."""
    kind, inner = tree
    if kind == "div":
        for t in inner:
            plain(t, out)
    elif kind == "w":
        out.append(inner)
    elif kind == "ul":
        for t in inner:
            lines = []
            plain(t, lines)
            out.extend(("- " if k == 0 else "  ") + line for k, line in enumerate(lines))
    else:
        width = [max(len(row[k]) for row in inner if k < len(row)) for k in range(max(map(len, inner)))]
        out.extend("  ".join(x.ljust(width[k]) for k, x in enumerate(row)).rstrip() for row in inner)


def markup(tree):
    kind, inner = tree
    if kind == "w":
        return f"<div>{inner}</div>"
    if kind == "ul":
        return "<ul>" + "".join(f"<li>{markup(t)}" for t in inner) + "</ul>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in inner) + "</table>"
    return "<div>" + "".join(map(markup, inner)) + "</div>"


word = st.text("abcdef", min_size=1, max_size=8)
leaf = word.map(lambda w: ("w", w)) | st.lists(st.lists(word, min_size=1, max_size=4), min_size=1, max_size=4).map(lambda rows: ("table", rows))
trees = st.recursive(leaf, lambda t: st.lists(t, min_size=1, max_size=4).flatmap(lambda x: st.sampled_from([("div", x), ("ul", x)])), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_equals_a_renderer_by_brute_force(tree):
    lines = []
    plain(tree, lines)
    assert [x for x in render(markup(tree)).split("\n") if x] == lines


def test_tags_are_found_as_browsers_do():
    found = lambda page: [(t, c, a) for _, _, c, t, a in _all(html_text.Tags(page))]
    assert found("a<b c='>'>x</B ><!-- <i> --><?x><1><br/>") == [("b", False, " c='>'"), ("b", True, " "), (None, False, ""), (None, False, ""), ("br", False, "/")]
    assert found("<a href=\"x") == [] and found("1 < 2 <i>") == [("i", False, "")]


def _all(tags):
    at, out = 0, []
    while (token := tags.next(at)) is not None:
        out.append(token)
        at = token[1]
    return out
