import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crateflow.llm import html_text


def test_implied_tags_lists_and_blocks():
    page = "<title>no</title><ul><li>a<ul><li>b<li>c</ul><li>d</ul><ol start=3><li>x<p>y</p><li value=9>z</ol><p>hi <b>bo</b>ld<br>x<p>next<div hidden>no</div>"
    assert html_text.text_of(page).split("\n") == ["- a", "  - b", "  - c", "- d", "", "3. x", "", "   y", "9. z", "", "hi bold", "x", "", "next"]


def test_tables_are_aligned():
    page = "<table><caption>T</caption><tr><th>name<th>n<tr><td>longer one<td>2<tr><td rowspan=2>r<td>4<tr><td>5<tr><td colspan=2>wide</table>"
    assert html_text.text_of(page).split("\n") == ["T", "name        n", "longer one  2", "r           4", "            5", "wide"]


def test_what_is_not_shown():
    page = '<style>p{}</style><script>var t="</p>";</script><!-- <p>c</p> --><p style="DISPLAY : none">a</p><template><p>t</p></template><noscript>n</noscript><input type=hidden value=h><p>seen &amp; &eacute;&copy;</p><pre>\n a\n  b</pre><img alt="pic">'
    assert html_text.text_of(page).split("\n") == ["seen & é©", "", " a", "  b", "", "pic"]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (1, "<p>x"), (3, "<" * 2000), (4, "<div>" * 3000 + "deep"), (5, "plain  text")], "page_id long, html string")
    got = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    assert got[:4] == [(1, ""), (2, ""), (None, "x"), (1, "x")]
    assert got[5][1] == "deep" and got[6][1] == "plain text"
    assert html_text.extract(pages.limit(0)).count() == 0


class _Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_data(self, data):
        self.out += data.split()


@settings(max_examples=80, deadline=None)
@given(parts=st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", " w1 ", " w2 ", "<br>", "<h1>", "</h1>", "</span>", "<blockquote>"]), max_size=40))
def test_every_word_is_kept(parts):
    page = "".join(parts)
    plain = _Words()
    plain.feed(page)
    got = [w for w in html_text.text_of(page).split() if w.startswith("w")]
    assert sorted(got) == sorted(plain.out)


_word = st.sampled_from(["ab", "c", "d-e", "\u65e5\u672c", "x1"])
_line = st.lists(_word, min_size=1, max_size=4).map(" ".join)
_rows = st.lists(st.lists(_line, min_size=1, max_size=4), min_size=1, max_size=4)
_items = st.recursive(_line, lambda deeper: st.tuples(_line, st.booleans(), st.lists(deeper, min_size=1, max_size=3)), max_leaves=6)
_blocks = st.lists(st.one_of(st.tuples(st.just("p"), _line), st.tuples(st.just("h2"), _line), st.tuples(st.just("div"), _line), st.tuples(st.just("table"), _rows), st.tuples(st.sampled_from(["ul", "ol"]), st.lists(_items, min_size=1, max_size=4))), max_size=6)


def _html_of(kind, x, closed):
    """The page's source; with closed, all end tags are written, and else all that may be left out are."""
    end = (lambda t: f"</{t}>") if closed else (lambda t: "")
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}{end('td')}" for c in r) + end("tr") for r in x) + "</table>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join("<li>" + (i if isinstance(i, str) else i[0] + _html_of("ol" if i[1] else "ul", i[2], closed)) + end("li") for i in x) + f"</{kind}>"
    return f"<{kind}>{x}" + (end("p") if kind == "p" else f"</{kind}>")


def _drawn(kind, x):
    """The lines of a block, from what it was made of and not from its source."""
    places = lambda t: sum(2 if ord(c) > 0x2E80 else 1 for c in t)
    if kind == "table":
        wide = [max(places(r[k]) for r in x if k < len(r)) for k in range(max(map(len, x)))]
        return ["  ".join((r[k] if k < len(r) else "") + " " * (w - places(r[k] if k < len(r) else "")) for k, w in enumerate(wide)).rstrip() for r in x]
    if kind in ("ul", "ol"):
        out = []
        for i, item in enumerate(x):
            mark = f"{i + 1}. " if kind == "ol" else "- "
            lines = [item] if isinstance(item, str) else [item[0], *_drawn("ol" if item[1] else "ul", item[2])]
            out += [(mark if j == 0 else " " * len(mark)) + t for j, t in enumerate(lines)]
        return out
    return [x]


@pytest.mark.parametrize("closed", [True, False])
@settings(max_examples=150, deadline=None)
@given(blocks=_blocks)
def test_layout_is_that_of_a_second_renderer(closed, blocks):
    want, before = [], None
    for kind, x in blocks:
        if before is not None and not (kind == before == "div"):
            want.append("")
        want += _drawn(kind, x)
        before = kind
    assert html_text.text_of("".join(_html_of(k, x, closed) for k, x in blocks)) == "\n".join(want)


@pytest.mark.parametrize("part", ["<a ", '<a title="x ', "<!", "<?", "<!--", "<style></style ", "<b>x</b> ", "&", "<p a=1 ", "</"])
def test_a_megabyte_of_broken_markup_takes_seconds(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.text_of(page)
    assert time.process_time() - began < 10


_ROW = "<tr>" + "<td>c" * 4000 + ("<tr><td>x" * 4000)
_WIDE = "<tr>" + ("<td>" + "w" * 120) * 1000 + "<tr><td colspan=999>a<td>x" * 200


@pytest.mark.parametrize("page", [
    "<table>" + "<tr>" + "<td>c" * 40_000 + "<tr><td>x" * 90_000, "<table>" + _ROW, "<table>" + _WIDE, "<table><tr>" + ("<td>" + "w" * 120) * 1000 + "<tr><td colspan=999>a<td>x" * 35_000,
    ("<ul><li>text of an item " * 190 + "</ul>" * 190) * 190, ("<blockquote><p>some text " * 150 + "</blockquote>" * 150) * 170, "<ul><li>" * 190 + "<li>text here" * 65_000,
    "<table><tr>" + "<td rowspan=999>a" * 20_000 + "<tr><td>x" * 70_000,
])
def test_layout_takes_time_and_space_in_proportion(page):
    began = time.process_time()
    text = html_text.text_of(page)
    assert time.process_time() - began < 10 and len(text) < 8 * max(len(page), 1 << 18)
    assert text.count("x") + text.count("c") >= page.count(">x") + page.count(">c")


def test_padding_is_bounded_by_a_line_and_indents_by_depth():
    page = "<table><tr><td>" + "w" * 300 + "<td>b<tr><td>a<td>x<tr><td>" + "v" * 80 + "<td>y</table>"
    first, second, third = html_text.text_of(page).split("\n")
    assert first == "w" * 300 + "  b" and second == "a  x" and third == "v" * 80 + " " * 222 + "y"
    deep = html_text.text_of("<ul><li>t" * 30).split("\n")
    assert [len(x) - len(x.lstrip()) for x in deep] == [min(40, 2 * i) for i in range(30)]


def test_marks_and_quotations_in_each_other():
    page = "<blockquote><p>a<p>b<ul><li>c<blockquote>d<p>e</blockquote><li><ol><li>f</ol></ul></blockquote><dl><dt>t<dd>u<p>v</dl><ul><li></ul>"
    assert html_text.text_of(page).split("\n") == ["> a", ">", "> b", ">", "> - c", ">", ">   > d", ">   >", ">   > e", "> - 1. f", "", "t", "    u", "", "    v", "", "-"]


def test_attributes_and_broken_tags():
    got = html_text.parse("<p A=1 b='x>y' c=\"z\" d e=&amp;f a=2 it's>text</p>").children[0]
    assert got.attributes == {"a": "1", "b": "x>y", "c": "z", "d": "", "e": "&f", "it's": ""} and got.children == ["text"]
    assert html_text.text_of("1 < 2 <3 a<b>c</b> </ x>d") == "1 < 2 <3 ac d"
    assert html_text.text_of("seen<a href='never closed <p>gone") == "seen"
    assert html_text.text_of("a<!-->b<!---->c<!-- x --!>d<!doctype x>e<?y?>f") == "abcdef"
