import html
import re

import pytest

from holdfast.llm import html_wrappers as w
from tests.conftest import DATA


def plain(page):
    """The article of the test pages by cutting the string."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(p for p in parts if p)


def test_test_pages(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    pages = {r["page_id"]: r for r in table.collect()}
    found = w.extract(table).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []), ("<", ["<"]), ("<!-- x", []), ('<script>if (a<b) "</p>"', []), ("<b>x", ["x"]), ("<p>a<p>b &amp;amp; c<br>d", ["a", "b &amp; c d"]),
        ("<article><p>x</article>tail<aside>q</aside>", ["x", "tail", "q"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p title='a>b'>x</p><svg><text>no</text></svg>", ["x"]), ("<p>a\n\t b</p>\xa0<p> </p>", ["a b"]),
    ],
)
def test_blocks(page, texts):
    assert [t for _, t, _ in w.blocks(page)] == texts


def test_dropped_elements():
    for tag, attrs in (("nav", ""), ("div", ' class="ad big"'), ("section", " id='comments'"), ("div", " role=banner"), ("div", " hidden"), ("p", ' style="display: none"')):
        assert w.dropped(tag, attrs)
    for tag, attrs in (("div", ' class="adder"'), ("p", ""), ("body", ' class="nav"'), ("article", ' id="main"')):
        assert not w.dropped(tag, attrs)


def accepts(wrapper, paths):
    import json

    expression, letters, *_ = w.compiled(json.dumps({"stream": json.dumps(wrapper)}))
    return bool(expression.fullmatch("".join(letters.get(p, "-") for p in paths)))


def test_wrappers_describe_every_stream_they_come_from():
    streams = [list(s) for s in ("abccd", "abd", "accccd", "abcece", "xabcd", "abcdz", "hphphp", "hp", "", "aaab", "abab")]
    wrapper = w.fold(streams[0])
    for s in streams[1:]:
        wrapper = w.align(wrapper, w.fold(s))
    assert all(accepts(wrapper, s) for s in streams) and not accepts(wrapper, list("dcba"))
    assert w.fold(list("hphphp")) == [[["h", "p"], False, True]] and w.fold(list("aab")) == [[["a"], False, True], [["b"], False, False]]


def test_pages_without_marks_and_odd_pages(spark):
    page = lambda k, extra="": f"<div class=menu><a>m</a></div><div><a href=x>all links here</a></div><h1>T{k}</h1><p>Text {k} one.<p>Two {k}.{extra}<div>Same on all</div><form><p>f</form>"
    rows = [(k, f"http://u@H.example:80/{k}", page(k, "<ul><li>i<li>j</ul>" if k % 2 else "")) for k in range(80)]
    rows += [(100, None, "<p>alone</p>"), (101, "no url", None), (None, "http://h2/", ""), (102, "http://h3/", "<main><p>in</main><p>out"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, wrapper int")
    found = w.extract(df).collect()
    assert len(found) == len(rows)
    text = {r["page_id"]: r["text"] for r in found}
    assert text[2] == "T2\nText 2 one.\nTwo 2." and text[100] == "alone" and text[101] == "" and text[None] == "" and text[102] == "in"
    assert text[3].startswith("T3\nText 3 one.\nTwo 3.")
    assert w.extract(df.limit(0)).count() == 0


def test_wrappers_are_merged_in_rounds(spark):
    import json

    streams = [list("ab" + "c" * (k % 2) + chr(100 + k)) for k in range(20)]
    rows = [("h", json.dumps(w.fold(s))) for s in streams] + [("g", json.dumps(w.fold(streams[0])))]
    found = {r["host"]: json.loads(r["stream"]) for r in w.merge_streams(spark.createDataFrame(rows, "host string, stream string"), crowd=3).collect()}
    assert set(found) == {"g", "h"} and all(accepts(found["h"], s) for s in streams)
