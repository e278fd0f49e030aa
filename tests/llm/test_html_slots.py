import pytest

from holdfast.llm import html_wrappers as w

LEAD = "A first paragraph with enough words to be the text of an article about number {}."


def texts(spark, pages, host="http://h/"):
    rows = [(k, host, p) for k, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_slot_decides_where_paths_are_alike(spark):
    """Notes in a container with a class of no list, between paragraphs, are the same on all pages; paragraphs differ."""
    page = "<div class=body><p>" + LEAD + "</div><div class=fine-print><p>All rights are ours.</div><div class=body><p>End {}.</div>"
    assert texts(spark, [page.format(k, k) for k in range(6)]) == {k: LEAD.format(k) + f"\nEnd {k}." for k in range(6)}


@pytest.mark.parametrize(
    "before, after",
    [
        ("<main class='has-sidebar'>", "</main>"), ("<article class='post share-enabled'>", "</article>"), ("<div class='content no-sidebar'>", "</div>"),
        ("<form action=x>", "</form>"), ("<div class='comment'>", "</div>"), ("<section id=search>", "</section>"), ("<article><header>", "</header></article>"),
    ],
)
def test_names_alone_drop_nothing(spark, before, after):
    found = texts(spark, [f"<nav>n</nav>{before}<h1>T{k}</h1><h2 id='related-work'>R{k}</h2><h2 id=notice>N{k}</h2><p>{LEAD.format(k)}{after}" for k in range(4)])
    assert found == {k: f"T{k}\nR{k}\nN{k}\n{LEAD.format(k)}" for k in range(4)}


def test_hints_drop_what_is_short_constant_or_links(spark):
    page = "<div class='ad'>Buy {}</div><div class=related><a href=x>" + LEAD + "</a></div><div class=notice>" + 9 * LEAD.format(0) + "</div><p>" + 12 * LEAD
    assert texts(spark, [page.format(*[k] * 14) for k in range(4)]) == {k: (12 * LEAD).format(*[k] * 12) for k in range(4)}


@pytest.mark.parametrize("copies", [1, 3, 10])
def test_copies_of_a_page_keep_its_text(spark, copies):
    page = "<h1>T</h1><p>" + LEAD.format(1)
    assert texts(spark, [page] * copies) == {k: "T\n" + LEAD.format(1) for k in range(copies)}


def test_a_page_is_not_emptied(spark):
    """Different pages of equal texts."""
    assert texts(spark, [f"<p title={k}>{LEAD.format(1)}" for k in range(5)]) == {k: LEAD.format(1) for k in range(5)}


def test_an_equal_lead_of_two_pages_and_copies_stays(spark):
    pages = ["<h1>Same</h1><p>" + LEAD.format(k % 2) for k in range(8)]
    assert texts(spark, pages) == {k: "Same\n" + LEAD.format(k % 2) for k in range(8)}
