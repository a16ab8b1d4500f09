"""Short regions of pages without an article or main element."""

from quilter.llm import html_text

NOISE = "<nav>a</nav><nav>b</nav><nav>c</nav>"
LONG = "word " * 30 + "end"


def test_short_regions_beside_long_ones_stay():
    page = f"<h1>Title</h1>{NOISE}<p>{LONG}</p>{NOISE}<p>Between</p>{NOISE}<p>Too</p>{NOISE}<p>{LONG}</p>{NOISE}<p>Closing line</p>"
    assert html_text.main_text(page).split("\n") == ["Title", LONG, "Between", "Too", LONG, "Closing line"]


def test_short_regions_apart_from_them_go():
    page = f"<p>far</p>{NOISE}<p>near</p>{NOISE}<p>{LONG}</p>{NOISE}<p>near too</p>{NOISE}<p>far too</p>"
    assert html_text.main_text(page).split("\n") == ["near", LONG, "near too"]


def test_boilerplate_beside_them_goes():
    page = f"<div class='sidebar'>x y z</div>{NOISE}<p>{LONG}</p>{NOISE}<p><a href='u'>a link alone</a></p>"
    assert html_text.main_text(page) == LONG


def test_attributes_are_parsed_name_by_name():
    page = f'<article><h2 id="related-work">Related work</h2><p title="the hidden truth">One</p><p data-id="menu">Two</p><h2 id="search-algorithms">Search</h2><p id="legal">Three</p><p data-x=\'class="ad"\'>Four</p><p>{LONG}</p></article>'
    assert html_text.main_text(page).split("\n") == ["Related work", "One", "Two", "Search", "Three", "Four", LONG]
    page = f'<article><p>{LONG}</p><p class="ad">a</p><div class="big related-posts">b</div><div id=comments><p>c</p></div><p hidden>d</p><p aria-hidden="true">e</p><p style="color:red;display: none">f</p><div role="navigation">g</div><p class="related-work">kept</p></article>'
    assert html_text.main_text(page).split("\n") == [LONG, "kept"]


def test_article_edges_cut_regions_and_text_outside_goes():
    page = f"<div>Top line</div><article><p>Short.</p><p>{LONG}</p><p>End.</p></article><div>Bottom line of some other words</div>"
    assert html_text.main_text(page).split("\n") == ["Short.", LONG, "End."]


def test_the_distribution_decides_between_article_and_the_rest(monkeypatch):
    teaser = "<article><p>A teaser of one line.</p></article>"
    page = f"{teaser}<div><p>{LONG}</p><p>and {LONG}</p></div>{teaser}"
    assert html_text.main_text(page).split("\n") == [LONG, f"and {LONG}"]
    monkeypatch.setattr(html_text, "regions", lambda weights, sides: [(i, i + 1, 1, 1) for i in range(len(weights))])
    assert html_text.main_text(page).split("\n") != [LONG, f"and {LONG}"]


def test_short_articles_beside_a_long_one_go_and_short_lines_in_it_stay():
    page = f"<article><p>teaser</p></article><article><p>{LONG}</p><ul><li><a href=u>x</a></li><li><a href=u>y</a></li><li><a href=u>z</a></li><li><a href=u>v</a></li></ul><aside>no</aside><aside>no</aside><aside>no</aside><p>Fin</p></article>"
    assert html_text.main_text(page).split("\n") == [LONG, "x", "y", "z", "v", "Fin"]


def test_first_short_paragraph_before_a_menu_stays():
    menu = "<ul>" + "<li><a href=u>item</a></li>" * 6 + "</ul>"
    assert html_text.main_text(f"<p>Short.</p>{menu}<p>{LONG}</p><p><a href=u>a paragraph that is a link</a></p><p>{LONG}</p>").split("\n") == ["Short.", LONG, "a paragraph that is a link", LONG]


def test_many_articles_take_linear_time():
    import time

    page = "".join(f"<article><p>{i} {LONG}</p></article><div>x</div>" for i in range(20_000))
    start = time.time()
    assert html_text.main_text(page).count("\n") == 19_999
    assert time.time() - start < 20


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", 7)], "text long, n_chars string, html string, extra int")
    assert [tuple(r) for r in html_text.extract(df, "text", "n_chars", "html").collect()] == [(1, "u", LONG, len(LONG))]
