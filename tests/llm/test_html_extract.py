from charta.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><article><header><h1>T&eacute;st &amp;amp; more</h1></header><p><b>First  part<br><p>foo<b>bar</b>
 x &lt;y&gt;<div class="ad">Buy</div><p>ok</p><form>Name <input></form><script>if (a < b) { "</p>" }</script><section id="comments"><p>Nice</p></section><aside>Side</aside><p>Last.</p></article><footer>&copy; F</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert H.main_text(PAGE) == "Tést &amp; more First part foobar x <y> ok Last."


def test_truncated_and_broken_pages():
    assert H.main_text("<article><p>One<p>Two") == "One Two"
    assert H.main_text("<article><p>a <!-- x <p>b") == "a"
    assert H.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert H.main_text("<article><p title='a>b'>x</p><script>") == "x"


def test_pages_without_article_keep_the_dense_region():
    body = "".join(f"<p>Sentence number {i} of the main part, long enough to count.</p>" for i in range(8))
    page = f"<div id=menu><a>a</a></div><p>x</p><nav>n</nav><nav>n</nav><nav>n</nav><nav>n</nav><div>{body}</div><div class=footer>f</div>"
    assert H.main_text(page).startswith("Sentence number 0") and H.main_text(page).endswith("count.")


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article></article>"), (4, "u", PAGE), (4, "u", PAGE), (None, "u", "<article>" + "<p>wort é</p>" * 5000)]
    pages = spark.createDataFrame([(i, u, h, "old", 9) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")
    out = H.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in out.collect())
    n = len(H.main_text(PAGE))
    assert got == sorted([("1", 0), ("2", 0), ("3", 0), ("4", n), ("4", n), ("None", 5000 * 7 - 1)])
    assert H.extract(pages.limit(0)).collect() == []


def test_surges_and_dives_decide_within_an_article(monkeypatch):
    gap = "<nav>n</nav><form>f</form><aside>a</aside>"
    body = "".join(f"<p>Sentence number {i} of the article, long enough to count for its density.</p>" for i in range(6))
    page = f"<article><p>by x</p>{gap}<h1>Top</h1>{gap}{body}{gap}<p>mid</p>{gap}{body}{gap}<p>Tag</p></article>"
    text = H.main_text(page)
    assert text.startswith("Top Sentence number 0") and " mid Sentence" in text and text.endswith("density.")
    monkeypatch.setattr(H, "dense_span", lambda sizes, share: (0, len(sizes)))
    assert H.main_text(page) == f"by x {text} Tag"


def test_bytes_that_are_no_utf8_and_odd_names(spark):
    pages = spark.createDataFrame([(1, "u", b"<article><p>a\xff b</p></article>", 5), (2, "u", None, 6)], "page_id long, url string, html binary, `a.b` int")
    pages = pages.selectExpr("page_id", "url", "cast(html as string) html", "`a.b`")
    out = H.extract(pages)
    assert out.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "u", 5, "a\ufffd b", 4), (2, "u", 6, "", 0)]
