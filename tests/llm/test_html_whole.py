from charta.llm import html_extract as H

LONG = "A sentence of the main part that is long enough to count, and then some more of it."


def test_nesting_of_tags_is_no_gap():
    assert H.main_text(f"<div><h2>Intro</h2></div><div><p>{LONG}</p></div>") == f"Intro {LONG}"
    deep = "<div>" * 9 + "<ul><li>Point</li></ul>" + "</div>" * 9
    assert H.main_text(f"<body><div><h1>Title</h1></div>{deep}<div><div><p>{LONG}</p></div></div>{deep}<script>x</script><div><p>End.</p></div></body>") == f"Title Point {LONG} Point End."


def test_short_lines_between_dense_regions_stay():
    gap = "<nav>n</nav>" * 4
    assert H.main_text(f"<p>x</p>{gap}<p>{LONG}</p>{gap}<p>short</p>{gap}<p>{LONG}</p>{gap}<p>y</p>") == f"{LONG} short {LONG}"


def test_single_controls_are_no_gap():
    assert H.main_text(f"<h1>Title</h1>{'<button>Share</button>' * 5}<p>{LONG}</p>") == f"Title {LONG}"


def test_marked_wrappers_keep_their_article():
    for attribute in ('class="page no-sidebar"', 'class="has-sidebar"', 'id="search-results"', 'class="layout-side-right"', 'class="sidebar-left"', "id=page class=social-page"):
        assert H.main_text(f"<div {attribute}><p>menu</p><article><p>One</p><div class=ad>Buy</div><p>Two</p></article><p>end</p></div>") == "One Two", attribute
        assert H.main_text(f"<div {attribute}><main><div {attribute}><article><p>One</p></article></div></main></div>") == "One", attribute


def test_articles_in_comment_areas_and_boilerplate_stay_out():
    for before, after in (("<div id=comments>", "</div>"), ("<section class=comment-list><div class=widget>", "</div></section>"), ("<aside>", "</aside>"), ("<nav><div>", "</div></nav>")):
        assert H.main_text(f"<article><p>One</p></article>{before}<article><p>Nice</p></article>{after}") == "One"
    assert H.main_text("<article><p>One</p><div class=related><article>Other</article></div><p>Two</p></article>") == "One Two"


def test_roles_mark_and_parts_of_names_do_not():
    assert H.main_text(f"<div role=search>Find</div><div class='with-ads alert-box'><p>{LONG}</p></div>") == LONG
    assert H.main_text(f"<div class='has-comments sidebar'>Side</div><p>{LONG}</p>") == LONG
