import re

from quillmark.llm import html_extract as X
from quillmark.llm.common import table


def plain(page):
    """The tables' pages hold their text in one article of h1 and p blocks."""
    import html

    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    found = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in found if x)


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    field = X.trained()
    for page, _ in X.labelled_pages(40, 5):
        found = X.blocks(page)[:9]
        if not found:
            continue
        s = field.scores(found)
        value = lambda y: sum(s[i][j] for i, j in enumerate(y)) + sum(field.between[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
        assert abs(value(field.decode(found)) - max(map(value, product((0, 1), repeat=len(found))))) < 1e-9


def test_unseen_pages():
    field, right, wrong, missed = X.trained(), 0, 0, 0
    for page, main in X.labelled_pages(150, 77):
        found = X.blocks(page)
        for a, b in zip(X.label_blocks(found, main), field.decode(found), strict=True):
            right, wrong, missed = right + (a and b), wrong + (b and not a), missed + (a and not b)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_the_tables_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in X.extract(pages).collect()}
    assert sum(got[k] != v for k, v in want.items()) <= 0.01 * len(want)


#: Pages written by hand, of shapes that `labelled_pages` doesn't make in this form, and their main text.
PAGES = {
    'plain': ('<html><body><p>First paragraph of the story, told at length.</p><p>Second paragraph, with more of it.</p></body></html>', 'First paragraph of the story, told at length.\nSecond paragraph, with more of it.'),
    'onep': ('<p>Only one short sentence.</p>', 'Only one short sentence.'),
    'table': ('<html><body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td><p>The council met on Tuesday to talk about the bridge.</p><p>It will be closed until spring, the mayor said.</p></td></tr></table></body></html>', 'The council met on Tuesday to talk about the bridge.\nIt will be closed until spring, the mayor said.'),
    'notes': ('<article><h1>Bridge closed</h1><p>The council met on Tuesday to talk about the bridge, which is old.</p><p>It will be closed until spring, the mayor said.</p><div class="user-notes"><p>Anna: I saw this coming, to be honest.</p><p>Bob: Me too, what a shame.</p></div></article>', 'Bridge closed\nThe council met on Tuesday to talk about the bridge, which is old.\nIt will be closed until spring, the mayor said.'),
    'math': ('<article><h1>Energy</h1><p>We know that <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds in this case.</p></article>', 'Energy\nWe know that E=m holds in this case.'),
    'form': ('<body><form><p>Tell us what you think about this story and more.</p><input><button>Go</button></form><article><p>The council met on Tuesday to talk about the bridge.</p></article></body>', 'The council met on Tuesday to talk about the bridge.'),
    'asp': ('<body><form action="x"><div class="menu"><a href="/">Home</a></div><main><p>The council met on Tuesday to talk about the bridge.</p></main></form></body>', 'The council met on Tuesday to talk about the bridge.'),
    'object': ('<article><p>Look at this: <object data="a.swf">a film of the bridge</object> and see.</p></article>', 'Look at this: a film of the bridge and see.'),
    'noscript': ('<body><noscript><article><p>The council met on Tuesday to talk about it.</p></article></body>', 'The council met on Tuesday to talk about it.'),
    'cite': ('<div id="page"><div id="hd"><a href="/">The Daily</a></div><div id="bd"><h1>Bridge closed</h1><p>The council met on Tuesday to talk about the bridge, which is old.</p><p>It will be closed until spring, the mayor said.</p></div><div id="ft">© 2020 The Daily. All rights reserved.</div></div>', 'Bridge closed\nThe council met on Tuesday to talk about the bridge, which is old.\nIt will be closed until spring, the mayor said.'),
    'responses': ('<main><h1>Bridge closed</h1><p>The council met on Tuesday to talk about the bridge, which is old.</p><section><h2>3 responses</h2><ol><li><p>I saw this coming, to be honest.</p></li><li><p>Me too, what a shame.</p></li></ol></section></main>', 'Bridge closed\nThe council met on Tuesday to talk about the bridge, which is old.'),
    'divs': ('<div><div><a href=/>Home</a> | <a href=/a>About us</a></div><div>The council met on Tuesday to talk about the bridge, which is old and rusty.</div><div>It will be closed until spring, the mayor said on the radio.</div><div>Copyright 2019 Daily Media</div></div>', 'The council met on Tuesday to talk about the bridge, which is old and rusty.\nIt will be closed until spring, the mayor said on the radio.'),
    'text': ('Just some text without any tags at all, but with a sentence.', 'Just some text without any tags at all, but with a sentence.'),
    'table_data': ('<article><p>Results of the race were as follows, officials said.</p><table><tr><th>Name</th><th>Time</th></tr><tr><td>Ann</td><td>12.4</td></tr></table></article>', 'Results of the race were as follows, officials said.\nName\nTime\nAnn\n12.4'),
    'ad': ('<body><div class="wrapper"><nav><a href=/>Home</a></nav><div class="story"><h1>Bridge closed</h1><p>The council met on Tuesday to talk about the bridge.</p><div class="advert">Buy two, get one free, only today.</div><p>It will be closed until spring, the mayor said.</p></div><aside><h3>Read more</h3><ul><li><a href=/q>Ten bridges you should see</a></li></ul></aside></div></body>', 'Bridge closed\nThe council met on Tuesday to talk about the bridge.\nIt will be closed until spring, the mayor said.'),
}


def test_pages_written_by_hand():
    field = X.trained()
    assert {k: field.extract(page) for k, (page, _) in PAGES.items()} == {k: want for k, (_, want) in PAGES.items()}


def test_head_and_forms_are_never_text():
    field = X.trained()
    story = "<p>The council met on Tuesday to talk about the bridge, which is old.</p>" * 3
    for page in (f"<form>{story}</form>", f"<head>{'words of the head ' * 20}</head>", f"<form><div>{story}</div></form><p>x</p>"):
        assert "council" not in field.extract(page) and "head" not in field.extract(page)
    assert X._barred((("form", ""), ("p", ""))) and not X._barred((("form", ""), ("main", ""), ("p", "")))
    assert [b.path[0][0] for b in X.blocks("<head><title>t</title><p>text")] == ["p"]  # another tag ends head


def test_marginals_are_those_of_all_paths():
    """Forward-backward against sums over all paths."""
    from itertools import product

    import numpy as np

    rng, field = np.random.default_rng(1), X.Field()
    field.between = rng.normal(0, 1, (2, 2))
    for n in (1, 2, 5):
        s = rng.normal(0, 2, (n, 2))
        p, pairs, total = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(s[i, j] for i, j in enumerate(y)) + sum(field.between[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
            total += w
            for i, j in enumerate(y):
                p[i, j] += w
            for a, b in zip(y[:-1], y[1:], strict=True):
                pairs[a, b] += w
        got = field._marginals(s)
        assert np.allclose(got[0], p / total) and np.allclose(got[1], pairs / total)


def test_blocks_of_odd_pages():
    texts = lambda page: [b.text for b in X.blocks(page)]
    assert texts("") == [] and texts("<p>") == [] and texts("plain &amp; text") == ["plain & text"]
    assert texts("<p>a<p>b &lt;c&gt; &#233;&nbsp;x</div></p>") == ["a", "b <c> é x"]
    assert texts("<div>a <b>b</b><i>c</i> <br>d<!-- no --><script>if (a<b) x('</p>')</script><p>e") == ["a bc d", "e"]
    assert texts("a < b <p title='x > y'>t</p><style>q{}</style>") == ["a < b", "t"]
    assert texts("<!-- open") == [] and texts("<script>x") == []
    assert texts("<noscript>x<p>y") == ["x", "y"] and texts("<template>x</template>y<template>z") == ["y", "z"]
    assert texts("<p>so <math><mi>a</mi><mo>+</mo><mn>1</mn></math> and <svg><text>b</text></svg> <object>c</object> end") == ["so a+1 and b c end"]


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<article><p>One sentence here, with words.</p></article>"), (3, "u", "<article><p>One sentence here, with words.</p></article>"), (4, "u", "<p>" + "long text, " * 20000)]
    got = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got[:2]] == ["", ""] and got[2].text == got[3].text == "One sentence here, with words." and len(got) == 5
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
