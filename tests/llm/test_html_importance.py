import collections
import math
import os
import re
import time

import pytest

from ionfield.llm import html_extract as h

SF = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("nodes", [h.BROADCAST_NODES, -1])
def test_what_a_host_repeats_inside_articles_goes_and_copies_stay(spark, monkeypatch, nodes):
    monkeypatch.setattr(h, "BROADCAST_NODES", nodes)
    box = "<div class=lead-in>Read more on A</div>"
    rows = [(i, "http://a.org/", f"<article>{box}<p>story {i} of {i * 7}</p><p>more {i}</p></article>") for i in range(40)]
    rows.append((40, "http://a.org/", "<article><div class=lead-in>Its own lead</div><p>last story</p></article>"))
    rows.append((41, "http://a.org/", f"<article>{box}<p>s</p></article>"))
    rows += [(100 + i, "http://b.org/", "<article><h1>Copy</h1><p>one text</p></article>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"story {i} of {i * 7}\nmore {i}" for i in range(40))
    assert got[40] == "Its own lead\nlast story"
    assert got[41] == "Read more on A\ns"  # over half of it would go
    assert all(got[100 + i] == "Copy\none text" for i in range(60))


def brute_force_tree(pages):
    """Importances of one host's pages, counted page by page."""
    seen = collections.defaultdict(set)
    for page in pages:
        for path, sequence, own, text in h.style_rows(page):
            seen[path, False, sequence].add(text)
            if own is not None:
                seen[path, True, own].add(text)
    out = {}
    for at in {k[0] for k in seen}:
        sequences = [len(s) for (p, t, _), s in seen.items() if p == at and not t]
        m = sum(sequences)
        if m < 2:
            continue
        drawn = lambda x, m=m: (m * x + h.PRIOR_PAGES) / (m + h.PRIOR_PAGES)
        entropy = -sum(n / m * math.log(n / m, m) for n in sequences)
        out[at, None] = (drawn(entropy), len(sequences))
        for (p, t, value), s in seen.items():
            if p == at and t and len(s) > 1:
                out[at, value] = (drawn(max(0.0, 1 - math.log(len(s), m))), 1)
    return out


@pytest.fixture(scope="module")
def driver_pages(spark):
    """A host's pages of the driver's table, as they are and with all that names their parts taken away."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    host = collections.Counter(h.host_of(r["url"]) for r in rows).most_common(1)[0][0]
    pages = [r["html"] for r in rows if h.host_of(r["url"]) == host]
    blank = [re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", p).replace(' class="ad"', "") for p in pages]
    return pages, blank


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_style_tree_against_brute_force(spark, driver_pages):
    for pages in driver_pages:
        rows = h.style_tree(spark.createDataFrame([(i, "http://x.org", p) for i, p in enumerate(pages + pages[:5])], SCHEMA)).collect()
        expected = brute_force_tree(pages)
        assert {(r["path"], r["value"]) for r in rows} == set(expected) and len(rows) == len(expected)
        for r in rows:
            assert (r["importance"], r["sequences"]) == (pytest.approx(expected[r["path"], r["value"]][0], abs=1e-9), expected[r["path"], r["value"]][1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_importance_alone_takes_menus_from_the_drivers_pages(spark, driver_pages):
    pages, blank = driver_pages
    inside = lambda p, tag: h.extract(re.search(f"<{tag}>(.*)</{tag}>", p, re.S)[1])
    out = {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame([(i, "http://x.org", p) for i, p in enumerate(blank)], SCHEMA)).collect()}
    assert sum(inside(p, "article") in out[i] for i, p in enumerate(pages)) >= 0.95 * len(pages)
    gone = sum(inside(p, "nav") not in out[i] for i, p in enumerate(pages))
    assert gone >= 0.8 * len(pages) and all(inside(p, "nav") in h.extract(b) for p, b in zip(pages, blank, strict=True))
    # As they are, articles come out whole and alone.
    out = {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame([(i, "http://x.org", p) for i, p in enumerate(pages)], SCHEMA)).collect()}
    assert all(out[i] == inside(p, "article") for i, p in enumerate(pages))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><div class="entry-header"><h1>Title</h1></div><p class="related">x</p><p>Body about market.</p><div class="market-share">half</div></article>', "Title\nBody about market.\nhalf"),
        ("<div class='has-sidebar with-header'><main class=no-sidebar><article class='post no-comments'><p>kept</p></article></main></div>", "kept"),
        ("<div id=header><article><p>kept</p></article></div>", "kept"),
        ("<article><p>a long enough story</p></article><section class=user-comments><article><p>a reader's much longer word on it, and more</p></article></section>", "a long enough story"),
        ("<article class=card><p>Teaser</p></article><div><p>The page's own text, which is far longer than its card.</p></div>", "Teaser\nThe page's own text, which is far longer than its card."),
        ("<article><p>The page's own text, which is far longer.</p></article><div>Beside it</div>", "The page's own text, which is far longer."),
    ],
)
def test_priors(html, text):
    assert h.extract(html) == text


def test_nesting_takes_time_in_proportion():
    start = time.time()
    page = "<div>t" * 20_000
    rows = h.style_rows(page)
    assert len(rows) == 20_000 and h.extract(page, {(1, None): (1.0, 1)}).count("t") == 20_000
    assert time.time() - start < 10
