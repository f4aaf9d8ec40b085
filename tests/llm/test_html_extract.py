import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionfield.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, host string, path long, x string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  &lt;b&gt;\n text&nbsp;x", "plain <b> text x"),
        ("<article><h1>T &amp; U</h1><p>a<b>b</b>\n c<p>d</article><footer>f", "T & U\nab c\nd"),
        ("<nav>n</nav><main><p>x</p><aside>s</aside><form>q</form><script>var t='</p>';</script><style>p{}</style>y</main>", "x\ny"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>p</p><footer>by</footer></article>", "Title\np"),
        ("<article><p>a</p><div class='cookie-notice'>n</div><section id=comments><p>c</p></section><div class=\"ad\">x</div><p>b</p></article>", "a\nb"),
        ("<div class=sideBar>s</div><div role='navigation'>n</div><div><p>one<br>two</p></div>", "one\ntwo"),
        ("<article class=comment><p>c</p></article><article><p>a<p>b<ul><li>1<li>2</ul></article>", "a\nb\n1\n2"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<article><p title='a > b'>x</p><!-- <p>no</p> --><p>y", "x\ny"),
        ("<p>a</b></div></p>b</i>c", "a\nbc"),
        ("<textarea>t</textarea><button>b</button><p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<article><p>&#233;&#x1F642;&copy;</p><pre>a\n  b</pre></article>", "é🙂©\na b"),
        ("<div class='article-body lead'><p>kept</p></div><div class='add loading'>kept too</div>", "kept\nkept too"),
    ],
)
def test_cases(html, text):
    assert h.extract(html) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-", max_size=60))
def test_broken_markup_never_fails(text):
    h.extract(text)
    h.style_rows(text)


def test_deep_and_long():
    assert h.extract("<div>" * 20_000 + "x") == "x"
    long = "<article>" + "<p>word </p>" * 50_000 + "</article>"
    assert h.extract(long).count("\n") == 49_999


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"http://a.org/{i}", f"<body><div class=top>Welcome to A</div><div class=x><p>story {i} of {i * 7}</p><p>more {i}</p></div><div class=low><p>All rights</p><p>reserved</p></div></body>"))
    rows += [(100 + i, "http://b.org/", f"<body><div class=top>Welcome to A</div><p>only {i}</p></body>") for i in range(3)]
    rows += [(200, None, "<p>no url</p>"), (201, "http://a.org/x", None), (None, "http://a.org/y", "<article><p>Welcome to A</p></article>"), (200, None, "<p>no url</p>")]
    got = {}
    for r in h.extract_main_text(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [f"story {i} of {i * 7}\nmore {i}"] for i in range(40))
    assert got[100] == ["Welcome to A\nonly 0"] and got[200] == ["no url"] * 2 and got[201] == [""] and got[None] == ["Welcome to A"]


def test_joined_importance_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://A.org/{i}", f"<div class=t>same</div><p>other {i}</p>") for i in range(20)]
    first = sorted(map(tuple, h.extract_main_text(pages(spark, rows)).collect()))
    monkeypatch.setattr(h, "BROADCAST_NODES", -1)
    assert sorted(map(tuple, h.extract_main_text(pages(spark, rows)).collect())) == first
    assert first[0][2] == "other 0"


def test_empty(spark):
    assert h.extract_main_text(pages(spark, [])).collect() == []
