"""HTML to Markdown: golden cases, long pages, nulls and broken markup."""

import pytest
from pyspark.sql import functions as F

from quire.functions.markdown import html_to_markdown
from quire.operators import enrich

GOLDEN = {
    "blocks": ("<article><h1>T &amp; U</h1><p>a <b>b</b> c<p><b>open<br><p>x</article>", "# T & U\n\na **b** c\n\n**open**\n\nx"),
    "nested articles": (
        "<p>out</p><article>o<article><p>in <a href='/x?a=1&amp;b'>l <em>k</em></a></p></article>after</article><footer>f</footer>",
        "o\n\nin [l *k*](/x?a=1&b)\n\nafter",
    ),
    "two articles": ("<body><article>a</article>between<article>b</article></body>", "a\n\nb"),
    "lists": (
        "<body><nav>n</nav><ul><li>a<li>b<ol><li>c</li><li>d <code>e  f</code></ol><li>g</ul>",
        "- a\n- b\n  1. c\n  2. d `e f`\n- g",
    ),
    "second list": ("<body><ol><li>a</ol><p>p</p><ol><li><p>b</p><p>c</p></ol>", "1. a\n\np\n\n1. b\n\n  c"),
    "code": ("<body><pre><code>\nx\n  y &lt;z\n</code></pre>", "```\nx\n  y <z\n```"),
    "quotes": ("<body><blockquote><p>q1<br>r<p>q2<blockquote>z</blockquote></blockquote>w", "> q1  \n> r\n\n> q2\n\n> > z\n\nw"),
    "links and images": (
        '<body><p><a href="u">x</a> <a>plain</a> <a href="e"></a><img src="i.png" alt="I">',
        "[x](u) plain ![I](i.png)",
    ),
    "marks": ("<body><p>a <b> b <i>c</i> </b>d<strong></strong><p>***<b></p><p>e</b>", "a ** b *c*** d\n\n***\n\ne"),
    "table": ("<body><table><tr><th>a<th>b<tr><td>1</td><td>2</td></table>", "| a | b\n| 1 | 2"),
    "references": ("<body>&#x41;&#66;&#xD800;&#99999999; 1 < 2 &unknown; &amp;lt;", "AB&#xD800;&#99999999; 1 < 2 &unknown; &lt;"),
    "left out": ("<head><title>x</title></head><body><script>var t='</p>'</script><p>a</p><!-- c <p>z --><nav>n</nav><p>b", "a\n\nb"),
    "plain": ("no tags", "no tags"),
    "empty": ("", ""),
    "null": (None, None),
}


@pytest.fixture(scope="module")
def rendered(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in GOLDEN.items()], "k string, h string")
    return {r.k: r.m for r in df.select("k", html_to_markdown(F.col("h")).alias("m")).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(rendered, name):
    assert rendered[name] == GOLDEN[name][1]


def test_long_page_is_whole(spark):
    html = "<article>" + "".join(f"<p>w{i} <i>x</i></p>" for i in range(3000)) + "</article>"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_markdown(F.col("h"))).first()[0]
    assert got == "\n\n".join(f"w{i} *x*" for i in range(3000))


def test_fetch_as_markdown(spark):
    pages = spark.createDataFrame([("http://a.org/x", "<article><h2>H</h2>t</article>"), ("http://a.org/y", "<article></article>")], "url string, html string")
    wanted = spark.createDataFrame([("1", 0, "http://a.org/x"), ("2", 0, "http://a.org/y")], "post_id string, pos int, url string")
    assert [(r.post_id, r.content) for r in enrich.fetch_articles(wanted, pages, markdown=True).collect()] == [("1", "## H\n\nt")]
