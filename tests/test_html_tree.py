"""Page trees against Python's own parser of markup."""

from html.parser import HTMLParser

import duckdb
import pytest

from tessera.functions import html_tree
from tessera.functions.html_tree import ENDS, HIDDEN, SHIELDS, VOID, Tree, squeezed
from tessera.plans import catalog

from . import oracle

SF = "/root/testdata/sf0.01"


class Plain(HTMLParser):
    """(tag, depth, parent) in order of opening, and the text under each, with the same repairs on the standard parser's events."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found, self.open = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        for place in range(len(self.open) - 1, -1, -1):
            own = self.found[self.open[place]][0]
            if tag in ENDS.get(own, ()):
                del self.open[place:]
                break
            if own in SHIELDS:
                break
        self.found.append([tag, len(self.open), self.open[-1] if self.open else -1, []])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[place]][0] == tag:
                del self.open[place:]
                break

    def handle_data(self, data):
        if self.open and self.found[self.open[-1]][0] in ("script", "style"):
            return
        for k in self.open:
            self.found[k][3].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


ODD = [
    "", "plain", "<p>a<p>b<div>c</div>d", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<b>x<i>y</b>z</i>", "</p>x</div>", "<table><tr><td>a<td>b<tr><td>c</table>", "<P CLASS='a>b'>x</P>",
    '<a href="x>y">l</a>', "<br/><img src=x><hr>t", "<!-- <p>no</p> --><p>yes</p>", "<script>if (a<b) '</p>'</script><p>t", "a < b & c", "<div><p>a &amp; b &#233; &copy;</p>", "<h1>a</h1>b<h2>c</h2>d<h4>e</h4>f<h2>g</h2>", "<style>p{}</style><body>x",
]


def check(page):
    rows = list(Tree(page).rows())
    want = Plain(page).found
    assert [(r[2], r[3], r[1]) for r in rows] == [(t, d, up) for t, d, up, _ in want]
    glued = lambda parts: "".join(squeezed("".join(parts)).split())
    assert all("".join(r[9].split()) == glued(w[3]) for r, w in zip(rows, want) if r[9] is not None)
    for r in rows:
        assert r[4] < r[5] and (r[1] < 0 or rows[r[1]][4] < r[4] < r[5] < rows[r[1]][5])
        assert r[8] == (r[2] in HIDDEN or (r[1] >= 0 and rows[r[1]][8]))


@pytest.mark.parametrize("page", ODD)
def test_odd_pages(page):
    check(page)


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    for page in texts.values():
        check(page)
    have = html_tree.page_nodes(pages).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in have} == {k: len(Plain(v).found) for k, v in texts.items()}


def test_sections_under_their_headings():
    page = "<body>lead<h1>A</h1>one<h2>B</h2>two<nav>no</nav><h4>C</h4>three<h2>D</h2>four<h3></h3>five<h1>E</h1></body>"
    assert [(r[1], r[2], r[4], r[6]) for r in Tree(page).sections()] == [
        (0, 0, "", "lead"), (1, 1, "A", "one"), (2, 2, "A > B", "two"), (2, 4, "A > B > C", "three"), (4, 2, "A > D", "four five"), (5, 1, "E", ""),
    ]


def test_main_text_leaves_links_out(spark):
    say = "a paragraph of more than forty characters, surely"
    page = f"<nav><p>{say}</p></nav><h1>A heading long enough</h1><p>{say}</p><p>short</p><p><a>{say}</a></p><p>{say} <a>few</a></p><h1>Second heading</h1>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>x"), (None, page)], "page_id long, html string")
    have = [tuple(r) for r in html_tree.main_text(html_tree.page_nodes(pages)).collect()]
    assert have == [(1, 3, f"A heading long enough\n\n{say}\n\n{say} few")]


def _same_as_sql(spark, tmp_path, name):
    say = "A paragraph of more than forty characters"
    body = [f"{say} &amp; &quot;more&quot;</p><p>{say} &quot", f"{say} &ampm; &quo", f"{say}&amp;amp;"]
    rows = [(k, "", f"<html><head><title>x</title></head><body>lead &amp<h1>A heading that is cut&amp;&amp{end}</h1><p>{p}</p></body></html>") for k, (end, p) in enumerate(zip(("", ";", "&am"), body))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert oracle.difference(spark, con, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_main_text_of_cut_references_equals_sql(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "page_main_text")


def test_outline_of_cut_references_equals_sql(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "page_outline")
