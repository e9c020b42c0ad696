"""Selector specifications on written pages: nested and attributed blocks, dynamic fields, error policies."""

import pytest

from revlens.operators import selectors as SEL
from revlens.operators.selectors import Field, Pairs, Records, Step

HOTEL = """<html><body>
<div class="card wide" data-n="1"><div data-part="review-rating"><span class="marks mark_40"></span></div>
  <div class="aspect two"><span><span class="marks mark_50"></span></span>Rooms</div>
  <div class="aspect two"><span><span class="marks mark_30"></span></span>Service</div>
  <div class="note wide">Fine &amp; quiet.<br>Come <b>again</b></div></div>
<div class="card wide"><div data-part="review-rating"><span class="marks mark_x"></span></div><div class="note wide">No number</div></div>
<div class="card"><div class="note wide">other class</div></div>
<div class="wide card">not the whole value</div>
<div class="card wide"><div data-part="review-rating"><span class="a mark_10"></span></div><div class="note wide">Bad</div><p>one<p>two</div>
</body></html>"""
RATING = Field("overall", (Step("div", attributes=(("data-part", "review-rating"),)), Step("span")), "class suffix", "int", 10)
ASPECTS = Pairs("aspects", Step("div", "aspect"), Field("label"), Field("v", (Step("span"), Step("span")), "class suffix", "double", 10))
REVIEW = Field("review", (Step("div", "note wide"),))
NUMBER = Field("n", (), "@data-n", "int", optional=True)


def read(spec, page):
    return [(i, *row) for i, row in spec.read(page)]


def spec(on_error):
    return Records((Step("body"), Step("div", "card wide")), (RATING, ASPECTS, REVIEW, NUMBER), on_error)


def test_policies():
    good = (0, 4, [("Rooms", 5.0), ("Service", 3.0)], "Fine & quiet.Come again", 1)
    last = (2, 1, [], "Bad", None)
    assert read(spec("skip"), HOTEL) == [good, last]
    assert read(spec("stop"), HOTEL) == [good]
    assert read(spec("keep"), HOTEL) == [good, (1, None, [], "No number", None), last]


def test_as_a_job(spark):
    df = spark.createDataFrame([(1, HOTEL), (2, None), (3, ""), (4, "<div class='card wide'"), (1, HOTEL)], "page_id long, html string")
    rows = SEL.extract(df, spec("skip")).collect()
    assert len(rows) == 4 and {r["page_id"] for r in rows} == {1} and {tuple(sorted(r["aspects"].items())) for r in rows} == {(), (("Rooms", 5.0), ("Service", 3.0))}
    assert SEL.extract(df.where("false"), spec("skip")).collect() == []
    assert dict(SEL.extract(df, spec("skip")).dtypes)["aspects"] == "map<string,double>"


def test_nested_containers_and_unclosed_elements():
    page = "<ul><li>a<ul><li class='x y'>b<li>c</ul><li class=y>d</ul><p>one<p title='<li>'>two<div>three</div>"
    assert [r[1] for r in read(Records((Step("li"),), (Field("t"),)), page)] == ["abc", "b", "c", "d"]
    assert [r[1] for r in read(Records((Step("ul"), Step("li", "y")), (Field("t"),)), page)] == ["b", "d"]
    assert [r[1] for r in read(Records((Step("p"),), (Field("t"),)), page)] == ["one", "two"]
    assert [r[1] for r in read(Records((Step("p", attributes=(("title", None),)),), (Field("t"),)), page)] == ["two"]
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert len(SEL.parse(deep).text()) == 1 and sum(1 for _ in SEL.parse(deep).below()) == 20_000


def test_specifications_are_checked():
    for wrong in (lambda: Field("a", kind="date"), lambda: Field("a", take="html"), lambda: Records((), (REVIEW,)),
                  lambda: Records((Step("p"),), (REVIEW, REVIEW)), lambda: Records((Step("p"),), (REVIEW,), "ignore")):
        with pytest.raises(ValueError):
            wrong()


def test_blocks_and_their_sql_on_nested_and_attributed_pages(spark):
    import duckdb
    from pyspark.sql import functions as F
    from revlens.operators import extract as XT
    from revlens.plans.q_extract import BLOCKS_SQL
    texts = ["<article><p>a</p><p class='x'>b</article><p>out<ARTICLE id=1><P>c<article><p\n>d</p></article><p>e</article>", "</article><article><p>x", "<p>none", "",
             "<article><pre>no</pre><p>y</article></article><p>z<article><p>w"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = df.select("page_id", F.posexplode(XT.blocks(F.col("html"))).alias("i", "b")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(map(tuple, got)) == sorted(con.execute(BLOCKS_SQL).fetchall()) and len(got) == 8
