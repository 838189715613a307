import pytest
from pyspark.sql import functions as F

from skarnwell.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, folded", [("Thuế Thu Nhập Cá Nhân", "thue thu nhap ca nhan"), ("ĐÀ NẴNG", "da nang"), ("", ""), (None, None), ("été", "ete")])
def test_fold(spark, given, folded):
    assert one(spark, T.fold(F.col("t")), t=given) == folded


def test_tokens(spark):
    assert one(spark, T.index_tokens(F.col("t")), t="snake_case Über-x 42") == ["snake", "case", "uber", "x", "42"]
    assert one(spark, T.query_tokens(F.col("t")), t="snake_case Über") == ["snake_case", "uber"]
    assert one(spark, T.plain_tokens(F.col("t")), t="The (quick) fox, and `it`!") == ["quick", "fox"]


def test_sentences_keep_their_digits(spark):
    text = "\n".join(f"{i} line." for i in range(20))
    assert one(spark, T.sentences(F.col("t")), t=text)[17] == "17 line."


def test_front_matter(spark):
    text = '---\nService: "auth"\ntype: runbook\nweird key: x\ntype: howto\n---\nbody'
    assert one(spark, T.front_matter(F.col("t")), t=text) == {"service": "auth", "type": "howto"}
    assert one(spark, T.without_front_matter(F.col("t")), t=text) == "body"
    assert one(spark, T.front_matter(F.col("t")), t="no front matter") == {}


def test_html(spark):
    html = "<title> A &amp; B </title><h1>One</h1><p>Two<br/>Three &lt;x&gt;</p><script>s()</script><a href='/y?q=1'>z</a>"
    assert one(spark, T.html_to_text(F.col("t")), t=html).split("\n") == ["A & B One"[:5] + " One", "Two", "Three <x>", "s()z"]
    assert "s()" not in one(spark, T.html_to_text(F.col("t"), strip_scripts=True), t=html)
    assert one(spark, T.page_title(F.col("t")), t=html) == "A & B"
    assert one(spark, T.page_links(F.col("t")), t=html) == ["/y?q=1"]
    assert one(spark, T.web_path(F.col("t")), t="https://h.example/a (b)?q=1#f") == "web://h.example/a (b)"


def test_citations(spark):
    ok = T.citations_valid(F.col("t"), F.lit(2))
    assert one(spark, ok, t="a [1] b [2]") is True
    assert one(spark, ok, t="a [3]") is False
    assert one(spark, ok, t="none") is False


def test_globs(spark):
    m = T.matches_any(F.col("p"), ["*.log", "email/*"])
    assert one(spark, m, p="a/b.log") and one(spark, m, p="email/x") and not one(spark, m, p="a/b.logs")


def test_llm_json(spark):
    got = one(spark, T.llm_json(F.col("t"), "score int"), t='Sure! {"score": 3} Hope that helps')
    assert got.score == 3
    assert one(spark, T.llm_json(F.col("t"), "score int"), t="none") is None


def test_slug_snippet(spark):
    assert one(spark, T.slug(F.col("t")), t="Héllo, Wörld! x") == "h-llo-w-rld-x"
    assert one(spark, T.snippet(F.col("t"), 10), t="a  b\nc d e f g h i") == "a b c d e…"
