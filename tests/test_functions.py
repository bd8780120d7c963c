import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.functions import yamltext
from quirefold.functions.markdown import convert
from quirefold.functions.paths import basename, dirname, extname, joined, stem


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("given, want", [("a<>:b. .", "a_b"), ("x/y", "x_y"), ("", ""), ("a.\n", "a.\n"), (None, None)])
def test_file_name(spark, given, want):
    assert one(spark, X.file_name, given) == want


@pytest.mark.parametrize("given, want", [("## A\n### B", "# A\n## B"), ("### A\n# B", "### A\n# B"), ("### A\n## B", "# A\n# B"), ("no heading", "no heading"), ("", "")])
def test_headings(spark, given, want):
    assert one(spark, X.normal_headings, given) == want


def test_templates(spark):
    df = spark.createDataFrame([("cost $$5", "see {{b}}", None)], "a string, c string, b string")
    got = df.select(X.render("{{c}}|{{a}}|{{b}}|{{z}}", [("c", F.col("c")), ("a", F.col("a")), ("b", F.col("b"))])).first()[0]
    assert got == "see |cost $5||{{z}}"


@pytest.mark.parametrize("value", ["<$`|$'|$&|$$>", "$$$", "$$&", "$`", "a\u0001b$$", "\u0001", "$1$", "'$'", "", "{{b}}$&"])
@pytest.mark.parametrize("template", ["p{{a}}s", "{{a}}{{a}}-{{b}}{{a}}", "no name", "{{a}}"])
def test_patterns_in_values(spark, template, value):
    df = spark.createDataFrame([(value, "x$`y")], "a string, b string")
    want = X.put_in(X.put_in(template, "a", value), "b", "x$`y")
    assert df.select(X.render(template, [("a", F.col("a")), ("b", F.col("b"))])).first()[0] == want


def test_utf16(spark):
    assert one(spark, X.utf16_length, "a😀") == 3


@pytest.mark.parametrize("html, want", [
    ('<img src="../i/a b.png" alt="x">', "![x](S/B/images/a%20b.png)"),
    ('<img src="https://x/a.png"><p>t</p>', "t"),
    ('<a href="c2.xhtml#p3">see</a>', "[[c2.xhtml#p3|see]]"),
    ("<a>t</a>", "[[null|t]]"),
    ('<a href="#n1">[1]</a>', "[^1]"),
    ('<p><a href="#n1">[1]</a> text</p>', "[^1]:  text"),
    ('<a href="http://x">see <b>it</b></a>', "[see it](http://x)"),
    ("<ruby>漢字<rt>かんじ</rt></ruby>", "{漢字|かんじ}"),
    ("<h2>A</h2><p>one<p>two", "## A\n\none\n\ntwo"),
    ("<ul><li>a<li>b</ul>", "*   a\n*   b"),
    ("<ol><li>a</li><li>b</li></ol>", "1.  a\n2.  b"),
    ("<p><b>x</b> <i>y</i> <code>z</code></p>", "**x** _y_ `z`"),
    ('<script>var t="</p>"</script>x', "x"),
    ("<blockquote>q</blockquote>", "> q"),
    ("", ""),
])
def test_markdown(html, want):
    assert convert(html, "S/B/images") == want


def test_front_matter():
    assert yamltext.properties("tags: ab", "book")["tags"] == ["a", "b", "book"]
    with pytest.raises(ValueError):
        yamltext.properties("", "book")
    props = {"title": "a: b", "n": 3, "ok": False, "tags": ["x"], "none": None}
    assert yamltext.parse(yamltext.write(props)) == props


@pytest.mark.parametrize("folder, name, want", [("a/b", "../c", "a/c"), ("", "x", "x"), ("a", "", "a"), ("", "", ".")])
def test_joined(folder, name, want):
    assert joined(folder, name) == want


def test_path_parts(spark):
    row = spark.createDataFrame([("/a/b.c/d.e.txt",)], "p string").select(basename(F.col("p")), dirname(F.col("p")), extname(F.col("p")), stem(F.col("p"))).first()
    assert tuple(row) == ("d.e.txt", "/a/b.c", ".txt", "d.e")
