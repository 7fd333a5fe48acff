import pytest
from pyspark.sql import functions as F

from convoloom.functions import paths, text
from convoloom.operators.messages import filter_types, message_type
from convoloom.operators.search import fold_spans
from convoloom.operators.workspaces import ScopeAmbiguous, resolve_scope


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("file:///c%3A/Work/./a/../B%20x/", "c:/work/b x"),
        (r"C:\Users\Dev\..\x", "c:/users/x"),
        ("/mnt/D/foo//bar/", "d:/foo/bar"),
        (r"\\Srv\Share\..\..\a", "//srv/share/a"),
        ("/a/./b/../../../c/", "/c"),
        ("a/../../b", "../b"),
        ("file://host/share/X", "//host/share/x"),
        ("file://localhost/a+b", "/a+b"),
        ("/", "/"),
        ("", None),
        (None, None),
        ("file:///a%2", None),
    ],
)
def test_paths(spark, raw, expected):
    assert one(spark, raw, paths.normalize_path) == expected


def test_labels_and_ids(spark):
    for label in ("global", " Unknown ", "(workspace: x)", "(global)"):
        assert one(spark, label, paths.public_path) is None
    assert one(spark, "46D408964d3ec2a21d9a23d01b13d82c", paths.dashed_uuid) == "46d40896-4d3e-c2a2-1d9a-23d01b13d82c" and one(spark, "zz", paths.dashed_uuid) is None
    assert one(spark, "C:/a b/c/", paths.project_slug) == "c-a b-c"
    assert one(spark, "/a b/ü", paths.file_uri) == "file:///a%20b/%C3%BC"
    assert one(spark, "/src/a/b", lambda c: paths.rebase(c, F.lit("/src/a"), F.lit("/d"))) == "/d/b" and one(spark, "/src/ab", lambda c: paths.rebase(c, F.lit("/src/a"), F.lit("/d"))) is None


def test_scope(spark):
    known = spark.createDataFrame([("/home/x/app",), ("/srv/y/app",), ("/srv/z/lib",), ("C:/Work/Tool",), (None,)], "path string")
    get = lambda r: [tuple(x) for x in resolve_scope(known, "path", r).collect()]
    assert get("/home/x/app/") == [("/home/x/app", "exact")] and get("z/lib") == [("/srv/z/lib", "unique-suffix")] and get("tool") == [("c:/work/tool", "unique-suffix")]
    assert get("nothing") == [] and get("ib") == []
    with pytest.raises(ScopeAmbiguous):
        get("app")


def test_title_preview_blocks(spark):
    assert one(spark, "x" * 50 + "\nmore", text.title_of) == "x" * 50 and one(spark, "x" * 51, text.title_of) == "x" * 47 + "..."
    assert one(spark, "\nx", text.title_of) is None and one(spark, None, text.preview_of) == ""
    assert one(spark, "a\n\n```js\nq\n```\nb ", text.preview_of) == "a [code] b" and one(spark, "y" * 101, text.preview_of) == "y" * 97 + "..."
    got = one(spark, "a\n```py\nx=1\n\n```\nb\n```\ny\n```", text.code_blocks)
    assert [tuple(b) for b in got] == [("py", "x=1", 1), (None, "y", 6)]
    assert one(spark, " <USER_QUERY>\n hi \u00a0 there\n</user_query> ", lambda c: text.normalize_text(text.unwrap_query(c))) == "hi there"


def test_search(spark):
    assert one(spark, "aAaa x", lambda c: text.match_positions(c, "AA")) == [0, 1, 2]
    assert one(spark, "abc", lambda c: text.match_positions(c, "")) == []
    s = one(spark, "0123456789needle0123456789", lambda c: text.snippet_of(c, text.match_positions(c, "needle"), 6, 4))
    assert tuple(s) == ("...6789needle0123...", [7])
    c = one(spark, "a\r\nb needle\nc\nd", lambda c: text.line_context(c, F.lit(5), 1))
    assert tuple(c) == (1, "b needle", ["a"], ["c"])


def test_spans_where_lower_case_changes_widths():
    assert fold_spans("İİx", "i̇x") == [(1, 3)] and fold_spans("a😀b", "b") == [(3, 4)] and fold_spans("aaa", "aa") == [(0, 2), (1, 3)] and fold_spans("x", "") == []


def test_types(spark):
    df = spark.createDataFrame([("user", "[Tool: x]", 0), ("assistant", "[Tool: x]", 0), ("assistant", "[Thinking] y", 1), ("assistant", "[Error] z", 0), ("assistant", "t", 2), ("assistant", "t", 0)], "role string, content string, n int")
    got = df.withColumn("type", message_type(F.col("role"), F.col("content"), F.col("n")))
    assert [r["type"] for r in got.collect()] == ["user", "tool", "thinking", "error", "tool", "assistant"]
    assert filter_types(got, []).count() == 6 and filter_types(got, ["tool"]).count() == 2
    with pytest.raises(ValueError):
        filter_types(got, ["nonsense"])


@pytest.mark.parametrize("n, expected", [(999, "999"), (1000, "1.0k"), (1250000, "1.3M")])
def test_counts(spark, n, expected):
    assert spark.range(1).select(text.compact_count(F.lit(n))).first()[0] == expected
