"""Ignore rules and the file tree source: hand-written cases, the three forms of the rules against each other, and walks that don't enter what is excluded."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import ignore
from spanloom.sources.tree import EXCLUDED, GRAPH_SOURCES, Part, TreeReader, tree

CASES = [  # lines, path, ignored
    (["*.log"], "a/b/x.log", True), (["*.log"], "a/x.logs", False), (["*.log", "!keep.log"], "a/keep.log", False), (["!keep.log", "*.log"], "keep.log", True),
    (["/build"], "build/x", True), (["/build"], "a/build/x", False), (["build/"], "a/build/x", True), (["build/"], "a/build", False), (["build"], "a/build", True),
    (["a/b"], "a/b/c", True), (["a/b"], "x/a/b", False), (["**/b"], "x/a/b", True), (["**/b"], "b", True), (["a/**"], "a/x/y", True), (["a/**"], "a", False), (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True),
    (["build/", "!build/keep"], "build/keep", True), (["build/*", "!build/keep"], "build/keep", False), (["*", "!*/", "!*.py"], "a/b/x.py", False), (["*", "!*/", "!*.py"], "a/b/x.js", True),
    (["# c", "", "  "], "# c", False), (["\\#c"], "#c", True), (["\\!c"], "!c", True), (["x\\ "], "x ", True), (["x  "], "x", True), (["a?c"], "abc", True), (["a?c"], "a/c", False),
    (["[ab].py"], "b.py", True), (["[!ab].py"], "b.py", False), (["[!ab].py"], "c.py", True), (["a*c"], "a/c", False), (["/"], "a", False), (["a.c"], "abc", False),
]


@pytest.mark.parametrize("lines, path, want", CASES)
def test_rules(lines, path, want):
    assert ignore.is_ignored(path, ignore.rules(lines)) is want


def test_rules_of_a_folder_and_null(spark):
    listed = ignore.rules(["*.tmp"]) + ignore.rules(["/x", "!a.tmp"], "sub/dir")
    rows = spark.createDataFrame([("a.tmp",), ("sub/dir/a.tmp",), ("sub/dir/x/y",), ("x/y",), ("sub/x",), (None,)], "path string")
    got = [r.i for r in rows.select(ignore.ignored(F.col("path"), listed).alias("i")).collect()]
    assert got == [True, False, True, False, False, None]


def test_forms_agree(spark):
    rows = spark.createDataFrame([(i, p, [(r.regex, r.keep, r.directory) for r in ignore.rules(x)]) for i, (x, p, _) in enumerate(CASES)], f"i int, path string, rules {ignore.RULES}")
    joined = {r.i: r.v for r in rows.select("i", ignore.ignored_by(F.col("path"), F.col("rules")).alias("v")).collect()}
    assert joined == {i: c[2] for i, c in enumerate(CASES)}
    for lines in ({tuple(c[0]) for c in CASES}):
        listed = ignore.rules(lines)
        for r in rows.select("path", ignore.ignored(F.col("path"), listed).alias("v")).collect():
            assert r.v == ignore.is_ignored(r.path, listed), (lines, r)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab*/!?[]\\ #", max_size=8), max_size=4), st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=4))
def test_any_line_is_a_rule_or_none(lines, parts):
    assert ignore.is_ignored("/".join(parts), ignore.rules(lines)) in (True, False)


@pytest.fixture
def root(tmp_path):
    for p in ["a/x.py", "a/deep/er/y.TS", "a/deep/n.md", "b/build/z.py", "node_modules/m/i.js", "b/skip/s.py", "b/skip/keep.py", "top.py", "noext", "b/.hidden", "docs/d.md"]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    return str(tmp_path)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_walk(spark, root, parts):
    assert paths(tree(spark, root, partitions=parts)) == sorted(["a/x.py", "a/deep/er/y.TS", "a/deep/n.md", "b/skip/s.py", "b/skip/keep.py", "top.py", "noext", "b/.hidden", "docs/d.md"])
    assert paths(tree(spark, root, partitions=parts, extensions=GRAPH_SOURCES)) == sorted(["a/x.py", "a/deep/er/y.TS", "b/skip/s.py", "b/skip/keep.py", "top.py"])
    assert paths(tree(spark, root, partitions=parts, rules=["skip/", "*.md", "!docs/*"], globs=["a/deep/"])) == ["a/x.py", "b/.hidden", "docs/d.md", "noext", "top.py"]
    assert paths(tree(spark, root, partitions=parts, exclude=["a", "b"])) == ["docs/d.md", "node_modules/m/i.js", "noext", "top.py"]


def test_content_and_filters(spark, root):
    t = tree(spark, root, content="true")
    r = t.filter("path = 'a/x.py'").first()
    assert (r.name, r.extension, r.size, r.text) == ("x.py", ".py", 14, "text of a/x.py")
    assert paths(t.filter("path LIKE 'a/d%' AND extension = '.ts'")) == ["a/deep/er/y.TS"]
    assert paths(t.filter("extension IN ('.md', '.py') AND path LIKE 'b/%' AND size > 1")) == ["b/skip/keep.py", "b/skip/s.py"]
    assert paths(t.filter("path LIKE 'a/%' AND path LIKE 'b/%'")) == []
    assert paths(t.filter("extension = '.md' AND extension = '.py'")) == []


def test_pruned_directories_are_not_entered(root, monkeypatch):
    r = TreeReader({"path": root, "rules": "skip/"}, False)
    entered = []
    listing = TreeReader._list
    monkeypatch.setattr(TreeReader, "_list", lambda self, d: (entered.append(d), listing(self, d))[1])
    list(r.read(Part("", True)))
    assert sorted(entered) == ["", "a", "a/deep", "a/deep/er", "b", "docs"] and "node_modules" in EXCLUDED
    entered.clear()
    assert len(TreeReader({"path": root, "partitions": "2"}, False).partitions()) <= 4 and entered == [""]


def test_empty_and_missing_roots(spark, tmp_path):
    assert tree(spark, str(tmp_path)).count() == 0
    assert tree(spark, str(tmp_path / "none")).count() == 0
