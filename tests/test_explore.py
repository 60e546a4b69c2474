"""Outlines, trees, tools and monitors on small inputs with known answers."""

import os

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import explore as X
from tracequarry.operators.tools import Tools, monitored
from tracequarry.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "⋮"),
        ("x\ny", "⋮"),
        ("import a\nx\ny\ndef f():\n    z", "import a\n⋮\ndef f():\n⋮"),
        ("class A:\n    B = C()\n    b = 1", "class A:\n    B = C()\n⋮"),
        ("x\n" * 50 + "import late", "⋮"),
    ],
)
def test_wide_outline(spark, text, want):
    assert one(spark, X.wide_outline(F.lit(text))) == want


def test_outline_of_null_and_long(spark):
    assert one(spark, X.escalated_outline(F.lit(None).cast("string"))) is None
    long = "def f():\n" * 5 + "    a = 1\n" * 100_000
    assert one(spark, X.escalated_outline(F.lit(long), 40)) == "def f():\n" * 5 + "⋮"


def test_interest_lines():
    assert X.interest_lines("def f():\n    '''a\n    b'''\n    return 1") == "def f():\n    '''a\n    b'''\n⋮"
    assert X.interest_lines("def f(): '''a'''\n    '''no'''") == "def f(): '''a'''\n⋮"
    assert X.interest_lines("def f():\n    '''open\nx") == "def f():\n    '''open\nx"
    assert X.interest_lines(None) == "⋮"


def test_import_text():
    assert X.import_text("import a\nx = 1\nfrom b import (\n  c,\n)\n") == "# Import dependencies\nimport a\nfrom b import (\n  c,\n)\n\n"
    assert X.import_text("def f():\n    import a") == X.import_text("def (") == X.import_text(None) == ""


def test_thresholds():
    assert X.thresholds()[:4] == pytest.approx([1.0, 1.0, 1.1, 1.32]) and X.thresholds()[-1] == 5.0


def test_package_tree_hides_below_hidden(spark):
    nodes = spark.createDataFrame([("a", "package", 0.9, None), ("a.b", "module", 5.0, "x"), ("c", "package", 1.0, None), ("c.d", "module", 1.0, "first\nsecond"), ("c.e", "module", None, None)], "id string, kind string, score double, doc string")
    assert sorted(r.shown for r in X.package_tree(nodes).collect()) == ["  - d.py - first...", "- c/"]


def test_listing(spark):
    paths = spark.createDataFrame([(f"d/{i:02}.txt",) for i in range(33)] + [("d/00.txt",), ("a/b/c/d/e.txt",), ("node_modules/x.txt",), ("top.txt",)], "path string")
    rows = X.file_list(paths, per_dir=30).collect()
    shown = {(r.dir, r.kind): r.shown for r in rows if r.kind != "file"}
    assert shown[("d", "more")].strip() == "... 3 more files not displayed" and shown[("a/b/c/d", "cut")].strip() == "... Maximum depth limit reached"
    assert sum(r.kind == "file" for r in rows) == 31 and not any("node_modules" in r.dir for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string")
    assert X.file_list(none).count() == 0 and X.path_nodes(none).count() == 0
    assert X.overview(*(spark.createDataFrame([], "last_line int") for _ in range(3))).first().n_lines == 0


def test_key_classes_guard(spark):
    classes = spark.createDataFrame([(f"m{i}.A", "A", f"m{i}", 0, 1, 4, "d" * 300) for i in range(3)], "id string, name string, module_id string, pos int, first_line int, last_line int, docstring string")
    functions = spark.createDataFrame([("m0.A.f", "m0.A")], "id string, class_id string")
    edges = spark.createDataFrame([("x", "m0.A.f"), ("y", "m0.A.f"), ("x", "m0.A.f")], "src string, dst string")
    assert X.key_classes(classes, functions, edges, 2).count() == 0
    got = {r.id: r for r in X.key_classes(classes, functions, edges, 3).collect()}
    assert (got["m0.A"].methods_count, got["m0.A"].called_by_count, got["m1.A"].methods_count, got["m1.A"].lines, len(got["m1.A"].docstring)) == (1, 2, 0, 4, 200)


class Shelf:
    def size(self, n: int) -> int:
        return n

    def _hidden(self, n: int) -> int:
        return n


def test_tools(spark):
    tools = Tools(spark)
    tools.register_all(Shelf())
    assert set(tools.known) == {"size"} and tools.execute("size", n=3) == 3
    with pytest.raises(KeyError):
        tools.execute("nothing")
    with pytest.raises(TypeError):
        tools.register(lambda x: x, "bare")
    assert [(r.tool, r.arguments, r.status) for r in tools.history().orderBy("call_no").collect()] == [("size", {"n": "3"}, "success"), ("nothing", {}, "error")]


def test_monitor_and_results(spark, tmp_path):
    for name in ("a.txt", "b.csv", "c.bin"):
        (tmp_path / name).write_text("x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.txt").write_text("x")

    def act():
        (tmp_path / "a.txt").write_text("longer")
        os.remove(tmp_path / "b.csv")
        (tmp_path / "new.txt").write_text("")
        return 7

    out, changes = monitored(spark, str(tmp_path), act)
    assert out == 7 and sorted(map(tuple, changes.collect())) == [("a.txt", "changed"), ("b.csv", "deleted"), ("new.txt", "added")]
    assert sorted(r.path for r in files.results(spark, str(tmp_path)).collect()) == ["a.txt", "new.txt"]


def test_display_log_appends_and_takes_pending(spark):
    rows = spark.createDataFrame([(1, "hi", "user", "u", "v", "t"), (2, "no role", None, "u", "v", "t")], "s long, content string, role string, sender string, receiver string, stamp string")
    pending = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c")], "s long, file string")
    log = rows.limit(0).select("s", X.display_row(F.col("content"), F.col("role"), F.col("sender"), F.col("receiver"), F.col("stamp"), F.expr("cast(array() AS array<string>)")).alias("shown"))
    shown, rest = X.display_log(log, rows, pending, "s")
    assert [(r.s, r.shown.new_files, r.shown.message.content) for r in shown.collect()] == [(1, '["a","b"]', "hi")]
    assert [tuple(r) for r in rest.collect()] == [(3, "c")]


def test_readers_see_empty_and_underscored_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "_own file+1.py").write_text("x = 1")
    (tmp_path / "pkg" / "big.py").write_text("y" * 200)
    assert {r.path: r.content for r in files.repository(spark, f"file://{tmp_path}", max_bytes=100).collect()} == {"pkg/__init__.py": "", "pkg/_own file+1.py": "x = 1"}
    assert {r.path: r.size for r in files.snapshot(spark, str(tmp_path)).collect()} == {"pkg/__init__.py": 0, "pkg/_own file+1.py": 5, "pkg/big.py": 200}
    (tmp_path / "none").mkdir()
    assert files.repository(spark, str(tmp_path / "none")).count() == 0
