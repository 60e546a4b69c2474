"""Six modules whose edges, views and records are known by reading them."""

import pytest

from tracequarry.operators import codegraph as C, views as V

CORPUS = (
    ("a.py", "import b\nimport pkg.c as pc\ndef f():\n    g()\n    b.h()\n    self.k()\n    pc.run()\ndef g():\n    '''Args: none'''\n    return x.y.z()\n"),
    ("b.py", "from a import g as gg, g\nclass Base:\n    def k(self):\n        return g()\nclass B(Base):\n    '''doc'''\n    def h(self, n: int) -> List[str]:\n        if n:\n            for i in n:\n                k()\n        B.h()\ndef h():\n    gg()\n    Base.k()\n"),
    ("pkg/c.py", "import b as bee\nfrom b import B\ndef run():\n    bee.h()\n    pkg.c.run()\n    def inner():\n        run()\n    while True:\n        inner()\nclass D(b.Base):\n    def m(self):\n        k()\n"),
    ("pkg/main.py", "import a\nimport pkg.c\nfrom pkg.c import run\nrun()\ndef main():\n    run()\n    a.f()\n    other.a.f()\n"),
    ("pkg/bad.py", "def broken(:\n"),
    ("notes.txt", "not code"),
)
EDGES = [("a.f", "a.g"), ("a.f", "b.h"), ("a.f", "pkg.c.run"), ("b.Base.k", "a.g"), ("b.B.h", "b.Base.k"), ("b.B.h", "b.B.h"), ("b.h", "b.Base.k"), ("pkg.c.run", "b.h"), ("pkg.c.run", "pkg.c.run"), ("pkg.c.run", "pkg.c.inner"), ("pkg.c.inner", "pkg.c.run"), ("pkg.c.D.m", "b.Base.k"), ("pkg.main.main", "pkg.c.run"), ("pkg.main.main", "a.f")]
MODULE_EDGES = [("a", "b"), ("a", "pkg.c"), ("b", "a"), ("pkg.c", "b"), ("pkg.main", "a"), ("pkg.main", "pkg.c")]


@pytest.fixture(scope="module")
def parts(spark):
    parsed = C.parse(spark.createDataFrame(list(CORPUS), "path string, content string")).cache()
    return {r: C.records(parsed, r) for r in ("call", "function", "class", "import", "module", "error")}


@pytest.fixture(scope="module")
def resolved(parts):
    return C.resolve_calls(parts["call"], parts["function"], parts["class"], parts["import"])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edges(parts, resolved):
    assert rows(C.call_edges(resolved)) == sorted(EDGES)
    assert rows(C.import_edges(parts["import"], parts["module"])) == sorted(MODULE_EDGES)
    assert rows(C.class_edges(resolved, parts["function"])) == [("b.B", "b.Base"), ("pkg.c.D", "b.Base")]
    assert len(rows(C.neighbours(C.call_edges(resolved)))) == 2 * len(EDGES)


def test_views(parts, resolved):
    seen = {r.id: r for r in V.entity_view(parts["function"], C.call_edges(resolved)).collect()}
    assert seen["b.B.h"].parameters == "self, n" and seen["b.B.h"].calls == ["b.B.h", "b.Base.k"] and seen["pkg.c.D.m"].called_by == []
    assert rows(V.class_view(parts["class"], parts["function"])) == [("b.B", "Base", "h(self, n)"), ("b.Base", "", "k(self)"), ("pkg.c.D", "b.Base", "m(self)")]


def test_records(parts):
    assert [r.id for r in parts["error"].collect()] == ["pkg.bad"]
    assert parts["function"].where("id = 'b.B.h'").first().return_type == "List[str]"
    assert sorted(r.id for r in parts["module"].collect()) == ["a", "b", "pkg.c", "pkg.main"]
