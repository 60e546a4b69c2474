"""Fixtures with known answers: logs, manifests, paths, packing, readers, writers, streams, graphs."""

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.operators import codegraph, corpus, errors, graph, manifest, messages, ranking, retrieval
from tracequarry.sources import files, sinks
from tracequarry.streaming import traces

LOGS = {
    "missing": ("Traceback\nModuleNotFoundError: No module named 'pandas'", [("missing_package", {"package_name": "pandas"})]),
    "name": ("ImportError: cannot import name 'SequentialModel' from 'tensorflow.keras' (x)", [("import_name_error", {"component_name": "SequentialModel", "package_name": "tensorflow.keras"})]),
    "attribute": ("AttributeError: module 'numpy.random' has no attribute 'randn_special'", [("attribute_error", {"package_name": "numpy.random", "attribute_name": "randn_special"})]),
    "conflict, other words": ("tensorflow 2.4.0 requires numpy~=1.19.2, but you have numpy 1.18.5", []),
    "dependency: the token before requires": ("ERROR: tensorboard 2.4.0 requires markdown>=2.6.8, which is not installed.", [("dependency_error", {"package_name": "2.4.0", "dependency_name": "markdown>=2.6.8"})]),
    "path before the name": ('File "/x/site-packages/pkg/a.py", line 3\nPermissionError: no', []),
    "clean": ("all went well", []),
}


def test_error_logs(spark):
    logs = spark.createDataFrame([(k, v[0]) for k, v in LOGS.items()], "id string, text string")
    got = errors.extract(logs).collect()
    for k, (_, want) in LOGS.items():
        assert [(r.error_type, r.details) for r in sorted(got, key=lambda r: (r.pattern_no, r.match_no)) if r.id == k] == want
    first = next(r for r in got if r.id == "missing")
    assert first.context == LOGS["missing"][0] and first.suggestion.endswith("pip install pandas")
    commands = {r.id: r.commands for r in errors.fix_commands(errors.extract(logs)).collect()}
    assert commands["missing"] == [*errors.PREAMBLE, "pip install pandas"] and set(commands) == {"missing", "dependency: the token before requires"}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("size,want", [(0, "0 B"), (512, "512.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"), (5 << 40, "5.0 TB")])
def test_sizes(spark, size, want):
    assert one(spark, T.size_format(F.lit(size))) == want


@pytest.mark.parametrize("size,want", [(256, "256.0 B"), (1024 + 256, "1.2 KB"), (1024 + 768, "1.8 KB"), (157 * 1024 + 256, "157.2 KB"), (3 * (1 << 20) + (1 << 18), "3.2 MB"), (0.25, "0.2 B"), (1023.99 * 1024, "1024.0 KB"), (5 << 50, "5120.0 TB"), (-1.25, "-1.2 B"), (None, None)])
def test_sizes_round_halves_to_even(spark, size, want):
    assert one(spark, T.size_format(F.lit(size))) == want


def test_text_functions(spark):
    assert one(spark, T.collapse_whitespace(F.lit(" a  \n b "))) == "a b"
    assert one(spark, T.sanitize_filename(F.lit("..My  File(1)!.txt_"))) == "my_file1.txt"
    assert one(spark, T.module_id(F.lit("a/py.py/b.py"))) == "a.py.py.b"
    assert one(spark, T.decision(F.lit("no: because"))).asDict() == {"verdict": "NO", "reason": "because"}
    assert one(spark, T.decision(F.lit("perhaps"))).verdict is None
    assert one(spark, T.code_blocks(F.lit("```python\nx\n```\n```sql\ny\n```"))) is None
    assert one(spark, T.clean_web_text(F.lit("see http://x.y/z now and then\n<b>Home</b>\nCopyright © 2020 all of it\n  three words here  "))) == "see  now and then\nthree words here"
    assert one(spark, T.file_kind(F.lit("a/b.PNG"))) == "image" and one(spark, T.retryable(F.lit("Read TIMED OUT"))) is True


ANSWERS = ["Yesótata why", "noß", "YES_1", "yes9", "no\u00a0x", "\u000byes x", "no:\u000b- x", "yes - \u3000 a \u00a0", "\u00a0 {} \u2003", "", None, "NO", " \n\tyes:-\r\nb\n", "```json\n{\"a\": 1}\n``` {x}```", "```\u000b{x}```", "\u200bx\u200b", "YES\u0301 x", "yes\U0001f600"]


def test_answers_as_in_sql(spark):
    import duckdb

    sql = r"""SELECT nullif(upper(regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 1)), ''), CASE WHEN regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 1) <> '' THEN trim(regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 2)) END,
      coalesce(nullif(regexp_extract(a, '(?s)```(?:json)?\s*(\{.*\})\s*```', 1), ''), trim(a)) FROM (SELECT unnest($1) AS a)"""
    want = duckdb.connect().execute(sql, [ANSWERS]).fetchall()
    got = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, a string").select("i", T.decision("a").alias("d"), T.json_block("a").alias("b")).select("i", "d.*", "b").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == want
    assert want[0] == ("YES", "ótata why", "Yesótata why")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_trace_runtime_is_whole(spark, kind, zone):
    rows = [(1, "2024-01-01 00:00:00.000000"), (1, "2024-01-30 07:39:09.783000"), (2, "2024-03-09 12:00:00.000001"), (2, "2024-03-11 12:00:00.001"), (3, None), (4, "1969-12-31 23:59:59.999999"), (4, "1970-01-01 00:00:00.000999")]
    rows += [(10 + k, t) for k in range(1000) for t in ("2024-01-01 00:00:00.001000", f"2024-02-01 00:00:{k % 60:02d}.{k:03d}000")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = spark.createDataFrame(rows, "trace_id int, ts string").selectExpr("trace_id", f"cast(ts AS {kind}) AS ts", "'x' AS event_type")
        got = {r.trace_id: r.runtime_ms for r in ranking.trace_labels(events).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    shift = 3_600_000 if kind == "timestamp" and zone != "UTC" else 0  # the clocks went forward between those two instants
    assert got[1] == 29 * 86_400_000 + 27_549_783 and got[2] == 2 * 86_400_000 - shift and got[3] is None and got[4] == 1
    assert all(got[10 + k] == 31 * 86_400_000 + (k % 60) * 1000 + k - 1 for k in range(1000))


def test_manifest(spark):
    c = F.lit
    assert one(spark, manifest.runtime(c("Python 3.x"))) == "python-3.x" and one(spark, manifest.error_type(c(""))) == "UnknownError"
    assert one(spark, manifest.language(c("C#"))) == "c#"  # the key drops the sign, so no alias is hit
    assert one(spark, manifest.infer_language(c("copy of it"))) == "python"  # a mark inside of a word counts
    assert one(spark, manifest.required_libraries(F.array(c("langgraph"), c("langchain-core")), F.array(c("time"), c("langchain_core.messages.HumanMessage")), c(""), ("time",))) == ["langchain-core", "langgraph"]
    assert one(spark, manifest.dedupe(F.array(c(" A "), c("a"), c(""), c("b")))) == ["A", "b"]
    pack = one(spark, manifest.query_pack(c("fix it"), F.array(c("Fix it"), c("more")), c("E"), c("slow"), c(""), c("P"), c("python-3.x"), c("python"), F.array(c("numpy"))))
    assert len(pack.retrieval_queries) == 18 and pack.retrieval_queries[0] == "fix it" and "unknown_node" in pack.template_queries[5]


def test_repo_score_can_pass_one(spark):
    full = ranking.repo_score({k: F.lit(1) for k in ranking.DIMENSIONS}, F.lit(10))
    assert round(one(spark, full), 6) == 1.06


def test_commands(spark):
    rows = [(1, 1, "sh", "# filename: setup_environment.sh\npip install x"), (1, 2, "sh", "sh   setup_environment.sh"), (1, 3, "sh", "ls"), (2, 1, "sh", "sh setup_environment.sh")]
    got = ranking.dedupe_commands(spark.createDataFrame(rows, "task int, pos int, language string, command string")).collect()
    assert sorted((r.task, r.pos) for r in got) == [(1, 1), (1, 3), (2, 1)]


def test_budgets_and_packs(spark):
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([4, 5, 3, 9, 1])], "g string, i int, t int")
    assert [r.i for r in corpus.budget_prefix(rows, "g", ["i"], F.col("t"), 9).orderBy("i").collect()] == [0, 1, 2]
    assert [r.pack for r in corpus.pack(rows, "g", "i", "t", 9).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert [r.pack for r in corpus.pack(rows, "g", "i", "t", 8, after=True).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_parser_rules(spark):
    got = list(codegraph.parse_module("m", "import os as o, sys\nasync def skip(): pass\nclass A(b.C):\n  def f(self, x):\n    def g(): return h()\n    return a.b.c() + d.e()\n"))
    functions = [(r["id"], r.get("class_id")) for r in got if r["record"] == "function"]
    assert functions == [("m.A.f", "m.A"), ("m.g", None)]
    assert sorted((r["id"], r["kind"], r.get("name") or r.get("full_path") or r["attribute"]) for r in got if r["record"] == "call") == sorted([("m.A.f", "nested_attribute", "a.b.c"), ("m.A.f", "attribute", "e"), ("m.A.f", "simple", "h"), ("m.g", "simple", "h")])
    assert [r["alias"] for r in got if r["record"] == "import"] == ["o", None] and [r["record"] for r in codegraph.parse_module("x", "def (")] == ["error"]


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["d"]
    with pytest.raises(ValueError):
        graph.betweenness(edges, most_nodes=2)


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in retrieval.vector_top(v, [1.0, 0.0], 2).collect()] == [4, 3]
    assert {(r["query"], r.vec_id) for r in retrieval.vector_top_of(v, v.where("vec_id = 0"), 1).collect()} == {(0, 1)}


def test_readers_and_writers(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.py": "x = 1", "pkg/b.txt": "é", "build/c.py": "no", "d/e/f/g/h.py": "too deep", "i.png": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "latin.log1").write_bytes("é".encode("latin-1"))
    assert {(r.path, r.content) for r in files.repository(spark, str(root)).collect()} == {("a.py", "x = 1"), ("pkg/b.txt", "é"), ("latin.log1", "é")}
    assert {r.path for r in files.snapshot(spark, str(root)).collect()} == {"a.py", "pkg/b.txt", "d/e/f/g/h.py", "i.png", "latin.log1"}
    (tmp_path / "t.json").write_text(json.dumps({"trace_id": "t", "repository": "https://github.com/o/r", "commit_id": "c", "code_location": {"filepath": "f", "lineno": 32, "function": "g"}, "error_context": {"type": "x"}}))
    flat = files.normalised_traces(files.traces(spark, str(tmp_path / "t.json"))).first()
    assert (flat.repository, flat.lineno, flat.violations) == ("o/r", 32, [])
    table = spark.createDataFrame([("1", "write", "pending", "high")], files.TODO_SCHEMA)
    sinks.todos(table, str(tmp_path / "todos"))
    assert files.todos(spark, str(tmp_path / "todos")).collect() == table.collect()
    with pytest.raises(Exception):
        sinks.todos(table.withColumn("status", F.lit("odd")), str(tmp_path / "bad"))
    for end in ("csv", "json", "parquet"):
        sinks.table(table, str(tmp_path / f"t.{end}"))
    assert files.csv(spark, str(tmp_path / "t.csv")).count() == 1
    with pytest.raises(TypeError):
        sinks.table(table, str(tmp_path / "t.xlsx"))
    log = spark.createDataFrame([("u", "m", "hello")], "user_id string, mode string, content string")
    sinks.conversation(log, str(tmp_path / "log"))
    sinks.conversation(log, str(tmp_path / "log"))
    assert files.conversations(spark, str(tmp_path / "log"), "u", "m").count() == 2 and files.conversations(spark, str(tmp_path / "log"), "v").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for made, name in ((traces.windowed_counts, "w"), (traces.distinct_events, "d")):
        q = made(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("out_d").count() == events.count()
    whole = traces.windowed_counts(events)
    closed = spark.table("out_w")
    assert closed.count() > 0 and closed.exceptAll(whole.select(*closed.columns)).count() == 0


def test_histories(spark):
    log = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x")], "conv_id long, turn long, role string, content string")
    assert {r.conv_id: r.history for r in messages.history(log, least=1).collect()} == {1: "User: a\nAssistant: b", 2: ""}
    assert {r.conv_id: r.run for r in messages.trailing_run(log).collect()} == {1: 0, 2: 1}


def test_spans_of_any_length(spark):
    spans = spark.createDataFrame([(1, 0, 5000), (1, 10, 20), (2, 7, None), (3, 640, 649), (4, 5, 4)], "doc_id long, first_line int, last_line int")
    asked = [(1, 0), (1, 15), (1, 4000), (1, 5000), (1, 5001), (2, 6), (2, 3000), (2, 900_000), (3, 639), (3, 640), (3, 649), (3, 650), (4, 5)]
    got = {(r.doc_id, r.line_no): r.first_line for r in corpus.span_at(spans, spark.createDataFrame(asked, "doc_id long, line_no int")).collect()}
    assert got == {(1, 0): 0, (1, 15): 0, (1, 4000): 0, (1, 5000): 0, (2, 3000): 7, (2, 900_000): 7, (3, 640): 640, (3, 649): 640}


def test_anchored_patterns_find_the_same(spark):
    import random
    import re

    rng = random.Random(3)
    bits = ["pkg", " requires ", "requires ", "a>=1", ", but b is installed", " is installed", ", which is not installed", " 1.0 is incompatible with ", " is incompatible with ", "q 2.0", " ", "\n", "1.0", ",", "x y ", "p requires a 2, but ", "p requires q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([3, 8, 20]))) for _ in range(400)]
    names = ("version_conflict", "dependency_error", "incompatible_version")
    fixed = {name: (re.compile("(?im)" + pattern), groups) for name, pattern, groups, _ in errors.PATTERNS if name in names}
    got = errors.extract(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    for name, (pattern, groups) in fixed.items():
        want = sorted((i, n, m[0], m.groups()) for i, t in enumerate(texts) for n, m in enumerate(pattern.finditer(t)))
        assert sorted((r.id, r.match_no, r.match_text, tuple(r.details[g] for g in groups)) for r in got if r.error_type == name) == want and want


def test_long_line_is_quick(spark):
    import time

    began = time.time()
    text = "word " * 200_000 + "a" * 500_000 + " requires b, which is not installed"
    assert [r.error_type for r in errors.extract(spark.createDataFrame([(1, text)], "id int, text string")).collect()] == ["dependency_error"]
    assert time.time() - began < 30


def test_running_sums_of_one_large_group(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("t"))
    got = corpus.running_before(rows, "g", ["i"], F.col("t")).orderBy("i").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.t


def test_queries_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, retrieval.vector_top_of(v, v.where("vec_id % 2 = 0"), 2, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 60


def test_directed_jumps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, personal=spark.createDataFrame([("d", 1.0)], "node string, weight double")).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and abs(ranks["d"] - 0.15) < 1e-6


def test_recursive_split():
    text = "Para one. " * 30 + "\n\n" + "Second line\n" * 20 + "x" * 250
    for size, overlap in ((100, 20), (300, 0), (40, 10)):
        found = retrieval.split_text(text, size, overlap)
        assert all(0 < len(c) <= size and c in text for c in found) and found[-1].endswith("x")
        assert set("".join(found).split()) >= {"Para", "one.", "Second", "line"}
    assert retrieval.split_text("", 10, 2) == [] and retrieval.split_text("short", 10, 2) == ["short"]


def test_stored_trees_and_vectors(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    for as_json in (False, True):
        sinks.code_tree({"modules": a, "calls": a}, f"{tmp_path}/tree{as_json}", as_json)
        assert files.code_tree(spark, f"{tmp_path}/tree{as_json}", ("modules", "calls"), as_json)["calls"].count() == 1
    sinks.vectors(a, f"{tmp_path}/v")
    assert files.vectors(spark, f"{tmp_path}/v").count() == 1
    sinks.drop(spark, f"{tmp_path}/v")
    assert not (tmp_path / "v").exists()


def test_canonical_query_trims_blanks_alone(spark):
    c, none = F.lit, F.expr("cast(array() AS array<string>)")
    assert one(spark, manifest.canonical_query(c(" E1 "), c("s2"), c("p3"), c("n4"), c("r5"), none, none)) == "fix E1 s2 p3 n4 runtime r5"
