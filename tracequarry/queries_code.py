"""Queries over logs of package errors, manifests, trace packets and source code; fixtures stand inline or follow from driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.operators import codegraph as C, errors as E, graph, manifest as Mf, ranking
from tracequarry.plans.shared import materialise
from tracequarry.queries import query, table
from tracequarry.sources import files
from tracequarry.streaming import traces

NL = "chr(10)"
# ---------------------------------------------------------------- errors
_LOGS = """CASE doc_id % 8 WHEN 0 THEN 'Traceback' || NL || 'ModuleNotFoundError: No module named ''' || lang || '.sub''' || NL || 'end'
 WHEN 1 THEN 'ImportError: cannot import name ''X' || lang || ''' from ''pkg.' || source || '''' WHEN 2 THEN 'AttributeError: module ''numpy.r'' has no attribute ''' || lang || ''''
 WHEN 3 THEN source || ' requires bar 2.0, but 1.0 is installed' WHEN 4 THEN 'x pkga requires ' || source || '>=2, which is not installed' || NL || 'x pkgc requires pkgb, which is not installed'
 WHEN 5 THEN 'a 1.0 is incompatible with ' || source || ' 2.0' WHEN 6 THEN 'ImportError: No module named ''q.r''' || NL || 'importerror: no module named ""' || lang || '"" ' || NL || 'ImportError: No module named ''q.s'''
 ELSE 'ImportError: DLL load failed while importing cv2: ' || source END""".replace('""', '"')


def _logs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_LOGS.replace("NL", "'\\n'")).alias("text"))


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _error_rows() -> str:
    parts = []
    for no, (name, pattern, groups, suggestion) in enumerate(E.PATTERNS):
        found = ", ".join(f"regexp_extract_all(text, '(?im){_quoted(pattern)}', {k}) AS g{k}" for k in range(len(groups) + 1))
        said = f"'{_quoted(suggestion)}'"
        for k, g in enumerate(groups, 1):
            said = f"replace({said}, '{{{g}}}', g{k}[i])"
        keyed = "[" + ", ".join(f"{{'k': '{g}', 'v': g{k}[i]}}" for k, g in enumerate(groups, 1)) + "]"
        parts.append(f"SELECT id, {no} AS pattern_no, i - 1 AS match_no, '{name}' AS error_type, g0[i] AS match_text, {said} AS suggestion, {keyed} AS d FROM (SELECT *, unnest(generate_series(1, len(g0))) AS i FROM (SELECT id, {found} FROM l))")
    return f"l AS (SELECT doc_id AS id, {_LOGS.replace('NL', NL)} AS text FROM documents), e AS ({' UNION ALL '.join(parts)})"


@query("WITH " + _error_rows() + " SELECT id, pattern_no, match_no, error_type, match_text, suggestion FROM e")
def error_extract(spark, sf_dir):
    return E.extract(_logs(spark, sf_dir)).select("id", "pattern_no", "match_no", "error_type", "match_text", "suggestion")


@query("WITH " + _error_rows() + " SELECT error_type, count(*) AS n, CASE error_type WHEN 'dll_load_error' THEN 'DLL Load Error' WHEN 'missing_package' THEN 'Missing Package' WHEN 'import_name_error' THEN 'Import Name Error' WHEN 'attribute_error' THEN 'Attribute Error' WHEN 'version_conflict' THEN 'Version Conflict' WHEN 'dependency_error' THEN 'Dependency Error' WHEN 'incompatible_version' THEN 'Incompatible Version' END AS label FROM e GROUP BY error_type")
def error_summary(spark, sf_dir):
    return E.summary(E.extract(_logs(spark, sf_dir)))


@query("WITH " + _error_rows() + " SELECT DISTINCT split_part(x.v, '.', 1) AS package FROM (SELECT unnest(d) AS x FROM e) WHERE contains(x.k, 'package') OR contains(x.k, 'module')")
def affected_packages(spark, sf_dir):
    return E.affected_packages(E.extract(_logs(spark, sf_dir)))


_V = "[x.v for x in d if x.k = '{0}'][1]"
_PKG, _DEP, _REQ = (_V.format(k) for k in ("package_name", "dependency_name", "required_version"))


@query("WITH " + _error_rows() + f""", c AS (SELECT id, pattern_no, match_no, CASE error_type WHEN 'missing_package' THEN 'p' || split_part({_PKG}, '.', 1) WHEN 'dependency_error' THEN 'p' || {_DEP} WHEN 'version_conflict' THEN 'c' || {_PKG} || '=' || {_REQ} END AS key,
 CASE error_type WHEN 'missing_package' THEN 'pip install ' || split_part({_PKG}, '.', 1) WHEN 'dependency_error' THEN 'pip install ' || {_DEP} WHEN 'version_conflict' THEN 'pip install ' || {_PKG} || '==' || {_REQ} END AS command FROM e)
SELECT id, '{_quoted("|".join(E.PREAMBLE))}' || '|' || string_agg(command, '|' ORDER BY pattern_no, match_no) AS commands FROM (SELECT * FROM c WHERE command IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY pattern_no, match_no) = 1) GROUP BY id""")
def fix_commands(spark, sf_dir):
    return E.fix_commands(E.extract(_logs(spark, sf_dir))).select("id", F.array_join("commands", "|").alias("commands"))


@query("WITH " + _error_rows() + " SELECT DISTINCT split_part(x.v, '.', 1) AS package FROM (SELECT unnest(d) AS x FROM e) WHERE x.k = 'package_name' AND split_part(x.v, '.', 1) NOT IN ('numpy', 'q') AND split_part(x.v, '.', 1) IN (SELECT lang FROM documents UNION SELECT 'pkg')")
def installable_packages(spark, sf_dir):
    named = E.extract(_logs(spark, sf_dir)).select(F.substring_index(F.element_at("details", F.lit("package_name")), ".", 1).alias("package")).where("package IS NOT NULL").distinct()
    builtin = spark.createDataFrame([("numpy",), ("q",)], "package string")
    index = table(spark, sf_dir, "documents").select(F.col("lang").alias("package")).distinct().unionByName(spark.createDataFrame([("pkg",)], "package string"))
    return E.installable(named, builtin, index)


@query("WITH " + _error_rows() + f" SELECT id, string_agg({_PKG}, ',' ORDER BY pattern_no, match_no) AS packages FROM e WHERE error_type IN ('missing_package', 'version_conflict', 'dependency_error', 'pkg_resources_error', 'syntax_error_in_package') AND {_PKG} IS NOT NULL GROUP BY id")
def install_packages(spark, sf_dir):
    return E.install_packages(E.extract(_logs(spark, sf_dir))).select("id", F.array_join("packages", ",").alias("packages"))


@query("WITH " + _error_rows() + " SELECT id, count(*) AS n_errors, count(DISTINCT error_type) AS n_kinds FROM e GROUP BY id")
def error_report(spark, sf_dir):
    return E.report(E.extract(_logs(spark, sf_dir))).select("id", "n_errors", F.size("kinds").cast("long").alias("n_kinds"))


# ---------------------------------------------------------------- manifests
_RAW = """SELECT doc_id, [' Python 3.x ', 'node', 'py3', 'Rust  1.7', '', 'GoLang'][1 + doc_id % 6] AS run, ['py', 'C#', 'TypeScript', 'node', '', 'Kotlin X'][1 + doc_id % 6] AS lang_raw, ['time-out', 'KeyError', 'HTTP 502', 'Odd  Error', ''][1 + doc_id % 5] AS err,
 ['RAG', 'react agent', 'My  Pattern', ' ', 'multi-agent'][1 + doc_id % 5] AS pat, text AS symptom, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS node, ['numpy and pandas', 'use torch', 'none', 'Flask app'][1 + doc_id % 4] AS said,
 [['numpy.linalg', ' os.path '], ['Azure_OpenAI', 'x'], CAST([] AS VARCHAR[]), ['langchain.core', 'numpy']][1 + doc_id % 4] AS deps, ['fix it , now', ' Fix  it, now', 'run .', ''] AS seeds FROM documents"""


def _raw(spark, sf_dir):
    pick = lambda xs, by: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % by).cast("int"))
    deps = F.get(F.array(F.array(F.lit("numpy.linalg"), F.lit(" os.path ")), F.array(F.lit("Azure_OpenAI"), F.lit("x")), F.expr("cast(array() AS array<string>)"), F.array(F.lit("langchain.core"), F.lit("numpy"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick([" Python 3.x ", "node", "py3", "Rust  1.7", "", "GoLang"], 6).alias("run"), pick(["py", "C#", "TypeScript", "node", "", "Kotlin X"], 6).alias("lang_raw"), pick(["time-out", "KeyError", "HTTP 502", "Odd  Error", ""], 5).alias("err"),
        pick(["RAG", "react agent", "My  Pattern", " ", "multi-agent"], 5).alias("pat"), F.col("text").alias("symptom"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("node"),
        pick(["numpy and pandas", "use torch", "none", "Flask app"], 4).alias("said"), deps.alias("deps"), F.array(*map(F.lit, ["fix it , now", " Fix  it, now", "run .", ""])).alias("seeds"),
    )


def _map(name: str, table_: dict[str, str], key: str, other: str) -> str:
    return "CASE " + f"regexp_replace(lower(trim({key})), '[^a-z0-9]+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END AS {name}"


def _ws(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_NORMAL = f"""r AS ({_RAW}), n AS (SELECT *, CASE WHEN run = '' THEN '' ELSE rt END AS runtime, CASE WHEN lang_raw = '' THEN '' ELSE la END AS language, CASE WHEN err = '' THEN 'UnknownError' ELSE et END AS error_type, CASE WHEN trim(pat) = '' THEN 'Unknown Architecture' ELSE ap END AS architecture
 FROM (SELECT *, {_map('rt', Mf.RUNTIMES, 'run', f"lower({_ws('run')})")}, {_map('la', Mf.LANGUAGES, 'lang_raw', f"lower({_ws('lang_raw')})")}, {_map('et', Mf.ERROR_TYPES, 'err', _ws('err'))}, {_map('ap', Mf.ARCHITECTURES, 'pat', _ws('pat'))} FROM r))"""


@query("WITH " + _NORMAL + " SELECT doc_id, runtime, language, error_type, architecture, CASE WHEN contains(h, 'python') OR contains(h, 'py') THEN 'python' WHEN contains(h, 'javascript') OR contains(h, 'node.js') OR contains(h, 'nodejs') OR contains(h, ' js ') THEN 'javascript' WHEN contains(h, 'typescript') OR contains(h, ' ts ') THEN 'typescript' WHEN contains(h, ' java ') THEN 'java' WHEN contains(h, ' golang ') OR contains(h, ' go ') THEN 'go' ELSE '' END AS inferred FROM (SELECT *, ' ' || lower(run || ' ' || symptom) || ' ' AS h FROM n)")
def manifest_normalise(spark, sf_dir):
    c = F.col
    return _raw(spark, sf_dir).select("doc_id", Mf.runtime(c("run")).alias("runtime"), Mf.language(c("lang_raw")).alias("language"), Mf.error_type(c("err")).alias("error_type"), Mf.architecture(c("pat")).alias("architecture"), Mf.infer_language(c("run"), c("symptom")).alias("inferred"))


def _library(x: str) -> str:
    return "CASE regexp_replace(lower(trim(" + x + ")), '[^a-z0-9]+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Mf.LIBRARIES.items()) + f" ELSE lower(trim(replace({x}, '_', '-'))) END"


_LIBS = f"""list_sort(list_distinct(list_concat([{_library('x')} for x in ['Requests', said]], [{_library("trim(split_part(trim(x), '.', 1))")} for x in deps if trim(split_part(trim(x), '.', 1)) not in ('os', 'sys', '')],
 [y for y in [{_library('x')} for x in regexp_extract_all(lower(said), '[a-z][a-z0-9_\\-.]+')] if y in ({', '.join(f"'{v}'" for v in Mf.LIBRARY_VALUES)})])))"""


@query("WITH " + _NORMAL + f" SELECT doc_id, array_to_string({_LIBS}, ',') AS libraries FROM n")
def manifest_libraries(spark, sf_dir):
    given = F.array(F.lit("Requests"), F.col("said"))
    return _raw(spark, sf_dir).select("doc_id", F.array_join(Mf.required_libraries(given, F.col("deps"), F.col("said"), ("os", "sys")), ",").alias("libraries"))


def _q(x: str) -> str:
    return f"replace(replace({_ws(x)}, ' ,', ','), ' .', '.')"


@query("WITH " + _NORMAL + f""", b AS (SELECT doc_id, runtime, language, 'numpy, torch' AS libs, [{_q("'fix ' || error_type || ' ' || symptom || ' in ' || architecture")}, {_q("'resolve ' || error_type || ' at ' || w || ' for ' || architecture")}, {_q("architecture || ' ' || w || ' timeout mitigation ' || error_type")}, {_q("error_type || ' ' || symptom || ' call path ' || w")}] AS bases
 FROM (SELECT *, CASE WHEN node = '' THEN 'unknown_node' ELSE node END AS w FROM n))
SELECT doc_id, md5(array_to_string(flatten([[x for x in [z, CASE WHEN runtime <> '' THEN {_q("z || ' runtime ' || runtime")} END, CASE WHEN language <> '' THEN {_q("z || ' language ' || language")} END, {_q("z || ' libraries ' || libs")}, CASE WHEN runtime <> '' THEN {_q("z || ' runtime ' || runtime || ' libraries ' || libs")} END] if x is not null] for z in bases]), '|')) AS templates FROM b""")
def query_templates(spark, sf_dir):
    n = _raw(spark, sf_dir)
    c = F.col
    made = Mf.templates(Mf.error_type(c("err")), c("symptom"), c("node"), Mf.architecture(c("pat")), Mf.runtime(c("run")), Mf.language(c("lang_raw")), F.array(F.lit("numpy"), F.lit("torch")))
    return n.select("doc_id", F.md5(F.array_join(made, "|")).alias("templates"))


@query("WITH " + _NORMAL + """ SELECT doc_id, 'look up|fix it, now|run.' AS seeds, array_to_string([CASE WHEN s = '' THEN q ELSE q || ' ' || s END for q in ['look up', 'fix it, now', 'run.']], '|') AS injected, 'look up' AS first_query
 FROM (SELECT doc_id, array_to_string([x for x in [CASE WHEN runtime <> '' THEN 'runtime ' || runtime END, CASE WHEN language <> '' THEN 'language ' || language END] if x is not null], ' ') AS s FROM n)""")
def query_pack(spark, sf_dir):
    c = F.col
    pack = Mf.query_pack(F.lit("look up"), c("seeds"), Mf.error_type(c("err")), c("symptom"), c("node"), Mf.architecture(c("pat")), Mf.runtime(c("run")), Mf.language(c("lang_raw")), F.expr("cast(array() AS array<string>)"))
    return _raw(spark, sf_dir).select("doc_id", pack.alias("p")).select("doc_id", F.array_join("p.seed_queries", "|").alias("seeds"), F.array_join("p.constraint_injected_queries", "|").alias("injected"), F.get("p.retrieval_queries", F.lit(0)).alias("first_query"))


@query("SELECT doc_id, array_to_string(list_concat([q], [x for x in [lang, source, upper(lang)] if lower(x) <> lower(q)]), '|') AS queries, array_to_string([trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in [' a  b ', '', lang] if trim(x) <> ''], '|') AS listed FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'z' END AS q FROM documents)")
def query_prepend(spark, sf_dir):
    q = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("z")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(Mf.prepend_query(F.array("lang", "source", F.upper("lang")), q), "|").alias("queries"), F.array_join(Mf.string_list(F.array(F.lit(" a  b "), F.lit(""), F.col("lang"))), "|").alias("listed"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang || '.x' ELSE lang || ' as y' END AS dependency, split_part(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang || '.x' ELSE lang || ' as y' END, '.', 1) AS root FROM documents")
def dependency_cleanup(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("from "), "source", F.lit("  import z"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" import "), "lang", F.lit(".x"))).otherwise(F.concat("lang", F.lit("  as y")))
    d = table(spark, sf_dir, "documents").select("doc_id", T.dependency_of(raw).alias("dependency"))
    return d.withColumn("root", T.dependency_root("dependency"))


# ---------------------------------------------------------------- trace packets and readers
@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'owner/' || source WHEN 1 THEN 'a/b' ELSE 'a/b/c' END AS repository, array_to_string([x for x in [CASE WHEN doc_id % 7 = 0 THEN 'blank trace_id' END, CASE WHEN doc_id % 5 = 0 THEN 'lineno' END, CASE WHEN doc_id % 3 = 2 THEN 'repository' END, CASE WHEN doc_id % 4 = 0 THEN 'error_context' END] if x is not null], ',') AS violations FROM documents""")
def trace_packets(spark, sf_dir):
    i = F.col("doc_id")
    packets = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("t"), i)).alias("trace_id"), F.when(i % 3 == 0, F.concat(F.lit("https://github.com/owner/"), "source")).when(i % 3 == 1, "a/b").otherwise("a/b/c").alias("repository"), F.lit("c0").alias("commit_id"),
        F.struct(F.lit("f.py").alias("filepath"), (i % 5).alias("lineno"), F.lit("g").alias("function")).alias("code_location"), F.when(i % 4 == 0, F.create_map(F.lit(" "), F.lit("x"))).otherwise(F.create_map(F.lit("type"), F.lit("x"))).alias("error_context"),
    )
    flat = files.normalised_traces(packets.withColumn("commit_id", F.concat_ws("#", "commit_id", "doc_id")))
    return flat.select(F.substring_index("commit_id", "#", -1).cast("long").alias("doc_id"), "repository", F.array_join("violations", ",").alias("violations"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not a file' WHEN doc_id % 5 = 1 THEN 'unknown encoding' WHEN doc_id % 5 = 2 THEN 'empty' END AS error, CASE WHEN doc_id % 5 > 2 THEN text END AS text FROM documents")
def content_decode(spark, sf_dir):
    i = F.col("doc_id") % 5
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{20})", "$1\n")
    payload = table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, "dir").otherwise("file").alias("type"), F.when(i == 1, "none").otherwise("base64").alias("encoding"), F.when(i == 2, " \n").otherwise(coded).alias("content"))
    return files.decoded_content(payload).select("doc_id", "error", "text")


@query("SELECT doc_id, source || '_a' || chr(10) || 'b' || chr(10) || chr(10) || 'c=1' AS code FROM documents")
def notebook_code(spark, sf_dir):
    cells = F.concat(F.lit('{"cells": [{"cell_type": "code", "source": ["'), "source", F.lit('_a\\n", "b"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "c=1"}]}'))
    return table(spark, sf_dir, "documents").select("doc_id", files.notebook_code(cells).alias("code"))


# ---------------------------------------------------------------- code graphs
#: Every document as a module: its text as a comment, two imports, two functions, a class of two methods. g of module i
#: calls the next module by an alias and the module of half its number by name.
_CODE = (
    "import corp.m{n} as nxt\nfrom corp.m{h} import g{h}\n# {text}\ndef f():\n    return g{i}()\ndef g{i}(x: Dict[str, int]):\n    \"\"\"Doc {i}.\"\"\"\n    nxt.f()\n    g{h}()\n"
    "class C{i}(B{h}):\n    def k(self, a):\n        f()\n        C{h}.j()\n    def j(self):\n        pass\n"
)


def _sources(spark, sf_dir):
    """The modules as files (path, content); a null text is empty, and what is not plain ASCII in a text is blank, so a text is one comment."""
    i = F.col("doc_id")
    values = {"i": i.cast("string"), "n": (i + 1).cast("string"), "h": F.floor(i / 2).cast("string"), "text": F.coalesce(F.regexp_replace("text", r"[^\x20-\x7e]", " "), F.lit(""))}
    code = F.concat(*(values.get(part, F.lit(part)) for part in re.split(r"\{(\w+)\}", _CODE)))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("corp/m"), "doc_id", F.lit(".py")).alias("path"), code.alias("content"))


def _corpus(spark, sf_dir):
    return C.parse(_sources(spark, sf_dir))


#: The modules' numbers: i, the next one (n) and half of it (h), null where there is no such module.
_MODULES_SQL = "d AS MATERIALIZED (SELECT DISTINCT doc_id AS i FROM documents), m AS MATERIALIZED (SELECT d.i, x.i AS n, y.i AS h FROM d LEFT JOIN d x ON x.i = d.i + 1 LEFT JOIN d y ON y.i = d.i // 2)"
_EDGES_SQL = (
    _MODULES_SQL + ", e AS (SELECT 'corp.m' || i || '.f' AS src, 'corp.m' || i || '.g' || i AS dst FROM m UNION SELECT 'corp.m' || i || '.g' || i, 'corp.m' || n || '.f' FROM m WHERE n IS NOT NULL"
    " UNION SELECT 'corp.m' || i || '.g' || i, 'corp.m' || h || '.g' || h FROM m WHERE h IS NOT NULL UNION SELECT 'corp.m' || i || '.C' || i || '.k', 'corp.m' || i || '.f' FROM m"
    " UNION SELECT 'corp.m' || i || '.C' || i || '.k', 'corp.m' || h || '.C' || h || '.j' FROM m WHERE h IS NOT NULL)"
)


def _parts(spark, sf_dir):
    parsed = materialise(_corpus(spark, sf_dir), "parsed")
    get = lambda r: C.records(parsed, r)
    return get("call"), get("function"), get("class"), get("import"), get("module")


@query(f"WITH {_EDGES_SQL} SELECT src, dst FROM e")
def call_edges(spark, sf_dir):
    calls, functions, classes, imports, _ = _parts(spark, sf_dir)
    return C.call_edges(C.resolve_calls(calls, functions, classes, imports))


@query(f"WITH {_MODULES_SQL} SELECT 'corp.m' || i AS src, 'corp.m' || n AS dst FROM m WHERE n IS NOT NULL UNION SELECT 'corp.m' || i, 'corp.m' || h FROM m WHERE h <> i")
def import_edges(spark, sf_dir):
    *_, imports, modules = _parts(spark, sf_dir)
    return C.import_edges(imports, modules)


@query(f"WITH {_MODULES_SQL} SELECT 'corp.m' || i || '.C' || i AS src, 'corp.m' || h || '.C' || h AS dst FROM m WHERE h <> i")
def class_call_edges(spark, sf_dir):
    calls, functions, classes, imports, _ = _parts(spark, sf_dir)
    return C.class_edges(C.resolve_calls(calls, functions, classes, imports), functions)


@query(f"WITH {_EDGES_SQL} SELECT src AS entity, 'calls' AS direction, dst AS other FROM e UNION ALL SELECT dst, 'called by', src FROM e")
def entity_references(spark, sf_dir):
    calls, functions, classes, imports, _ = _parts(spark, sf_dir)
    return C.neighbours(C.call_edges(C.resolve_calls(calls, functions, classes, imports)))


@query("""WITH d AS (SELECT doc_id AS i, doc_id // 2 AS h, 'corp.m' || doc_id AS m FROM documents), r AS (
SELECT 'module' AS record, m, m AS id, NULL AS name, NULL AS class_id, NULL AS kind, '' AS docstring, NULL AS bases, NULL AS parameters, 1 AS first_line, 16 AS last_line FROM d
UNION ALL SELECT 'import', m, m, 'corp.m' || (i + 1), NULL, 'import', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'import', m, m, 'g' || h, NULL, 'importfrom', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'function', m, m || '.f', 'f', NULL, NULL, '', NULL, '', 4, 5 FROM d
UNION ALL SELECT 'function', m, m || '.g' || i, 'g' || i, NULL, NULL, 'Doc ' || i || '.', NULL, 'x', 6, 9 FROM d
UNION ALL SELECT 'class', m, m || '.C' || i, 'C' || i, NULL, NULL, '', 'B' || h, NULL, 10, 15 FROM d
UNION ALL SELECT 'function', m, m || '.C' || i || '.k', 'k', m || '.C' || i, NULL, '', NULL, 'self,a', 11, 13 FROM d
UNION ALL SELECT 'function', m, m || '.C' || i || '.j', 'j', m || '.C' || i, NULL, '', NULL, 'self', 14, 15 FROM d
UNION ALL SELECT 'call', m, m || '.f', 'g' || i, NULL, 'simple', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'call', m, m || '.g' || i, NULL, NULL, 'attribute', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'call', m, m || '.g' || i, 'g' || h, NULL, 'simple', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'call', m, m || '.C' || i || '.k', 'f', m || '.C' || i, 'simple', NULL, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT 'call', m, m || '.C' || i || '.k', NULL, m || '.C' || i, 'attribute', NULL, NULL, NULL, NULL, NULL FROM d)
SELECT record, m AS module_id, id, name, class_id, kind, docstring, bases, parameters, first_line, last_line FROM r""")
def code_records(spark, sf_dir):
    return _corpus(spark, sf_dir).select("record", "module_id", "id", "name", "class_id", "kind", "docstring", F.array_join("bases", ",").alias("bases"), F.array_join("parameters", ",").alias("parameters"), "first_line", "last_line")


_IDS = "source || '.' || lang || CASE WHEN doc_id % 3 = 0 THEN '.m' || (doc_id % 5) ELSE '' END"


@query(f"""WITH p AS (SELECT string_split({_IDS}, '.') AS p FROM documents), k AS (SELECT p, unnest(generate_series(1, len(p))) AS k FROM p)
SELECT array_to_string(p[1:k], '.') AS id, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '.') END AS parent, k AS depth, bool_or(k = len(p)) AS is_module FROM k GROUP BY ALL""")
def hierarchy(spark, sf_dir):
    return C.hierarchy(table(spark, sf_dir, "documents").select(F.expr(_IDS).alias("id")))


_KEY = "[" + ", ".join(f"'{k}'" for k in C.KEYWORDS) + "]"


def _name_score(n: str) -> str:
    return f"least(CASE WHEN len([k for k in {_KEY} if contains(lower({n}), k)]) > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN {n} IN ('__main__', 'main') THEN 0.7 ELSE 0.0 END + CASE WHEN {n} IN ('__init__', 'app', 'settings', 'config', 'utils', 'constants') THEN 0.5 ELSE 0.0 END, 1.0)"


_NAME = "['main', 'ApiThing', 'utils', 'config', 'plain'][1 + doc_id % 5]"


@query(rf"""SELECT doc_id, round(least({_name_score('n')} + 0.5 * {_name_score("split_part(i, '.', 1)")} + 0.5 * {_name_score("split_part(i, '.', 2)")}, 1.0), 6) AS semantic,
 round(least((len([x for x in ls if regexp_matches(x, '\bif\b')]) + len([x for x in ls if regexp_matches(x, '\bfor\b')]) + len([x for x in ls if regexp_matches(x, '\bwhile\b')]) + len([x for x in ls if regexp_matches(x, '\bexcept\b')])) / 50.0, 1.0) + least((doc_id % 9) / 4.0 / 5.0, 1.0) * 0.3, 6) AS complexity,
 round(least(least(length(text) / 200.0, 1.0) * 0.7 + CASE WHEN contains(text, 'Args:') THEN 0.15 ELSE 0 END, 1.0), 6) AS documentation, round(least(len(ls) / 500.0, 1.0), 6) AS size
FROM (SELECT doc_id, text, {_NAME} AS n, lang || '.' || {_NAME} AS i, string_split(text || chr(10) || repeat(' ', doc_id % 9) || 'def x', chr(10)) AS ls FROM documents)""")
def module_features(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ["main", "ApiThing", "utils", "config", "plain"])), (F.col("doc_id") % 5).cast("int"))
    # A def after one line feed: its indent is the blanks alone.
    text = F.concat("text", F.lit("\n"), F.repeat(F.lit(" "), (F.col("doc_id") % 9).cast("int")), F.lit("def x"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(C.semantic_score(name, F.concat("lang", F.lit("."), name)), 6).alias("semantic"), F.round(C.complexity_score(text), 6).alias("complexity"), F.round(C.documentation_score(F.col("text")), 6).alias("documentation"), F.round(C.size_score(F.size(F.split(text, "\n"))), 6).alias("size"))


@query("""SELECT l_partkey AS part, round(least(2.0 * least(count(*) / 5.0, 1.0) + 3.0 * 0.1 + 0.2 + 0.5 * 0.3 + 4.0 * (least(count(*) / 20.0, 1.0) * 0.7 + greatest(0.0, 1.0 - (epoch(TIMESTAMP '2000-01-01') - epoch(max(l_shipdate))) / 86400.0 / 365) * 0.3), 10.0), 6) AS score FROM lineitem GROUP BY 1""")
def module_scores(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("timestamp").cast("double").alias("last"))
    history = C.history_score(F.col("n"), F.col("last"), F.lit(946684800.0))
    return per.select("part", F.round(C.module_score(C.usage_score(F.col("n")), F.lit(0.1), F.lit(0.2), F.lit(0.3), history), 6).alias("score"))


_SCORES = f"m AS (SELECT DISTINCT {_IDS} AS id FROM documents), s AS (SELECT id, (length(id) % 7) * 1.0 AS score FROM m)"


@query(f"""WITH {_SCORES}, n AS (SELECT array_to_string(p[1:k], '.') AS id, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '.') END AS parent, k AS depth, bool_or(k = len(p)) AS leaf FROM (SELECT p, unnest(generate_series(1, len(p))) AS k FROM (SELECT string_split(id, '.') AS p FROM m)) GROUP BY ALL),
l AS (SELECT n.id, parent, depth, coalesce(score, 0) AS score FROM n LEFT JOIN s USING (id) WHERE leaf),
p2 AS (SELECT n.id, n.parent, least((max(l.score) * 0.7 + avg(l.score) * 0.3) * 1.5, 10.0) AS score FROM n JOIN l ON l.parent = n.id WHERE n.depth = 2 AND NOT n.leaf GROUP BY ALL),
k1 AS (SELECT parent, score FROM l WHERE depth = 2 UNION ALL SELECT parent, score FROM p2), p1 AS (SELECT n.id, least((max(k1.score) * 0.7 + avg(k1.score) * 0.3) * 1.5, 10.0) AS score FROM n JOIN k1 ON k1.parent = n.id WHERE n.depth = 1 AND NOT n.leaf GROUP BY ALL)
SELECT id, round(score, 6) AS score FROM p2 UNION ALL SELECT id, round(score, 6) FROM p1""")
def package_rollup(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.expr(_IDS).alias("id")).distinct()
    return C.package_scores(C.hierarchy(ids), ids.select("id", (F.length("id") % 7).cast("double").alias("score"))).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- graphs
#: Parts and suppliers of all line items; and the same folded to a graph of the size of a repository's modules.
_GRAPH = "SELECT DISTINCT 'p' || l_partkey AS src, CASE WHEN l_suppkey % 3 = 0 THEN 's' || l_suppkey ELSE 'p' || l_suppkey END AS dst FROM lineitem WHERE l_suppkey % 3 = 0 OR l_partkey <> l_suppkey"
_MODULES = "SELECT DISTINCT 'm' || (l_partkey % 60) AS src, CASE WHEN l_suppkey % 5 = 0 THEN 's' || (l_partkey % 12) ELSE 'm' || ((l_partkey * 7 + l_suppkey % 5) % 60) END AS dst FROM lineitem"


def _graph(spark, sf_dir, graph_sql=_GRAPH):
    return spark.sql(graph_sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


@query(f"WITH g AS ({_GRAPH}) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM g UNION ALL SELECT dst, 1, 0 FROM g) GROUP BY node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir))


def _pagerank_ctes(rounds: int, graph_sql: str) -> str:
    out = f"g AS MATERIALIZED ({graph_sql}), v AS MATERIALIZED (SELECT src AS node FROM g UNION SELECT dst FROM g), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), d AS MATERIALIZED (SELECT src, count(*) AS n FROM g GROUP BY src), r0 AS MATERIALIZED (SELECT node, 1.0 / c.n AS rank FROM v, c)"
    for k in range(rounds):
        out += f""", r{k + 1} AS MATERIALIZED (SELECT v.node, 0.15 / c.n + 0.85 * (coalesce(m.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM d)) / c.n) AS rank FROM v CROSS JOIN c LEFT JOIN (SELECT g.dst, sum(r.rank / d.n) AS got FROM g JOIN d USING (src) JOIN r{k} r ON r.node = g.src GROUP BY g.dst) m ON m.dst = v.node)"""
    return out


@query("WITH " + _pagerank_ctes(8, _GRAPH) + " SELECT node, round(rank, 6) AS rank FROM r8")
def module_rank(spark, sf_dir):
    # The graph has two levels, so ranks stand still after a few rounds: eight in the SQL, as many here.
    return graph.pagerank(_graph(spark, sf_dir), 8, tolerance=None).select("node", F.round("rank", 6).alias("rank"))


@query("SELECT node, round(b, 6) AS betweenness FROM (VALUES ('a', 0.0), ('b', 0.25), ('c', 0.25), ('d', 0.75), ('e', 0.5), ('f', 0.0)) AS t(node, x), (SELECT 0) AS z(o), LATERAL (SELECT CASE node WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.5 / 20 WHEN 'c' THEN 1.5 / 20 WHEN 'd' THEN 6.0 / 20 WHEN 'e' THEN 4.0 / 20 ELSE 0.0 END AS b)")
def module_betweenness(spark, sf_dir):
    # a goes to d by b or c; d, e, f follow in a chain.
    return graph.betweenness(spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")).select("node", F.round("betweenness", 6).alias("betweenness"))


def _betweenness_ctes(depth: int) -> str:
    """Shortest paths level by level, and the dependencies back; right while no shortest path is longer than depth."""
    out = "l0 AS MATERIALIZED (SELECT node AS s, node, 0 AS d, 1.0::DOUBLE AS paths FROM v)"
    seen = "SELECT s, node FROM l0"
    for k in range(1, depth + 1):
        out += f", l{k} AS MATERIALIZED (SELECT l.s, g.dst AS node, {k} AS d, sum(l.paths) AS paths FROM l{k - 1} l JOIN g ON g.src = l.node WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.s = l.s AND z.node = g.dst) GROUP BY l.s, g.dst)"
        seen += f" UNION ALL SELECT s, node FROM l{k}"
    out += f", b{depth} AS MATERIALIZED (SELECT s, node, paths, 0.0::DOUBLE AS dep FROM l{depth})"
    for k in range(depth - 1, -1, -1):
        out += f", b{k} AS MATERIALIZED (SELECT l.s, l.node, l.paths, coalesce(sum(l.paths / w.paths * (1 + w.dep)), 0.0) AS dep FROM l{k} l LEFT JOIN (SELECT w.*, g.src FROM b{k + 1} w JOIN g ON g.dst = w.node) w ON w.s = l.s AND w.src = l.node GROUP BY l.s, l.node, l.paths)"
    every = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, depth + 1))
    return out + f", bc AS MATERIALIZED (SELECT v.node, coalesce(sum(e.dep), 0) / ((c.n - 1) * (c.n - 2)) AS b FROM v CROSS JOIN c LEFT JOIN ({every}) e ON e.node = v.node GROUP BY v.node, c.n)"


@query("WITH " + _pagerank_ctes(40, _MODULES) + ", " + _betweenness_ctes(8) + """, dg AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM g UNION ALL SELECT dst, 1, 0 FROM g) GROUP BY node)
SELECT node, round(least((least(i / 5.0, 1.0) * 0.5 + least(o / 10.0, 1.0) * 0.2 + least(rank * 10, 1.0) * 0.6 + least(b * 10, 1.0) * 0.4) / 1.7 + CASE WHEN i > 2 AND o <= 1 THEN 0.3 ELSE 0 END + CASE WHEN i > 2 AND o > 2 THEN 0.2 ELSE 0 END, 1.0), 4) AS score FROM dg JOIN r40 USING (node) JOIN bc USING (node)""")
def relation_scores(spark, sf_dir):
    # Degrees, ranks and betweenness of one graph of modules.
    g = materialise(_graph(spark, sf_dir, _MODULES), "modules")
    d = graph.degrees(g).join(graph.pagerank(g), "node").join(graph.betweenness(g), "node")
    return d.select("node", F.round(C.relation_score(F.col("n_in"), F.col("n_out"), F.col("rank"), F.col("betweenness")), 4).alias("score"))


# ---------------------------------------------------------------- commands, boosts, patterns
@query("SELECT doc_id % 10 AS task, doc_id AS pos, 'sh' AS language, c AS command FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# filename: ' || lang || '.sh' || chr(10) || 'ls ' || doc_id WHEN 1 THEN 'sh   ' || lang || '.sh' ELSE 'echo  ' || source END AS c, CASE doc_id % 3 WHEN 0 THEN lang || '.sh' END AS f FROM documents) x WHERE CASE WHEN f IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id < x.doc_id AND d.doc_id % 10 = x.doc_id % 10 AND d.doc_id % 3 = 0 AND d.lang || '.sh' = x.f) WHEN x.doc_id % 3 = 1 THEN NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id < x.doc_id AND d.doc_id % 10 = x.doc_id % 10 AND d.doc_id % 3 IN (0, 1) AND 'sh   ' || d.lang || '.sh' = x.c) ELSE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id < x.doc_id AND d.doc_id % 10 = x.doc_id % 10 AND d.doc_id % 3 = 2 AND 'echo  ' || d.source = x.c) END")
def command_dedupe(spark, sf_dir):
    i = F.col("doc_id")
    c = F.when(i % 3 == 0, F.concat(F.lit("# filename: "), "lang", F.lit(".sh\nls "), i)).when(i % 3 == 1, F.concat(F.lit("sh   "), "lang", F.lit(".sh"))).otherwise(F.concat(F.lit("echo  "), "source"))
    return ranking.dedupe_commands(table(spark, sf_dir, "documents").select((i % 10).alias("task"), i.alias("pos"), F.lit("sh").alias("language"), c.alias("command")))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND contains(url, '/') THEN 1.5 ELSE 7.5 END AS score, CASE WHEN 3 * (page_id % 3) * 0.5 + page_id % 4 >= 4.4 THEN 'high' WHEN 3 * (page_id % 3) * 0.5 + page_id % 4 >= 3.2 THEN 'medium' ELSE 'low' END AS level FROM pages")
def boosts_and_patterns(spark, sf_dir):
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", ranking.root_boost(F.lit(1.5), F.when(i % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit("/"), F.lit("")))).alias("score"), ranking.pattern_level((i % 3) * 0.5, i % 4).alias("level"))


# ---------------------------------------------------------------- windows of event streams, on the stored table
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return traces.windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, no")
def event_sessions(spark, sf_dir):
    return traces.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "errors")
