"""Queries of outlines by lines, key classes, package trees, listings, displays and tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.operators import codegraph as C, corpus, explore as X
from tracequarry.operators.tools import Tools
from tracequarry.queries import query, table
from tracequarry.queries_code import _MODULES_SQL, _corpus, _parts, _sources

# ---------------------------------------------------------------- outlines
_LINED = r"text || '\n' || 'def f' || doc_id || '(x):\n    y = 1\n' || repeat('    z = 2\n    w(z)\n', CAST(doc_id % 3 * 20 AS INT)) || '    Z = X\n    return y\nimport os\n' || repeat('  def g():\n', CAST(doc_id % 2 * 4 AS INT)) || 'class C' || doc_id"


def _kept(name: str, flag: str) -> str:
    return f"""{name} AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS o FROM (SELECT doc_id, i, CASE WHEN k THEN x WHEN lag(k) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM false THEN '⋮' END AS s FROM (SELECT *, {flag} AS k FROM l)) GROUP BY doc_id)"""


_HEAD = r"regexp_matches(x, '^\s*(def|class)\s+')"
_WIDE = _HEAD + r" OR (regexp_matches(x, '^\s*(import|from)\s+') AND i <= 50) OR regexp_matches(x, '^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[A-Z]|__init__')"
_CLOSE = r"regexp_matches(x, '^\s*(def|class|import|from|async def)') OR regexp_matches(x, '^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=')"


@query(f"""WITH s AS (SELECT doc_id, string_split({_LINED.replace(chr(92) + 'n', chr(10))}, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS i FROM s),
{_kept('c', _CLOSE)}, {_kept('w', _WIDE)}, {_kept('h', _HEAD)}
SELECT doc_id, CASE WHEN ceil(length(c.o) / 4.0) <= 100 THEN c.o WHEN ceil(length(w.o) / 4.0) <= 100 THEN w.o ELSE h.o END AS outline, w.o AS wide FROM c JOIN w USING (doc_id) JOIN h USING (doc_id)""")
def escalated_outlines(spark, sf_dir):
    text = F.expr(_LINED)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.escalated_outline(text, 100).alias("outline"), X.wide_outline(text).alias("wide"))


@query("""SELECT 'corp/m' || doc_id || '.py' AS id, concat_ws(chr(10), 'import corp.m' || (doc_id + 1) || ' as nxt', 'from corp.m' || h || ' import g' || h, '⋮', 'def f():', '⋮', 'def g' || doc_id || '(x: Dict[str, int]):', '    \"\"\"Doc ' || doc_id || '.\"\"\"', '⋮', 'class C' || doc_id || '(B' || h || '):', '    def k(self, a):', '⋮', '    def j(self):', '⋮') AS interest,
'# Import dependencies' || chr(10) || 'import corp.m' || (doc_id + 1) || ' as nxt' || chr(10) || 'from corp.m' || h || ' import g' || h || chr(10) || chr(10) AS imports FROM (SELECT doc_id, doc_id // 2 AS h FROM documents)""".replace('\\"', '"'))
def interest_and_imports(spark, sf_dir):
    return X.by_lines(_sources(spark, sf_dir))


# ---------------------------------------------------------------- key classes, trees
@query(f"WITH {_MODULES_SQL}, c AS (SELECT h AS i, count(*) AS callers FROM m WHERE h IS NOT NULL GROUP BY h) SELECT 'corp.m' || i || '.C' || i AS id, 'C' || i AS name, 'corp.m' || i AS module_id, 0.0::DOUBLE AS importance_score, 2 AS methods_count, coalesce(callers, 0) AS called_by_count, 6 AS lines, '' AS docstring FROM m LEFT JOIN c USING (i)")
def key_classes(spark, sf_dir):
    calls, functions, classes, imports, _ = _parts(spark, sf_dir)
    return X.key_classes(classes, functions, C.call_edges(C.resolve_calls(calls, functions, classes, imports)), None).drop("pos")


@query("""WITH d AS (SELECT coalesce(source, 'none') AS source, 'f' || (doc_id % 7) || '.py' AS path, doc_id AS pos, text, coalesce(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE text IS NOT NULL)
SELECT source, path, min(pos) AS pos, '```python' || chr(10) || '## ' || path || chr(10) || chr(10) || 'import x' || min(pos) || chr(10) || string_agg(text, chr(10) ORDER BY pos) || chr(10) || '```' || chr(10) AS block FROM d WHERE b <= 3000 GROUP BY source, path""")
def class_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    i = F.col("doc_id")
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("source"), F.concat(F.lit("f"), i % 7, F.lit(".py")).alias("path"), i.alias("pos"), F.concat(F.lit("import x"), i, F.lit("\n")).alias("imports"), F.col("text").alias("outline"))
    return X.class_budget(rows, "source")


@query("""WITH d AS (SELECT DISTINCT source AS s, lang AS l, doc_id AS i FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), n AS (
SELECT DISTINCT s AS id, 0 AS depth, ascii(right(s, 1)) % 3 * 0.6 AS score, s || '/' AS t, NULL AS p, s AS top FROM d
UNION ALL SELECT DISTINCT s || '.' || l, 1, ascii(l) % 2 + 0.5, l || '/', s, s FROM d
UNION ALL SELECT s || '.' || l || '.m' || i, 2, i % 5 * 0.4, 'm' || i || '.py - Doc ' || i || '...', s || '.' || l, s FROM d)
SELECT n.id, depth, round(score, 6)::DOUBLE AS score, repeat('  ', depth) || '- ' || t AS shown FROM n WHERE score >= CASE depth WHEN 2 THEN 1.1 ELSE 1.0 END AND (depth = 0 OR top IN (SELECT id FROM n WHERE depth = 0 AND score >= 1.0)) AND (depth < 2 OR p IN (SELECT id FROM n WHERE depth = 1 AND score >= 1.0))""")
def package_tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("doc_id").alias("i"))
    none = F.lit(None).cast("string").alias("doc")
    score = lambda c: F.round(c, 6).alias("score")
    tops = d.select(F.col("s").alias("id"), F.lit("package").alias("kind"), score(F.ascii(F.right("s", F.lit(1))) % 3 * 0.6), none).distinct()
    mids = d.select(F.concat_ws(".", "s", "l").alias("id"), F.lit("package").alias("kind"), score(F.ascii("l") % 2 + 0.5), none).distinct()
    leaves = d.select(F.concat(F.concat_ws(".", "s", "l"), F.lit(".m"), "i").alias("id"), F.lit("module").alias("kind"), score(F.col("i") % 5 * 0.4), F.concat(F.lit("Doc "), "i", F.lit("\nmore")).alias("doc"))
    return X.package_tree(tops.unionByName(mids).unionByName(leaves))


@query("SELECT n AS n_modules, n AS n_classes, 4 * n AS n_functions, 16 * n AS n_lines, '# Code Repository Overview' || chr(10) || chr(10) || 'Total modules: ' || n || chr(10) || chr(10) || 'Total classes: ' || n || chr(10) || chr(10) || 'Total functions: ' || 4 * n || chr(10) || chr(10) || 'Total lines of code: ' || 16 * n || chr(10) AS header FROM (SELECT count(DISTINCT doc_id) AS n FROM documents)")
def code_overview(spark, sf_dir):
    _, functions, classes, _, modules = _parts(spark, sf_dir)
    return X.overview(modules, classes, functions)


_FILES = "coalesce(source, 'none') || '/' || CASE doc_id % 6 WHEN 0 THEN 'build/x/' WHEN 1 THEN 'a/b/c/d/' WHEN 2 THEN 'a/' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '__' ELSE '' END || doc_id || '.txt'"


@query(f"""WITH f AS (SELECT string_split({_FILES}, '/') AS p FROM documents), s AS (SELECT DISTINCT p[:-2] AS d, p[-1] AS name FROM f WHERE NOT list_contains(p, 'build')), u AS (SELECT DISTINCT d[1:k] AS d FROM (SELECT d, unnest(generate_series(1, len(d))) AS k FROM s)),
r AS (SELECT array_to_string(d, '/') AS dir, len(d) AS k, name, row_number() OVER (PARTITION BY d ORDER BY name) AS pos, count(*) OVER (PARTITION BY d) AS n FROM s WHERE len(d) < 4 AND NOT starts_with(name, '__'))
SELECT array_to_string(d, '/') AS dir, CASE WHEN len(d) < 4 THEN 'dir' ELSE 'cut' END AS kind, 0 AS pos, repeat('    ', len(d)) || CASE WHEN len(d) < 4 THEN d[-1] || '/' ELSE '... Maximum depth limit reached' END AS shown FROM u WHERE len(d) <= 4
UNION ALL SELECT dir, 'file', pos, repeat('    ', k + 1) || name FROM r WHERE pos <= 30 UNION ALL SELECT dir, 'more', 31, repeat('    ', k + 1) || '... ' || (n - 30) || ' more files not displayed' FROM r WHERE pos = 31""")
def file_listing(spark, sf_dir):
    return X.file_list(table(spark, sf_dir, "documents").select(F.expr(_FILES).alias("path")))


@query(f"""WITH f AS (SELECT DISTINCT string_split({_FILES}, '/') AS p FROM documents), n AS (SELECT p, unnest(generate_series(1, len(p))) AS k FROM f)
SELECT array_to_string(p[1:k], '/') AS node, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '/') END AS parent, p[k] AS name, CASE WHEN bool_or(k < len(p)) THEN 'directory' ELSE 'file' END AS kind, count(*) AS n_files FROM n GROUP BY 1, 2, 3""")
def path_nodes(spark, sf_dir):
    return X.path_nodes(table(spark, sf_dir, "documents").select(F.expr(_FILES).alias("path")))


# ---------------------------------------------------------------- displays, tools
@query("SELECT p_partkey, p_name, p_brand, p_type, '... and 2 more columns' AS note FROM part")
def column_preview(spark, sf_dir):
    shown, note = X.preview_columns(table(spark, sf_dir, "part"), 4)
    return shown.withColumn("note", F.lit(note))


@query("""SELECT conv_id, text AS content, role, CASE WHEN conv_id % 3 = 0 THEN '["a' || conv_id || '.png","b.csv"]' ELSE '[]' END AS new_files, '' AS system_message FROM conversations WHERE role IS NOT NULL""")
def display_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.col("text").alias("content"), "role", F.col("role").alias("sender"), F.lit("all").alias("receiver"), F.col("turn").cast("string").alias("stamp"))
    ids = c.where("conv_id % 3 = 0").select("conv_id").distinct()
    pending = ids.select("conv_id", F.explode(F.array(F.lit("b.csv"), F.concat(F.lit("a"), "conv_id", F.lit(".png")))).alias("file"))
    # The log so far is empty, so what is shown is what was added.
    so_far, none = X.display_log(rows.limit(0).select("conv_id", X.display_row(F.col("content"), F.col("role"), F.col("sender"), F.col("receiver"), F.col("stamp"), F.expr("cast(array() AS array<string>)")).alias("shown")), rows, pending, "conv_id")
    return so_far.unionByName(none.select("conv_id", F.lit(None).cast(so_far.schema["shown"].dataType).alias("shown"))).select("conv_id", "shown.message.content", "shown.message.role", "shown.new_files", "shown.sender_info.system_message")


@query("SELECT page_id, 'find ' || page_id AS asked, url, CASE WHEN page_id % 7 = 0 THEN 'Error browsing URL' ELSE substr(html, 1, 20000) END AS found FROM pages")
def browse_results(spark, sf_dir):
    asked = F.concat(F.lit("find "), "page_id")
    said = X.browse_result(asked, F.col("url"), F.when(F.col("page_id") % 7 != 0, F.col("html")))
    back = F.from_json("j", "`Input Query` string, `Search URL` string, `Search Result` string")
    return table(spark, sf_dir, "pages").select("page_id", said.alias("j")).select("page_id", back.alias("r")).select("page_id", F.col("r.Input Query").alias("asked"), F.col("r.Search URL").alias("url"), F.col("r.Search Result").alias("found"))


@query("SELECT * FROM (VALUES (0, 'grep', 'DataFrame', 'success'), (1, 'lines', 'DataFrame', 'success'), (2, 'missing', NULL, 'error')) AS t(call_no, tool, docs, status), (SELECT sum(len(string_split(text, chr(10)))) AS n_lines FROM documents)")
def tool_history(spark, sf_dir):
    def lines(docs: DataFrame) -> DataFrame:
        return corpus.lines(docs)

    def grep(docs: DataFrame, keyword: str) -> DataFrame:
        return corpus.grep(docs, keyword)

    tools = Tools(spark)
    tools.register(lines)
    tools.register(grep)
    docs = table(spark, sf_dir, "documents")
    tools.execute("grep", docs=docs, keyword="a")
    found = tools.execute("lines", docs=docs)
    try:
        tools.execute("missing")
    except KeyError:
        pass
    n = found.agg(F.count(F.lit(1)).alias("n_lines"))
    return tools.history().select("call_no", "tool", F.col("arguments")["docs"].alias("docs"), "status", F.lit(1).alias("k")).join(n.withColumn("k", F.lit(1)), "k").drop("k")
