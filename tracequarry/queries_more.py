"""Queries of further edits of logs, renderings, rankings, retrieval and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.operators import manifest, messages as M, ranking, retrieval, views as V
from tracequarry.queries import FLAT, LOG, flat, log, query, table
from tracequarry.sources import files


def _renumbered(rows: str) -> str:
    return f" SELECT {FLAT} FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn) FROM ({rows}))"


# ---------------------------------------------------------------- edits
@query(LOG + f" SELECT {FLAT} FROM (SELECT * REPLACE (CASE WHEN turn = 1 THEN 'assistant' ELSE role END AS role, CASE WHEN turn = 1 THEN {{'name': 'look', 'arguments': 'x'}} ELSE function_call END AS function_call) FROM m)")
def function_call_add(spark, sf_dir):
    return flat(M.add_function_call(log(spark, sf_dir), 1, "look", "x"))


@query(LOG + ", f AS (SELECT conv_id, min(turn) AS t FROM m WHERE function_call.name = 'fn1' GROUP BY conv_id)" + _renumbered("SELECT * REPLACE (CAST(turn AS DOUBLE) AS turn) FROM m UNION ALL SELECT conv_id, t + 0.5, 'function', 'fn1', 'done', NULL, NULL, NULL, NULL FROM f"))
def function_response_add(spark, sf_dir):
    return flat(M.add_function_response(log(spark, sf_dir), "fn1", "done"))


@query(LOG + f" SELECT {FLAT} FROM (SELECT * REPLACE (CASE WHEN tool_calls IS NOT NULL THEN [CASE WHEN c.id = 'c' || conv_id || '_1' THEN {{'id': c.id, 'name': 'renamed', 'arguments': 'new'}} ELSE c END for c in tool_calls] END AS tool_calls) FROM m)")
def tool_call_update(spark, sf_dir):
    m = log(spark, sf_dir)
    updates = m.select("conv_id").distinct().select("conv_id", F.concat(F.lit("c"), "conv_id", F.lit("_1")).alias("id"), F.lit("renamed").alias("name"), F.lit("new").alias("arguments"))
    return flat(M.update_tool_call(m, updates))


@query(LOG + f" SELECT {FLAT} FROM (SELECT * REPLACE (CASE WHEN role = 'function' AND name = 'fn1' THEN 'changed' ELSE content END AS content) FROM m)")
def function_response_update(spark, sf_dir):
    return flat(M.update_function_response(log(spark, sf_dir), "fn1", "changed"))


@query(LOG + _renumbered("SELECT * FROM m WHERE NOT coalesce(role = 'function' AND name = 'fn1', false)"))
def function_response_delete(spark, sf_dir):
    return flat(M.delete_function_response(log(spark, sf_dir), "fn1"))


_CODED = "CASE WHEN turn % 2 = 1 THEN content || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' ELSE content END"


@query(LOG + f" SELECT conv_id, turn, coalesce(len(CASE WHEN turn % 2 = 0 THEN tool_calls END), 0) AS n_calls FROM (SELECT * REPLACE ({_CODED} AS content) FROM m)")
def calls_beside_code(spark, sf_dir):
    m = log(spark, sf_dir).withColumn("content", F.expr(_CODED.replace("chr(10)", "'\\n'")))
    return M.without_calls_beside_code(m).select("conv_id", "turn", F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).cast("long").alias("n_calls"))


@query("""WITH b AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg((least(n, 6) - r + 1) || '. ' || upper(role[1]) || role[2:] || ': ' || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, chr(10) ORDER BY turn) AS page, greatest(max(n) - 6, 0) AS earlier FROM b WHERE r <= 6 GROUP BY conv_id""")
def history_page(spark, sf_dir):
    return M.history_page(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))


# ---------------------------------------------------------------- rendering and parsing
@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '()' WHEN 1 THEN source || '.' || lang || '()' WHEN 2 THEN source || '.a.' || lang || '()' ELSE 'Unknown call type: other' END AS call, CASE WHEN text = '' THEN '' WHEN len(string_split(text, chr(10))) > 3 THEN q || chr(10) || string_split(text, chr(10))[1] || chr(10) || '...' || chr(10) || q ELSE q || text || q END AS doc FROM documents, (SELECT repeat(chr(39), 3) AS q)")
def call_and_doc_text(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("simple", "attribute", "nested_attribute", "other"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.call_text(kind, "lang", "source", "lang", F.concat("source", F.lit(".a."), "lang")).alias("call"), T.doc_text("text").alias("doc"))


_SAID = "CASE doc_id % 4 WHEN 0 THEN 'Here: [{\"role\": \"user\", \"content\": ' || doc_id || '}, {\"role\": \"tool\", \"content\": \"' || lang || '\"}] ok' WHEN 1 THEN '[{\"role\": \"user\"}]' WHEN 2 THEN 'nothing' ELSE '[{\"role\": 1, \"content\": \"x\"}]' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'user=' || doc_id || ';tool=' || lang WHEN 3 THEN '1=x' END AS parts FROM documents")
def dialogue_parse(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SAID).alias("t"))
    return said.select("doc_id", F.array_join(F.transform(T.dialogue("t"), lambda r: F.concat(r["role"], F.lit("="), r["content"])), ";").alias("parts"))


_CODE = "'import ' || lang || '.x' || chr(10) || 'from ' || source || ' import y' || chr(10) || '  import os' || chr(10) || text"


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '(?m)^\s*import\s+([a-zA-Z0-9_\.]+)', 1), regexp_extract_all(t, '(?m)^\s*from\s+([a-zA-Z0-9_\.]+)\s+import\s+', 1)))), ',') AS modules FROM (SELECT doc_id, {_CODE} AS t FROM documents)")
def import_extraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.imports_of(F.expr(_CODE.replace("chr(10)", "'\\n'"))), ",").alias("modules"))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 3 = 2 AND trim(url) <> '' AS valid FROM pages")
def optional_queries(spark, sf_dir):
    i = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", T.optional_query(F.when(i == 1, " ").when(i == 2, F.col("url"))).alias("valid"))


@query(r"SELECT doc_id, array_to_string([x for x in string_split_regex(trim('fix ' || lang || ' ' || trim(text) || ' pat ' || CASE WHEN doc_id % 2 = 0 THEN source || ' ' ELSE '' END || 'runtime py libraries ' || CASE WHEN doc_id % 3 = 0 THEN 'a b c d' ELSE 'dep' END), '\s+') if x <> ''][1:48], ' ') AS query FROM documents")
def canonical_queries(spark, sf_dir):
    libs = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, ("a", " ", "b", "c", "d", "e")))).otherwise(F.array(F.lit(" ")))
    node = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", manifest.canonical_query(F.col("lang"), F.col("text"), F.lit("pat"), node, F.lit("py"), libs, F.array(F.lit("dep"))).alias("query"))


# ---------------------------------------------------------------- scores
@query("SELECT doc_id, round((doc_id % 3) * 1.0 + (doc_id % 5) * 0.3 + (doc_id % 7) * 0.2 + CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0 END + least(n_chars / 1000, 1.0) * 0.3, 6) AS score, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.0 END AS node, (doc_id % 100) / 100 BETWEEN 0.6 AND 0.75 AS wasteful FROM documents")
def fallback_scores(spark, sf_dir):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "module").when(i % 3 == 1, "package").otherwise("file")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ranking.fallback_score(i % 3, i % 5, i % 7, i % 2 == 0, F.col("n_chars")), 6).alias("score"), ranking.node_score(kind, F.lit(1.0), F.lit(2.0)).alias("node"), ranking.inefficient((i % 100) / 100).alias("wasteful"))


@query("""WITH l AS (SELECT source || '/' || lang || '/' || doc_id AS id, source || '/' || lang AS parent, source AS top, (doc_id % 5) * 0.3 AS s FROM documents), p AS (SELECT parent AS id, top, sum(s) * 0.5 AS s FROM l GROUP BY ALL)
SELECT id, round(s, 6) AS score FROM p UNION ALL SELECT top, round(sum(s) * 0.5, 6) FROM p GROUP BY top""")
def fallback_package_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    leaves = docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("parent"), F.lit(2).alias("depth"), ((F.col("doc_id") % 5) * 0.3).alias("score"))
    inner = docs.select(F.concat_ws("/", "source", "lang").alias("id"), F.col("source").alias("parent"), F.lit(1).alias("depth"), F.lit(None).cast("double").alias("score")).distinct()
    top = docs.select(F.col("source").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(None).cast("double").alias("score")).distinct()
    found = ranking.fallback_packages(leaves.unionByName(inner).unionByName(top))
    return found.where("depth < 2").select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.0 WHEN doc_id % 4 = 1 THEN 0.8 ELSE 0.0 END AS score FROM documents")
def key_component_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    components = docs.where(i % 4 < 2).select(i.alias("pos"), F.when(i % 4 == 0, i.cast("string")).otherwise("inner").alias("id"), F.when(i % 4 == 1, i.cast("string")).otherwise("m").alias("module"))
    return ranking.key_component_score(docs.select("doc_id", i.cast("string").alias("id")), components).select("doc_id", "score")


@query("SELECT doc_id, array_to_string([x for x in [CASE WHEN doc_id % 2 = 0 THEN 'nonGoals' END, CASE WHEN doc_id % 3 = 0 THEN 'mustHave' END, CASE WHEN doc_id % 5 = 0 THEN 'metrics' END] if x is not null], ',') AS violations FROM documents")
def spec_violations(spark, sf_dir):
    i = F.col("doc_id")
    goals = F.when(i % 2 == 0, F.expr("cast(array() AS array<string>)")).otherwise(F.array("source"))
    must = F.array(F.when(i % 3 == 0, "be better").otherwise("be better by 5 %"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ranking.spec_violations(goals, must, F.array(F.when(i % 5 == 0, "speed").otherwise("speed 5"))), ",").alias("violations"))


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END, page_id) AS pos FROM pages QUALIFY pos <= 50")
def listing_data_first(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".x"))
    first = table(spark, sf_dir, "pages").select("page_id", ranking.data_first(path).alias("late")).orderBy("late", "page_id").limit(50)
    return first.select("page_id", F.row_number().over(M.Window.orderBy("late", "page_id")).cast("long").alias("pos"))


# ---------------------------------------------------------------- retrieval
@query("SELECT doc_id, lang || ': ' || text AS content, 2 + CASE WHEN source IS NULL THEN 0 ELSE 1 END + 1 AS n_meta FROM documents")
def document_conversion(spark, sf_dir):
    docs = retrieval.as_documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    return docs.select("doc_id", "content", F.size("metadata").alias("n_meta"))


@query("SELECT vec_id, score FROM (SELECT vec_id, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)) ORDER BY score DESC, vec_id LIMIT 5")
def retrieval_dispatch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    first = v.where("vec_id = 0").first()
    return retrieval.retrieve(v, [], list(first["embedding"]), 5, 1.0, id_col="vec_id")


@query()
def recursive_text_chunks(spark, sf_dir):
    return retrieval.recursive_chunks(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- views
_PATHS = "CASE doc_id % 3 WHEN 0 THEN 'pkg/' || lang || doc_id || '.py' WHEN 1 THEN 'data/' || doc_id || '.txt' ELSE 'gone/' || doc_id END"


@query(f"SELECT {_PATHS} AS path, CASE doc_id % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'file' ELSE 'none' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'pkg.' || lang || doc_id WHEN 1 THEN 'data/' || doc_id || '.txt' END AS key FROM documents")
def path_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_PATHS).alias("path"))
    modules = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("pkg."), "lang", "doc_id").alias("id"))
    return V.resolved_paths(docs.select("path"), modules, docs.where("doc_id % 3 < 2").select("path"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'a' || doc_id || '.py' WHEN 1 THEN 'a' || doc_id || '.txt' ELSE '.git/' || doc_id END AS path, CASE WHEN doc_id % 3 = 2 THEN 'ignored' WHEN ceil(length(text) / 4.0) <= 4000 + CASE WHEN doc_id % 3 = 0 THEN 4000 ELSE 0 END THEN text ELSE substr(text, 1, 8000 + CASE WHEN doc_id % 3 = 0 THEN 8000 ELSE 0 END) || chr(10) || chr(10) || '>>> ...omitted content... <<<' || chr(10) || chr(10) || right(text, 8000 + CASE WHEN doc_id % 3 = 0 THEN 8000 ELSE 0 END) END AS shown FROM documents")
def file_contents(spark, sf_dir):
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a' || doc_id || '.py' WHEN 1 THEN 'a' || doc_id || '.txt' ELSE '.git/' || doc_id END")
    return V.file_contents(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")))


@query("""WITH t AS (SELECT source AS module, doc_id AS line, 'class C' || doc_id || chr(10) || '    def m' || doc_id AS t FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, doc_id, 'def f' || doc_id FROM documents WHERE doc_id % 2 = 1)
SELECT module, string_agg(t, chr(10) ORDER BY line) AS outline FROM t WHERE module IS NOT NULL GROUP BY module""")
def file_structure(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("module"), "doc_id")
    classes = docs.where("doc_id % 2 = 0").select("module", F.concat(F.lit("C"), "doc_id").alias("name"), F.col("doc_id").alias("line"))
    methods = docs.where("doc_id % 2 = 0").select("module", F.concat(F.lit("C"), "doc_id").alias("owner"), F.concat(F.lit("m"), "doc_id").alias("name"), (F.col("doc_id") + 1).alias("line"))
    free = docs.where("doc_id % 2 = 1").select("module", F.lit(None).cast("string").alias("owner"), F.concat(F.lit("f"), "doc_id").alias("name"), F.col("doc_id").alias("line"))
    return V.structure(classes, methods.unionByName(free))


@query("SELECT page_id, page_id % 5 <> 0 AS success, CASE WHEN page_id % 5 <> 0 THEN length(html) END AS html_chars, CASE WHEN page_id % 5 <> 0 THEN len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) END AS n_links FROM pages")
def crawl_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("error", F.when(F.col("page_id") % 5 == 0, "timeout"))
    return files.crawled(pages).select("page_id", "success", "html_chars", "n_links")
