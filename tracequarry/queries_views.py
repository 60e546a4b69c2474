"""Queries of look-ups, views, trees, verdict joins and tolerant parsing."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.operators import codegraph as C, corpus, messages as M, retrieval, views as V
from tracequarry.queries import _BEFORE, FLAT, LOG, flat, log, query, table
from tracequarry.queries_code import _EDGES_SQL, _parts
from tracequarry.sources import files


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT 'src1' AS id, 'hit' AS kind")
def entity_lookup(spark, sf_dir):
    return V.find_entity(_docs(spark, sf_dir).select(F.col("source").alias("id")).distinct(), "src1")


@query("WITH s AS (SELECT DISTINCT source || '.' || lang AS id FROM documents), m AS (SELECT id FROM s WHERE contains(id, '5.')) SELECT id, CASE WHEN (SELECT count(*) FROM m) = 1 THEN 'hit' WHEN (SELECT count(*) FROM m) <= 5 THEN 'choice' ELSE 'many' END AS kind FROM m ORDER BY id LIMIT 5")
def entity_choice(spark, sf_dir):
    return V.find_entity(_docs(spark, sf_dir).select(F.concat_ws(".", "source", "lang").alias("id")).distinct(), "5.")


@query(f"""WITH {_EDGES_SQL}, f AS (SELECT 'corp.m' || i || '.f' AS id, '' AS parameters FROM d UNION ALL SELECT 'corp.m' || i || '.g' || i, 'x' FROM d UNION ALL SELECT 'corp.m' || i || '.C' || i || '.k', 'self, a' FROM d UNION ALL SELECT 'corp.m' || i || '.C' || i || '.j', 'self' FROM d),
o AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS calls FROM e GROUP BY src), b AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS called_by FROM e GROUP BY dst)
SELECT id, parameters, coalesce(calls, '') AS calls, coalesce(called_by, '') AS called_by FROM f LEFT JOIN o USING (id) LEFT JOIN b USING (id)""")
def function_views(spark, sf_dir):
    calls, functions, classes, imports, _ = _parts(spark, sf_dir)
    seen = V.entity_view(functions, C.call_edges(C.resolve_calls(calls, functions, classes, imports)))
    return seen.select("id", "parameters", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query("SELECT 'corp.m' || doc_id || '.C' || doc_id AS id, 'B' || (doc_id // 2) AS bases, 'k(self, a); j(self)' AS methods FROM documents")
def class_views(spark, sf_dir):
    _, functions, classes, *_ = _parts(spark, sf_dir)
    return V.class_view(classes, functions)


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def verdict_join(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return V.verdict_join(docs, docs.select("source", F.when(F.col("doc_id") % 97 == 0, "Yes").otherwise("no").alias("verdict")), "source")


@query("""WITH b AS (SELECT conv_id, turn AS idx, text AS code FROM conversations), w AS (SELECT DISTINCT conv_id, unnest([2, 0, 9, 2, 1]) AS idx, unnest([0, 1, 2, 3, 4]) AS pos FROM conversations)
SELECT conv_id, min(pos) AS pos, idx, code FROM b JOIN w USING (conv_id, idx) WHERE idx <> 1 GROUP BY conv_id, idx, code""")
def block_reorder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ints = lambda *x: F.array(*map(F.lit, x))
    return V.reorder_blocks(c.select("conv_id", F.col("turn").alias("idx"), F.col("text").alias("code")), c.select("conv_id").distinct().select("conv_id", ints(2, 0, 9, 2, 1).alias("wanted"), ints(0, 2, 9).alias("keep")), "conv_id")


@query("SELECT conv_id AS task, role || turn AS repo, CASE WHEN turn < 2 THEN 0.5 ELSE 0.0 END AS score FROM conversations")
def score_write_back(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    groups = c.groupBy(F.col("conv_id").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"])).alias("repos"))
    said = c.select(F.col("conv_id").alias("task")).distinct().select("task", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(99))).alias("repo_index")).withColumn("score", F.lit(0.5))
    return V.score_write_back(groups, said)


@query(f"SELECT source || '/' || doc_id AS path, n_chars AS size, 'other' AS origin FROM documents WHERE NOT ({_BEFORE}) UNION ALL SELECT source || '/' || doc_id, 1, 'module' FROM documents WHERE {_BEFORE} OR doc_id % 6 = 0 AND ({_BEFORE})")
def merge_right_wins(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("n_chars").alias("size"))
    return V.merge_first(docs.select("path", "size", F.lit("other").alias("origin")), docs.where(_BEFORE).select("path", F.lit(1).cast("long").alias("size"), F.lit("module").alias("origin")), "path")


@query("SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def result_accumulation(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return V.accumulate(p.where("page_id % 2 = 0").select("url"), p.where("page_id % 3 = 0").select("url"), "url")


@query("""WITH n AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS node, array_to_string(p[1:k - 1], '/') AS parent, k AS depth, p[k] AS name FROM (SELECT p, unnest(generate_series(1, len(p))) AS k FROM (SELECT string_split(source || '/' || lang || '/' || doc_id, '/') AS p FROM documents))),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name) AS r FROM n QUALIFY r <= [15, 10, 8, 6][least(depth, 4)])
SELECT a.node AS sort_path, a.depth, repeat('  ', a.depth - 1) || a.name AS shown FROM r a WHERE (a.depth = 1 OR a.parent IN (SELECT node FROM r)) AND (a.depth < 3 OR string_split(a.node, '/')[1] IN (SELECT node FROM r))""")
def path_tree(spark, sf_dir):
    return V.tree(_docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang", "doc_id").alias("path")))


@query("SELECT doc_id, 'lang=' || lang || ', ' || source || '; n=' || n_chars AS metadata, 'do ' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE '- ' || source || chr(10) || '- ' || lang END || ' in ' || lang AS filled, CASE doc_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'archive' ELSE 'path' END AS kind FROM documents")
def render_text(spark, sf_dir):
    meta = F.create_map(F.lit("n"), F.array(F.col("n_chars").cast("string")), F.lit("lang"), F.array("lang", "source"))
    i = F.col("doc_id") % 3
    items = F.when(i == 0, F.expr("cast(array() AS array<string>)")).when(i == 1, F.array("source")).otherwise(F.array("source", "lang"))
    address = F.when(i == 0, F.concat(F.lit("https://x/"), "source")).when(i == 1, F.concat("source", F.lit(".tar.gz"))).otherwise(F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", V.metadata_text(meta).alias("metadata"), V.fill_placeholders("do {items} in {lang}", {"items": V.list_text(items), "lang": F.col("lang")}).alias("filled"), V.repo_kind(address).alias("kind"))


@query("SELECT conv_id, string_agg(role || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || text END, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def search_context(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("title"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("snippet"), F.lit("").alias("content"))
    return V.hit_context(hits, "conv_id")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"a\": [\"' || lang || '\"], \"b\": 1}' WHEN 1 THEN '{\"k\": \"' || source || '\"}' WHEN 2 THEN '{\"key\": \"' || source || '\"}' END AS projected FROM documents")
def bounded_projection(spark, sf_dir):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, F.concat(F.lit('```json\n{"b": 1, "a": ["'), "lang", F.lit('"]}\n```'))).when(i == 1, F.concat(F.lit("{'k': ' "), "source", F.lit("  '}"))).when(i == 2, F.concat(F.lit("key: "), "source")).otherwise("nothing")
    return V.project(_docs(spark, sf_dir).select("doc_id", raw.alias("raw")), "doc_id", "raw").withColumnRenamed("id", "doc_id")


_OUT = "import os\nclass A(B):\n    \"\"\"first\"\"\"\n    def f(self, x=1):\n# 1 classes, 1 functions, 8 lines"


@query("SELECT source || doc_id || '.py' AS path, '" + _OUT.replace("'", "''") + "' AS outline, false AS over FROM documents")
def code_outlines(spark, sf_dir):
    text = "import os\nclass A(B):\n    '''first\n    second'''\n    def f(self, x=1):\n        pass\nx = 2\n"
    return V.outlines(_docs(spark, sf_dir).select(F.concat("source", "doc_id", F.lit(".py")).alias("path"), F.lit(text).alias("content")))


@query("SELECT conv_id, coalesce(nullif(trim(CASE WHEN conv_id % 3 = 0 THEN ' done ' ELSE ' ' END), ''), arg_max(text, turn)) AS answer FROM conversations GROUP BY conv_id")
def final_answer(spark, sf_dir):
    last = M.last_message(log(spark, sf_dir))
    said = F.trim(F.when(F.col("conv_id") % 3 == 0, " done ").otherwise(" "))
    return last.select("conv_id", F.coalesce(F.when(said != "", said), "content").alias("answer"))


@query("SELECT conv_id, turn, role, text AS content FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE turn < l")
def history_preload(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    newest = M.last_message(c).select("conv_id", F.col("turn").alias("newest"))
    return c.join(newest, "conv_id").where("turn < newest").select("conv_id", "turn", "role", "content")


@query(LOG + """, f AS (SELECT conv_id, turn AS t, function_call.name AS fn, 'call_' || substr(md5(conv_id || '/' || turn), 1, 8) AS id FROM m WHERE turn = 1 AND function_call IS NOT NULL),
k AS (SELECT m.* REPLACE (CASE WHEN turn = t THEN NULL ELSE function_call END AS function_call, CASE WHEN turn = t THEN list_concat(coalesce(tool_calls, []), [{'id': id, 'name': fn, 'arguments': function_call.arguments}]) ELSE tool_calls END AS tool_calls,
  CASE WHEN role = 'function' AND name = fn THEN 'tool' ELSE role END AS role, CASE WHEN role = 'function' AND name = fn THEN NULL ELSE name END AS name, CASE WHEN role = 'function' AND name = fn THEN id ELSE tool_call_id END AS tool_call_id,
  CASE WHEN turn = t AND (SELECT count(*) FROM m x WHERE x.conv_id = m.conv_id AND x.role = 'function' AND x.name = fn) > 0 THEN list_concat(coalesce(tool_responses, []), (SELECT list({'tool_call_id': f.id, 'role': 'tool', 'content': x.content} ORDER BY x.turn) FROM m x WHERE x.conv_id = m.conv_id AND x.role = 'function' AND x.name = fn)) ELSE tool_responses END AS tool_responses)
  FROM m LEFT JOIN f USING (conv_id)) SELECT """ + FLAT + " FROM k")
def function_call_convert(spark, sf_dir):
    return flat(M.convert_function_call(log(spark, sf_dir), 1))


@query("SELECT source, doc_id, n_chars, md5(text) AS content FROM documents WHERE n_chars >= 5 AND CAST(ceil(length(text) / 4.0) AS BIGINT) <= 500")
def retrieval_post_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where((F.length("text") >= 5) & (T.token_estimate("text") <= 500)).select("source", "doc_id", "n_chars", F.md5("text").alias("content"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id AS doc_id, html FROM pages)")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), files.html_text(F.col("html")).alias("text"))


@query("SELECT query, vec_id, score, rank FROM (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)), 6) DESC, v.vec_id) AS rank FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) q WHERE v.vec_id <> q.vec_id) WHERE rank <= 3")
def vector_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_of(v, v.where("vec_id % 100 = 0"), 3)


@query("SELECT source, sum(n_chars)::BIGINT AS bytes, count(*) AS files, bool_or(lang = 'fr') AS has_fr, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source")
def corpus_statistics(spark, sf_dir):
    return corpus.statistics(_docs(spark, sf_dir), "source", F.col("lang") == "fr").withColumnRenamed("has", "has_fr")
