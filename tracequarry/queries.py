"""Queries of the operators outside llm, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import paths, text as T
from tracequarry.operators import corpus, manifest, messages as M, ranking, retrieval
from tracequarry.plans.shared import attach
from tracequarry.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- messages
#: conversations as a message log: tool calls by assistants of even conversations, answered one and two turns later.
MESSAGES = """
SELECT conv_id, turn, r AS role, CASE WHEN r = 'function' THEN 'fn' || (conv_id % 3) END AS name, text AS content,
       CASE WHEN r = 'assistant' AND conv_id % 2 = 0 THEN TOOLCALLS END AS tool_calls,
       CASE WHEN r = 'assistant' AND conv_id % 5 = 1 THEN FUNCTION END AS function_call,
       CASE WHEN conv_id % 2 = 0 AND turn % 4 = 3 THEN RESPONSES END AS tool_responses,
       CASE WHEN r = 'tool' THEN 'c' || conv_id || '_' || (turn - 1) END AS tool_call_id
FROM (SELECT *, CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 2 = 0 THEN 'tool' WHEN role = 'user' AND conv_id % 5 = 1 AND turn = 2 THEN 'function' ELSE role END AS r FROM conversations)
"""
_SPARK = {
    "TOOLCALLS": "CASE WHEN turn % 4 = 1 THEN array(named_struct('id', 'c' || conv_id || '_' || turn, 'name', 'tool' || (turn % 3), 'arguments', text), named_struct('id', 'd' || conv_id || '_' || turn, 'name', 'tool0', 'arguments', 'x')) ELSE array(named_struct('id', 'c' || conv_id || '_' || turn, 'name', 'tool' || (turn % 3), 'arguments', text)) END",
    "FUNCTION": "named_struct('name', 'fn' || (conv_id % 3), 'arguments', text)",
    "RESPONSES": "array(named_struct('tool_call_id', 'c' || conv_id || '_' || (turn - 2), 'role', 'tool', 'content', text))",
}
_DUCK = {
    "TOOLCALLS": "CASE WHEN turn % 4 = 1 THEN [{'id': 'c' || conv_id || '_' || turn, 'name': 'tool' || (turn % 3), 'arguments': text}, {'id': 'd' || conv_id || '_' || turn, 'name': 'tool0', 'arguments': 'x'}] ELSE [{'id': 'c' || conv_id || '_' || turn, 'name': 'tool' || (turn % 3), 'arguments': text}] END",
    "FUNCTION": "{'name': 'fn' || (conv_id % 3), 'arguments': text}",
    "RESPONSES": "[{'tool_call_id': 'c' || conv_id || '_' || (turn - 2), 'role': 'tool', 'content': text}]",
}


def _filled(parts: dict[str, str]) -> str:
    out = MESSAGES
    for k, v in parts.items():
        out = out.replace(k, v)
    return out


LOG = f"WITH m AS ({_filled(_DUCK)})"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message log of MESSAGES."""
    return spark.sql(_filled(_SPARK).replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))


def flat(frame: DataFrame) -> DataFrame:
    """A message log with its nested parts as text."""
    return frame.select(
        "conv_id", "turn", "role", F.coalesce("name", F.lit("-")).alias("name"), F.md5("content").alias("content"), F.coalesce("tool_call_id", F.lit("-")).alias("tool_call_id"),
        F.coalesce(F.array_join(F.transform("tool_calls", lambda c: F.concat(c["id"], F.lit("="), c["name"])), ","), F.lit("-")).alias("calls"),
        F.coalesce(F.array_join(F.transform("tool_responses", lambda r: F.concat(r["tool_call_id"], F.lit("="), F.md5(r["content"]))), ","), F.lit("-")).alias("responses"),
        F.coalesce(F.col("function_call.name"), F.lit("-")).alias("function_name"),
    )


FLAT = """conv_id, turn, role, coalesce(name, '-') AS name, md5(content) AS content, coalesce(tool_call_id, '-') AS tool_call_id,
 coalesce(array_to_string([c.id || '=' || c.name for c in tool_calls], ','), '-') AS calls,
 coalesce(array_to_string([r.tool_call_id || '=' || md5(r.content) for r in tool_responses], ','), '-') AS responses, coalesce(function_call.name, '-') AS function_name"""
_EMPTY_IDS = "CAST([] AS VARCHAR[])"


def _prune(ids: str) -> str:
    left = f"[r for r in tool_responses if not list_contains({ids}, r.tool_call_id)]"
    return f"CASE WHEN len({left}) > 0 THEN {left} END"


@query(LOG + """ SELECT conv_id, count(*) AS total_messages, count(*) FILTER (role = 'system') AS n_system, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
 count(*) FILTER (role = 'tool') AS n_tool, count(*) FILTER (role = 'function') AS n_function, sum(coalesce(len(tool_calls), 0)) AS tool_calls, count(function_call) AS function_calls,
 count(*) FILTER (role = 'tool') + sum(coalesce(len(tool_responses), 0)) AS tool_responses FROM m GROUP BY conv_id""")
def conversation_summary(spark, sf_dir):
    return M.summary(log(spark, sf_dir))


@query(LOG + " SELECT conv_id, turn FROM m WHERE regexp_matches(content, '(?i)thing|élle')")
def message_search(spark, sf_dir):
    return M.search(log(spark, sf_dir), "thing|élle")


@query(LOG + " SELECT conv_id, turn, role FROM m WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'fn1' FROM m WHERE name = 'fn1'")
def messages_by_role_and_name(spark, sf_dir):
    m = log(spark, sf_dir)
    return M.with_role(m, "assistant").select("conv_id", "turn", "role").unionByName(M.with_name(m, "fn1").select("conv_id", "turn", F.col("name").alias("role")))


@query(LOG + " SELECT conv_id, turn, role, content FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_message(spark, sf_dir):
    return M.last_message(log(spark, sf_dir))


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(text || role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'a' ELSE 'b' END AS role FROM conversations)) WHERE b IS NULL OR b <> text || role")
def dedupe_consecutive(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("first"), F.when(F.col("turn") % 3 == 0, "a").otherwise("b").alias("role"))
    return M.drop_consecutive(m, "first", "role").select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, text AS c FROM conversations) WHERE trim(c) <> '' AND NOT starts_with(c, 'Th')) WHERE b IS NULL OR b <> c""")
def admissible_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return M.admissible(m, "Th").select("conv_id", "turn")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), t AS (SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || substr(text, 1, 200) AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, CASE WHEN n > 2 THEN string_agg(line, chr(10) ORDER BY turn) ELSE '' END AS history, greatest(n - 4, 0) AS earlier FROM n JOIN t USING (conv_id) GROUP BY conv_id, n""")
def last_n_history(spark, sf_dir):
    return M.history(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))


@query("""WITH l AS (SELECT conv_id, max(turn) AS newest, arg_max(text, turn) AS question FROM conversations GROUP BY 1),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM (SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || substr(text, 1, 200) AS line FROM conversations JOIN l USING (conv_id) WHERE turn < newest QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY 1)
SELECT conv_id, CASE WHEN history IS NULL THEN question ELSE 'History:' || chr(10) || history || chr(10) || chr(10) || 'Question: ' || question END AS prompt FROM l LEFT JOIN h USING (conv_id)""")
def prompt_with_history(spark, sf_dir):
    return M.prompt_with_history(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))


@query("SELECT conv_id, count(*) FILTER (o IS NULL OR turn > o) AS run FROM (SELECT *, max(CASE WHEN role <> 'user' THEN turn END) OVER (PARTITION BY conv_id) AS o FROM conversations) GROUP BY conv_id")
def trailing_user_run(spark, sf_dir):
    return M.trailing_run(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, min(turn) AS turn, min(s) AS tokens FROM (SELECT *, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s > 300 GROUP BY conv_id")
def token_limit_crossing(spark, sf_dir):
    return M.limit_crossing(table(spark, sf_dir, "conversations"), T.token_estimate("text"), 300)


@query(LOG + """, u AS (SELECT conv_id, turn, unnest(generate_series(1, len(p))) AS i, p FROM (SELECT conv_id, turn, list_concat(coalesce([{'role': r.role, 'content': r.content, 'tool_call_id': r.tool_call_id} for r in tool_responses], []), CASE WHEN role <> 'tool' THEN [{'role': role, 'content': content, 'tool_call_id': NULL}] ELSE [] END) AS p FROM m))
SELECT conv_id, turn, i - 1 AS part, p[i].role AS role, p[i].content AS content, p[i].tool_call_id AS tool_call_id FROM u""")
def unrolled_responses(spark, sf_dir):
    return M.unroll(log(spark, sf_dir))


@query("""WITH e AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations)
SELECT conv_id, turn, role, text AS content FROM e WHERE turn = 0 OR turn > l - 3 UNION ALL SELECT conv_id, min(turn), 'user', '[summary]' FROM e WHERE turn > 0 AND turn <= l - 3 GROUP BY conv_id""")
def folded_history(spark, sf_dir):
    return M.fold(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))


_CALLS = ", c AS (SELECT conv_id, turn, i, tool_calls[i].id AS id, tool_calls[i].name AS name, tool_calls[i].arguments AS arguments FROM (SELECT *, unnest(generate_series(1, len(tool_calls))) AS i FROM m WHERE tool_calls IS NOT NULL)), r AS (SELECT conv_id, turn, i, tool_responses[i].tool_call_id AS id, tool_responses[i].content AS content FROM (SELECT *, unnest(generate_series(1, len(tool_responses))) AS i FROM m WHERE tool_responses IS NOT NULL))"


@query(LOG + _CALLS + """ SELECT conv_id, id, c1.turn AS call_turn, name, r1.turn AS response_turn, content FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, i) = 1) c1
LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, i) = 1) r1 USING (conv_id, id)""")
def tool_call_responses(spark, sf_dir):
    return M.link(log(spark, sf_dir))


@query(LOG + " SELECT conv_id, turn, array_to_string(list_distinct_kept, ', ') AS tools, array_to_string([c.name || ': ' || substr(c.arguments, 1, 400) for c in tool_calls], ' | ') AS digest FROM (SELECT *, [c.name for c, i in tool_calls if list_position([d.name for d in tool_calls], c.name) = i] AS list_distinct_kept FROM m WHERE len(tool_calls) > 0)")
def tool_call_digest(spark, sf_dir):
    return M.call_digest(log(spark, sf_dir))


@query(LOG + " SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS l FROM m) WHERE NOT (turn = l AND coalesce(len(tool_calls), 0) > 0)")
def without_dangling_call(spark, sf_dir):
    return M.without_dangling_call(log(spark, sf_dir)).select("conv_id", "turn")


_RENUMBER = "SELECT * REPLACE (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn)"


def _deleted(index: int) -> str:
    return LOG + f""", g AS (SELECT conv_id, list_concat(coalesce([c.id for c in tool_calls], []), CASE WHEN role = 'tool' THEN [tool_call_id] ELSE [] END) AS ids, coalesce([c.id for c in tool_calls], []) AS gone FROM m WHERE turn = {index}),
    k AS (SELECT m.* REPLACE ({_prune(f"coalesce(g.ids, {_EMPTY_IDS})")} AS tool_responses) FROM m LEFT JOIN g USING (conv_id) WHERE turn <> {index} AND NOT (role = 'tool' AND list_contains(coalesce(g.gone, {_EMPTY_IDS}), tool_call_id)))
    SELECT {FLAT} FROM ({_RENUMBER} FROM k)"""


@query(_deleted(1))
def message_delete(spark, sf_dir):
    return flat(M.delete_at(log(spark, sf_dir), 1))


@query(_deleted(2))
def message_delete_tool_row(spark, sf_dir):
    return flat(M.delete_at(log(spark, sf_dir), 2))


_IDS = "['c' || conv_id || '_1', 'd' || conv_id || '_3']"


def _ids():
    return F.array(F.concat(F.lit("c"), "conv_id", F.lit("_1")), F.concat(F.lit("d"), "conv_id", F.lit("_3")))


_LEFT = f"[c for c in tool_calls if not list_contains({_IDS}, c.id)]"


@query(LOG + f""", k AS (SELECT * REPLACE ({_prune(_IDS)} AS tool_responses, CASE WHEN len({_LEFT}) > 0 THEN {_LEFT} END AS tool_calls) FROM m WHERE NOT (role = 'tool' AND list_contains({_IDS}, tool_call_id))) SELECT {FLAT} FROM ({_RENUMBER} FROM k)""")
def tool_call_delete(spark, sf_dir):
    return flat(M.delete_call(log(spark, sf_dir), _ids()))


@query(LOG + f", k AS (SELECT * REPLACE ({_prune(_IDS)} AS tool_responses) FROM m WHERE NOT (role = 'tool' AND list_contains({_IDS}, tool_call_id))) SELECT {FLAT} FROM ({_RENUMBER} FROM k)")
def tool_response_delete(spark, sf_dir):
    return flat(M.delete_responses(log(spark, sf_dir), _ids()))


@query(LOG + f" SELECT {FLAT} FROM (SELECT * REPLACE (CASE WHEN turn = 1 THEN 'edited ' || conv_id ELSE content END AS content) FROM m)")
def message_update(spark, sf_dir):
    return flat(M.update_at(log(spark, sf_dir), 1, F.concat(F.lit("edited "), "conv_id")))


@query(LOG + " SELECT conv_id, turn, role, content FROM m UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'more for ' || conv_id FROM m GROUP BY conv_id")
def message_append(spark, sf_dir):
    return M.append(log(spark, sf_dir), "user", F.concat(F.lit(" more for "), "conv_id")).select("conv_id", "turn", "role", "content")


@query(LOG + f""" SELECT {FLAT} FROM (SELECT * REPLACE (CASE WHEN turn = 0 THEN 'assistant' ELSE role END AS role, CASE WHEN turn = 0 THEN list_concat(coalesce(tool_calls, []), [{{'id': 'call_' || substr(md5(conv_id || '/' || turn), 1, 8), 'name': 'look', 'arguments': 'a'}}]) ELSE tool_calls END AS tool_calls) FROM m)""")
def tool_call_add(spark, sf_dir):
    return flat(M.add_call(log(spark, sf_dir), 0, "look", "a"))


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("c"), "conv_id", F.lit("_1")).alias("id"), F.concat(F.lit("answer "), "conv_id").alias("answer"))


@query(LOG + """, f AS (SELECT conv_id, min(turn) AS t FROM m WHERE list_contains([c.id for c in tool_calls], 'c' || conv_id || '_1') GROUP BY conv_id),
k AS (SELECT m.* REPLACE (CAST(turn AS DOUBLE) AS turn, CASE WHEN tool_responses IS NOT NULL AND f.t IS NOT NULL THEN list_concat([r for r in tool_responses if r.tool_call_id <> 'c' || m.conv_id || '_1'], [{'tool_call_id': 'c' || m.conv_id || '_1', 'role': 'tool', 'content': 'answer ' || m.conv_id}]) ELSE tool_responses END AS tool_responses) FROM m LEFT JOIN f USING (conv_id)
      UNION ALL BY NAME SELECT conv_id, t + 0.5 AS turn, 'tool' AS role, 'answer ' || conv_id AS content, 'c' || conv_id || '_1' AS tool_call_id FROM f)
SELECT """ + FLAT + f" FROM ({_RENUMBER} FROM k)")
def tool_response_add(spark, sf_dir):
    return flat(M.add_response(log(spark, sf_dir), _answers(spark, sf_dir)))


@query(LOG + " SELECT " + FLAT + """ FROM (SELECT * REPLACE (CASE WHEN role = 'tool' AND tool_call_id = 'c' || conv_id || '_1' THEN 'answer ' || conv_id ELSE content END AS content,
 [{'tool_call_id': r.tool_call_id, 'role': r.role, 'content': CASE WHEN r.tool_call_id = 'c' || conv_id || '_1' THEN 'answer ' || conv_id ELSE r.content END} for r in tool_responses] AS tool_responses) FROM m)""")
def tool_response_update(spark, sf_dir):
    return flat(M.update_response(log(spark, sf_dir), _answers(spark, sf_dir)))


_OLD = ", o AS (SELECT conv_id, max(function_call.name) AS old FROM m WHERE turn = 1 GROUP BY conv_id)"


@query(LOG + _OLD + " SELECT " + FLAT + " FROM (SELECT m.* REPLACE (CASE WHEN turn = 1 AND function_call IS NOT NULL THEN {'name': 'renamed', 'arguments': function_call.arguments} ELSE function_call END AS function_call, CASE WHEN role = 'function' AND name = old THEN 'renamed' ELSE name END AS name) FROM m LEFT JOIN o USING (conv_id))")
def function_call_rename(spark, sf_dir):
    return flat(M.rename_function(log(spark, sf_dir), 1, "renamed"))


@query(LOG + _OLD + f", k AS (SELECT m.* REPLACE (CASE WHEN turn <> 1 THEN function_call END AS function_call) FROM m LEFT JOIN o USING (conv_id) WHERE NOT (role = 'function' AND coalesce(name = old, false))) SELECT {FLAT} FROM ({_RENUMBER} FROM k)")
def function_call_delete(spark, sf_dir):
    return flat(M.delete_function_call(log(spark, sf_dir), 1))


@query(LOG + f""", g AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN coalesce([c.id for c in tool_calls], {_EMPTY_IDS}) END) AS gone, max(CASE WHEN role = 'assistant' THEN function_call.name END) AS old, max(CASE WHEN role = 'tool' THEN tool_call_id END) AS own FROM m WHERE turn = 1 GROUP BY conv_id),
k AS (SELECT m.* REPLACE ({_prune(f"list_concat(coalesce(gone, {_EMPTY_IDS}), CASE WHEN own IS NOT NULL THEN [own] ELSE [] END)")} AS tool_responses, CASE WHEN NOT (turn = 1 AND role = 'assistant') THEN tool_calls END AS tool_calls,
  CASE WHEN NOT (turn = 1 AND role = 'assistant') THEN function_call END AS function_call, CASE WHEN NOT (turn = 1 AND role = 'function') THEN name END AS name, CASE WHEN NOT (turn = 1 AND role = 'tool') THEN tool_call_id END AS tool_call_id, CASE WHEN turn = 1 THEN 'user' ELSE role END AS role)
  FROM m LEFT JOIN g USING (conv_id) WHERE NOT (role = 'tool' AND list_contains(coalesce(gone, {_EMPTY_IDS}), tool_call_id)) AND NOT (role = 'function' AND coalesce(name = old, false)))
SELECT {FLAT} FROM ({_RENUMBER} FROM k)""")
def message_change_role(spark, sf_dir):
    return flat(M.change_role(log(spark, sf_dir), 1, "user"))


# ---------------------------------------------------------------- text
@query("SELECT doc_id, length(text) AS length, sha256(text) AS sha256, substr(text, 1, 240) AS preview FROM documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("f")).select("doc_id", "f.*")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_whitespace("text")).alias("collapsed"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))


@query(r"SELECT page_id, regexp_replace(lower(trim(url)), '[^a-z0-9]+', '', 'g') AS key, replace(replace(trim(regexp_replace(url, '\s+', ' ', 'g')), ' ,', ','), ' .', '.') AS query_text, split_part(trim(url), '.', 1) AS root, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS name, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare FROM pages")
def key_and_name_normalisation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.norm_key("url").alias("key"), T.query_text("url").alias("query_text"), T.dependency_root("url").alias("root"), T.sanitize_name("url").alias("name"), T.strip_prefix("url", "https://").alias("bare"))


@query("""SELECT o_orderkey, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 4) * 37 AS DOUBLE) AS b FROM orders)""")
def size_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.size_format(F.floor("o_totalprice") * (F.col("o_orderkey") % 4) * 37).alias("size"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, md5(CASE WHEN ceil(length(text) / 4.0) <= 200 THEN text ELSE substr(text, 1, 400) || chr(10) || chr(10) || '>>> ...omitted content... <<<' || chr(10) || chr(10) || right(text, 400) END) AS cut FROM documents")
def head_tail_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), F.md5(T.head_tail_cut("text", 200)).alias("cut"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS slice, CASE WHEN len(string_split(trim(text), chr(10))) > 3 THEN string_split(trim(text), chr(10))[1] || '...' ELSE trim(text) END AS opening FROM documents")
def line_slices(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_slice("text", 2, 4).alias("slice"), T.first_lines("text").alias("opening"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_\\-.]+')) AS token FROM documents) WHERE length(token) >= 3 AND token NOT IN (" + ", ".join(f"'{t}'" for t in manifest.STOP_TOKENS) + ") GROUP BY token ORDER BY n DESC, token LIMIT 24")
def token_frequency(spark, sf_dir):
    return corpus.token_frequency(table(spark, sf_dir, "documents"))


@query(r"SELECT o_orderkey, CASE dayofweek(d) WHEN 6 THEN d + INTERVAL 2 DAY WHEN 0 THEN d + INTERVAL 1 DAY ELSE d END::DATE AS workday, least(pow(2.0, o_orderkey % 9), 60.0) AS delay FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def next_weekday_and_backoff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.next_weekday("o_orderdate").alias("workday"), T.backoff(F.col("o_orderkey") % 9).alias("delay"))


_ANSWER = "CASE doc_id % 4 WHEN 0 THEN ' yes - ' WHEN 1 THEN 'NO: ' WHEN 2 THEN '```json' || chr(10) || '{\"a\": 1}' || chr(10) || '```' ELSE '' END || text"


@query(rf"""SELECT doc_id, nullif(upper(regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 1)), '') AS verdict, CASE WHEN regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 1) <> '' THEN trim(regexp_extract(a, '(?is)^\s*(YES|NO)\b[:\-\s]*(.*)$', 2)) END AS reason,
 coalesce(nullif(regexp_extract(a, '(?s)```(?:json)?\s*(\{{.*\}})\s*```', 1), ''), trim(a)) AS block, CASE substr(a, 1, 1) WHEN '#' THEN 'heading' WHEN '{{' THEN 'json' WHEN '[' THEN 'json' ELSE 'code' END AS kind FROM (SELECT doc_id, {_ANSWER} AS a FROM documents)""")
def answer_parsing(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWER.replace("chr(10)", "'\\n'")).alias("a"))
    return a.select("doc_id", T.decision("a").alias("d"), T.json_block("a").alias("block"), T.response_preview("a")["kind"].alias("kind")).select("doc_id", "d.verdict", "d.reason", "block", "kind")


_PIP = "CASE WHEN doc_id % 3 = 0 THEN 'Collecting ' || lang || chr(10) || '  Using cached x' || chr(10) || 'Successfully installed ' || source || chr(10) ELSE '' END || text"


@query(rf"""SELECT doc_id, md5(CASE WHEN regexp_matches(t, 'Successfully installed |Requirement already satisfied:|WARNING: You are using pip version|ERROR: pip''s dependency resolver|ERROR: Could not install packages|Attempting uninstall|Found existing installation|Successfully uninstalled')
 THEN array_to_string([x for x in string_split(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10)) if not regexp_matches(x, '{T.PIP_NOISE}')], chr(10)) ELSE t END) AS kept FROM (SELECT doc_id, {_PIP} AS t FROM documents)""")
def installer_log_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PIP.replace("chr(10)", "'\\n'")).alias("t")).select("doc_id", F.md5(T.filter_installer_log("t")).alias("kept"))


def _web_sql() -> str:
    t = "html"
    for pattern, by in T.WEB_RULES:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return rf"SELECT page_id, md5(array_to_string([x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split({t}, chr(10))] if len(string_split_regex(x, '\s+')) > 2], chr(10))) AS cleaned FROM pages"


@query(_web_sql())
def clean_web_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_web_text("html")).alias("cleaned"))


_FENCES = "'say' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '```sh' || chr(10) || ' ls ' || chr(10) || '```' WHEN 1 THEN '```python' || chr(10) || 'y' || chr(10) || '```' || chr(10) || '```sql' || chr(10) || 'q' || chr(10) || '```' ELSE source END"


@query(rf"""SELECT doc_id, CASE WHEN len(l) > 0 AND len([x for x in l if lower(x) not in ('python', 'python3', 'sh', 'bash', 'shell')]) = 0 THEN array_to_string([lower(l[i]) || '=' || trim(c[i]) for i in generate_series(1, len(l))], ';') END AS blocks
FROM (SELECT doc_id, regexp_extract_all(t, '(?s)```[ \t]*(\w+)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```', 1) AS l, regexp_extract_all(t, '(?s)```[ \t]*(\w+)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```', 2) AS c FROM (SELECT doc_id, {_FENCES} AS t FROM documents))""")
def code_blocks(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FENCES.replace("chr(10)", "'\\n'")).alias("t"))
    return t.select("doc_id", F.array_join(F.transform(T.code_blocks("t"), lambda b: F.concat(b["language"], F.lit("="), b["code"])), ";").alias("blocks"))


@query("SELECT doc_id, md5(replace(text, 'the', 'THE')) AS all_edits, md5(CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END) AS first_edit, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' END AS error FROM (SELECT *, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents)")
def text_edits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.replace("text", F.lit("the"), F.lit("THE"))).alias("all_edits"), F.md5(T.replace_once("text", "the", "THE")).alias("first_edit"), T.strict_edit("text", "the", "THE")["error"].alias("error"))


@query("SELECT doc_id, len([x for x in [" + ", ".join(f"'{m}'" for m in T.RETRY_MARKERS) + "] if contains(lower(text || CASE doc_id % 3 WHEN 0 THEN ' Connection Reset' WHEN 1 THEN ' 429' ELSE '' END), x)]) > 0 AS retryable FROM documents")
def retryable_errors(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Connection Reset").when(F.col("doc_id") % 3 == 1, " 429").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.retryable(t).alias("retryable"))


# ---------------------------------------------------------------- search
@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'en/')")
def path_search(spark, sf_dir):
    return corpus.paths_with(table(spark, sf_dir, "pages"), "en/", "url").select("page_id", "url")


@query("""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(lower(text), 'hation'))),
h AS (SELECT doc_id, line_no, ls[line_no + 1] AS line, contains(lower(ls[line_no + 1]), 'hation') AS hit FROM l), n AS (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS before FROM n WHERE near = 1)
SELECT doc_id, line_no, CASE WHEN hit THEN '>>> ' ELSE '    ' END || line AS shown FROM b WHERE before <= 50""")
def line_grep(spark, sf_dir):
    return corpus.grep(table(spark, sf_dir, "documents"), "hation")


@query("SELECT doc_id, len([x for x in string_split(lower(text), chr(10)) if contains(x, 'hation')]) AS n_lines FROM documents WHERE contains(lower(text), 'hation')")
def keyword_hits(spark, sf_dir):
    return corpus.keyword_hits(table(spark, sf_dir, "documents"), "Hation")


@query("SELECT doc_id, i AS line_no, lpad(CAST(i + 1 AS VARCHAR), 6, ' ') || chr(9) || ls[i + 1] AS shown FROM (SELECT doc_id, ls, unnest(generate_series(1, least(len(ls), 4) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def numbered_lines(spark, sf_dir):
    return corpus.numbered_lines(table(spark, sf_dir, "documents"), 1, 3)


@query("WITH s AS (SELECT doc_id, line_no AS first_line, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS last_line FROM (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE regexp_matches(ls[line_no + 1], '^The')) SELECT doc_id, w AS line_no, min(first_line) AS first_line FROM (SELECT doc_id, unnest([doc_id % 7, 40 * (doc_id % 7), 5000 + doc_id]) AS w FROM documents) JOIN s USING (doc_id) WHERE w >= first_line AND (last_line IS NULL OR w <= last_line) GROUP BY doc_id, w")
def range_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.span_at(corpus.spans_of(docs, "^The"), docs.select("doc_id", F.explode(F.array(F.col("doc_id") % 7, 40 * (F.col("doc_id") % 7), 5000 + F.col("doc_id"))).alias("line_no")))


# ---------------------------------------------------------------- dedupe, budgets, snapshots
@query("SELECT doc_id, source FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1")
def dedupe_ordered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("k"))
    return corpus.dedupe_first(docs, F.col("k"), F.col("doc_id")).select("doc_id", "source")


@query("SELECT source, doc_id, b AS before FROM (SELECT source, doc_id, coalesce(sum(t) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM documents)) WHERE b <= 8000")
def budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate("text").alias("t"))
    return corpus.budget_prefix(docs, "source", ["doc_id"], F.col("t"), 8000).select("source", "doc_id", "before")


@query("WITH p AS (SELECT source, doc_id, length(text) > 8000 AS o, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS pos FROM documents), s AS (SELECT *, min(CASE WHEN o THEN pos END) OVER (PARTITION BY source) AS stop FROM p) SELECT source, doc_id, pos FROM s WHERE stop IS NULL OR pos < stop")
def budget_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.budget_files(docs.select("source", "doc_id", "lang", F.length("text").alias("t")), "source", ["doc_id"], F.col("t"), F.col("lang") == "fr", 8000).select("source", "doc_id", "pos")


_PACKED = """WITH RECURSIVE o AS (SELECT source, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
w AS (SELECT source, doc_id, n, t, t AS total, CAST(0 AS BIGINT) AS pack FROM o WHERE n = 1 UNION ALL SELECT o.source, o.doc_id, o.n, o.t, CASE WHEN {new} THEN o.t ELSE w.total + o.t END, CASE WHEN {new} THEN w.pack + 1 ELSE w.pack END FROM w JOIN o ON o.source = w.source AND o.n = w.n + 1)
SELECT source, doc_id, t, pack FROM w"""


@query(_PACKED.format(new="w.total + o.t > 6000"))
def greedy_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate("text").alias("t"))
    return corpus.pack(docs, "source", "doc_id", "t", 6000)


@query(_PACKED.format(new="w.total > 6000"))
def chunked_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate("text").alias("t"))
    return corpus.pack(docs, "source", "doc_id", "t", 6000, after=True)


_BEFORE, _AFTER = "doc_id % 3 <> 0", "doc_id % 4 <> 1"


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), (F.col("n_chars") + 0).alias("size"), "doc_id")
    return docs.where(_BEFORE).select("path", "size"), docs.where(_AFTER).select("path", (F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"))


_SNAP = f"WITH b AS (SELECT source || '/' || doc_id AS path, n_chars AS size FROM documents WHERE {_BEFORE}), a AS (SELECT source || '/' || doc_id AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE {_AFTER})"


@query(_SNAP + " SELECT path, size FROM a WHERE path NOT IN (SELECT path FROM b)")
def snapshot_new(spark, sf_dir):
    return corpus.new_paths(*_snapshots(spark, sf_dir)).select("path", "size")


@query(_SNAP + " SELECT path, CASE WHEN b.size IS NULL THEN 'added' WHEN a.size IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE b.size IS DISTINCT FROM a.size")
def snapshot_diff(spark, sf_dir):
    return corpus.snapshot_changes(*_snapshots(spark, sf_dir))


_PATH = "CASE doc_id % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'build/' WHEN 2 THEN '.git/' WHEN 3 THEN 'node_modules/a/' WHEN 4 THEN '__x/' ELSE 'a/b/' END || source || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.PNG' WHEN 2 THEN '.png' WHEN 3 THEN '.ipynb' WHEN 4 THEN '.log' WHEN 5 THEN '.csv' ELSE '' END"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""SELECT doc_id, path, CASE WHEN ends_with(path, '.ipynb') AND NOT list_has_any(string_split(path, '/'), {_list(paths.REPO_DIRS)}) THEN false ELSE starts_with(path, '.') OR starts_with(path, '__') OR len([e for e in {_list(paths.REPO_ENDS)} if ends_with(path, e)]) > 0 OR list_has_any(string_split(path, '/'), {_list(paths.REPO_DIRS)}) END AS in_repository,
 list_has_any(string_split(path, '/'), {_list(paths.SNAPSHOT_DIRS)}) OR len([e for e in {_list(paths.SNAPSHOT_ENDS)} if ends_with(lower(string_split(path, '/')[-1]), e)]) > 0 OR starts_with(string_split(path, '/')[-1], '.') AS in_snapshot,
 CASE WHEN e IN ('csv', 'xlsx', 'xls') THEN 'data' WHEN e IN ('txt', 'md', 'py', 'js', 'html', 'css') THEN 'text' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'tiff') THEN 'image' ELSE 'other' END AS kind,
 CASE WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp', 'svg') THEN 0 WHEN e = 'pdf' THEN 1 WHEN e IN ('csv', 'xlsx', 'json') THEN 2 ELSE 3 END AS priority, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module_id
FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM (SELECT doc_id, {_PATH} AS path FROM documents))""")
def path_filters(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    c = F.col("path")
    return p.select("doc_id", "path", paths.ignored_in_repository(c).alias("in_repository"), paths.ignored_in_snapshot(c).alias("in_snapshot"), T.file_kind("path").alias("kind"), ranking.file_priority(c).alias("priority"), T.module_id("path").alias("module_id"))


# ---------------------------------------------------------------- profiles
@query("SELECT n_rows, column_name, n_null, n_distinct, least, greatest FROM (SELECT count(*) AS n_rows, unnest([{'column_name': 'o_custkey', 'n_null': count(*) - count(o_custkey), 'n_distinct': count(DISTINCT o_custkey), 'least': min(o_custkey)::VARCHAR, 'greatest': max(o_custkey)::VARCHAR}, {'column_name': 'o_orderstatus', 'n_null': count(*) - count(o_orderstatus), 'n_distinct': count(DISTINCT o_orderstatus), 'least': min(o_orderstatus), 'greatest': max(o_orderstatus)}, {'column_name': 'o_orderpriority', 'n_null': count(*) - count(o_orderpriority), 'n_distinct': count(DISTINCT o_orderpriority), 'least': min(o_orderpriority), 'greatest': max(o_orderpriority)}], recursive := true) FROM orders)")
def profile_columns(spark, sf_dir):
    return corpus.profile(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def profile_top_values(spark, sf_dir):
    return corpus.top_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query()
def json_schema(spark, sf_dir):
    return corpus.json_schema(table(spark, sf_dir, "events"), "props")


@query("SELECT page_id, i - 1 AS pos, h[i] AS href, regexp_replace(t[i], '<[^>]*>', '', 'g') AS text FROM (SELECT page_id, h, t, unnest(generate_series(1, len(h))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2) AS t FROM pages))")
def link_extract(spark, sf_dir):
    return files.links(table(spark, sf_dir, "pages"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def url_exclusion(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id", "url")


# ---------------------------------------------------------------- retrieval
@query("SELECT doc_id, i AS chunk_no, substr(text, i * 900 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 101, 0) // 900)) AS i FROM documents WHERE length(text) > 0)")
def text_chunks(spark, sf_dir):
    return corpus.chunks(table(spark, sf_dir, "documents"))


_QV = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]


@query("SELECT vec_id, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e, " + str(_QV) + "::DOUBLE[] AS q FROM embeddings) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return retrieval.vector_top(table(spark, sf_dir, "embeddings"), _QV, 20)


_TERMS = ["the", "hation", "que"]


def _bm25_sql(terms: list[str]) -> str:
    counts = ", ".join(f"len([x for x in w if x = '{t}']) AS t{i}" for i, t in enumerate(terms))
    parts = " + ".join(f"ln((docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    totals = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    return rf"c AS (SELECT doc_id, len(w) AS n, {counts} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents)), a AS (SELECT count(*) AS docs, avg(n) AS mean, {totals} FROM c), bm AS (SELECT doc_id, round({parts}, 6) AS score FROM c, a WHERE {parts} > 0)"


@query("WITH " + _bm25_sql(_TERMS) + " SELECT doc_id, score FROM bm WHERE score > 0")
def bm25_scores(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), _TERMS)


@query("WITH " + _bm25_sql(_TERMS) + """, k AS (SELECT doc_id, 1.0 * n_chars AS score FROM documents ORDER BY score DESC, doc_id LIMIT 100), b AS (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100),
r AS (SELECT doc_id, 0.6 / (row_number() OVER (ORDER BY score DESC, doc_id) + 60) AS part FROM k UNION ALL SELECT doc_id, 0.4 / (row_number() OVER (ORDER BY score DESC, doc_id) + 60) FROM b)
SELECT doc_id, round(sum(part), 9) AS score FROM r GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def rank_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    long = retrieval.best(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), 100, "doc_id")
    return retrieval.fuse(long, retrieval.best(retrieval.bm25(docs, _TERMS), 100, "doc_id"), 0.6, 10, "doc_id")


# ---------------------------------------------------------------- ranking
@query("SELECT doc_id, round(0.6 * (quality * 0.2 + toxic * 0.2 + quality * 0.15 + toxic * 0.15 + (1 - toxic) * 0.15 + quality * 0.1 + 0.1 + 0.0) + (doc_id % 11) / 10.0 * 0.4, 9) AS score FROM labels")
def repo_scores(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    named = dict(zip(ranking.DIMENSIONS, (q, t, q, t, 1 - t, q, F.lit(1), F.lit(0)), strict=True))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(ranking.repo_score(named, F.col("doc_id") % 11), 9).alias("score"))


@query("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def top_per_source(spark, sf_dir):
    return ranking.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", 5, "doc_id")


@query("""SELECT user_id AS trace_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS runtime_ms, count(*) AS span_count,
 array_to_string([x for x in [CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 > 45000 OR count(*) >= 8 THEN 'latency' END, CASE WHEN count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') = 0 THEN 'retrieval' END, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failure' END] if x is not null], ',') AS labels FROM events GROUP BY user_id""")
def trace_labels(spark, sf_dir):
    return ranking.trace_labels(table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "ts", "event_type"))


@query("SELECT event_type, CASE WHEN s >= 5 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT event_type, 2 * (count(DISTINCT user_id) % 3) + count(*) FILTER (value < 1) % 2 + CASE WHEN avg(value) < 0.4 THEN 2 ELSE 0 END AS s FROM events GROUP BY event_type)")
def cluster_severity(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count_distinct("user_id") % 3).alias("n"), (F.count_if(F.col("value") < 1) % 2).alias("bad"), F.avg("value").alias("mean"))
    return per.select("event_type", ranking.cluster_severity(F.col("n"), F.col("bad"), F.col("mean")).alias("severity"))
