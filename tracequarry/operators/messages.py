"""Conversation logs: look-ups, summaries, histories and edits.

A message frame has conv_id, turn, role, name, content, tool_calls array<struct<id, name, arguments>>, function_call
struct<name, arguments>, tool_responses array<struct<tool_call_id, role, content>> and tool_call_id. Edits give
a new frame; they act on every conversation of the frame at once and never bring rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracequarry.functions.text import code_blocks


def by_turn() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def whole() -> WindowSpec:
    return Window.partitionBy("conv_id")


def search(messages: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """conv_id and turn of the messages whose content matches a regular expression."""
    return messages.where(F.col("content").rlike(pattern if case_sensitive else f"(?i){pattern}")).select("conv_id", "turn")


def with_role(messages: DataFrame, role: str) -> DataFrame:
    return messages.where(F.col("role") == role)


def with_name(messages: DataFrame, name: str) -> DataFrame:
    return messages.where(F.col("name") == name)


def last_message(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "content"), "turn").alias("m")).select("conv_id", "m.*")


def summary(messages: DataFrame) -> DataFrame:
    """Totals of each conversation; a tool row and an aggregated response both count."""
    count = lambda c: F.count_if(c)
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        *(count(F.col("role") == r).alias(f"n_{r}") for r in ("system", "user", "assistant", "tool", "function")),
        F.sum(F.coalesce(F.size(F.coalesce("tool_calls", F.array())), F.lit(0))).alias("tool_calls"),
        count(F.col("function_call").isNotNull()).alias("function_calls"),
        (count(F.col("role") == "tool") + F.sum(F.size(F.coalesce("tool_responses", F.array())))).alias("tool_responses"),
    )


def drop_consecutive(messages: DataFrame, *same: str) -> DataFrame:
    """A message equal in `same` to the one before it goes."""
    key = F.struct(*same)
    return messages.withColumn("__before", F.lag(key).over(by_turn())).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(key)).drop("__before")


def admissible(messages: DataFrame, system_prefix: str = "System:") -> DataFrame:
    """Empty messages, those with a system prefix and immediate repeats go."""
    kept = messages.where((F.trim("content") != "") & ~F.col("content").startswith(system_prefix))
    return drop_consecutive(kept, "content")


def without_failed_runs(messages: DataFrame) -> DataFrame:
    return messages.where(~F.coalesce(F.col("content").contains("exitcode: 1 (execution failed)"), F.lit(False)))


def history(messages: DataFrame, last: int = 4, cut: int = 200, least: int = 2) -> DataFrame:
    """The last messages of each conversation as lines "Role: text"; empty where there are at most `least`."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("content", 1, cut))
    # Few rows of each conversation reach the aggregate: the rank is cut before the shuffle's end.
    tail = messages.select("conv_id", "turn", line.alias("line"), rank.alias("r")).where(F.col("r") <= last)
    lines = tail.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda p: p["line"]), "\n").alias("history"))
    total = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(lines, "conv_id").select("conv_id", F.when(F.col("n") > least, F.col("history")).otherwise("").alias("history"), F.greatest(F.col("n") - last, F.lit(0)).alias("earlier"))


def prompt_with_history(messages: DataFrame, last: int = 4, cut: int = 200) -> DataFrame:
    """The last message as a question after the history of the others; alone where it is the only one."""
    newest = last_message(messages).select("conv_id", F.col("content").alias("question"), F.col("turn").alias("newest"))
    earlier = messages.join(newest.select("conv_id", "newest"), "conv_id").where("turn < newest").drop("newest")
    told = history(earlier, last, cut, 0).select("conv_id", "history")
    return newest.join(told, "conv_id", "left").select("conv_id", F.when(F.col("history").isNull(), F.col("question")).otherwise(F.concat(F.lit("History:\n"), "history", F.lit("\n\nQuestion: "), "question")).alias("prompt"))


def trailing_run(messages: DataFrame, role: str = "user") -> DataFrame:
    """How many messages of the role end each conversation."""
    other = F.max(F.when(F.col("role") != role, F.col("turn"))).over(whole())
    return messages.withColumn("__other", other).groupBy("conv_id").agg(F.count_if((F.col("turn") > F.col("__other")) | F.col("__other").isNull()).alias("run"))


def limit_crossing(messages: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """The first turn at which a conversation's running number of tokens is over the limit."""
    running = F.sum(tokens).over(by_turn().rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("__sum", running).where(F.col("__sum") > limit).groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min("__sum").alias("tokens"))


def unroll(messages: DataFrame) -> DataFrame:
    """Each aggregated response as a row of its own, and the message itself unless it is a tool row."""
    own = F.struct(F.lit(None).cast("string").alias("tool_call_id"), F.col("role"), F.col("content"))
    parts = F.concat(F.coalesce("tool_responses", F.expr("cast(array() AS array<struct<tool_call_id:string,role:string,content:string>>)")), F.when(F.col("role") != "tool", F.array(own)).otherwise(F.expr("cast(array() AS array<struct<tool_call_id:string,role:string,content:string>>)")))
    return messages.select("conv_id", "turn", F.posexplode(parts).alias("part", "m")).select("conv_id", "turn", "part", "m.role", "m.content", "m.tool_call_id")


def fold(messages: DataFrame, tail: int = 3, note: str = "[summary]") -> DataFrame:
    """The first message, one note for the middle, the last ones."""
    last = F.max("turn").over(whole())
    ends = messages.withColumn("__last", last)
    kept = ends.where((F.col("turn") == 0) | (F.col("turn") > F.col("__last") - tail)).select("conv_id", "turn", "role", "content")
    middle = ends.where((F.col("turn") > 0) & (F.col("turn") <= F.col("__last") - tail)).groupBy("conv_id").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.lit("user").alias("role"), F.lit(note).alias("content"))
    return kept.unionByName(middle)


def calls(messages: DataFrame) -> DataFrame:
    """One row a tool call."""
    return messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("pos", "c")).select("conv_id", "turn", "pos", "c.id", "c.name", "c.arguments")


def responses(messages: DataFrame) -> DataFrame:
    """One row an aggregated tool response."""
    return messages.select("conv_id", "turn", F.posexplode("tool_responses").alias("pos", "r")).select("conv_id", "turn", "pos", F.col("r.tool_call_id").alias("id"), "r.content")


def link(messages: DataFrame) -> DataFrame:
    """Each tool call with the first aggregated response to it: turns of both, content (null where there is none)."""
    first = responses(messages).groupBy("conv_id", "id").agg(F.min_by(F.struct(F.col("turn").alias("response_turn"), "content"), F.struct("turn", "pos")).alias("r"))
    made = calls(messages).groupBy("conv_id", "id").agg(F.min_by(F.struct(F.col("turn").alias("call_turn"), "name"), F.struct("turn", "pos")).alias("c"))
    return made.join(first, ["conv_id", "id"], "left").select("conv_id", "id", "c.call_turn", "c.name", "r.response_turn", "r.content")


def call_digest(messages: DataFrame, cut: int = 400) -> DataFrame:
    """Distinct tool names in order, and "name: arguments" joined by a bar."""
    return messages.where(F.size("tool_calls") > 0).select(
        "conv_id", "turn", F.array_join(F.array_distinct(F.transform("tool_calls", lambda c: c["name"])), ", ").alias("tools"),
        F.array_join(F.transform("tool_calls", lambda c: F.concat(c["name"], F.lit(": "), F.substring(c["arguments"], 1, cut))), " | ").alias("digest"),
    )


def without_dangling_call(messages: DataFrame) -> DataFrame:
    """The last message of a conversation goes if it carries tool calls."""
    return messages.withColumn("__last", F.max("turn").over(whole())).where(~((F.col("turn") == F.col("__last")) & F.coalesce(F.size("tool_calls") > 0, F.lit(False)))).drop("__last")


def _pruned(gone: Column) -> Column:
    """tool_responses without those that answer one of the ids `gone`; null when none is left."""
    left = F.filter("tool_responses", lambda r: ~F.coalesce(F.array_contains(gone, r["tool_call_id"]), F.lit(False)))
    return F.when(F.size(left) > 0, left)


def renumbered(messages: DataFrame) -> DataFrame:
    return messages.withColumn("turn", (F.row_number().over(by_turn()) - 1).cast("long"))


def delete_at(messages: DataFrame, index: int) -> DataFrame:
    """Delete a message of every conversation, with the responses to its calls; for a tool row, its aggregated copies."""
    at = F.col("turn") == index
    gone = F.max(F.when(at, F.coalesce(F.transform("tool_calls", lambda c: c["id"]), F.expr("cast(array() AS array<string>)")))).over(whole())
    own = F.max(F.when(at & (F.col("role") == "tool"), F.col("tool_call_id"))).over(whole())
    marked = messages.withColumns({"__gone": gone, "__own": own})
    kept = marked.where(~at & ~((F.col("role") == "tool") & F.coalesce(F.array_contains("__gone", F.col("tool_call_id")), F.lit(False))))
    ids = F.coalesce(F.array_compact(F.concat(F.coalesce("__gone", F.expr("cast(array() AS array<string>)")), F.array("__own"))), F.expr("cast(array() AS array<string>)"))
    return renumbered(kept.withColumn("tool_responses", _pruned(ids)).drop("__gone", "__own"))


def delete_call(messages: DataFrame, ids: Column) -> DataFrame:
    """Delete the tool calls whose id is in the array, and every response to them."""
    kept = messages.where(~((F.col("role") == "tool") & F.coalesce(F.array_contains(ids, F.col("tool_call_id")), F.lit(False))))
    calls_left = F.filter("tool_calls", lambda c: ~F.array_contains(ids, c["id"]))
    return renumbered(kept.withColumns({"tool_calls": F.when(F.size(calls_left) > 0, calls_left), "tool_responses": _pruned(ids)}))


def delete_responses(messages: DataFrame, ids: Column) -> DataFrame:
    """Delete tool rows and aggregated responses to the ids."""
    kept = messages.where(~((F.col("role") == "tool") & F.coalesce(F.array_contains(ids, F.col("tool_call_id")), F.lit(False))))
    return renumbered(kept.withColumn("tool_responses", _pruned(ids)))


def update_at(messages: DataFrame, index: int, content: Column) -> DataFrame:
    return messages.withColumn("content", F.when(F.col("turn") == index, content).otherwise(F.col("content")))


def append(messages: DataFrame, role: str, content: Column) -> DataFrame:
    """A message after the last of every conversation; blank content is skipped."""
    new = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumns({"role": F.lit(role), "content": F.trim(content)}).where("content <> ''")
    return messages.unionByName(new, allowMissingColumns=True)


def add_call(messages: DataFrame, index: int, name: str, arguments: str) -> DataFrame:
    """Add a tool call to a message, which becomes the assistant's. The id is made from conversation and turn."""
    at = F.col("turn") == index
    call = F.struct(F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("/", "conv_id", "turn")), 1, 8)).alias("id"), F.lit(name).alias("name"), F.lit(arguments).alias("arguments"))
    more = F.concat(F.coalesce("tool_calls", F.expr("cast(array() AS array<struct<id:string,name:string,arguments:string>>)")), F.array(call))
    return messages.withColumns({"role": F.when(at, "assistant").otherwise(F.col("role")), "tool_calls": F.when(at, more).otherwise(F.col("tool_calls"))})


def add_response(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (conv_id, id, answer): a tool row after the first message with the call, and each aggregate refreshed."""
    first = calls(messages).groupBy("conv_id", "id").agg(F.min("turn").alias("turn"))
    new = answers.join(first, ["conv_id", "id"]).select("conv_id", (F.col("turn") + 0.5).alias("turn"), F.lit("tool").alias("role"), F.col("id").alias("tool_call_id"), F.col("answer").alias("content"))
    per = answers.join(first, ["conv_id", "id"], "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("tool_call_id"), F.lit("tool").alias("role"), F.col("answer").alias("content")))).alias("__new"))
    fresh = messages.join(per, "conv_id", "left")
    refreshed = F.when(F.col("tool_responses").isNotNull() & F.col("__new").isNotNull(), F.concat(F.filter("tool_responses", lambda r: ~F.exists("__new", lambda n: n["tool_call_id"] == r["tool_call_id"])), "__new")).otherwise(F.col("tool_responses"))
    old = fresh.withColumns({"tool_responses": refreshed, "turn": F.col("turn").cast("double")}).drop("__new")
    return renumbered(old.unionByName(new, allowMissingColumns=True))


def update_response(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (conv_id, id, answer): new content for tool rows and aggregated responses with the id."""
    per = answers.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "answer"))).alias("__new"))
    fresh = messages.join(per, "conv_id", "left")
    row = F.when(F.col("role") == "tool", F.coalesce(F.element_at("__new", F.col("tool_call_id")), F.col("content"))).otherwise(F.col("content"))
    parts = F.transform("tool_responses", lambda r: F.struct(r["tool_call_id"].alias("tool_call_id"), r["role"].alias("role"), F.coalesce(F.element_at("__new", r["tool_call_id"]), r["content"]).alias("content")))
    return fresh.withColumns({"content": row, "tool_responses": parts}).drop("__new")


def rename_function(messages: DataFrame, index: int, name: str) -> DataFrame:
    """A message's function call gets a new name, and the responses of the old name follow."""
    old = F.max(F.when(F.col("turn") == index, F.col("function_call.name"))).over(whole())
    marked = messages.withColumn("__old", old)
    call = F.when((F.col("turn") == index) & F.col("function_call").isNotNull(), F.struct(F.lit(name).alias("name"), F.col("function_call.arguments").alias("arguments"))).otherwise(F.col("function_call"))
    named = F.when((F.col("role") == "function") & (F.col("name") == F.col("__old")), F.lit(name)).otherwise(F.col("name"))
    return marked.withColumns({"function_call": call, "name": named}).drop("__old")


def delete_function_call(messages: DataFrame, index: int) -> DataFrame:
    """A message's function call goes, with the responses of its name."""
    old = F.max(F.when(F.col("turn") == index, F.col("function_call.name"))).over(whole())
    marked = messages.withColumn("__old", old)
    kept = marked.where(~((F.col("role") == "function") & F.coalesce(F.col("name") == F.col("__old"), F.lit(False))))
    return renumbered(kept.withColumn("function_call", F.when(F.col("turn") != index, F.col("function_call"))).drop("__old"))


def change_role(messages: DataFrame, index: int, role: str) -> DataFrame:
    """Give a message of every conversation another role, with what follows from it.

    From assistant: its calls go, and the responses to them. From function: its name goes. From tool: its id goes, and
    the aggregated responses with that id.
    """
    at = F.col("turn") == index
    none = F.expr("cast(array() AS array<string>)")
    leaving = at & (F.col("role") == "assistant") & F.lit(role != "assistant")
    gone = F.max(F.when(leaving, F.coalesce(F.transform("tool_calls", lambda c: c["id"]), none))).over(whole())
    old = F.max(F.when(leaving, F.col("function_call.name"))).over(whole())
    own = F.max(F.when(at & (F.col("role") == "tool") & F.lit(role != "tool"), F.col("tool_call_id"))).over(whole())
    marked = messages.withColumns({"__gone": gone, "__old": old, "__own": own})
    answered = (F.col("role") == "tool") & F.coalesce(F.array_contains("__gone", F.col("tool_call_id")), F.lit(False))
    replied = (F.col("role") == "function") & F.coalesce(F.col("name") == F.col("__old"), F.lit(False))
    kept = marked.where(~answered & ~replied)
    ids = F.array_compact(F.concat(F.coalesce("__gone", none), F.array("__own")))
    changed = kept.withColumns({
        "tool_responses": _pruned(ids),
        "tool_calls": F.when(~(at & (F.col("role") == "assistant") & F.lit(role != "assistant")), F.col("tool_calls")),
        "function_call": F.when(~(at & (F.col("role") == "assistant") & F.lit(role != "assistant")), F.col("function_call")),
        "name": F.when(~(at & (F.col("role") == "function") & F.lit(role != "function")), F.col("name")),
        "tool_call_id": F.when(~(at & (F.col("role") == "tool") & F.lit(role != "tool")), F.col("tool_call_id")),
        "role": F.when(at, F.lit(role)).otherwise(F.col("role")),
    })
    return renumbered(changed.drop("__gone", "__old", "__own"))


def convert_function_call(messages: DataFrame, index: int) -> DataFrame:
    """A message's function call becomes a tool call with an id made from conversation and turn; responses of its name follow, as rows and in the aggregate."""
    at = (F.col("turn") == index) & F.col("function_call").isNotNull()
    name = F.max(F.when(at, F.col("function_call.name"))).over(whole())
    ident = F.max(F.when(at, F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("/", "conv_id", "turn")), 1, 8)))).over(whole())
    marked = messages.withColumns({"__name": name, "__id": ident})
    reply = (F.col("role") == "function") & F.coalesce(F.col("name") == F.col("__name"), F.lit(False))
    none = F.expr("cast(array() AS array<struct<tool_call_id:string,role:string,content:string>>)")
    told = F.transform(F.array_sort(F.collect_list(F.when(reply, F.struct("turn", "content"))).over(whole())), lambda x: x["content"])
    marked = marked.withColumns({"__reply": reply, "__told": told})
    own = F.transform("__told", lambda c: F.struct(F.col("__id").alias("tool_call_id"), F.lit("tool").alias("role"), c.alias("content")))
    call = F.struct(F.col("__id").alias("id"), F.col("function_call.name").alias("name"), F.col("function_call.arguments").alias("arguments"))
    calls_now = F.concat(F.coalesce("tool_calls", F.expr("cast(array() AS array<struct<id:string,name:string,arguments:string>>)")), F.array(call))
    more = F.concat(F.coalesce("tool_responses", none), own)
    return marked.withColumns({
        "tool_calls": F.when(at, calls_now).otherwise(F.col("tool_calls")), "tool_responses": F.when(at & (F.size("__told") > 0), more).otherwise(F.col("tool_responses")), "function_call": F.when(~at, F.col("function_call")),
        "role": F.when(F.col("__reply"), "tool").otherwise(F.col("role")), "name": F.when(~F.col("__reply"), F.col("name")), "tool_call_id": F.when(F.col("__reply"), F.col("__id")).otherwise(F.col("tool_call_id")),
    }).drop("__name", "__id", "__reply", "__told")


def add_function_call(messages: DataFrame, index: int, name: str, arguments: str) -> DataFrame:
    """Give a message of every conversation a function call; it becomes the assistant's."""
    at = F.col("turn") == index
    call = F.struct(F.lit(name).alias("name"), F.lit(arguments).alias("arguments"))
    return messages.withColumns({"role": F.when(at, "assistant").otherwise(F.col("role")), "function_call": F.when(at, call).otherwise(F.col("function_call"))})


def add_function_response(messages: DataFrame, name: str, content: str) -> DataFrame:
    """A function row after the first message that calls the function; conversations without such a call stay."""
    first = messages.where(F.col("function_call.name") == name).groupBy("conv_id").agg(F.min("turn").alias("turn"))
    new = first.select("conv_id", (F.col("turn") + 0.5).alias("turn"), F.lit("function").alias("role"), F.lit(name).alias("name"), F.lit(content).alias("content"))
    return renumbered(messages.withColumn("turn", F.col("turn").cast("double")).unionByName(new, allowMissingColumns=True))


def update_tool_call(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (conv_id, id, name, arguments): the first call with the id gets name and arguments and keeps the id."""
    placed = calls(messages).groupBy("conv_id", "id").agg(F.min("turn").alias("turn")).join(updates, ["conv_id", "id"])
    per = placed.groupBy("conv_id", "turn").agg(F.collect_list(F.struct("id", "name", "arguments")).alias("__new"))
    fresh = messages.join(per, ["conv_id", "turn"], "left")

    def put(c: Column, i: Column) -> Column:
        mine = F.get(F.filter("__new", lambda n: n["id"] == c["id"]), F.lit(0))
        repeated = F.exists(F.slice("tool_calls", F.lit(1), i), lambda x: x["id"] == c["id"])
        return F.when(mine.isNotNull() & ~repeated, F.struct(c["id"].alias("id"), mine["name"].alias("name"), mine["arguments"].alias("arguments"))).otherwise(c)

    return fresh.withColumn("tool_calls", F.when(F.col("__new").isNotNull(), F.transform("tool_calls", put)).otherwise(F.col("tool_calls"))).drop("__new")


def update_function_response(messages: DataFrame, name: str, content: str) -> DataFrame:
    own = F.coalesce((F.col("role") == "function") & (F.col("name") == name), F.lit(False))
    return messages.withColumn("content", F.when(own, F.lit(content)).otherwise(F.col("content")))


def delete_function_response(messages: DataFrame, name: str) -> DataFrame:
    return renumbered(messages.where(~F.coalesce((F.col("role") == "function") & (F.col("name") == name), F.lit(False))))


def without_calls_beside_code(messages: DataFrame) -> DataFrame:
    """Tool calls of a message go where its content has code that can be run."""
    return messages.withColumn("tool_calls", F.when(code_blocks("content").isNull(), F.col("tool_calls")))


def history_page(messages: DataFrame, last: int = 6, most: int = 100) -> DataFrame:
    """conv_id, the last messages in a numbered list with their contents cut, and how many come before."""
    back = messages.withColumns({"__back": F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))), "__n": F.count(F.lit(1)).over(whole())}).where(F.col("__back") <= last)
    no = F.least(F.col("__n"), F.lit(last)) - F.col("__back") + 1
    content = F.coalesce("content", F.lit(""))
    shown = F.concat(no.cast("string"), F.lit(". "), F.initcap("role"), F.lit(": "), F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content))
    rows = F.array_sort(F.collect_list(F.struct("turn", shown.alias("shown"))))
    return back.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["shown"]), "\n").alias("page"), F.greatest(F.first("__n") - last, F.lit(0)).cast("long").alias("earlier"))
