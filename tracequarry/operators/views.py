"""Look-ups, views, trees, verdict joins and tolerant parsing."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.paths import ignored_in_repository
from tracequarry.functions.text import head_tail_cut, module_id


def find_entity(entities: DataFrame, key: str, most: int = 5, id_col: str = "id") -> DataFrame:
    """Exact id, else ids that end with or hold the key; kind says hit, choice (up to `most`) or many (the first ones)."""
    marked = entities.select(id_col, (F.col(id_col) == key).alias("exact")).where(F.col(id_col).contains(key))
    exact = marked.agg(F.max("exact")).first()[0]
    if exact:
        return marked.where("exact").select(id_col, F.lit("hit").alias("kind"))
    few = marked.orderBy(id_col).limit(most + 1)
    n = few.count()
    return few.orderBy(id_col).limit(most).select(id_col, F.lit("hit" if n == 1 else "choice" if n <= most else "many").alias("kind"))


def entity_view(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with their parameters and the sorted lists of what they call and who calls them."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("calls"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("called_by"))
    none = F.expr("cast(array() AS array<string>)")
    return functions.select("id", F.array_join("parameters", ", ").alias("parameters")).join(out, "id", "left").join(back, "id", "left").select("id", "parameters", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))


def class_view(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Classes with their bases and the signatures of their methods in order."""
    own = functions.where("class_id IS NOT NULL").groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("name", F.lit("("), F.array_join("parameters", ", "), F.lit(")")).alias("s")))).alias("m"))
    return classes.select("id", F.array_join("bases", ", ").alias("bases")).join(own, "id", "left").select("id", "bases", F.coalesce(F.array_join(F.transform("m", lambda x: x["s"]), "; "), F.lit("")).alias("methods"))


def verdict_join(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows whose verdict (key, verdict) says yes."""
    return rows.join(verdicts.where(F.lower("verdict") == "yes").select(key).distinct(), key, "left_semi")


def reorder_blocks(blocks: DataFrame, plans: DataFrame, group: str) -> DataFrame:
    """blocks (group, idx, code) in the order of plans (group, wanted array<int>, keep array<int>); strays and repeats go."""
    wanted = plans.select(group, F.posexplode("wanted").alias("pos", "idx"), "keep").where(F.array_contains("keep", F.col("idx")))
    first = wanted.groupBy(group, "idx").agg(F.min("pos").alias("pos"))
    return blocks.join(first, [group, "idx"]).select(group, "pos", "idx", "code")


def score_write_back(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """groups (task, repos array<string>) with verdicts (task, repo_index from 1, score); indexes out of range go."""
    each = groups.select("task", F.posexplode("repos").alias("pos", "repo"))
    return each.join(verdicts.select("task", (F.col("repo_index") - 1).alias("pos"), "score"), ["task", "pos"], "left").select("task", "repo", F.coalesce("score", F.lit(0.0)).alias("score"))


def merge_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union of two tables of one layout in which the right side wins on a key."""
    return left.join(right.select(key), key, "left_anti").select(*left.columns).unionByName(right)


def accumulate(seen: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Results so far and those of the next round that are not among them."""
    return seen.unionByName(new.dropDuplicates([key]).join(seen.select(key), key, "left_anti").select(*seen.columns))


def tree(paths: DataFrame, caps: tuple[int, ...] = (15, 10, 8, 6)) -> DataFrame:
    """A path tree as rows in order of display: sort_path, depth, shown. Each folder shows as many entries as its depth allows."""
    parts = F.split("path", "/")
    each = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    node = each.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("node"), F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/").alias("parent"), F.col("k").alias("depth"), F.element_at("p", F.col("k").cast("int")).alias("name")).distinct()
    cap = F.get(F.array(*map(F.lit, caps)), F.least(F.col("depth") - 1, F.lit(len(caps) - 1)).cast("int"))
    ranked = node.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("name"))).where(F.col("r") <= cap)
    # A node shows if all its ancestors do.
    chain = ranked.select("node", "depth", "name", F.explode(F.transform(F.sequence(F.lit(1), "depth"), lambda k: F.array_join(F.slice(F.split("node", "/"), F.lit(1), k), "/"))).alias("up"))
    held = chain.join(ranked.select(F.col("node").alias("up")), "up").groupBy("node", "depth", "name").agg(F.count(F.lit(1)).alias("n")).where("n = depth")
    return held.select(F.col("node").alias("sort_path"), "depth", F.concat(F.repeat(F.lit("  "), (F.col("depth") - 1).cast("int")), "name").alias("shown"))


def metadata_text(m: Column) -> Column:
    """A map of lists as text: entries joined by a comma, pairs by a semicolon, in order of the keys."""
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ", "))), "; ")


def fill_placeholders(template: str, values: dict[str, Column]) -> Column:
    """Literal {name} placeholders; a list renders as nothing, its one entry, or lines with dashes."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def list_text(a: Column) -> Column:
    return F.when(F.size(a) == 0, "").when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise(F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n"))


def hit_context(hits: DataFrame, group: str) -> DataFrame:
    """Search hits (title, snippet, content) of a group as one text, blank parts left out."""
    part = F.array_join(F.filter(F.array("title", "snippet", "content"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    return hits.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def repo_kind(c: Column) -> Column:
    """url, archive or path, by what a repository's address looks like."""
    return F.when(c.rlike(r"^(https?://|git@)"), "url").when(c.rlike(r"\.(zip|tar|tar\.gz|tgz)$"), "archive").otherwise("path")


def bounded(value, depth: int, keys: int, items: int, chars: int):
    """A JSON value cut to a depth, so many keys and items, and so many characters; white space is collapsed."""
    if depth <= 0:
        return "..."
    if isinstance(value, dict):
        return {str(k): bounded(v, depth - 1, keys, items, chars) for k, v in list(value.items())[:keys]}
    if isinstance(value, list):
        return [bounded(v, depth - 1, keys, items, chars) for v in value[:items]]
    return " ".join(value.split())[:chars] if isinstance(value, str) else value


def lenient(text: str):
    """JSON, else a Python literal, else "key: value" lines; fences around it go. None if nothing fits."""
    text = (text or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            pass
    pairs = [x.split(":", 1) for x in text.split("\n") if ":" in x]
    return {k.strip().strip("\"'"): v.strip().strip(",\"'") for k, v in pairs} or None


def project(rows: DataFrame, id_col: str, text_col: str, depth: int = 4, keys: int = 24, items: int = 16, chars: int = 320) -> DataFrame:
    """Leniently parsed texts cut to the bounds, as JSON with sorted keys; null where nothing could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [lenient(t) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "projected": [None if v is None else json.dumps(bounded(v, depth, keys, items, chars), sort_keys=True, default=str) for v in read]})

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {dict(rows.dtypes)[id_col]}, projected string")


def outline(source: str) -> str:
    """Imports, classes and functions of a Python text with their first doc lines, and totals; the first lines of what does not parse."""
    try:
        parsed = ast.parse(source)
    except (SyntaxError, ValueError):
        return "\n".join(source.split("\n")[:20])
    out, n_class, n_def = [ast.unparse(x) for x in parsed.body if isinstance(x, (ast.Import, ast.ImportFrom))], 0, 0

    def walk(body: list, indent: str) -> None:
        nonlocal n_class, n_def
        for node in body:
            if isinstance(node, ast.ClassDef):
                n_class += 1
                out.append(f"{indent}class {node.name}({', '.join(ast.unparse(b) for b in node.bases)}):")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                n_def += 1
                out.append(f"{indent}def {node.name}({ast.unparse(node.args)}):")
            else:
                continue
            if doc := ast.get_docstring(node):
                out.append(f'{indent}    """{doc.split(chr(10))[0]}"""')
            walk(node.body, indent + "    ")

    walk(parsed.body, "")
    return "\n".join([*out, f"# {n_class} classes, {n_def} functions, {source.count(chr(10)) + 1} lines"])


def outlines(files: DataFrame, path_col: str = "path", text_col: str = "content", budget: int = 3000) -> DataFrame:
    """path, outline and whether the text itself is over the budget of estimated tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["p"], "outline": [outline(t or "") for t in pdf["t"]], "over": [len(t or "") > 4 * budget for t in pdf["t"]]})

    return files.select(F.col(path_col).alias("p"), F.col(text_col).alias("t")).mapInPandas(run, "path string, outline string, over boolean")


def resolved_paths(asked: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """asked (path) with kind and key: the module (id) that the path names, with or without its suffix, else the file (path), else none."""
    named = asked.withColumn("__id", module_id("path"))
    found = named.join(modules.select(F.col("id").alias("__module")), F.col("__id") == F.col("__module"), "left").join(files.select(F.col("path").alias("__file")), F.col("path") == F.col("__file"), "left")
    kind = F.when(F.col("__module").isNotNull(), "module").when(F.col("__file").isNotNull(), "file").otherwise("none")
    return found.select("path", kind.alias("kind"), F.coalesce("__module", "__file").alias("key"))


def file_contents(files: DataFrame, code_tokens: int = 8000, other_tokens: int = 4000) -> DataFrame:
    """files (path, content) as they are shown: ignored paths say so, code and other files are cut in the middle, each to its own length."""
    cut = F.when(F.lower("path").endswith(".py"), head_tail_cut("content", code_tokens)).otherwise(head_tail_cut("content", other_tokens))
    return files.select("path", F.when(ignored_in_repository(F.col("path")), F.lit("ignored")).otherwise(cut).alias("shown"))


def structure(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """module and outline: its classes (module, name, line) with their methods, and its functions (module, owner: null outside classes, name, line), in order of lines."""
    own = functions.where("owner IS NOT NULL").groupBy("module", F.col("owner").alias("name")).agg(F.array_sort(F.collect_list(F.struct("line", F.concat(F.lit("    def "), "name").alias("t")))).alias("ms"))
    heads = classes.join(own, ["module", "name"], "left").select("module", "line", F.array_join(F.concat(F.array(F.concat(F.lit("class "), "name")), F.coalesce(F.transform("ms", lambda m: m["t"]), F.expr("cast(array() AS array<string>)"))), "\n").alias("t"))
    free = functions.where("owner IS NULL").select("module", "line", F.concat(F.lit("def "), "name").alias("t"))
    return heads.unionByName(free).groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("outline"))
