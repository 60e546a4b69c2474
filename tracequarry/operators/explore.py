"""Reading a repository: outlines by lines, key classes, thresholded package trees, file listings, displays."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.paths import REPO_DIRS, ignored_in_repository
from tracequarry.functions.text import token_estimate
from tracequarry.operators.corpus import budget_prefix

# What makes a line of code worth showing, from the closest look to the widest.
CLOSE = (r"^\s*(def|class|import|from|async def)", r"^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=")
HEADS = r"^\s*(def|class)\s+"
IMPORTS = r"^\s*(import|from)\s+"
CONSTANTS = r"^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[A-Z]|__init__"


def _shown(text: Column, keep) -> Column:
    """The lines for which keep(line, number) holds, each gap between them as one line of dots."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(keep(x, i), x))
    # Beside each line the one before it, so a gap is told from its first line without looking through the text again.
    before = F.slice(F.concat(F.array(F.lit("")), lines), F.lit(1), F.size(lines))
    marked = F.zip_with(lines, before, lambda x, up: F.when(x.isNotNull(), x).when(up.isNotNull(), "⋮"))
    return F.array_join(F.array_compact(marked), "\n")


def close_outline(text: Column) -> Column:
    """Definitions, imports and assignments inside of blocks."""
    return _shown(text, lambda x, i: x.rlike(CLOSE[0]) | x.rlike(CLOSE[1]))


def wide_outline(text: Column) -> Column:
    """Definitions, constants, and imports of the first 50 lines."""
    return _shown(text, lambda x, i: x.rlike(HEADS) | (x.rlike(IMPORTS) & (i < 50)) | x.rlike(CONSTANTS))


def heads_outline(text: Column) -> Column:
    """Definitions alone."""
    return _shown(text, lambda x, i: x.rlike(HEADS))


def escalated_outline(text: Column, budget: int = 3000) -> Column:
    """The first of the three outlines that is within the budget of estimated tokens, else the last; null stays null."""
    close, wide = close_outline(text), wide_outline(text)
    return F.when(token_estimate(close) <= budget, close).when(token_estimate(wide) <= budget, wide).otherwise(heads_outline(text))


def interest_lines(source: str) -> str:
    """Definitions with their docstrings, and imports of the first 50 lines; gaps as dots."""
    lines = (source or "").split("\n")
    keep: set[int] = set()
    for i, line in enumerate(lines):
        words = line.split(None, 1)
        head = words[0] if len(words) > 1 else ""
        if head in ("import", "from") and i < 50:
            keep.add(i)
        if head not in ("def", "class"):
            continue
        keep.add(i)
        quote = next((q for q in ('"""', "'''") if i + 1 < len(lines) and q in lines[i + 1]), None)
        if quote and not any(line.count(q) > 1 for q in ('"""', "'''")):
            end = i + 1
            if lines[end].count(quote) < 2:
                end = next((j for j in range(i + 2, len(lines)) if quote in lines[j]), len(lines) - 1)
            keep.update(range(i + 1, end + 1))
    out: list[str] = []
    for i, line in enumerate(lines):
        if i in keep:
            out.append(line)
        elif not out or out[-1] != "⋮":
            out.append("⋮")
    return "\n".join(out)


def import_text(source: str) -> str:
    """The import statements at the top level as they are written, below a heading; empty without any or where the text does not parse."""
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError):
        return ""
    found = [ast.get_source_segment(source, x) or "" for x in body if isinstance(x, (ast.Import, ast.ImportFrom))]
    return "# Import dependencies\n" + "\n".join(found) + "\n\n" if found else ""


def by_lines(files: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """id, interest and imports of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "interest": [interest_lines(t) for t in pdf["t"]], "imports": [import_text(t) for t in pdf["t"]]})

    return files.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {dict(files.dtypes)[id_col]}, interest string, imports string")


def key_classes(classes: DataFrame, functions: DataFrame, edges: DataFrame, most_modules: int | None = 300) -> DataFrame:
    """Classes with the number of their methods, of calls that reach those, and of lines; no row beyond most_modules modules.

    classes and functions as codegraph.records() gives them, edges (src, dst) between functions. Scores are all 0, so
    the order is that of definition: module_id, pos.
    """
    if most_modules is not None and classes.select("module_id").distinct().limit(most_modules + 1).count() > most_modules:
        return key_classes(classes.limit(0), functions, edges, None)
    reached = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    own = functions.where("class_id IS NOT NULL").select("id", "class_id").join(reached, "id", "left")
    counts = own.groupBy(F.col("class_id").alias("id")).agg(F.count(F.lit(1)).alias("methods_count"), F.sum(F.coalesce("n", F.lit(0))).alias("called_by_count"))
    none = F.lit(0).cast("long")
    return classes.join(counts, "id", "left").select("id", "name", "module_id", "pos", F.lit(0.0).alias("importance_score"), F.coalesce("methods_count", none).alias("methods_count"), F.coalesce("called_by_count", none).alias("called_by_count"), (F.col("last_line") - F.col("first_line") + 1).alias("lines"), F.substring("docstring", 1, 200).alias("docstring"))


def class_budget(classes: DataFrame, group: str, budget: int = 3000) -> DataFrame:
    """group, path and block: the outlines (group, path, pos, imports, outline) of key classes by file, while what stands before one is within the budget.

    A class is left out when the text so far is over the budget, and then so are all after it. Files come in the order of their first class.
    """
    kept = budget_prefix(classes, group, ["pos"], token_estimate("outline"), budget)
    files = kept.groupBy(group, "path").agg(F.min("pos").alias("pos"), F.min_by("imports", "pos").alias("imports"), F.array_sort(F.collect_list(F.struct("pos", "outline"))).alias("o"))
    block = F.concat(F.lit("```python\n## "), "path", F.lit("\n\n"), F.coalesce("imports", F.lit("")), F.array_join(F.transform("o", lambda x: x["outline"]), "\n"), F.lit("\n```\n"))
    return files.select(group, "path", "pos", block.alias("block"))


def thresholds(least: float = 1.0, levels: int = 64, cap: float = 5.0) -> list[float]:
    """The score that a node needs at each depth: a tenth more for every level passed, up to the cap."""
    out = [least]
    for level in range(levels - 1):
        out.append(min(out[-1] * (1.0 + 0.1 * level), cap))
    return out


def package_tree(nodes: DataFrame, least: float = 1.0) -> DataFrame:
    """Nodes (id: dotted, kind: package or module, score, doc) that are important enough, as are all above them: id, depth from 0, shown.

    Deeper than 64 levels the last threshold holds.
    """
    need = thresholds(least)
    parts = F.split("id", r"\.")
    depth = (F.size(parts) - 1).alias("depth")
    fit = nodes.select("*", depth).where(F.col("score") >= F.get(F.array(*map(F.lit, need)), F.least(F.col("depth"), F.lit(len(need) - 1))))
    ups = fit.select("id", "depth", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("up"))
    whole = ups.join(fit.select(F.col("id").alias("up")), "up", "left_semi").groupBy("id", "depth").agg(F.count(F.lit(1)).alias("n")).where("n = depth + 1").select("id")
    first_line = F.substring(F.split(F.coalesce("doc", F.lit("")), "\n")[0], 1, 50)
    name = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.element_at(parts, -1))
    shown = F.when(F.col("kind") == "package", F.concat(name, F.lit("/"))).otherwise(F.concat(name, F.lit(".py"), F.when(first_line != "", F.concat(F.lit(" - "), first_line, F.lit("..."))).otherwise("")))
    return fit.join(whole, "id", "left_semi").select("id", "depth", "score", shown.alias("shown"))


def overview(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: number of modules, classes, functions and lines of records that codegraph.parse() gave, and the header that states them."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = modules.agg(F.count(F.lit(1)).alias("n_modules"), F.coalesce(F.sum(F.col("last_line")), F.lit(0)).alias("n_lines"))
    one = sizes.select("*", F.lit(1).alias("k")).join(count(classes, "n_classes").withColumn("k", F.lit(1)), "k").join(count(functions, "n_functions").withColumn("k", F.lit(1)), "k").drop("k")
    header = F.concat(F.lit("# Code Repository Overview\n\nTotal modules: "), "n_modules", F.lit("\n\nTotal classes: "), "n_classes", F.lit("\n\nTotal functions: "), "n_functions", F.lit("\n\nTotal lines of code: "), "n_lines", F.lit("\n"))
    return one.select("n_modules", "n_classes", "n_functions", "n_lines", header.alias("header"))


def file_list(paths: DataFrame, max_depth: int = 4, per_dir: int = 30) -> DataFrame:
    """A listing of paths (path) as rows dir, kind (dir, cut, file, more), pos, shown: files a folder by name up to per_dir, folders to max_depth."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # Ignored folders go with all they hold; of the others the ignored files.
    seen = paths.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, REPO_DIRS)))).select(dirs.alias("d"), name.alias("name"))
    ups = seen.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("d")), lambda k: F.slice("d", F.lit(1), k))).alias("d")).distinct()
    depth = F.size("d")
    pad = lambda k: F.repeat(F.lit("    "), k)
    key = F.array_join("d", "/").alias("dir")
    heads = ups.where((depth > 0) & (depth <= max_depth)).select(key, F.when(depth < max_depth, "dir").otherwise("cut").alias("kind"), F.lit(0).cast("long").alias("pos"), F.when(depth < max_depth, F.concat(pad(depth), F.element_at("d", -1), F.lit("/"))).otherwise(F.concat(pad(depth), F.lit("... Maximum depth limit reached"))).alias("shown"))
    files = seen.where((depth < max_depth) & ~ignored_in_repository(F.col("name"))).select(key, "name", depth.alias("k")).distinct()
    # Only the first names of a folder are kept on the way: of each part of a hashed folder first, then of the whole.
    part = F.pmod(F.xxhash64("name"), F.lit(64)).alias("part")
    ranked = files.select("dir", "name", "k", part).withColumn("r", F.row_number().over(Window.partitionBy("dir", "part").orderBy("name"))).where(F.col("r") <= per_dir)
    listed = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("dir").orderBy("name"))).where(F.col("pos") <= per_dir).select("dir", F.lit("file").alias("kind"), F.col("pos").cast("long").alias("pos"), F.concat(pad(F.col("k") + 1), "name").alias("shown"))
    more = files.groupBy("dir", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_dir)
    rest = more.select("dir", F.lit("more").alias("kind"), F.lit(per_dir + 1).cast("long").alias("pos"), F.concat(pad(F.col("k") + 1), F.lit("... "), F.col("n") - per_dir, F.lit(" more files not displayed")).alias("shown"))
    return heads.unionByName(listed).unionByName(rest)


def path_nodes(paths: DataFrame) -> DataFrame:
    """The tree of paths (path) as a table: node, parent (null at the top), name, kind (directory, file), n_files below or at it."""
    parts = F.split("path", "/")
    each = paths.select(parts.alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    up = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    node = each.select(up(F.col("k")).alias("node"), F.when(F.col("k") > 1, up(F.col("k") - 1)).alias("parent"), F.element_at("p", F.col("k").cast("int")).alias("name"), (F.col("k") < F.size("p")).alias("inner"))
    return node.groupBy("node", "parent", "name").agg(F.when(F.max("inner"), "directory").otherwise("file").alias("kind"), F.count(F.lit(1)).alias("n_files"))


def preview_columns(df: DataFrame, most: int = 15) -> tuple[DataFrame, str]:
    """The first columns of a table for display, and what to say of the others."""
    rest = len(df.columns) - most
    return df.select(*(F.col(f"`{c}`") for c in df.columns[:most])), f"... and {rest} more columns" if rest > 0 else ""


def display_row(content: Column, role: Column, sender: Column, receiver: Column, stamp: Column, new_files: Column) -> Column:
    """A message as it is shown and replayed; no new files are an empty list."""
    empty = F.lit("")
    files = F.when(F.coalesce(F.size(new_files), F.lit(0)) > 0, F.to_json(new_files)).otherwise("[]")
    return F.struct(F.struct(content.alias("content"), role.alias("role")).alias("message"), F.struct(sender.alias("name"), empty.alias("description"), empty.alias("system_message")).alias("sender_info"), receiver.alias("receiver_name"), F.lit("{}").alias("llm_config"), role.alias("sender_role"), stamp.alias("timestamp"), files.alias("new_files"))


def display_log(log: DataFrame, rows: DataFrame, pending: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """log with new rows (session, and what display_row() needs: content, role, sender, receiver, stamp) appended, each with its session's pending files (session, file); the second frame is pending without them."""
    files = pending.groupBy(session).agg(F.sort_array(F.collect_list("file")).alias("__files"))
    shown = display_row(F.col("content"), F.col("role"), F.col("sender"), F.col("receiver"), F.col("stamp"), F.col("__files"))
    added = rows.join(files, session, "left").where(F.col("role").isNotNull()).select(session, shown.alias("shown"))
    return log.unionByName(added), pending.join(rows.select(session), session, "left_anti")


def browse_result(query: Column, url: Column, content: Column, most: int = 20_000) -> Column:
    """A page as JSON of query, address and its first characters; a page that could not be read says so."""
    found = F.coalesce(F.substring(content, 1, most), F.lit("Error browsing URL"))
    return F.to_json(F.struct(query.alias("Input Query"), url.alias("Search URL"), found.alias("Search Result")))
