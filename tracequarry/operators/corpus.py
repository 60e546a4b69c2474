"""Text corpora: search, statistics, packing to budgets, snapshots, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.text import candidate_tokens
from tracequarry.operators.manifest import STOP_TOKENS
from tracequarry.plans.shared import materialise

#: A span without an end goes on to this line.
LAST_LINE = (1 << 30) - 1


def paths_with(files: DataFrame, keyword: str, path: str = "path") -> DataFrame:
    return files.where(F.lower(path).contains(keyword.lower()))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line, from 0; split at line feeds."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def numbered_lines(docs: DataFrame, offset: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines offset .. offset + limit - 1 with their numbers from 1, padded to six places."""
    cut = docs.select(id_col, F.posexplode(F.slice(F.split(text_col, "\n"), offset + 1, limit)).alias("p", "line"))
    return cut.select(id_col, (F.col("p") + offset).alias("line_no"), F.concat(F.lpad((F.col("p") + offset + 1).cast("string"), 6, " "), F.lit("\t"), "line").alias("shown"))


def grep(docs: DataFrame, keyword: str, around: int = 2, most: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with the keyword in any case and those around them; a text stops after more than `most` lines shown.

    Windows run within a text, after texts without the keyword are left out.
    """
    hit = F.lower("line").contains(keyword.lower())
    by = Window.partitionBy(id_col).orderBy("line_no")
    near = F.max(hit.cast("int")).over(by.rowsBetween(-around, around))
    shown = lines(docs.where(F.lower(text_col).contains(keyword.lower())), id_col, text_col).withColumns({"near": near, "hit": hit}).where("near = 1")
    before = F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return shown.withColumn("before", before).where(F.col("before") <= most).select(id_col, "line_no", F.concat(F.when(F.col("hit"), ">>> ").otherwise("    "), "line").alias("shown"))


def keyword_hits(docs: DataFrame, keyword: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with the keyword of each text, without splitting texts that lack it."""
    n = F.size(F.filter(F.split(F.lower(text_col), "\n"), lambda x: x.contains(keyword.lower())))
    return docs.where(F.lower(text_col).contains(keyword.lower())).select(id_col, n.alias("n_lines"))


def token_frequency(docs: DataFrame, limit: int = 24, text_col: str = "text") -> DataFrame:
    """The most frequent identifier-like tokens of three letters and more that are no stop words; ties by the token."""
    each = docs.select(F.explode(candidate_tokens(text_col)).alias("token")).where((F.length("token") >= 3) & ~F.col("token").isin(*STOP_TOKENS))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(limit)


def dedupe_first(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """Of rows with an equal key, the first in order; blank keys go. No window: a frequent key is no hot task, and of long keys only digests move."""
    keyed = rows.withColumns({"__key": F.sha2(F.lower(F.trim(key)), 256), "__order": order}).where(F.trim(key) != "")
    names = rows.columns
    return keyed.groupBy("__key").agg(F.min_by(F.struct(*names), "__order").alias("r")).select("r.*")


def running_before(rows: DataFrame, group: str, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """rows with the sum of value over the rows of the same group that come before, in order.

    Rows are dealt by ranges of (group, order) and stored, so one large group lies in many ranges: a range's sum is
    added up first, and the window inside it sees only its own rows. order must tell rows apart for a fixed result.
    """
    dealt = materialise(rows.withColumn("__value", value).repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "__range").agg(F.sum("__value").alias("__sum"))
    # A row a range and group: a group has at most as many as there are ranges.
    offset = F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), offset.alias("__offset"))
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = dealt.join(offsets, (F.col("__range") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__offset") + inside).drop("__value", "__range", "__of", "__group", "__sum", "__offset")


def budget_prefix(rows: DataFrame, group: str, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """Rows of each group until the running number of tokens is over the budget; the test is before the row."""
    return running_before(rows, group, order, tokens).where(F.col("before") <= budget)


def budget_files(rows: DataFrame, group: str, order: list[str], tokens: Column, first: Column, budget: int) -> DataFrame:
    """Rows flagged `first`, then others up to the first that is over the budget by itself; pos counts them from 1."""
    marked = rows.withColumns({"__late": (~first).cast("int"), "__over": tokens > budget})
    place = F.struct("__late", *order)
    stops = marked.where("__over").groupBy(F.col(group).alias("__group")).agg(F.min(place).alias("__stop"))
    kept = marked.join(stops, F.col(group).eqNullSafe(F.col("__group")), "left").where(F.col("__stop").isNull() | (place < F.col("__stop"))).drop("__over", "__stop", "__group")
    return running_before(kept, group, ["__late", *order], F.lit(1), "pos").withColumn("pos", (F.col("pos") + 1).cast("int")).drop("__late")


def pack(rows: DataFrame, group: str, order: str, size: str, budget: int, after: bool = False) -> DataFrame:
    """Number consecutive rows so that each pack holds at most the budget (after: until it is over the budget).

    Sequential by nature: rows of a group stream in order through one task in batches of bounded size; groups are
    spread over tasks.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (group, order, size)) + ", pack long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, no, total = None, 0, 0
        for pdf in batches:
            packs = []
            for g, s in zip(pdf[group], pdf[size], strict=True):
                if g != now:
                    now, no, total = g, 0, 0
                if after:
                    if total > budget:
                        no, total = no + 1, 0
                    total += s
                else:
                    if total and total + s > budget:
                        no, total = no + 1, 0
                    total += s
                packs.append(no)
            yield pdf.assign(pack=packs)

    return rows.select(group, order, size).repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def new_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after whose path is not in before."""
    return after.join(before.select("path"), "path", "left_anti")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change: added, deleted or changed (size differs)."""
    both = before.select("path", F.col("size").alias("old")).join(after.select("path", F.col("size").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def spans_of(docs: DataFrame, opens: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of lines that begin where a line matches `opens`, up to the line before the next."""
    begun = lines(docs, id_col, text_col).where(F.col("line").rlike(opens))
    following = F.lead("line_no").over(Window.partitionBy(id_col).orderBy("line_no"))
    return begun.select(id_col, F.col("line_no").alias("first_line"), (following - 1).alias("last_line"))


def span_at(spans: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """wanted (id_col, line_no) with the first span that holds the line, however long or open the span.

    A span is cut in aligned intervals of 1, 2, 4 ... lines (at most two of each length), and a line lies in one
    interval of each length: an equi-join that needs no range test and no bound on a span's length.
    """
    levels = F.sequence(F.lit(0), F.lit(30))
    end = F.least(F.coalesce(F.col("last_line"), F.lit(LAST_LINE)), F.lit(LAST_LINE)).cast("long") + 1
    sized = spans.select(id_col, "first_line", F.col("first_line").cast("long").alias("a"), end.alias("z")).where("a < z").withColumn("level", F.explode(levels))
    # From the level's first whole interval up to, not including, the last: an odd one at either side has no parent within the span.
    cut = sized.select(id_col, "first_line", "level", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)").alias("l"), F.expr("shiftright(z, level)").alias("r")).where("l < r")
    side = F.array_compact(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)))
    intervals = cut.select(id_col, "first_line", "level", F.explode(side).alias("interval"))
    asked = wanted.where(F.col("line_no").between(0, LAST_LINE)).select(id_col, "line_no").distinct().withColumn("level", F.explode(levels))
    hits = asked.withColumn("interval", F.expr("shiftright(cast(line_no AS long), level)")).join(intervals, [id_col, "level", "interval"])
    return hits.groupBy(id_col, "line_no").agg(F.min("first_line").alias("first_line"))


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a column: its type, nulls, distinct values, least and greatest value as text; one pass."""
    aggs = []
    for c in names:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.count_distinct(c).alias(f"distinct_{c}"), F.min(c).cast("string").alias(f"min_{c}"), F.max(c).cast("string").alias(f"max_{c}")]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct"), F.col(f"min_{c}").alias("least"), F.col(f"max_{c}").alias("greatest")) for c in names))
    return one.select("n_rows", F.explode(rows).alias("r")).select("n_rows", "r.*")


def top_values(df: DataFrame, column: str, most: int = 4) -> DataFrame:
    """The most frequent values of a column; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """The merged schema of a column of JSON documents."""
    return df.select(F.expr(f"schema_of_variant_agg(parse_json({column}))").alias("schema"))


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of `size` characters, each `overlap` characters into the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - overlap - 1, F.lit(0)), F.lit(step))
    return docs.where(F.length(text_col) > 0).select(id_col, text_col, F.posexplode(starts).alias("chunk_no", "at")).select(id_col, "chunk_no", F.substring(F.col(text_col), F.col("at") + 1, F.lit(size)).alias("chunk"))


def statistics(docs: DataFrame, group: str, wanted: Column, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Size, files and lines of each group, and whether any of its files is a wanted one."""
    return docs.groupBy(group).agg(F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("files"), F.coalesce(F.bool_or(wanted), F.lit(False)).alias("has"), F.sum(F.size(F.split(text_col, "\n"))).alias("lines"))
