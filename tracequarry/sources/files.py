"""Readers: repositories, logs, notebooks, manifests, traces, tables, snapshots. Files are read by Spark, so any store does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.paths import ignored_in_repository, ignored_in_snapshot
from tracequarry.plans.shared import attach

TRACE_SCHEMA = "trace_id string, repository string, commit_id string, code_location struct<filepath: string, lineno: int, function: string>, error_context map<string, string>"
#: {query} is the name that the files give to the canonical query.
MANIFEST_SCHEMA = "problem_domain struct<error_type: string, symptom: string, failing_node: string>, codebase_context struct<primary_slice: string, filepath: string, dependencies: array<string>, architecture_pattern: string>, search_intent struct<queries: array<string>, {query}: string, technical_constraints: struct<runtime: string, language: string, required_libraries: array<string>>>"
TODO_SCHEMA = "id string, content string, status string, priority string"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or an absolute path, and the path in it."""
    address = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", root.rstrip("/") or "/"))
    return fs.FileSystem.from_uri(address)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size, mtime and full_path of every file below root, by one listing of names on the driver.

    Spark's own scans pass over empty files and names with a leading "_", such as a package's __init__.py.
    """
    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    rows = [(f.path[len(base.rstrip("/")) + 1 :], f.size, f.mtime, f.path) for f in found if f.type == fs.FileType.File]
    return attach(spark).createDataFrame(rows, "path string, size long, mtime timestamp, full_path string")


def contents(files: DataFrame, root: str, most_bytes: int = 32 << 20) -> DataFrame:
    """path and content (bytes) of listed files, read by the executors; a task holds at most most_bytes and one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(root)
        for pdf in batches:
            paths, read, held = [], [], 0
            for path, full in zip(pdf["path"], pdf["full_path"], strict=True):
                with store.open_input_stream(full) as f:
                    paths.append(path)
                    read.append(f.read())
                held += len(read[-1])
                if held > most_bytes:
                    yield pd.DataFrame({"path": paths, "content": read})
                    paths, read, held = [], [], 0
            yield pd.DataFrame({"path": paths, "content": read})

    return files.select("path", "full_path").repartition("path").mapInPandas(run, "path string, content binary")


def snapshot(spark: SparkSession, root: str, keep_ignored: bool = False) -> DataFrame:
    """path (relative), size and mtime of every file below root; contents are not read."""
    listed = listing(spark, root).drop("full_path")
    return listed if keep_ignored else listed.where(~ignored_in_snapshot(F.col("path")))


def repository(spark: SparkSession, root: str, max_depth: int = 3, per_dir: int = 40, max_bytes: int = 10 << 20, crowded: int = 100, full: int = 50, of_full: int = 5) -> DataFrame:
    """path and content of the text files of a repository, pruned: depth, ignored paths, size, files a folder.

    A folder of over `crowded` files is left out, one of over `full` keeps the first few by name. Only files that stay are read.
    """
    listed = listing(spark, root).where((F.size(F.split("path", "/")) <= max_depth + 1) & ~ignored_in_repository(F.col("path")))
    by = Window.partitionBy("dir")
    ranked = listed.withColumn("dir", F.regexp_replace("path", "[^/]*$", "")).withColumns({"n": F.count(F.lit(1)).over(by), "r": F.row_number().over(by.orderBy("path"))})
    most = F.when(F.col("n") > crowded, 0).when(F.col("n") > full, of_full).otherwise(per_dir)
    kept = ranked.where((F.col("r") <= most) & (F.col("size") <= max_bytes))
    return contents(kept, root).select("path", decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def logs(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", decoded(F.col("content")).alias("text"))


def notebook_code(content: Column) -> Column:
    """The code cells of a notebook's JSON, with a blank line between; a cell's source may be a text or a list of texts."""
    cells = F.from_json(content, "struct<cells: array<struct<cell_type: string, source: string>>>")["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    text = lambda s: F.when(s.startswith("["), F.array_join(F.from_json(s, "array<string>"), "")).otherwise(s)
    return F.array_join(F.transform(code, lambda c: text(c["source"])), "\n\n")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header and, without a schema, inferred types."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each; a malformed file fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark, path, TRACE_SCHEMA)


def manifests(spark: SparkSession, path: str, query_field: str = "canonical_query") -> DataFrame:
    return json_objects(spark, path, MANIFEST_SCHEMA.replace("{query}", query_field))


def todos(spark: SparkSession, path: str) -> DataFrame:
    """A list of todos; what is malformed is left out."""
    return spark.read.schema(TODO_SCHEMA).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def conversations(spark: SparkSession, path: str, user: str | None = None, mode: str | None = None) -> DataFrame:
    """A stored log; user and mode prune its partitions."""
    found = spark.read.parquet(path)
    found = found if user is None else found.where(F.col("user_id") == user)
    return found if mode is None else found.where(F.col("mode") == mode)


def decoded_content(payload: DataFrame) -> DataFrame:
    """A contents API's payload (type, encoding, content) with text and error."""
    flat = F.regexp_replace("content", r"\s", "")
    error = F.when(F.col("type") != "file", "not a file").when(F.col("encoding") != "base64", "unknown encoding").when(flat == "", "empty")
    return payload.withColumns({"error": error, "text": F.when(error.isNull(), F.decode(F.unbase64(flat), "UTF-8"))})


def normalised_traces(packets: DataFrame) -> DataFrame:
    """Flat trace packets: location columns, owner/name of the repository, and a list of what is wrong."""
    repo = F.regexp_extract("repository", r"^https?://github\.com/+([^/]+/+[^/]+)", 1)
    flat = packets.select(F.trim("trace_id").alias("trace_id"), F.regexp_replace(F.when(repo != "", repo).otherwise(F.col("repository")), r"(/+)|\.git$", "/").alias("repository"), F.trim("commit_id").alias("commit_id"), "code_location.filepath", "code_location.lineno", "code_location.function", "error_context")
    repo = F.regexp_replace("repository", "/$", "")
    blank = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"blank {c}")
    wrong = F.array_compact(F.array(
        blank("trace_id"), blank("commit_id"), blank("filepath"), blank("function"), F.when(~F.coalesce(F.col("lineno") > 0, F.lit(False)), "lineno"),
        F.when(F.size(F.split("repository", "/")) != 2, "repository"), F.when(~F.coalesce((F.size("error_context") > 0) & F.forall(F.map_keys("error_context"), lambda k: F.trim(k) != ""), F.lit(False)), "error_context"),
    ))
    return flat.withColumn("repository", repo).withColumn("violations", wrong)


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, white space is collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a link of a page, in order: href and its text."""
    pattern = F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all(html_col, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html_col, pattern, F.lit(2)).alias("text"))
    return pages.select(id_col, F.posexplode(pairs).alias("pos", "l")).select(id_col, "pos", F.col("l.href").alias("href"), F.regexp_replace("l.text", "<[^>]*>", "").alias("text"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stored vector table."""
    return spark.read.parquet(path)


def code_tree(spark: SparkSession, path: str, names: tuple[str, ...], as_json: bool = False) -> dict[str, DataFrame]:
    return {name: (spark.read.json if as_json else spark.read.parquet)(f"{path}/{name}") for name in names}


def crawled(pages: DataFrame, id_col: str = "page_id", most: int = 20_000) -> DataFrame:
    """Results of a crawl (id_col, url, html, error): success, lengths, links and the text cut to `most` characters."""
    text, ok = html_text(F.col("html")), F.col("error").isNull()
    hrefs = F.size(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"'), F.lit(1)))
    return pages.select(id_col, "url", ok.alias("success"), "error", F.when(ok, F.length("html")).alias("html_chars"), F.when(ok, hrefs).alias("n_links"), F.when(ok, F.substring(text, 1, most)).alias("content"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """path of the files of a folder itself (none below it) that a run may leave for a reader."""
    return listing(spark, folder).where(~F.col("path").contains("/") & F.col("path").rlike(r"\.(png|jpg|jpeg|csv|xlsx|json|txt|pdf|html)$")).select("path")
