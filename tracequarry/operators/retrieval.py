"""Retrieval over chunks: vectors, BM25, rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.plans.shared import materialise

K1, B, FUSION = 1.5, 0.75, 60


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_top(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of highest cosine with one query vector, ties by id: a partial top-k in every task, then one of those."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def vector_top_of(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1000) -> DataFrame:
    """The k nearest others of each of a stated set of queries, ties by id; any number of queries.

    Queries are counted and dealt by hash to blocks of about `block` (so what is broadcast at once is bounded), and
    the vectors are read once a block. A vector is its own query's other if its id differs.
    """
    asked = materialise(queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("qv")), "queries")
    blocks = max(1, -(-asked.count() // block))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), id_col))
    out = None
    for no in range(blocks):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == no))
        scored = vectors.join(some, F.col(id_col) != F.col("query")).select("query", id_col, F.round(cosine(F.col(vector_col), F.col("qv")), 6).alias("score"))
        best_of = scored.withColumn("rank", rank).where(F.col("rank") <= k)
        out = best_of if out is None else out.unionByName(best_of)
    return out


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term and tf of lower-case words."""
    each = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
    return each.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Scores of documents with a query term, in any case.

    Words are runs of letters and digits. Words and query terms are counted in the text, without lists of words, and
    only these counts are stored; nothing is shuffled but one row of totals a task.
    """
    query = [q.lower() for q in query]
    text, letter = F.lower(text_col), r"[\p{L}\p{N}]"
    times = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    found = [times(rf"(?<!{letter})\Q{q}\E(?!{letter})").alias(f"t{i}") for i, q in enumerate(query)]
    counted = materialise(docs.select(id_col, times(letter + "+").alias("n"), *found), "bm25_counts")
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(query)))).first()
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = math.log((totals["docs"] - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5) + 1)
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (totals["mean"] or 1.0)))
    return counted.select(id_col, F.round(score, 6).alias("score")).where("score > 0")


def fuse(left: DataFrame, right: DataFrame, weight: float, k: int, id_col: str, constant: int = FUSION) -> DataFrame:
    """Weighted reciprocal-rank fusion of two scored lists that were cut before (a few hundred rows), best k."""
    ranked = lambda d, w: d.select(id_col, (F.lit(w) / (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) + constant)).alias("part"))
    both = ranked(left, weight).unionByName(ranked(right, 1 - weight))
    return both.groupBy(id_col).agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def best(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def as_documents(rows: DataFrame, id_col: str, title: str = "title", summary: str = "summary") -> DataFrame:
    """id, content ("title: summary") and the other columns as a map of texts."""
    rest = [c for c in rows.columns if c not in (id_col, title, summary)]
    meta = F.map_filter(F.create_map(*(x for c in (title, summary, *rest) for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    return rows.select(id_col, F.concat_ws(": ", title, summary).alias("content"), meta.alias("metadata"))


def retrieve(docs: DataFrame, query: list[str], vector: list[float], k: int, weight: float, candidates: int = 100, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
    """The k best of docs by vectors alone (weight 1 and more) or by the fusion of vectors and BM25, each cut to `candidates` before."""
    near = vector_top(docs, vector, candidates if weight < 1 else k, id_col, vector_col)
    if weight >= 1:
        return near
    return fuse(near, best(bm25(docs, query, id_col, text_col), candidates, id_col), weight, k, id_col)


def functions_matching(functions: DataFrame, query: list[str], k: int, most: int = 5000) -> DataFrame:
    """The k functions (id, source) whose source, up to `most` characters, fits the words of a query best."""
    return best(bm25(functions.select("id", F.substring("source", 1, most).alias("source")), query, "id", "source"), k, "id")


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does; a piece begins with up to `overlap` characters of the one before, in whole parts."""
    by = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(by) + 1 :]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        whole = by.join(held).strip()
        if whole:
            out.append(whole)

    for part in text.split(by) if by else text:
        if len(part) > size and by:
            flush()
            held.clear()
            out.extend(split_text(part, size, overlap, finer))
            continue
        if held and len(by.join([*held, part])) > size:
            flush()
            while held and (len(by.join(held)) > overlap or len(by.join([*held, part])) > size):
                held.pop(0)
        if part or not by:
            held.append(part)
    flush()
    return out


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, chunk_no and chunk of every text, split at paragraphs, lines and words."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).to_pylist()):
                found = split_text(t or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found), batch.column(0).type), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=[id_col, "chunk_no", "chunk"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, chunk_no int, chunk string")
