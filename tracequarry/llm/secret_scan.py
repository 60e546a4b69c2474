"""Secret scans with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Candidates are found by patterns. The value of each is hashed, and for every hash the distinct repositories and
owners that hold it are counted over the whole corpus. A value that several owners have in several repositories, or
that very many repositories have, is an example that people copy; any other is taken for a live credential of its
owners. Where the table names no repository, a text is one, whose exact copies count once: a secret does not become
an example because its document was copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.plans.shared import materialise

# Kinds in order of the spans' ranks. In each pattern the value is what follows the prefix, to the match's end.
# Fixed values of the contract: assign, access and hex. A match whose value is shorter than the least fails.
KINDS = ("assign", "access", "hex", "vendor", "live")
PREFIX = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": (PREFIX + "[A-Za-z0-9+/_.=-]+", PREFIX, 6),
    "access": ("AKIA[A-Z0-9]{16,}", "", 20),
    "hex": ("[0-9a-f]{24,}", "", 24),
    "vendor": (r"(?:gh[opsu]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{16,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", "", 16),
}
#: A value under more owners than this, in more repositories than this, is a copied example, ...
MOST_OWNERS = 2
#: ... as is one in more repositories than this, whoever owns them.
MOST_REPOSITORIES = 50
NAMES = str(list(KINDS))
SPAN = "struct<kind:int,s:int,e:int,v:int,hash:string>"
#: Matches that are walked at a time: what is added to grows no longer than this, so the walk is linear in them.
WALK = 256
#: Values with more occurrences than this share of all are joined by broadcast; there are at most its inverse of them.
HOT_SHARE = 0.001


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __spans: all candidates, a kind after another, leftmost and non-overlapping in each.

    kind is the place in KINDS; s and e count code points, e exclusive; v is where the value begins. Positions
    come from the lengths of the matches and of the pieces between them.
    """
    found = docs.withColumn("__t", F.coalesce(text.cast("string"), F.lit("")))
    found = found.withColumns({f"__m{k}": F.expr(f"regexp_extract_all(__t, {_literal(PATTERNS[kind][0])}, 0)") for k, kind in enumerate(PATTERNS)})
    found = found.withColumns({f"__g{k}": F.expr(f"CASE WHEN size(__m{k}) > 0 THEN split(__t, {_literal(PATTERNS[kind][0])}, -1) END") for k, kind in enumerate(PATTERNS)})
    spans = []
    for k, kind in enumerate(PATTERNS):
        _, prefix, least = PATTERNS[kind]
        value = f"regexp_replace(x.x, concat('^', {_literal(prefix)}), '')" if prefix else "x.x"
        # Places are sums of lengths; blocks of matches are walked one after another, each into a list of its own.
        walked = f"""
            flatten(aggregate(sequence(0, (size(__m{k}) - 1) div {WALK}), named_struct('at', 0, 'out', cast(array() AS array<array<struct<s:int,x:string>>>)),
                (acc, b) -> aggregate(sequence(b * {WALK} + 1, least(size(__m{k}), (b + 1) * {WALK})), named_struct('at', acc.at, 'own', cast(array() AS array<struct<s:int,x:string>>)),
                    (one, i) -> named_struct('at', one.at + length(__g{k}[i - 1]) + length(__m{k}[i - 1]),
                                             'own', concat(one.own, array(named_struct('s', one.at + length(__g{k}[i - 1]), 'x', __m{k}[i - 1])))),
                    one -> named_struct('at', one.at, 'out', concat(acc.out, array(one.own)))),
                acc -> acc.out))"""
        full = f"transform({walked}, x -> named_struct('s', x.s, 'x', x.x, 'value', {value}))"
        spans.append(f"""CASE WHEN size(__m{k}) > 0 THEN transform(filter({full}, p -> length(p.value) >= {least}),
            p -> named_struct('kind', {k}, 's', p.s, 'e', p.s + length(p.x), 'v', p.s + length(p.x) - length(p.value), 'hash', sha2(p.value, 256))) ELSE cast(array() AS array<{SPAN}>) END""")
    drop = ["__t", *(f"__{x}{k}" for k in range(len(PATTERNS)) for x in "mg")]
    return found.withColumn("__spans", F.expr(f"concat({', '.join(spans)})")).drop(*drop)


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """hash, n_repositories, n_owners and n (rows that hold it) over all rows of candidates(). A null repository or owner counts as one.

    Counted in steps, each with a partial sum before its shuffle: a value that fills the corpus is no hot key.
    """
    each = found.select(F.explode(F.array_distinct(F.transform("__spans", lambda p: p["hash"]))).alias("hash"), repository.alias("repository"), owner.alias("owner"))
    held = each.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    # Each count in its own order of steps, so neither keys a task on a value alone before it is small.
    by_repository = held.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    by_owner = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return by_repository.join(by_owner, "hash").select("hash", "n_repositories", "n_owners", "n")


def is_live(most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> Column:
    spread = (F.col("n_owners") > most_owners) & (F.col("n_repositories") > most_owners)
    return ~(spread | (F.col("n_repositories") > most_repositories))


FOUND = "array<struct<kind:int,s:int,e:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str | None = None, owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of every whole text with the corpus-wide verdict.

    Returns keep, id_col, __spans (candidates; kind 0 to 3), __live (the spans of the values judged live, as kind 4
    from the value's start), __repositories and __owners (the greatest counts among the row's values, 0 without one),
    one row for each input row. A null text counts as empty; a very long one is walked in time in proportion to its
    matches, in one task. repository names a column; without it a text and its exact copies are one. Of the text
    itself only what keep names is stored on the way, beside the values' digests.
    """
    names = list(dict.fromkeys((*keep, id_col)))
    text = F.col(text_col).cast("string")
    place = F.col(repository) if repository else F.md5(text)
    picked = docs.select(*(F.col(c) for c in names), text.alias("__text"), place.alias("__repository"), F.col(owner).alias("__owner"))
    # Written once: the texts are matched in one pass, and the row numbers stay as they are.
    found = materialise(candidates(picked, F.col("__text")).drop("__text").withColumn("__row", F.monotonically_increasing_id()), "secret_candidates")
    holding = found.where(F.size("__spans") > 0)
    counts = materialise(ownership(holding, F.col("__repository"), F.col("__owner")).withColumn("live", is_live(most_owners, most_repositories)), "secret_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(1000, int(total * HOT_SHARE))
    each = holding.select("__row", F.explode("__spans").alias("p")).select("__row", "p.v", "p.e", "p.hash")
    columns = ("hash", "n_repositories", "n_owners", "live")
    # At most 1 / HOT_SHARE values have more rows than the bound: a small side, and no task gets all rows of one of the others.
    hot = F.broadcast(counts.where(F.col("n") > bound).select(*columns))
    judged = each.join(hot, "hash").unionByName(each.join(hot.select("hash"), "hash", "left_anti").join(counts.where(F.col("n") <= bound).select(*columns), "hash"))
    marked = judged.groupBy("__row").agg(
        F.sort_array(F.collect_set(F.when(F.col("live"), F.expr("named_struct('kind', 4, 's', v, 'e', e)")))).alias("__live"), F.max("n_repositories").alias("__repositories"), F.max("n_owners").alias("__owners")
    )
    # Only rows that have a candidate take part in the join.
    some = holding.join(marked, "__row", "left")
    none = found.where(F.size("__spans") == 0).withColumns({"__live": F.lit(None).cast(FOUND), "__repositories": F.lit(None).cast("long"), "__owners": F.lit(None).cast("long")})
    zero = F.lit(0).cast("long")
    cols = [*names, "__spans", F.coalesce("__live", F.expr(f"cast(array() AS {FOUND})")).alias("__live"), F.coalesce("__repositories", zero).alias("__repositories"), F.coalesce("__owners", zero).alias("__owners")]
    return some.select(*cols).unionByName(none.select(*cols))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda p: F.struct(p["s"].alias("s"), p["kind"].alias("kind"), p["e"].alias("e"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans of each row of scan()."""
    base = F.filter("__spans", lambda p: p["kind"] < 3)
    plain = F.transform("__spans", lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
    count = lambda k: F.size(F.filter("__spans", lambda p: p["kind"] == k)).cast("long")
    return scanned.select(
        F.col(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(plain, "__live")).alias("spans"), F.size("__live").cast("long").alias("n_live"),
        F.col("__repositories").alias("most_repositories"), F.col("__owners").alias("most_owners"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str | None = None, owner: str = "source", mask: str = "[SECRET]", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """docs with every live value replaced by the mask; other rows and columns stay as they are."""
    names = docs.columns
    found = scan(docs, id_col, text_col, repository, owner, most_owners, most_repositories, tuple(names))
    walked = F.aggregate(
        "__live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, p: F.when(p["e"] <= acc["at"], acc).otherwise(
            F.struct(p["e"].alias("at"), F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.greatest(p["s"] - acc["at"], F.lit(0))), F.lit(mask)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return found.withColumn(text_col, F.when(F.size("__live") > 0, walked).otherwise(F.col(text_col))).select(*names)


def oracle(most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> str:
    """DuckDB SQL for report(scan(documents))."""
    parts = []
    for k, kind in enumerate(PATTERNS):
        pattern, prefix, least = (x.replace("'", "''") if isinstance(x, str) else x for x in PATTERNS[kind])
        value = f"regexp_replace(m, '^(?:' || '{prefix}' || ')', '')" if prefix else "m"
        parts.append(f"""
        SELECT rn, doc_id, source, copy, {k} AS kind, s, s + length(m) AS e, {value} AS value FROM (
            SELECT rn, doc_id, source, copy, ms[i] AS m, coalesce(list_sum([length(x) for x in gs[1:i]]), 0) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS s
            FROM (SELECT rn, doc_id, source, copy, ms, string_split_regex(t, '{pattern}') AS gs, unnest(generate_series(1, len(ms))) AS i
                  FROM (SELECT rn, doc_id, source, copy, t, regexp_extract_all(t, '{pattern}') AS ms FROM d) WHERE len(ms) > 0))
        WHERE length({value}) >= {least}""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t, coalesce(text, '') AS copy FROM documents),
    c AS ({' UNION ALL '.join(parts)}),
    v AS (SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners, count(DISTINCT copy) AS repositories FROM c GROUP BY value),
    l AS (SELECT value FROM v WHERE NOT (owners > {most_owners} AND repositories > {most_owners} OR repositories > {most_repositories})),
    a AS (SELECT rn, kind, s, e FROM c UNION ALL SELECT DISTINCT rn, 4, e - length(value), e FROM c WHERE value IN (SELECT value FROM l)),
    f AS (SELECT rn, max(repositories) AS most_repositories, max(owners) AS most_owners FROM c JOIN v USING (value) GROUP BY rn),
    r AS (SELECT rn, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 4) AS n_live,
                 string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base,
                 string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans
          FROM a GROUP BY rn)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(most_repositories, 0) AS most_repositories, coalesce(most_owners, 0) AS most_owners
    FROM d LEFT JOIN r USING (rn) LEFT JOIN f USING (rn)"""
