"""Source code as tables: parsing, call and import edges, references, hierarchy, importance."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import module_id

RECORDS = "record string, module_id string, id string, pos int, name string, class_id string, kind string, object string, attribute string, full_path string, module string, alias string, docstring string, bases array<string>, parameters array<string>, return_type string, first_line int, last_line int"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
# Names that speak for importance.
KEYWORDS = ("main", "core", "engine", "api", "service", "controller", "manager", "handler", "processor", "factory", "builder", "provider", "repository", "executor", "scheduler", "config", "security")
COMMON_NAMES = ("__init__", "app", "settings", "config", "utils", "constants")
PACKAGE_NAMES = ("src", "core", "main", "api")


def _dotted(node: ast.AST) -> str:
    """a.b.c of an attribute chain or a name; what stands before a call or subscript is left out."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names))


def _annotation(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        return f"{_dotted(node.value) or 'unknown'}[{', '.join(_annotation(x) or 'unknown' for x in inner)}]"
    return _dotted(node) or None if isinstance(node, (ast.Name, ast.Attribute)) else None


def parse_module(module: str, content: str) -> Iterator[dict]:
    """Records of one Python module: module, class, function, call, import. Nothing but an error record on bad syntax.

    Functions outside of classes carry the module's id at any depth; functions defined directly in a class carry the
    class's. Imports are those of the module's top level, with pos; calls are all within the function.
    """
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        yield {"record": "error", "id": module, "docstring": str(e)}
        return
    yield {"record": "module", "id": module, "docstring": ast.get_docstring(tree) or "", "first_line": 1, "last_line": content.count("\n") + 1}
    pos = 0
    for node in tree.body:
        for name in node.names if isinstance(node, (ast.Import, ast.ImportFrom)) else ():
            own = isinstance(node, ast.Import)
            yield {"record": "import", "id": module, "pos": pos, "kind": "import" if own else "importfrom", "name": name.name, "alias": name.asname, "module": None if own else node.module or ""}
            pos += 1
    owner = {id(f): f"{module}.{c.name}" for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef)}
    order = 0
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            yield {"record": "class", "id": f"{module}.{node.name}", "pos": order, "name": node.name, "docstring": ast.get_docstring(node) or "", "bases": [b for b in map(_dotted, node.bases) if b], "first_line": node.lineno, "last_line": node.end_lineno}
            order += 1
        elif isinstance(node, ast.FunctionDef):
            cls = owner.get(id(node))
            me = f"{cls or module}.{node.name}"
            yield {"record": "function", "id": me, "pos": order, "name": node.name, "class_id": cls, "docstring": ast.get_docstring(node) or "", "parameters": [a.arg for a in node.args.args], "return_type": _annotation(node.returns), "first_line": node.lineno, "last_line": node.end_lineno}
            order += 1
            for k, call in enumerate(c for c in ast.walk(node) if isinstance(c, ast.Call)):
                f = call.func
                base = {"record": "call", "id": me, "pos": k, "class_id": cls}
                if isinstance(f, ast.Name):
                    yield base | {"kind": "simple", "name": f.id}
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    yield base | {"kind": "attribute", "object": f.value.id, "attribute": f.attr}
                elif isinstance(f, ast.Attribute):
                    yield base | {"kind": "nested_attribute", "full_path": _dotted(f)}


def parse(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Files (path, content) to RECORDS; a file is parsed by itself, so the work is spread over the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r | {"module_id": m} for m, c in zip(pdf["m"], pdf["c"], strict=True) for r in parse_module(m, c or "")]
            yield pd.DataFrame([[r.get(n) for n in _NAMES] for r in rows], columns=_NAMES)

    return files.where(F.col(path_col).endswith(".py")).select(module_id(path_col).alias("m"), F.col(text_col).alias("c")).mapInPandas(run, RECORDS)


def records(parsed: DataFrame, record: str) -> DataFrame:
    found = parsed.where(F.col("record") == record)
    if record in ("class", "function"):  # of definitions with one id the last counts
        names = found.columns
        found = found.groupBy("id").agg(F.max_by(F.struct(*names), "pos").alias("r")).select("r.*")
    return found


def resolve_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """Each call site (id, pos) with its target; sites without one are left out.

    The rules in order: simple names in the module, in the class, in its bases, among from-imports; attributes in
    classes with that last name, then in imported modules; paths exactly, then as the end of an id. Every rule is an
    equi-join; the first rule and, in it, the first definition wins.
    """
    known = functions.select(F.col("id").alias("target"), F.col("pos").alias("ord"))
    site = calls.select("id", "pos", "module_id", "class_id", "kind", "name", "object", "attribute", "full_path")
    base = classes.select(F.col("id").alias("class_id"), F.posexplode("bases").alias("b_no", "b"))
    ids = classes.select(F.col("id").alias("b_id"))
    simple = site.where("kind = 'simple'")
    dotted = lambda *c: F.concat_ws(".", *c)
    zero = F.lit(0)
    options = [
        simple.select("id", "pos", zero.alias("rule"), zero.alias("sub"), dotted("module_id", "name").alias("target")),
        simple.where("class_id IS NOT NULL").select("id", "pos", F.lit(1).alias("rule"), zero.alias("sub"), dotted("class_id", "name").alias("target")),
        simple.join(base, "class_id").withColumn("b_id", F.when(F.col("b").contains("."), F.col("b")).otherwise(dotted("module_id", "b")))
        .join(ids.withColumn("in", F.lit(True)), "b_id", "left").where(F.col("in") | F.col("b").contains("."))
        .select("id", "pos", F.lit(2).alias("rule"), F.col("b_no").alias("sub"), dotted("b_id", "name").alias("target")),
        simple.join(imports.where("kind = 'importfrom'").select("module_id", "name", "module", F.col("pos").alias("i")), ["module_id", "name"])
        .select("id", "pos", F.lit(3).alias("rule"), F.col("i").alias("sub"), dotted("module", "name").alias("target")),
        site.where("kind = 'attribute'").join(classes.select(F.col("name").alias("object"), F.col("id").alias("cls"), F.col("pos").alias("c_no")), "object")
        .select("id", "pos", F.lit(4).alias("rule"), F.col("c_no").alias("sub"), dotted("cls", "attribute").alias("target")),
        site.where("kind = 'attribute'").join(imports.where("kind = 'import'").select("module_id", F.explode(F.array_compact(F.array_distinct(F.array("name", "alias")))).alias("object"), F.col("name").alias("full"), F.col("pos").alias("i")), ["module_id", "object"])
        .select("id", "pos", F.lit(5).alias("rule"), F.col("i").alias("sub"), dotted("full", "attribute").alias("target")),
        site.where("kind = 'nested_attribute'").select("id", "pos", F.lit(6).alias("rule"), zero.alias("sub"), F.col("full_path").alias("target")),
    ]
    # The end of an id: every end is a key of its own, so the rule stays an equi-join.
    ends = functions.select(F.col("id").alias("target"), F.col("pos").alias("ord"), F.split("id", r"\.").alias("p")).select("target", "ord", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda k: F.array_join(F.slice("p", k, F.size("p")), "."))).alias("full_path")).where("full_path <> ''")
    tail = site.where("kind = 'nested_attribute'").join(ends, "full_path").select("id", "pos", F.lit(7).alias("rule"), zero.alias("sub"), "target", "ord")
    every = options[0]
    for o in options[1:]:
        every = every.unionByName(o)
    hits = every.join(known, "target").unionByName(tail)
    return hits.groupBy("id", "pos").agg(F.min_by("target", F.struct("rule", "sub", "ord", "target")).alias("target"))


def call_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct()


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct edges between modules that are known."""
    named = imports.select(F.col("module_id").alias("src"), F.when(F.col("kind") == "import", F.col("name")).otherwise(F.col("module")).alias("dst"))
    return named.join(modules.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def class_edges(resolved: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct edges between different classes whose methods call each other."""
    own = functions.where("class_id IS NOT NULL").select(F.col("id").alias("f"), F.col("class_id").alias("c"))
    a = resolved.join(own.withColumnsRenamed({"f": "id", "c": "src"}), "id").join(own.withColumnsRenamed({"f": "target", "c": "dst"}), "target")
    return a.where("src <> dst").select("src", "dst").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions: entity, direction (calls, called by), other."""
    return edges.select(F.col("src").alias("entity"), F.lit("calls").alias("direction"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("entity"), F.lit("called by").alias("direction"), F.col("src").alias("other")))


def hierarchy(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Every prefix of dotted ids as a node: id, parent (null at the top), depth, is_leaf."""
    parts = F.split(id_col, r"\.")
    each = ids.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    node = each.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), ".").alias("id"), F.when(F.col("k") > 1, F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), ".")).alias("parent"), F.col("k").alias("depth"), (F.col("k") == F.size("p")).alias("leaf"))
    return node.groupBy("id", "parent", "depth").agg(F.max("leaf").alias("is_module"))


def name_score(name: Column) -> Column:
    low = F.lower(name)
    found = F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: low.contains(k))
    return F.least(F.when(found, 0.3).otherwise(0.0) + F.when(name.isin("__main__", "main"), 0.7).otherwise(0.0) + F.when(name.isin(*COMMON_NAMES), 0.5).otherwise(0.0), F.lit(1.0))


def semantic_score(name: Column | None, ident: Column) -> Column:
    """The name's score and half of that of each part of the id, at most 1."""
    parts = F.aggregate(F.split(ident, r"\."), F.lit(0.0), lambda acc, p: acc + name_score(p) * 0.5)
    return F.least((name_score(name) if name is not None else F.lit(0.0)) + parts, F.lit(1.0))


def complexity_score(content: Column) -> Column:
    """Lines with branch words over 50, and the deepest indent of a def; blank lines before it count as indent."""
    rows = F.split(content, "\n")
    count = lambda w: F.size(F.filter(rows, lambda x: x.rlike(rf"\b{w}\b")))
    branches = count("if") + count("for") + count("while") + count("except")
    deepest = F.array_max(F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^(\s*)def\s+"), F.lit(1)), F.length))
    return F.least(branches / 50.0, F.lit(1.0)) + F.coalesce(F.least(deepest / 4.0 / 5.0, F.lit(1.0)) * 0.3, F.lit(0.0))


def usage_score(imports: Column, calls: Column | None = None) -> Column:
    out = F.least(imports / 5.0, F.lit(1.0))
    return out if calls is None else out + F.least(calls / 10.0, F.lit(1.0)) * 0.5


def history_score(commits: Column, last: Column, as_of: Column) -> Column:
    """last and as_of in seconds."""
    return F.least(commits / 20.0, F.lit(1.0)) * 0.7 + F.greatest(F.lit(0.0), 1.0 - (as_of - last) / 86400.0 / 365) * 0.3


def documentation_score(text: Column) -> Column:
    has = lambda *w: F.when(F.exists(F.array(*map(F.lit, w)), lambda x: text.contains(x)), 1.0).otherwise(0.0)
    return F.least(F.least(F.length(text) / 200.0, F.lit(1.0)) * 0.7 + has("Args:", "Parameters:") * 0.15 + has("Returns:", "Return:") * 0.15 + has("Example:", "Examples:") * 0.1, F.lit(1.0))


def size_score(lines: Column) -> Column:
    return F.least(lines / 500.0, F.lit(1.0))


def module_score(usage: Column, relations: Column, complexity: Column, semantic: Column, history: Column) -> Column:
    return F.least(2.0 * usage + 3.0 * relations + complexity + 0.5 * semantic + 4.0 * history, F.lit(10.0))


def relation_score(n_in: Column, n_out: Column, rank: Column, between: Column) -> Column:
    base = (F.least(n_in / 5.0, F.lit(1.0)) * 0.5 + F.least(n_out / 10.0, F.lit(1.0)) * 0.2 + F.least(rank * 10, F.lit(1.0)) * 0.6 + F.least(between * 10, F.lit(1.0)) * 0.4) / 1.7
    return F.least(base + F.when((n_in > 2) & (n_out <= 1), 0.3).otherwise(0.0) + F.when((n_in > 2) & (n_out > 2), 0.2).otherwise(0.0), F.lit(1.0))


def package_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of packages from their children, level by level from the deepest; nodes of hierarchy(), scores (id, score) of modules."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    leaf = nodes.join(scores, "id", "left").where("is_module").select("id", "parent", "depth", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = leaf
    packages = nodes.where("NOT is_module")
    for depth in range(deepest - 1, 0, -1):
        kids = known.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("id")).agg(F.max("score").alias("most"), F.avg("score").alias("mean"))
        name = F.element_at(F.split("id", r"\."), -1)
        score = F.least((F.col("most") * 0.7 + F.col("mean") * 0.3) * 1.5 + 0.5 * name_score(name) + F.when(name.isin(*PACKAGE_NAMES), 2.0).otherwise(0.0), F.lit(10.0))
        known = known.unionByName(packages.where(F.col("depth") == depth).join(kids, "id").select("id", "parent", "depth", score.alias("score")))
    return known.join(packages.select("id"), "id", "left_semi").select("id", "score")
