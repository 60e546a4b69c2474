"""Manifests of a failing trace: canonical values, inferred libraries, retrieval queries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.functions.text import candidate_tokens, collapse_whitespace, dependency_root, norm_key, query_text

# Aliases by key. Keys with signs that the key drops are left out, as no look-up can reach them.
RUNTIMES = {"python": "python-3.x", "python3": "python-3.x", "python3x": "python-3.x", "py3": "python-3.x", "node": "node-18+", "nodejs": "node-18+", "javascript": "node-18+", "typescript": "node-18+", "java": "java-17+", "go": "go-1.22+", "golang": "go-1.22+"}
LANGUAGES = {"python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "node": "javascript", "nodejs": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java", "go": "go", "golang": "go", "csharp": "csharp", "dotnet": "csharp"}
DEFAULT_RUNTIMES = {"python": "python-3.x", "javascript": "node-18+", "typescript": "node-18+", "java": "java-17+", "go": "go-1.22+", "csharp": "dotnet-8"}
ERROR_TYPES = {"timeoutwarning": "TimeoutWarning", "timeoutexceeded": "TimeoutWarning", "timeouterror": "TimeoutError", "timeout": "TimeoutWarning", "keyerror": "KeyError", "valueerror": "ValueError", "indexerror": "IndexError", "attributeerror": "AttributeError", "typeerror": "TypeError", "connectionerror": "ConnectionError", "http502": "BadGatewayError", "badgateway": "BadGatewayError", "gatewayerror": "BadGatewayError", "ratelimit": "RateLimitError", "toomanyrequests": "RateLimitError"}
ARCHITECTURES = {"stategraphwithtoolcalling": "State Graph with Tool Calling", "stategraphwithtools": "State Graph with Tool Calling", "langgraphstategraphwithtoolcalling": "State Graph with Tool Calling", "reactagent": "ReAct Agent", "multiagent": "Multi-Agent Orchestration", "multiagentorchestration": "Multi-Agent Orchestration", "retrievalaugmentedgeneration": "RAG", "rag": "RAG"}
LIBRARIES = {"langgraph": "langgraph", "langchain": "langchain", "autogen": "autogen", "openai": "openai", "anthropic": "anthropic", "fastapi": "fastapi", "flask": "flask", "django": "django", "pydantic": "pydantic", "requests": "requests", "numpy": "numpy", "pandas": "pandas", "torch": "torch", "transformers": "transformers", "azureopenai": "azure-openai"}
LIBRARY_VALUES = (*dict.fromkeys(LIBRARIES.values()), "langchain-core")
LANGUAGE_HINTS = (("python", ("python", "py")), ("javascript", ("javascript", "node.js", "nodejs", " js ")), ("typescript", ("typescript", " ts ")), ("java", (" java ",)), ("go", (" golang ", " go ")))
STOP_TOKENS = ("the", "and", "for", "with", "from", "this", "that", "into", "using", "used", "use", "fix", "runtime", "libraries", "library", "error", "warning", "node", "execution", "seconds", "state")


def alias(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    known = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.coalesce(F.element_at(known, key), otherwise)


def runtime(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(alias(RUNTIMES, norm_key(c), F.lower(collapse_whitespace(c))))


def language(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(alias(LANGUAGES, norm_key(c), F.lower(collapse_whitespace(c))))


def error_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "UnknownError").otherwise(alias(ERROR_TYPES, norm_key(c), collapse_whitespace(c)))


def architecture(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "Unknown Architecture").otherwise(alias(ARCHITECTURES, norm_key(c), collapse_whitespace(c)))


def library(c: Column) -> Column:
    return alias(LIBRARIES, norm_key(c), F.lower(F.trim(F.replace(c, F.lit("_"), F.lit("-")))))


def infer_language(*texts: Column) -> Column:
    """The first language one of whose marks is in the texts."""
    corpus = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *texts)), F.lit(" "))
    out = None
    for name, marks in LANGUAGE_HINTS:
        hit = F.exists(F.array(*map(F.lit, marks)), lambda m: corpus.contains(m))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def string_list(c: Column) -> Column:
    """Blank and null entries go, white space is collapsed; null counts as empty."""
    return F.transform(F.filter(F.coalesce(c, F.expr("cast(array() AS array<string>)")), lambda x: F.trim(x) != ""), collapse_whitespace)


def dedupe(values: Column) -> Column:
    """Trimmed values without blanks and without repeats; case does not count."""
    # A fold, so values are computed once: a lambda that names them would compute them for every element again.
    pair = lambda x: F.struct(F.trim(x).alias("v"), F.lower(F.trim(x)).alias("k"))
    none = F.expr("cast(array() AS array<struct<v: string, k: string>>)")
    kept = F.aggregate(F.filter(F.transform(values, lambda x: pair(x)), lambda p: p["v"] != ""), none, lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.transform(kept, lambda p: p["v"])


def required_libraries(existing: Column, dependencies: Column, texts: Column, builtin: tuple[str, ...] = ()) -> Column:
    """Sorted union of given libraries, of the dependencies' roots that are not built in, and of known ones named in the text."""
    given = F.transform(existing, library)
    roots = F.filter(F.transform(dependencies, dependency_root), lambda r: (r != "") & ~r.isin(*builtin) if builtin else r != "")
    named = F.filter(F.transform(candidate_tokens(texts), library), lambda x: x.isin(*LIBRARY_VALUES))
    return F.array_sort(F.array_distinct(F.filter(F.concat(given, F.transform(roots, library), named), lambda x: x != "")))


def prepend_query(queries: Column, first: Column) -> Column:
    """The canonical query first, its repeats in any case gone."""
    return F.concat(F.array(first), F.filter(queries, lambda q: F.lower(q) != F.lower(first)))


def templates(error: Column, symptom: Column, node: Column, pattern: Column, run: Column, lang: Column, libs: Column) -> Column:
    """Four base templates, each with up to four variants of constraints."""
    where = F.when(F.coalesce(node, F.lit("")) == "", "unknown_node").otherwise(node)
    clause = F.array_join(F.slice(libs, 1, 8), ", ")
    bases = [
        F.concat_ws(" ", F.lit("fix"), error, symptom, F.lit("in"), pattern), F.concat_ws(" ", F.lit("resolve"), error, F.lit("at"), where, F.lit("for"), pattern),
        F.concat_ws(" ", pattern, where, F.lit("timeout mitigation"), error), F.concat_ws(" ", error, symptom, F.lit("call path"), where),
    ]
    # A base is cleaned once; what is added begins with a word, so the two clean parts joined are clean.
    added = [
        F.lit(""), F.when(run != "", F.concat(F.lit(" "), query_text(F.concat(F.lit("runtime "), run)))), F.when(lang != "", F.concat(F.lit(" "), query_text(F.concat(F.lit("language "), lang)))),
        F.when(clause != "", F.concat(F.lit(" "), query_text(F.concat(F.lit("libraries "), clause)))),
        F.when((run != "") & (clause != ""), F.concat(F.lit(" "), query_text(F.concat(F.lit("runtime "), run, F.lit(" libraries "), clause)))),
    ]
    every = F.transform(F.array(*map(query_text, bases)), lambda base: F.array(*(F.concat(base, x) for x in added)))
    return F.filter(F.flatten(every), lambda x: x.isNotNull())


def query_pack(query: Column, seeds: Column, error: Column, symptom: Column, node: Column, pattern: Column, run: Column, lang: Column, libs: Column, most: int = 18) -> Column:
    """struct(seed_queries, template_queries, constraint_injected_queries, retrieval_queries)."""
    first = query_text(query)
    cleaned = dedupe(F.transform(F.filter(seeds, lambda q: F.trim(q) != ""), query_text))
    own = F.when(F.array_contains(cleaned, query), cleaned).otherwise(F.concat(F.array(first), cleaned))
    clause = F.array_join(F.slice(libs, 1, 8), ", ")
    suffix = F.concat_ws(" ", F.when(run != "", F.concat(F.lit("runtime "), run)), F.when(lang != "", F.concat(F.lit("language "), lang)), F.when(clause != "", F.concat(F.lit("libraries "), clause)))
    injected = F.transform(own, lambda s: F.when((suffix != "") & ~F.lower(query_text(s)).contains(F.lower(suffix)), query_text(F.concat(query_text(s), F.lit(" "), suffix))).otherwise(query_text(s)))
    made = templates(error, symptom, node, pattern, run, lang, libs)
    return F.struct(own.alias("seed_queries"), dedupe(made).alias("template_queries"), dedupe(injected).alias("constraint_injected_queries"), F.slice(dedupe(F.concat(F.array(first), injected, made, own)), 1, most).alias("retrieval_queries"))


def canonical_query(error: Column, symptom: Column, pattern: Column, node: Column, run: Column, libs: Column, dependencies: Column, most_libraries: int = 4, most_tokens: int = 48) -> Column:
    """One line that names the problem: what to fix, where, the runtime and a few libraries (dependencies where none is given), cut to a number of words."""
    filled = lambda xs: F.filter(xs, lambda x: F.trim(x) != "")
    given = F.when(F.size(filled(libs)) > 0, filled(libs)).otherwise(filled(dependencies))
    named = F.when(F.size(given) > 0, F.concat(F.lit("libraries "), F.array_join(F.slice(given, 1, most_libraries), " ")))
    parts = F.array(F.lit("fix"), error, symptom, pattern, node, F.concat(F.lit("runtime "), F.coalesce(run, F.lit(""))), named)
    words = F.filter(F.split(F.array_join(F.transform(filled(F.array_compact(parts)), lambda x: F.trim(x)), " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most_tokens), " ")


def brief(error: Column, symptom: Column, node: Column, path: Column, pattern: Column, dependencies: Column, excerpt: Column, query: Column, queries: Column, run: Column, lang: Column, libs: Column, pack: Column) -> Column:
    """What of a manifest goes to a prompt: its parts, and the first retrieval and template queries of its pack."""
    return F.struct(
        F.struct(error.alias("error_type"), symptom.alias("symptom"), node.alias("failing_node")).alias("problem_domain"),
        F.struct(path.alias("filepath"), pattern.alias("architecture_pattern"), dependencies.alias("dependencies"), excerpt.alias("primary_slice_excerpt")).alias("codebase_context"),
        F.struct(query.alias("query"), queries.alias("queries"), run.alias("runtime"), lang.alias("language"), libs.alias("required_libraries")).alias("search_intent"),
        F.struct(F.slice(pack["retrieval_queries"], 1, 8).alias("retrieval_queries"), F.slice(pack["template_queries"], 1, 6).alias("template_queries")).alias("query_pack_preview"),
    )
