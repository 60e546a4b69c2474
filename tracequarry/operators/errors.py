"""Package-installation errors in logs: extraction, summaries and fix commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error type, pattern, names of its groups, suggestion.
PATTERNS: tuple[tuple[str, str, tuple[str, ...], str], ...] = (
    ("missing_package", r"(?:ImportError|ModuleNotFoundError): No module named ['\"]([^'\"]+)['\"]", ("package_name",), "Install the missing package using pip: pip install {package_name}"),
    ("import_name_error", r"(?:ImportError): cannot import name ['\"]([^'\"]+)['\"] from ['\"]([^'\"]+)['\"]", ("component_name", "package_name"), "Check if package {package_name} version is correct. Component {component_name} may have been added in newer versions or doesn't exist in current version."),
    ("attribute_error", r"(?:AttributeError): module ['\"]([^'\"]+)['\"] has no attribute ['\"]([^'\"]+)['\"]", ("package_name", "attribute_name"), "Check the documentation of package {package_name} to confirm if {attribute_name} exists or requires additional imports."),
    ("version_conflict", r"(?:.*?)requires ([^\s]+) ([^,]+), but ([^\s]+) is installed", ("package_name", "required_version", "installed_version"), "Install the required version of package: pip install {package_name}=={required_version} or use virtual environment to isolate dependencies."),
    ("syntax_error_in_package", r"(?:SyntaxError|IndentationError)(?:.*?)File ['\"](?:.*?)site-packages[/\\]([^/\\]+)[/\\](?:.*?)['\"], line (\d+)", ("package_name", "line_number"), "Package {package_name} may be incompletely installed or corrupted. Try reinstalling: pip uninstall {package_name} && pip install {package_name}"),
    ("import_error_in_package", r"(?:ImportError): (?:.*?)site-packages[/\\]([^/\\]+)[/\\](?:.*?): ([^\"'\n]+)", ("package_name", "error_details"), "Package {package_name} internal dependency issue: {error_details}. Check if its dependencies are completely installed."),
    ("dependency_error", r"(?:.*?)([^\s]+) requires ([^\s]+), which is not installed", ("package_name", "dependency_name"), "Install the missing dependency: pip install {dependency_name}"),
    ("dll_load_error", r"(?:ImportError): DLL load failed while importing ([^:]+): ([^\"'\n]+)", ("module_name", "error_details"), "Module {module_name} failed to load DLL: {error_details}. May need to install system-level dependencies or VC++ runtime."),
    ("permission_error", r"(?:PermissionError)(?:.*?)site-packages[/\\]([^/\\]+)[/\\]", ("package_name",), "Package {package_name} access permission issue. Try running with administrator/sudo privileges or check file permissions."),
    ("pkg_resources_error", r"(?:pkg_resources\.DistributionNotFound): The '([^']+)(?:[^']*?)' distribution was not found", ("package_name",), "Distribution package {package_name} not found. Try: pip install {package_name}"),
    ("incompatible_version", r"(?:.*?)([^\s]+) ([^\s]+) is incompatible with ([^\s]+) ([^\s]+)", ("package1", "version1", "package2", "version2"), "Package version conflict: {package1} {version1} is incompatible with {package2} {version2}. Create virtual environment or adjust dependency versions."),
)
# The lines before the commands, and the labels of the error types.
PREAMBLE = ("# Recommend installing dependencies in virtual environment to avoid version conflicts", "python -m venv venv", "# Windows: venv\\Scripts\\activate", "# Linux/Mac: source venv/bin/activate")
FRIENDLY = {
    "missing_package": "Missing Package",
    "import_name_error": "Import Name Error",
    "attribute_error": "Attribute Error",
    "version_conflict": "Version Conflict",
    "syntax_error_in_package": "Syntax Error in Package",
    "import_error_in_package": "Package Import Error",
    "dependency_error": "Dependency Error",
    "dll_load_error": "DLL Load Error",
    "permission_error": "Permission Error",
    "pkg_resources_error": "Resource Distribution Error",
    "incompatible_version": "Incompatible Version",
}
#: Errors whose package goes to the list of packages to install.
INSTALLED_FOR = ("missing_package", "version_conflict", "dependency_error", "pkg_resources_error", "syntax_error_in_package")
#: Of the patterns that begin with anything, the form that is tried only at a line's beginning or at the last match's
#: end, and at the beginnings of words: it finds the same matches with the same groups, without a walk over the rest
#: of the line from each of its characters.
ANCHORED = {
    "version_conflict": r"(?:^|\G).*?requires ([^\s]+) ([^,]+), but ([^\s]+) is installed",
    "dependency_error": r"(?:^|\G)(?:|.*?(?<!\S))([^\s]++) requires ([^\s]+), which is not installed",
    "incompatible_version": r"(?:^|\G)(?:|.*?(?<!\S))([^\s]++) ([^\s]++) is incompatible with ([^\s]+) ([^\s]+)",
}
#: What a text must hold, in lower case, to have any match.
MARKS = ("error", " requires ", "requires ", "distributionnotfound", " is incompatible with ")


def friendly_name(error_type: str) -> str:
    return FRIENDLY.get(error_type, error_type)


def _row(no: int, name: str, regex: str, groups: tuple[str, ...], suggestion: str) -> Callable[[Column], Column]:
    """A match as an error's struct; its groups are read from it."""

    def one(m: Column, i: Column) -> Column:
        values = [F.regexp_extract(m, regex, k) for k in range(1, len(groups) + 1)]
        details = F.create_map(*(x for g, v in zip(groups, values, strict=True) for x in (F.lit(g), v)))
        said = F.lit(suggestion)
        for g, v in zip(groups, values, strict=True):
            said = F.replace(said, F.lit("{" + g + "}"), v)
        return F.struct(F.lit(no).alias("pattern_no"), i.alias("match_no"), F.lit(name).alias("error_type"), m.alias("match_text"), details.alias("details"), said.alias("suggestion"))

    return one


def extract(logs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row an error: id_col, pattern_no, match_no, error_type, match_text, details map, suggestion, context.

    Patterns in order, matches in order of the text. context has up to three lines before and after the first
    occurrence of the match. A pattern passes over a text once, and its groups are read from the matches; texts
    without any of the words that all patterns need are left out before.
    """
    kinds = []
    for no, (name, pattern, groups, suggestion) in enumerate(PATTERNS):
        regex = "(?im)" + ANCHORED.get(name, pattern)
        found = F.regexp_extract_all(F.col(text_col), F.lit(regex), F.lit(0))
        kinds.append(F.transform(found, _row(no, name, regex, groups, suggestion)))
    logs = logs.where(F.lower(text_col).rlike("|".join(MARKS)))
    at = F.instr(F.col(text_col), F.col("e.match_text"))
    before = F.split(F.substring(F.col(text_col), F.lit(1), at - 1), "\n")
    after = F.split(F.substring(F.col(text_col), at + F.length("e.match_text"), F.length(text_col)), "\n")
    context = F.concat(F.array_join(F.slice(before, F.greatest(F.size(before) - 3, F.lit(1)), 4), "\n"), F.col("e.match_text"), F.array_join(F.slice(after, 1, 4), "\n"))
    return logs.select(id_col, text_col, F.explode(F.concat(*kinds)).alias("e")).select(id_col, "e.*", context.alias("context"))


def summary(errors: DataFrame) -> DataFrame:
    """Errors of each type with its friendly name."""
    name = None
    for kind, *_ in PATTERNS:
        name = F.when(F.col("error_type") == kind, friendly_name(kind)) if name is None else name.when(F.col("error_type") == kind, friendly_name(kind))
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).withColumn("label", name)


def affected_packages(errors: DataFrame) -> DataFrame:
    """Distinct base names under the details whose key names a package or module."""
    each = errors.select(F.explode("details").alias("key", "value")).where(F.col("key").contains("package") | F.col("key").contains("module"))
    return each.select(F.substring_index("value", ".", 1).alias("package")).distinct()


def fix_commands(errors: DataFrame, id_col: str = "id") -> DataFrame:
    """Commands of each log in order, each package once, after the four lines of the preamble.

    Packages of missing, dependency and broken-package errors share one list of those seen; version commands are
    once by their text.
    """
    d = lambda k: F.element_at("details", F.lit(k))
    kind = F.col("error_type")
    base = F.substring_index(d("package_name"), ".", 1)
    key = F.when(kind == "missing_package", base).when(kind == "dependency_error", d("dependency_name")).when(kind == "syntax_error_in_package", d("package_name"))
    command = (
        F.when(kind.isin("missing_package", "dependency_error"), F.concat(F.lit("pip install "), key))
        .when(kind == "syntax_error_in_package", F.concat(F.lit("pip uninstall -y "), key, F.lit(" && pip install --no-cache-dir "), key))
        .when(kind == "version_conflict", F.concat(F.lit("pip install "), d("package_name"), F.lit("=="), d("required_version")))
    )
    keyed = errors.withColumns({"command": command, "key": F.when(key.isNotNull(), F.concat(F.lit("p"), key)).otherwise(F.concat(F.lit("c"), command))}).where("command IS NOT NULL")
    first = keyed.groupBy(id_col, "key").agg(F.min(F.struct("pattern_no", "match_no", "command")).alias("f"))
    listed = first.groupBy(id_col).agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return listed.select(id_col, F.concat(F.array(*map(F.lit, PREAMBLE)), F.transform("fs", lambda f: f["command"])).alias("commands"))


def install_packages(errors: DataFrame, id_col: str = "id") -> DataFrame:
    """The packages that each log's errors name for installing, in order of the errors, repeats kept."""
    named = errors.where(F.col("error_type").isin(*INSTALLED_FOR)).select(id_col, F.struct("pattern_no", "match_no", F.element_at("details", F.lit("package_name")).alias("package")).alias("p")).where("p.package IS NOT NULL")
    return named.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["package"]).alias("packages"))


def report(errors: DataFrame, id_col: str = "id") -> DataFrame:
    """One row a log with errors: their number, each kind with its number, and the commands and packages that they lead to."""
    kinds = errors.groupBy(id_col, "error_type").agg(F.count(F.lit(1)).alias("n"))
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FRIENDLY.items() for x in kv)), F.col("error_type")), F.col("error_type"))
    listed = kinds.groupBy(id_col).agg(F.sum("n").alias("n_errors"), F.array_sort(F.collect_list(F.concat(label, F.lit(": "), F.col("n").cast("string")))).alias("kinds"))
    empty = F.expr("cast(array() AS array<string>)")
    both = listed.join(fix_commands(errors, id_col), id_col, "left").join(install_packages(errors, id_col), id_col, "left")
    return both.withColumns({"commands": F.coalesce("commands", empty), "packages": F.coalesce("packages", empty)})


def installable(packages: DataFrame, builtin: DataFrame, index: DataFrame) -> DataFrame:
    """Packages (package) that are neither relative nor built in, and are in the index."""
    return packages.where(~F.col("package").startswith(".")).join(builtin, "package", "left_anti").join(index, "package", "left_semi")
