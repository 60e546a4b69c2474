"""Path predicates: which files a scan or a snapshot leaves out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a repository scan leaves out.
REPO_DIRS = ("__pycache__", ".git", ".vscode", "venv", "env", "node_modules", ".pytest_cache", "build", "dist", ".github", "logs")
REPO_ENDS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico", ".webp", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mpeg", ".mpg", ".m4v", ".mkv", ".webm",
    ".mp3", ".wav", ".ogg", ".m4a", ".aac", ".flac", ".wma", ".m4b", ".m4p", ".zip", ".rar", ".tar", ".gz", ".bz2", ".7z", ".iso", ".dmg", ".pkg", ".deb",
    ".rpm", ".msi", ".exe", ".app", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pyc", ".pyo", ".pyd", ".so", ".dll", ".class", ".egg-info", "~", ".swp",
)
# What a snapshot leaves out.
SNAPSHOT_DIRS = ("__pycache__", ".git", ".svn", ".hg", "node_modules", ".venv", "venv", ".env", "env", ".pytest_cache", ".mypy_cache", ".tox", "dist", "build", "egg-info", ".eggs", ".idea", ".vscode", ".DS_Store")
SNAPSHOT_ENDS = (".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".log", ".tmp", ".bak", ".swp", ".ds_store")


def _ends(c: Column, ends: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, ends)), lambda e: c.endswith(e))


def ignored_in_repository(path: Column) -> Column:
    """Hidden, dunder and media paths, archives, build folders; notebooks outside such folders are kept."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, REPO_DIRS)))
    return F.when(path.endswith(".ipynb") & ~inside, False).otherwise(path.startswith(".") | path.startswith("__") | _ends(path, REPO_ENDS) | inside)


def ignored_in_snapshot(path: Column) -> Column:
    """Cache and tool folders, build products, logs and hidden names."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SNAPSHOT_DIRS)))
    return inside | _ends(F.lower(name), SNAPSHOT_ENDS) | (name.startswith(".") & ~name.isin(".", ".."))
