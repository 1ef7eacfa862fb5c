"""Which paths count as Python sources of a repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Directory names left out of the analysis.
IGNORED_DIRECTORIES = (
    "env", "venv", "env.bak", "venv.bak", "vcs", "node_modules", "bower_components",
    "build", "dist", "lib", "lib64", "bin", "wheelhouse", "wheels",
    "develop-eggs", "eggs", "parts", "sdist", "var", "share", "temp", "tmp",
    "logs", "data", "dataset", "datasets", "docs", "notes", "wiki", "documentation",
    "cache", "target", "migrations", "assets", "static", "media", "vendor", "third_party",
    "instance", "config", "settings", "ini", "manifest",
    "vagrant", "docker", "dockerfiles", "vagrantfiles", "profile_default",
    "downloads", "cython_debug", "site",
)
# First characters of directory names left out.
IGNORED_PREFIXES = (".", "~", "_", "#", "$", "!", "%", "+")


def name_variants(names: Sequence[str]) -> list[str]:
    """Every name in lower, upper and capitalised spelling."""
    return [spelling for n in names for spelling in (n.lower(), n.upper(), n.capitalize())]


def _directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _prefix_class(prefixes: Sequence[str]) -> str:
    return "[" + "".join("\\" + p for p in prefixes) + "]"


def is_python(path: Column) -> Column:
    return path.endswith(".py")


def in_denied_directory(path: Column, deny: Sequence[str] = IGNORED_DIRECTORIES, depth: str = "root") -> Column:
    """True below a denied directory: at the repository root only, or at ``any`` depth."""
    names = name_variants(deny)
    directories = _directories(path)
    if depth == "root":
        return F.coalesce(F.get(directories, F.lit(0)).isin(names), F.lit(False))
    if depth == "any":
        return F.exists(directories, lambda d: d.isin(names))
    raise ValueError("depth is 'root' or 'any'")


def in_prefixed_directory(path: Column, prefixes: Sequence[str] = IGNORED_PREFIXES) -> Column:
    """True when a directory at any depth starts with one of the characters."""
    pattern = "^" + _prefix_class(prefixes)
    return F.exists(_directories(path), lambda d: d.rlike(pattern))


def lint_ignored(path: Column, prefixes: Sequence[str] = IGNORED_PREFIXES) -> Column:
    """The linter's path rule: a part after a slash or backslash starts with one of the
    characters and another separator follows. Paths are relative to the repository."""
    return F.concat(F.lit("/"), path).rlike(rf"[/\\]{_prefix_class(prefixes)}.*[/\\]")


def python_sources(
    df: DataFrame,
    path: str = "path",
    deny: Sequence[str] = IGNORED_DIRECTORIES,
    prefixes: Sequence[str] = IGNORED_PREFIXES,
    depth: str = "root",
) -> DataFrame:
    """Keep the rows whose path is an analysed Python file."""
    p = F.col(path)
    return df.where(
        is_python(p) & ~in_denied_directory(p, deny, depth) & ~in_prefixed_directory(p, prefixes)
    )
