"""Names, owners, paths and sizes derived from text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _parts(url: Column) -> Column:
    slashed = F.translate(url, "\\", "/")
    return F.split(F.regexp_replace(slashed, "/+$", ""), "/")


def clean_url(url: Column) -> Column:
    """Trim white space at both ends and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/$", "")


def repo_name(url: Column, legacy: bool = False) -> Column:
    """Last path part without the ``.git`` suffix (``legacy`` removes every ``.git``)."""
    last = F.element_at(_parts(url), -1)
    return F.regexp_replace(last, r"\.git" if legacy else r"\.git$", "")


def repo_owner(url: Column) -> Column:
    """Second-last part of a URL; NULL when there is none."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.trim(F.try_element_at(parts, F.lit(-2)))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, without leading slashes."""
    root = root.rstrip("/")
    below = F.when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 1)))
    return F.trim(F.ltrim(F.coalesce(below, path), F.lit("/")))


def repo_path(url: Column, root: str) -> Column:
    """Directory a repository has below ``root``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), repo_name(url))


def kb_to_mb(size_kb: Column) -> Column:
    return size_kb / F.lit(1024.0)


def size_text(size_kb: Column) -> Column:
    """``512 KB``, ``2.00 MB`` or ``3.00 GB``."""
    # format_string rounds half up; bround first gives half-even.
    mb = F.bround(size_kb / F.lit(1024.0), 2)
    gb = F.bround(size_kb / F.lit(1024.0 * 1024.0), 2)
    return (
        F.when(size_kb < 1024, F.concat(size_kb.cast("string"), F.lit(" KB")))
        .when(size_kb < 1024 * 1024, F.format_string("%.2f MB", mb))
        .otherwise(F.format_string("%.2f GB", gb))
    )
