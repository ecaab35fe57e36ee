"""URL columns: normal form, parts, filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what a crawl of the kind leaves out, and the types of files it takes
EXCLUDED = (
    "/internal/",
    "/quicktabs/ajax/",
    "/ajax/",
    "/apios/",
    "/matomo/",
    "/visit/",
    "gallery/index.html",
    "?language=hi",
    "javascript:",
    "mailto:",
    "tel:",
    "#",
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico",
    ".css", ".js", ".woff", ".woff2", ".ttf",
    ".mp4", ".avi", ".mp3",
    ".xml",
    ".zip", ".tar", ".jar",
)
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv")


def host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def last_segment(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(c), "/+$", ""), "([^/]*)$", 1)


def normalised(c: Column) -> Column:
    """An absolute http(s) URL without fragment and trailing slashes, its scheme small; others are null. The host keeps its case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "#.*$", ""), "/+$", "")
    web = bare.rlike(r"^(?i:https?)://[^/?#]+")
    return F.when(web, F.concat(F.lower(F.regexp_extract(bare, "^([A-Za-z]+):", 1)), F.regexp_replace(bare, "^[A-Za-z]+", "")))


def _joined(href: pd.Series, base: pd.Series) -> pd.Series:
    def join(h: str | None, b: str | None) -> str | None:
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None

    return pd.Series([join(h, b) for h, b in zip(href, base)], dtype=object)


def resolved(href: Column, base: Column) -> Column:
    """href against base, in normal form. Absolute and root-relative links stay native; pages with others need ``resolved_any``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    return normalised(F.when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(href))


def resolved_any(href: Column, base: Column) -> Column:
    """href against base by the rules for relative references, dots and queries included (Arrow)."""
    return normalised(F.pandas_udf(_joined, "string")(href, base))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """c contains one of the parts: one pattern, so that c is made once."""
    return c.rlike("|".join(map(re.escape, parts))) if parts else F.lit(False)


def is_excluded(c: Column, parts: Sequence[str] = EXCLUDED) -> Column:
    return contains_any(F.lower(c), parts)


def is_allowed(c: Column, domains: Sequence[str], parts: Sequence[str] = EXCLUDED) -> Column:
    """Not empty, the host ends with a domain (also within a label), nothing excluded in it."""
    ok = host(c).rlike(f"(?:{'|'.join(map(re.escape, domains))})$") if domains else F.lit(False)
    return F.coalesce((c != "") & ok & ~is_excluded(c, parts), F.lit(False))


def is_document(c: Column, suffixes: Sequence[str] = DOCUMENT_SUFFIXES) -> Column:
    return F.coalesce(F.lower(path(c)).rlike(f"(?:{'|'.join(map(re.escape, suffixes))})$"), F.lit(False))


def file_type(c: Column, mime: Column | None = None) -> Column:
    """Suffix without dot, else by a part of the MIME type, else 'unknown'."""
    out = None
    for s in DOCUMENT_SUFFIXES:
        hit = F.lower(path(c)).endswith(s)
        out = F.when(hit, s[1:]) if out is None else out.when(hit, s[1:])
    if mime is not None:
        for part, kind in (("pdf", "pdf"), ("wordprocessingml", "docx"), ("msword", "doc"), ("spreadsheetml", "xlsx"), ("excel", "xls"), ("csv", "csv")):
            out = out.when(F.contains(F.lower(mime), F.lit(part)), kind)
    return out.otherwise("unknown")


def crawl_action(c: Column, depth: Column, most: int = 4) -> Column:
    """What becomes of a queued URL, the first that applies."""
    return (
        F.when(F.contains(F.lower(c), F.lit("/internal/")), "skip_login")
        .when(contains_any(c, ("/quicktabs/ajax/", "/ajax/")), "skip_ajax")
        .when(depth > most, "skip_depth")
        .when(is_document(c), "document")
        .otherwise("page")
    )
