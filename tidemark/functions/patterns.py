"""Glob patterns and small string rules used for entity / table / rule keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """Translate a shell glob (``*``, ``?``, ``[...]``) into an anchored Java regex.

    Done once on the driver; the regex then runs JVM-side via ``rlike``.
    """
    out, i, n = ["^"], 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = glob.find("]", i + 1)
            if j == -1:
                out.append(re.escape(c))
            else:
                body = glob[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    out.append("$")
    return "".join(out)


def is_glob(s: str) -> bool:
    return any(ch in s for ch in "*?[")


def glob_predicate(c: Column, glob: str) -> Column:
    """A glob as a predicate; its literal beginning is a ``startswith``, which reaches the parquet scan."""
    cut = min(glob.index(ch) for ch in "*?[" if ch in glob)
    head, rest = glob[:cut], glob[cut:]
    if rest == "*":
        return c.startswith(head)
    match = c.rlike(glob_to_regex(glob))
    return c.startswith(head) & match if head else match


def matches(col, pattern_or_list) -> Column:
    """Entity wildcard or explicit list -> predicate Column."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(pattern_or_list, (list, tuple, set)):
        exact = [p for p in pattern_or_list if not is_glob(p)]
        globs = [p for p in pattern_or_list if is_glob(p)]
        pred = c.isin(exact) if exact else F.lit(False)
        for g in globs:
            pred = pred | glob_predicate(c, g)
        return pred
    if is_glob(pattern_or_list):
        return glob_predicate(c, pattern_or_list)
    return c == F.lit(pattern_or_list)


def plugin_of(tbl) -> Column:
    """``plugin_instance`` -> plugin (text before the first ``_``)."""
    return F.substring_index(F.col(tbl) if isinstance(tbl, str) else tbl, "_", 1)


def instance_of(tbl) -> Column:
    """``plugin_instance`` -> instance (text after the first ``_``; '' if none)."""
    c = F.col(tbl) if isinstance(tbl, str) else tbl
    parts = F.split(c, "_", 2)
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def sanitize_table(tbl) -> Column:
    """Table names cannot hold ``/``: replace by ``_``."""
    return F.translate(F.col(tbl) if isinstance(tbl, str) else tbl, "/", "_")


def short_host(host) -> Column:
    """Drop the last two domain labels when a host name has more than two."""
    c = F.col(host) if isinstance(host, str) else host
    parts = F.split(c, r"\.")
    n = F.size(parts)
    return F.when(n > 2, F.array_join(F.slice(parts, F.lit(1), n - 2), ".")).otherwise(c)


def strip_replica(node) -> Column:
    """``group^role^addr`` (exactly three parts) -> ``addr``; other forms unchanged."""
    c = F.col(node) if isinstance(node, str) else node
    parts = F.split(c, r"\^")
    return F.when(F.size(parts) == 3, F.element_at(parts, 3)).otherwise(c)


def split_first(col, sep: str):
    """(head, tail) around the first ``sep`` (tail '' when absent)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, _re_escape(sep), 2)
    return parts.getItem(0), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def _re_escape(s: str) -> str:
    return re.escape(s)
