"""Predicates on paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import to_java


def glob_regex(glob: str) -> str | None:
    """A shell pattern for a base name as an anchored regex; None if it is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body).replace("[", r"\[") + "]")
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"


def matches_any(path: Column, name: Column, patterns: tuple[str, ...]) -> Column:
    """Each pattern is tried as a glob on the name and as a regex on the path; an invalid form is not tried."""
    found = F.lit(False)
    for p in patterns:
        g = glob_regex(p)
        if g:
            found = found | name.rlike(g)
        try:
            re.compile(p)
            found = found | path.rlike(to_java(p))
        except (re.error, ValueError):
            pass
    return found


def included(path: Column, name: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """No include pattern admits all; exclusion wins."""
    wanted = matches_any(path, name, include) if include else F.lit(True)
    return wanted & ~matches_any(path, name, exclude)


def within(path: Column, roots: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/") or "/"
        out = out | (path == r) | path.startswith(r if r == "/" else r + "/")
    return out


def own_artefact(path: Column, output: str = "", last_scan: str = "", cache_dir: str = "") -> Column:
    """Files that scans write themselves: the output and its numbered rotations, the marker, the cache. Paths are absolute."""
    out = F.lit(False)
    if output:
        stem, dot, ext = output.rpartition(".")
        stem, ext = (stem, ext) if dot and "/" not in ext else (output, "ndjson")
        out = out | path.rlike("^" + re.escape(stem) + r"(\.[0-9]+)?\." + re.escape(ext) + r"\z")
    if last_scan:
        out = out | (path == last_scan)
    return out | within(path, (cache_dir,)) if cache_dir else out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
