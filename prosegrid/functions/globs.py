"""Path globs as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """With a slash the glob is anchored on the path, else it matches the base name; ** crosses components."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob.lstrip("/")):
        out.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + ("" if "/" in glob else "(?:.*/)?") + "".join(out) + "$"


def matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def specificity(glob: str) -> tuple[bool, int]:
    """Anchored beats base name, then the longer text."""
    return "/" in glob, len(glob)


def selected(path: Column, globs: list[str], excludes: list[str]) -> Column:
    hit = F.lit(False)
    for glob in globs:
        hit = hit | matches(path, glob)
    for glob in excludes:
        hit = hit & ~matches(path, glob)
    return hit
