"""Paths: home expansion, and finding paths in text."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space.
SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_PATH_WORD = f"(?<![^{SPACE}])[/~][^{SPACE}]+"
# Fixed value: what is cut off the right end of a word before it is taken for a path.
_TRAILING = r"""[:;,.!?"'()\[\]{}]+\z"""


def _clean(path: Column) -> Column:
    """``path`` without empty, ``.`` and ``..`` segments (absolute paths only)."""

    def add(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when((part == "") | (part == "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), add)
    needed = path.rlike(r"//|/\.\.?(?:/|\z)|./\z")
    return F.when(needed, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)


def expand_home(path: Column, home: str) -> Column:
    """``~`` and ``~/x`` to the home directory, ``~user/x`` to ``/home/user/x``."""
    user = F.substr(F.split_part(path, F.lit("/"), F.lit(1)), F.lit(2))
    rest = F.substr(path, F.locate("/", path) + 1)
    expanded = (
        F.when(path == "~", F.lit(home))
        .when(F.startswith(path, F.lit("~/")), _clean(F.concat(F.lit(home + "/"), rest)))
        .when(F.contains(path, F.lit("/")), _clean(F.concat_ws("/", F.lit("/home"), user, rest)))
        .otherwise(path)
    )
    return F.when(F.startswith(path, F.lit("~")), expanded).otherwise(path)


def expand_home_literal(path: str, home: str) -> str:
    """The same for one path, for rules."""
    if path == "~":
        return home
    if path.startswith("~") and "/" in path:
        user, _, rest = path[1:].partition("/")
        joined = posixpath.normpath(f"{home if not user else '/home/' + user}/{rest}")
        return joined.replace("//", "/", 1) if joined.startswith("//") else joined
    return path


def extract_paths(text: Column) -> Column:
    """Distinct path-like words of a text in order of appearance.

    A word counts if it starts with ``/`` or ``~/``, or with ``~name`` and has a
    slash.  Punctuation at its right end is cut off, at its left end it is not.
    """
    words = F.regexp_extract_all(text, F.lit(_PATH_WORD), F.lit(0))
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, F.lit(_TRAILING), F.lit("")))

    def is_path(w: Column) -> Column:
        named = w.rlike(r"(?s)\A~[^~].*/") | w.rlike(r"(?s)\A~/")
        return (F.length(w) >= 2) & (F.startswith(w, F.lit("/")) | named)

    return F.when(
        F.contains(text, F.lit("/")), F.array_distinct(F.filter(trimmed, is_path))
    ).otherwise(F.array().cast("array<string>"))
