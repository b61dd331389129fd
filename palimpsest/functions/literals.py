"""Literals that a regex cannot match without, and one regex that finds many literals in a single pass."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser as parser

from palimpsest.functions.dialect import python_form

#: A shorter literal is in most texts; with more alternatives a pattern is better tried.
SHORTEST, MOST = 2, 16
# What stands in tokens: a literal of nothing else may come up where an earlier pattern left one.
_IN_TOKEN = re.compile(r"[A-Z0-9:]*")


def _usable(run: str) -> str:
    """The longest part of a run that a rewritten text has only if the text had it: without brackets, not of a token."""
    parts = [p for p in re.split(r"[\[\]]", run) if len(p) >= SHORTEST and not _IN_TOKEN.fullmatch(p)]
    return max(parts, key=len, default="")


def _of(items) -> list[frozenset[str]]:
    """Sets of literals, of each of which every match has one."""
    found: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if _usable(run):
            found.append(frozenset([_usable(run)]))
        run = ""

    for kind, value in items:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if kind is op.AT:
            # An anchor takes no room: what stands on both sides of it is still together.
            continue
        if kind is op.SUBPATTERN and not value[1] and not value[2] and all(k is op.LITERAL for k, _ in value[3]):
            run += "".join(chr(c) for _, c in value[3])
            continue
        end()
        if kind is op.SUBPATTERN and not value[1]:
            found += _of(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            found += _of(value[2])
        elif kind is op.BRANCH:
            options = [_of(branch) for branch in value[1]]
            if all(options):
                found.append(frozenset().union(*(_best(o) for o in options)))
    end()
    return found


def _best(found: list[frozenset[str]]) -> frozenset[str]:
    return max(found, key=lambda s: (len(s) <= MOST, min(map(len, s)), -len(s)))


def required_literals(regex: str) -> tuple[str, ...]:
    """Literals (RE2 syntax read) of which every match has one at least; empty if none are known.

    Only literals that redaction does not bring into a text are taken.
    """
    try:
        parsed = parser.parse(python_form(regex))
    except (re.error, OverflowError):
        return ()
    if parsed.state.flags & re.IGNORECASE:
        return ()
    found = _of(parsed)
    best = _best(found) if found else frozenset()
    return tuple(sorted(best)) if len(best) <= MOST else ()


def literal_trie(literals: Iterable[str]) -> str:
    """A Java regex that matches the longest of the literals at a place, trying each character once."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}

    def body(node: dict) -> str:
        options = [re.escape(c) + body(below) for c, below in sorted(node.items()) if c]
        if not options:
            return ""
        whole = options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"
        return f"(?:{whole})?" if "" in node else whole

    return body(root)


def prefixes(literals: Iterable[str]) -> dict[str, list[str]]:
    """For each literal those that it begins with, itself included: they stand wherever it stands."""
    known = set(literals)
    return {x: [x[:n] for n in range(1, len(x) + 1) if x[:n] in known] for x in sorted(known)}
