"""Regex dialects: RE2 to ``java.util.regex``, and path globs to Java regex.

RE2 works on ASCII classes and treats only ``\\n`` as a line end.  Java's word
boundary is Unicode aware, its multi-line ``^`` also follows ``\\r`` and U+2028,
and its ``\\s`` contains the vertical tab.  Running an RE2 pattern unchanged in
Spark therefore misses, for example, an address preceded by an accented letter.
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
# Java's \w and \p{...} are ASCII by default and one table lookup, where several ranges
# in a class are tried one by one.
_RANGES = (
    ("A-Za-z0-9_", r"\w"),
    ("0-9A-Za-z_", r"\w"),
    ("0-9a-fA-F", r"\p{XDigit}"),
    ("A-Za-z0-9", r"\p{Alnum}"),
    ("a-zA-Z0-9", r"\p{Alnum}"),
    ("a-zA-Z", r"\p{Alpha}"),
)
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NOT_AFTER_WORD = r"(?<!\w)"
_NOT_BEFORE_WORD = r"(?!\w)"
# RE2's names of ASCII classes; Java's are the same, capitalized, but for ``word``.
_POSIX = {
    name: rf"\p{{{java}}}"
    for name, java in (
        ("alnum", "Alnum"), ("alpha", "Alpha"), ("ascii", "ASCII"), ("blank", "Blank"), ("cntrl", "Cntrl"),
        ("digit", "Digit"), ("graph", "Graph"), ("lower", "Lower"), ("print", "Print"), ("punct", "Punct"),
        ("space", "Space"), ("upper", "Upper"), ("xdigit", "XDigit"),
    )
} | {"word": r"\w"}
_POSIX_CLASS = re.compile(r"\[:(\^?)(\w+):\]")
_FLAGS = re.compile(r"^\(\?([ims]+)\)")


def _split_flags(regex: str) -> tuple[str, str]:
    m = _FLAGS.match(regex)
    return (m.group(1), regex[m.end():]) if m else ("", regex)


def _java_body(body: str, word_left: bool, word_right: bool, any_case: bool) -> str:
    out: list[str] = []
    in_class = False
    # RE2 folds the long s and the Kelvin sign to s and k; Java's (?i) does not.
    folded = "\u017f\u212a" if any_case else ""
    i = 0
    while i < len(body):
        c = body[i]
        pair = body[i:i + 2]
        if pair == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
        elif pair == r"\S" and not in_class:
            out.append(f"[^{_SPACE}]")
            i += 2
        elif pair == r"\b" and not in_class:
            if word_left and (i == 0 or body[i + 2:i + 4] == r"\d"):
                out.append(_NOT_AFTER_WORD)
            elif word_right and body[i + 2:] in ("", ")"):
                out.append(_NOT_BEFORE_WORD)
            else:
                out.append(_BOUNDARY)
            i += 2
        elif c == "\\":
            out.append(pair)
            i += 2
        elif c == "[" and in_class and (posix := _POSIX_CLASS.match(body, i)):
            negated, name = posix.groups()
            if name not in _POSIX:
                raise ValueError(f"no such class: {posix.group()}")
            java = _POSIX[name]
            out.append(java.swapcase()[:2] + java[2:] if negated else java)
            i = posix.end()
        elif c == "[" and in_class:
            out.append(r"\[")
            i += 1
        elif body.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 4
        else:
            if c == "[":
                in_class = True
                if body[i + 1:i + 2] == "]":
                    raise ValueError(f"write ']' as '\\]' inside a class: {body!r}")
            elif c == "]":
                in_class = False
                if "A-Z" in "".join(out).rpartition("[")[2]:
                    c = folded + c
            elif c == "&" and in_class:
                c = r"\&"
            elif c == "$" and not in_class:
                c = r"\z"
            out.append(c)
            i += 1
    return "".join(out)


def to_java(regex: str, *, first: str = "", word_left: bool = False, word_right: bool = False) -> str:
    """The Java expression that matches what ``regex`` matches in RE2.

    ``first`` puts a one-character check in front, so that the engine gives up
    at once wherever no match can start.
    """
    flags, body = _split_flags(regex)
    java = _java_body(body, word_left, word_right, "i" in flags)
    if "m" in flags:
        java = java.replace(r"\z", "$")
        flags += "d"
    java = (f"(?=[{first}])" if first else "") + java
    for ranges, table in _RANGES:
        java = java.replace(ranges, table)
    return (f"(?{flags})" if flags else "") + java


def _capture_span(body: str) -> tuple[int, int]:
    depth, start, in_class, i = 0, -1, False, 0
    open_depth = -1
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            captures = body[i + 1:i + 2] != "?" or re.match(r"\?P?<[A-Za-z]", body[i + 1:i + 5])
            if captures and start < 0:
                start, open_depth = i, depth
            depth += 1
        elif c == ")":
            depth -= 1
            if start >= 0 and depth == open_depth:
                return start, i + 1
        i += 1
    raise ValueError(f"no capture group in {body!r}")


def split_on_group(regex: str) -> str:
    """Rewrite ``head(value)tail`` to ``(head)(value)(tail)``, so that the value
    can be replaced while its context is kept."""
    flags, body = _split_flags(regex)
    start, end = _capture_span(body)
    return (f"(?{flags})" if flags else "") + f"({body[:start]}){body[start:end]}({body[end:]})"


def python_form(regex: str) -> str:
    """The regex for Python's parser, which looks at its structure only: the classes' names make no sense to it.

    Two characters stand for a class, so that a class by itself is not taken for a literal.
    """
    return _POSIX_CLASS.sub("01", regex).replace(r"\z", r"\Z")


def check_regex(regex: str, group: int) -> None:
    """Refuse what the tokenizer cannot give a meaning to."""
    if group not in (0, 1):
        raise ValueError("group must be 0 (whole match) or 1")
    to_java(regex)
    named = re.search(r"\(\?P?<([A-Za-z0-9]*_\w*)>", regex)
    if named:
        raise ValueError(f"a group's name consists of letters and digits: {named.group(1)!r}")
    compiled = re.compile(python_form(regex))
    if group and compiled.groups != 1:
        raise ValueError("a group pattern needs exactly one capture group")
    if not group and compiled.match("") is not None:
        raise ValueError("a pattern must not match the empty string")
    if group:
        split_on_group(regex)


def _glob_class(glob: str, i: int) -> tuple[str, int]:
    end = i + 1
    if glob[end:end + 1] in ("!", "^"):
        end += 1
    start = end
    while end < len(glob) and glob[end] != "]":
        end += 2 if glob[end] == "\\" else 1
    if end >= len(glob) or end == start:
        raise ValueError(f"malformed class in glob {glob!r}")
    negated = glob[i + 1] in "!^"
    items = re.sub(r"([\[&])", r"\\\1", glob[start:end])
    return f"(?!/)[{'^' if negated else ''}{items}]", end + 1


def _glob_braces(glob: str, i: int) -> tuple[list[str], int]:
    options, depth, part, j = [], 0, "", i
    while j < len(glob):
        c = glob[j]
        if c == "\\":
            part += glob[j:j + 2]
            j += 2
            continue
        if c == "{":
            depth += 1
            part += c if depth > 1 else ""
        elif c == "}":
            depth -= 1
            if depth == 0:
                return options + [part], j + 1
            part += c
        elif c == "," and depth == 1:
            options.append(part)
            part = ""
        else:
            part += c
        j += 1
    raise ValueError(f"unclosed brace in glob {glob!r}")


def _glob_body(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        at_segment_start = i == 0 or glob[i - 1] == "/"
        if at_segment_start and glob[i:i + 3] == "**/":
            out += "(?:[^/]*/)*"
            i += 3
        elif at_segment_start and glob[i:] == "**":
            if out.endswith("/"):
                out = out[:-1] + "(?:/.*)?"
            else:
                out += ".*"
            i += 2
        elif c == "*":
            while glob[i:i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[":
            piece, i = _glob_class(glob, i)
            out += piece
        elif c == "{":
            options, i = _glob_braces(glob, i)
            out += "(?:" + "|".join(_glob_body(o) for o in options) + ")"
        elif c == "\\":
            if i + 1 >= len(glob):
                raise ValueError(f"trailing backslash in glob {glob!r}")
            out += re.escape(glob[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    return out


def glob_body(glob: str) -> str | None:
    """The unanchored Java regex of a path glob, or None if the glob is malformed
    (a malformed rule matches nothing).

    ``*`` and ``?`` stay within one path segment, ``**`` spans segments when it
    is a whole segment, and a trailing ``/**`` also matches the directory itself.
    """
    try:
        body = _glob_body(glob)
        re.compile(body)
        return body
    except (ValueError, re.error):
        return None


def split_braces(glob: str, most: int) -> list[str]:
    """The globs without braces that a glob with braces stands for; the glob itself if there are more
    than ``most`` or its braces are malformed."""
    done, waiting = [], [glob]
    while waiting:
        one = waiting.pop(0)
        at = next((m.start() for m in re.finditer(r"\\.|\[[^\]]*\]|\{", one, re.S) if m.group() == "{"), -1)
        if at < 0:
            done.append(one)
            continue
        try:
            options, end = _glob_braces(one, at)
        except ValueError:
            return [glob]
        waiting += [one[:at] + o + one[end:] for o in options]
        if len(done) + len(waiting) > most:
            return [glob]
    return done


def globs_to_java(globs: list[str]) -> str | None:
    """One anchored Java regex for "any of these globs matches", None if none can."""
    bodies = [b for b in map(glob_body, globs) if b is not None]
    return r"(?s)\A(?:" + "|".join(bodies) + r")\z" if bodies else None
