"""Detection and numbered tokenization as Column expressions.

Every enabled pattern is applied in catalog order to the text as rewritten so
far.  Each distinct value of a scope gets one token ``[TG:CATEGORY:N]``; a value
seen before keeps its token, whatever pattern finds it again.  Numbers start at 1, or
after the largest that the scope's texts have in that category already, as a token or
in a spelling that is restored as well: what only looks like a token is never restored.

For one pattern, a single ``regexp_replace`` puts marks around all matches, one
``split`` at the marks separates text from values, and array functions allocate
tokens and put the pieces together again.  A cheap literal test per pattern
decides first which patterns can match at all; a row without any such pattern is
passed through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.dialect import split_on_group, to_java
from palimpsest.functions.expr import let, no_strings, with_lookup
from palimpsest.functions.literals import literal_trie, prefixes
from palimpsest.functions.patterns import Pattern, default_patterns
from palimpsest.functions.tokens import RESERVED, TOKEN_PREFIX, last_reserved, reserved_numbers, token

# A private-use character stands on both sides of a match while a text is being
# rewritten, so a split at it gives text, value, text, ..., text.  Texts that have
# it already are escaped with a second one for the duration.
_MARK, _ESC = "\ue000", "\ue001"
# From so many patterns on that have required literals of their own, these are looked for together.
TOGETHER = 16
_ESCAPES = ((_ESC, _ESC + "\ue003"), (_MARK, _ESC + "\ue002"))

MATCH_STRUCT = "array<struct<pattern:string,n:int>>"


def java_form(p: Pattern) -> tuple[str, int]:
    """A pattern's Java regex and the number of the group that holds the value."""
    if p.java:
        return p.java, 2
    regex = to_java(p.regex, first=p.first, word_left=p.word_left, word_right=p.word_right)
    return (split_on_group(regex), 2) if p.group else (regex, 0)


# Seven digits with at most two separators between neighbours.
_LONG_NUMBER = r"\d(?:[\s.()\-]{0,2}+\d){6}"


def with_shared_gates(text: Column, body: Callable[[Column], Column]) -> Column:
    """Run ``body`` with what the patterns' shared gates found in the text."""
    gates = let(
        text.rlike("[0-9]"),
        lambda digits: F.struct(digits.alias("digits"), (digits & text.rlike(_LONG_NUMBER)).alias("long_number")),
    )
    return let(gates, body)


def can_match(text: Column, gates: Column, p: Pattern) -> Column:
    """Whether the text fulfils what every match of the pattern needs."""
    tests = [F.lit(True)]
    if p.needs_digits:
        tests.append(gates["digits"])
    if p.needs_long_number:
        tests.append(gates["long_number"])
    if p.hint:
        tests.append(F.contains(text, F.lit(p.hint)))
    if p.needs:
        tests.append(reduce(or_, (F.contains(text, F.lit(literal)) for literal in p.needs)))
    if p.gate:
        tests.append(text.rlike(p.gate))
    return reduce(and_, tests)


def candidates(text: Column, patterns: Sequence[Pattern]) -> Column:
    """Positions (from 1) of the patterns that may match, ascending.

    The tests look at the original text only.  That is enough: tokens are set off
    by brackets, which no required literal contains, so a rewritten text has no
    required literal that the original lacks.
    """
    if not patterns:
        return F.array().cast("array<int>")
    places = list(enumerate(patterns, 1))
    together = [(i, p) for i, p in places if p.own_literals and p.needs]
    if len(together) < TOGETHER:
        together = []
    alone = [(i, p) for i, p in places if (i, p) not in together]
    tested = with_shared_gates(
        text, lambda gates: F.array_compact(F.array(*(F.when(can_match(text, gates, p), F.lit(i)) for i, p in alone)))
    )
    if not together:
        return tested
    return F.array_sort(F.concat(tested if alone else F.array().cast("array<int>"), _by_literal(text, together)))


def _by_literal(text: Column, patterns: Sequence[tuple[int, Pattern]]) -> Column:
    """Numbers of the patterns of which a required literal is in the text, which is gone through once."""
    wanted: dict[str, set[int]] = {}
    for literal, parts in prefixes(x for _, p in patterns for x in p.needs).items():
        wanted[literal] = {i for i, p in patterns if set(parts) & set(p.needs)}
    table = F.create_map(*(c for x, own in wanted.items() for c in (F.lit(x), F.array(*map(F.lit, sorted(own))))))
    # Looking ahead, so that literals that overlap are all found.
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({literal_trie(wanted)}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.element_at(table, x))))


def _choose(number: Column, options: Sequence[Column], first: int = 1) -> Column:
    """The option of that number, found by halving."""
    if len(options) == 1:
        return options[0]
    half = len(options) // 2
    return F.when(number < first + half, _choose(number, options[:half], first)).otherwise(
        _choose(number, options[half:], first + half)
    )


def _mark(text: Column, number: Column, patterns: Sequence[Pattern]) -> Column:
    """The text with marks around the pattern's matches, NULL if it has none."""

    def marked(p: Pattern) -> Column:
        regex, group = java_form(p)
        if group == 0:
            done = F.regexp_replace(text, F.lit(regex), F.lit(f"{_MARK}$0{_MARK}"))
        else:
            tail = "" if p.java else "$3"
            done = F.regexp_replace(text, F.lit(regex), F.lit(f"$1{_MARK}$2{_MARK}{tail}"))
        # Looking first is cheaper than a replacement that copies the text for nothing.
        return F.when(text.rlike(regex), done)

    return _choose(number, [marked(p) for p in patterns])


def _escape(text: Column) -> Column:
    escaped = text
    for char, code in _ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    clash = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_ESC))
    return F.when(clash, escaped).otherwise(text)


def _unescape(text: Column) -> Column:
    plain = text
    for char, code in reversed(_ESCAPES):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(F.contains(text, F.lit(_ESC)), plain).otherwise(text)


def _step(state: Column, number: Column, patterns: Sequence[Pattern], reserved: Column) -> Column:
    name = F.element_at(F.array(*(F.lit(p.name) for p in patterns)), number)
    category = F.element_at(F.array(*(F.lit(p.category) for p in patterns)), number)

    def used() -> Column:
        own = let(
            F.concat(F.lit(TOKEN_PREFIX), category, F.lit(":")),
            lambda prefix: F.size(F.filter(state["tokens"], lambda t: F.startswith(t, prefix))),
        )
        return own + last_reserved(reserved, category)

    def after(text: Column, values: Column, tokens: Column, n: Column) -> Column:
        return F.struct(
            text.alias("text"),
            values.alias("values"),
            tokens.alias("tokens"),
            F.concat(state["matches"], F.array(F.struct(name.alias("pattern"), n.alias("n")))).alias("matches"),
        )

    def rewritten(pieces: Column) -> Column:
        # a group that took part with nothing in it is neither replaced nor counted
        found = F.filter(pieces, lambda x, i: (i % 2 == 1) & (x != ""))

        def assembled(fresh: Column) -> Column:
            values = F.concat(state["values"], fresh)
            numbered = let(used(), lambda last: F.transform(fresh, lambda _, i: token(category, last + i + 1)))
            tokens = F.when(F.size(fresh) == 0, state["tokens"]).otherwise(F.concat(state["tokens"], numbered))
            return let(
                F.struct(values.alias("values"), tokens.alias("tokens")),
                lambda m: after(
                    with_lookup(
                        m["values"],
                        m["tokens"],
                        lambda find: F.array_join(
                            F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & (x != ""), find(x)).otherwise(x)), ""
                        ),
                    ),
                    m["values"],
                    m["tokens"],
                    F.size(found),
                ),
            )

        return let(F.array_except(found, state["values"]), assembled)

    def one_match(pieces: Column) -> Column:
        """The same for a single match, by far the most frequent number: nothing is looked up piece by piece."""
        value = F.get(pieces, F.lit(1))

        def with_token(own: Column) -> Column:
            return F.concat(F.get(pieces, F.lit(0)), own, F.get(pieces, F.lit(2)))

        def at_place(at: Column) -> Column:
            known = after(with_token(F.get(state["tokens"], at - 1)), state["values"], state["tokens"], F.lit(1))
            fresh = let(
                token(category, used() + 1),
                lambda own: after(
                    with_token(own), F.concat(state["values"], F.array(value)), F.concat(state["tokens"], F.array(own)), F.lit(1)
                ),
            )
            return F.when(at > 0, known).otherwise(fresh)

        return let(F.array_position(state["values"], value).cast("int"), at_place)

    return let(
        _mark(state["text"], number, patterns),
        lambda marked: F.when(marked.isNull(), state).otherwise(
            let(
                F.split(marked, _MARK, -1),
                lambda pieces: F.when(F.size(pieces) == 1, state)
                .when((F.size(pieces) == 3) & (F.get(pieces, F.lit(1)) != ""), one_match(pieces))
                .otherwise(rewritten(pieces)),
            )
        ),
    )


def _fold(
    text: Column, which: Column, values: Column, tokens: Column, patterns: Sequence[Pattern], reserved: Column
) -> Column:
    start = F.struct(
        text.alias("text"),
        values.alias("values"),
        tokens.alias("tokens"),
        F.array().cast(MATCH_STRUCT).alias("matches"),
    )
    if not patterns:
        return start
    return F.aggregate(which, start, lambda state, number: _step(state, number, patterns, reserved))


def redact(text: Column | str, patterns: Sequence[Pattern] | None = None) -> Column:
    """Tokenize one text, which is a scope of its own.

    Returns ``struct<text, values, tokens, matches>``: the rewritten text, the
    distinct values and their tokens in order of allocation, and how many matches
    each pattern had (repeats count).  A value may contain earlier tokens.
    ``patterns`` defaults to the default set; an empty list changes nothing.
    """
    text = F.col(text) if isinstance(text, str) else text
    patterns = default_patterns() if patterns is None else list(patterns)
    untouched = _fold(text, F.array().cast("array<int>"), no_strings(), no_strings(), [], F.array())
    return let(
        candidates(text, patterns),
        lambda which: F.when(F.size(which) == 0, untouched).otherwise(
            let(
                let(
                    reserved_numbers(text),
                    lambda reserved: _fold(_escape(text), which, no_strings(), no_strings(), patterns, reserved),
                ),
                lambda state: F.struct(
                    _unescape(state["text"]).alias("text"),
                    F.transform(state["values"], _unescape).alias("values"),
                    state["tokens"].alias("tokens"),
                    state["matches"].alias("matches"),
                ),
            )
        ),
    )


def redact_all(texts: Column, active: Column, patterns: Sequence[Pattern] | None = None) -> Column:
    """Tokenize an array of texts that share one scope, text by text.

    ``active`` is a parallel boolean array; inactive texts are kept as they are.
    Returns ``struct<values, tokens, parts: array<struct<text, matches>>>``.
    """
    patterns = default_patterns() if patterns is None else list(patterns)
    start = F.struct(
        no_strings().alias("values"),
        no_strings().alias("tokens"),
        F.array().cast(f"array<struct<text:string,matches:{MATCH_STRUCT}>>").alias("parts"),
    )

    def add(scope: Column, item: Column, reserved: Column) -> Column:
        text = item["text"]
        which = F.when(item["active"], candidates(text, patterns)).otherwise(F.array().cast("array<int>"))
        folded = _fold(_escape(text), which, scope["values"], scope["tokens"], patterns, reserved)
        return let(
            folded,
            lambda state: F.struct(
                state["values"].alias("values"),
                state["tokens"].alias("tokens"),
                F.concat(
                    scope["parts"],
                    F.array(F.struct(_unescape(state["text"]).alias("text"), state["matches"].alias("matches"))),
                ).alias("parts"),
            ),
        )

    items = F.zip_with(texts, active, lambda t, a: F.struct(t.alias("text"), a.alias("active")))
    shaped = F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit("TG")), F.lit(False)))
    taken = F.when(shaped, reserved_numbers(F.array_join(texts, "\n"))).otherwise(F.array().cast(RESERVED))
    return let(
        taken,
        lambda reserved: F.aggregate(
            items,
            start,
            lambda scope, item: add(scope, item, reserved),
            lambda scope: F.struct(
                F.transform(scope["values"], _unescape).alias("values"),
                scope["tokens"].alias("tokens"),
                scope["parts"].alias("parts"),
            ),
        ),
    )


def match_total(matches: Column) -> Column:
    """Matches over all patterns."""
    return F.aggregate(matches, F.lit(0), lambda total, m: total + m["n"])


def match_map(matches: Column) -> Column:
    """``map<pattern, n>`` of a ``matches`` array."""
    return F.map_from_entries(matches)


def mask(text: Column | str, patterns: Sequence[Pattern] | None = None) -> Column:
    """Replace every match by its bare category ``[TG:CATEGORY]``.

    No numbering and no mapping: for one-way masking, where values need not be
    told apart afterwards.
    """
    text = F.col(text) if isinstance(text, str) else text
    patterns = default_patterns() if patterns is None else list(patterns)
    if not patterns:
        return text

    def masked(state: Column, p: Pattern) -> Column:
        regex, group = java_form(p)
        label = f"[TG:{p.category}]"
        if group == 0:
            return F.regexp_replace(state, F.lit(regex), F.lit(label))
        tail = "" if p.java else "$3"
        return F.regexp_replace(state, F.lit(regex), F.lit(f"$1{label}{tail}"))

    return F.aggregate(
        candidates(text, patterns),
        text,
        lambda state, number: _choose(number, [masked(state, p) for p in patterns]),
    )
