"""Redacting values that stand in a text in an encoded form.

Runs of base64, hexadecimal digits, percent escapes and character entities are decoded,
a decoded text again as often as it is nested; the patterns look at the text as decoded.
What they find is followed back to where it stands: the encoded form gets the token, is
what the mapping holds, and is put back on restoring.  Neither form is handed on.

    bWFpbCBhQGIuY29t  ->  [TG:EMAIL:1]        id=user%40example.com&x  ->  id=[TG:EMAIL:1]&x
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.expr import let, no_strings, split_at, with_lookup
from palimpsest.functions.patterns import Pattern
from palimpsest.functions.tokens import (
    TOKEN_REGEX, last_reserved, reserved_numbers, token, token_category, token_number, tokens_in,
)
from palimpsest.operators.redact import redact
from palimpsest.operators.restore import restore

#: How often a decoded text is looked through for further encoded runs.
DEPTH = 3

# A run of each kind.  Base64 of seven bytes or more has a capital letter after another character.
_PERCENT = r"(?:%[0-9A-Fa-f]{2})++"
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "commat": "@", "period": ".", "colon": ":", "sol": "/", "nbsp": " "}
_ENTITY = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|{'|'.join(_NAMED)});"
_HEX = r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){7,}+(?![0-9A-Za-z])"
_BASE64 = r"(?:(?<![A-Za-z0-9+/_\-])|(?<=%[0-9A-Fa-f]{2}))(?=[A-Za-z0-9+/_\-]*?[A-Za-z0-9+/_\-][A-Z])[A-Za-z0-9+/_\-]{10,}+={0,2}"
_RUN = f"{_PERCENT}|{_ENTITY}|{_HEX}|{_BASE64}"
# Decoded text with a character that does not occur in texts: the run was no text.
_UNREADABLE = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]"


def _readable(binary: Column) -> Column:
    """Bytes as text, NULL if they are none."""
    text = F.try_validate_utf8(binary.cast("string"))
    return let(text, lambda t: F.when((t != "") & ~t.rlike(_UNREADABLE), t))


def _character(number: Column) -> Column:
    """The character with this code point, NULL if there is none."""
    valid = number.between(32, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    # Any other number stands in for an invalid one, whose character is not used.
    code = F.when(valid, number).otherwise(F.lit(32))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _decoded(run: Column) -> Column:
    """One run decoded once, NULL if it is not the encoded form of a text."""
    body = F.substr(run, F.lit(3), F.length(run) - 3)
    named = F.element_at(
        F.create_map(*(F.lit(x) for kv in _NAMED.items() for x in kv)), F.substr(run, F.lit(2), F.length(run) - 2)
    )
    entity = (
        F.when(run.rlike(r"\A&#[0-9]"), _character(body.cast("long")))
        .when(run.rlike(r"\A&#"), _character(F.conv(F.substr(body, F.lit(2)), 16, 10).cast("long")))
        .otherwise(named)
    )
    plain = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return (
        F.when(F.startswith(run, F.lit("%")), _readable(F.unhex(F.replace(run, F.lit("%"), F.lit("")))))
        .when(F.startswith(run, F.lit("&")), entity)
        .when(run.rlike(rf"\A(?:[0-9A-Fa-f]{{2}}){{7,}}\z"), _readable(F.unhex(run)))
        .when(F.length(plain) % 4 != 1, _readable(F.try_to_binary(padded, F.lit("base64"))))
    )


def _units(text: Column) -> Column:
    """The text in order as ``array<struct<raw, plain, coded>>``: what stands between runs, and runs with what they say."""
    none = F.lit(None).cast("string")
    gap = lambda g: F.struct(g.alias("raw"), g.alias("plain"), F.lit(False).alias("coded"))

    def unit(run: Column) -> Column:
        return let(
            _decoded(run),
            lambda d: F.struct(run.alias("raw"), F.coalesce(d, run).alias("plain"), d.isNotNull().alias("coded")),
        )

    def woven(p: Column) -> Column:
        pairs = F.zip_with(p["gaps"], p["runs"], lambda g, r: F.array(gap(g), F.when(r.isNull(), gap(none)).otherwise(unit(r))))
        return F.filter(F.flatten(pairs), lambda u: u["raw"].isNotNull() & (u["raw"] != ""))

    parts = F.struct(split_at(text, _RUN).alias("gaps"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)).alias("runs"))
    return let(parts, woven)


def _plain(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: u["plain"]), "")


def _unwrapped(text: Column) -> Column:
    """The text with what is encoded in it decoded, as deep as it goes."""
    return F.aggregate(
        F.sequence(F.lit(2), F.lit(DEPTH)),
        text,
        lambda t, _: F.when(t.rlike(_RUN), _plain(_units(t))).otherwise(t),
    )


def _deep(units: Column) -> Column:
    """Units with their runs decoded at any depth, and where each begins and ends in the decoded text."""
    inner = F.transform(
        units,
        lambda u: F.when(
            u["coded"], F.struct(u["raw"].alias("raw"), _unwrapped(u["plain"]).alias("plain"), u["coded"].alias("coded"))
        ).otherwise(u),
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("from_raw"),
        F.array().cast("array<struct<lo:int,hi:int,raw_lo:int,raw_hi:int,coded:boolean>>").alias("spans"),
    )

    def add(acc: Column, u: Column) -> Column:
        hi, raw_hi = acc["at"] + F.length(u["plain"]), acc["from_raw"] + F.length(u["raw"])
        span = F.struct(
            acc["at"].alias("lo"), hi.alias("hi"), acc["from_raw"].alias("raw_lo"), raw_hi.alias("raw_hi"), u["coded"].alias("coded")
        )
        return F.struct(hi.alias("at"), raw_hi.alias("from_raw"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return let(
        inner,
        lambda i: F.struct(_plain(i).alias("text"), F.aggregate(i, start, add, lambda acc: acc["spans"]).alias("spans")),
    )


def _found(r: Column) -> Column:
    """Where the values that a redacted text has tokens for stand in the text itself: ``array<struct<lo, hi, token>>``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int,token:string>>").alias("found"))

    def by_piece(find) -> Column:
        def add(acc: Column, piece: Column) -> Column:
            lo = acc["at"] + F.length(piece["gap"])
            value = find(piece["token"])
            hi = lo + F.coalesce(F.length(value), F.length(piece["token"]), F.lit(0))
            one = F.array(F.struct(lo.alias("lo"), hi.alias("hi"), piece["token"].alias("token")))
            return F.struct(hi.alias("at"), F.when(value.isNotNull(), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

        pieces = F.arrays_zip(split_at(r["text"], TOKEN_REGEX).alias("gap"), tokens_in(r["text"]).alias("token"))
        return F.aggregate(pieces, start, add, lambda acc: acc["found"])

    whole = F.transform(r["values"], lambda v: restore(v, r["tokens"], r["values"]))
    return with_lookup(r["tokens"], whole, by_piece)


def _unit_at(spans: Column, position: Column) -> Column:
    """Number (from 1) of the unit that a position of the decoded text lies in, by halving."""

    def halve(bounds: Column, _: Column) -> Column:
        mid = F.floor((bounds["lo"] + bounds["hi"]) / 2).cast("int")
        after = F.element_at(spans, mid)["hi"] <= position
        return F.when(
            bounds["lo"] < bounds["hi"],
            F.struct(F.when(after, mid + 1).otherwise(bounds["lo"]).alias("lo"), F.when(after, bounds["hi"]).otherwise(mid).alias("hi")),
        ).otherwise(bounds)

    start = F.struct(F.lit(1).alias("lo"), F.size(spans).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans))).cast("int"))
    return F.aggregate(steps, start, halve, lambda bounds: bounds["lo"])


def _placed(found: Column, spans: Column) -> Column:
    """The same in the text as it stands.  An encoded run goes as a whole: a value that begins in the run of
    the value before goes with it, up to its own end."""

    def back(f: Column) -> Column:
        def between(i: Column) -> Column:
            first, last = F.element_at(spans, i["first"]), F.element_at(spans, i["last"])
            lo = F.when(first["coded"], first["raw_lo"]).otherwise(first["raw_lo"] + f["lo"] - first["lo"])
            hi = F.when(last["coded"], last["raw_hi"]).otherwise(last["raw_hi"] - (last["hi"] - f["hi"]))
            touched = F.slice(spans, i["first"], i["last"] - i["first"] + 1)
            coded = F.exists(touched, lambda s: s["coded"])
            return F.struct(lo.alias("lo"), hi.alias("hi"), f["token"].alias("token"), coded.alias("coded"))

        return let(F.struct(_unit_at(spans, f["lo"]).alias("first"), _unit_at(spans, f["hi"] - 1).alias("last")), between)

    none = F.array().cast("array<struct<lo:int,hi:int,token:string,coded:boolean>>")

    def add(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], f["hi"]).alias("hi"), last["token"].alias("token"), F.lit(True).alias("coded"))
        return F.when(
            (F.size(kept) > 0) & (f["lo"] < F.try_element_at(kept, F.lit(-1))["hi"]),
            F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(longer)),
        ).otherwise(F.concat(kept, F.array(f)))

    return F.aggregate(F.transform(found, back), none, add)


def _assembled(text: Column, placed: Column, reserved: Column, matches: Column) -> Column:
    """The text with tokens for what stands there: a value's first form keeps its token, any other is
    numbered after the category's last."""
    forms = F.transform(placed, lambda p: p.withField("form", F.substr(text, p["lo"] + 1, p["hi"] - p["lo"])))

    def numbered(forms: Column) -> Column:
        every, given = F.transform(forms, lambda f: f["form"]), F.transform(forms, lambda f: f["token"])

        def named(values: Column, first: Column) -> Column:
            again = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.array_position(first, F.get(first, i)) != i + 1)

            def one(i: Column, nth: Column) -> Column:
                category = token_category(F.get(first, i))
                own = F.transform(F.filter(given, lambda t: token_category(t) == category), token_number)
                before = F.size(F.filter(F.slice(again, 1, nth), lambda k: token_category(F.get(first, k)) == category))
                return token(category, F.greatest(F.array_max(own), last_reserved(reserved, category)) + before + 1)

            fresh = F.transform(again, one)
            return let(
                F.struct(again.alias("at"), fresh.alias("tokens")),
                lambda x: F.transform(first, lambda t, i: F.coalesce(F.get(x["tokens"], (F.array_position(x["at"], i) - 1).cast("int")), t)),
            )

        def lookup(values: Column) -> Column:
            first = with_lookup(every, given, lambda find: F.transform(values, find))
            return let(first, lambda f: F.struct(values.alias("values"), named(values, f).alias("tokens"), forms.alias("forms")))

        return let(F.array_distinct(every), lookup)

    def written(m: Column) -> Column:
        def pieces(find) -> Column:
            start = F.struct(F.lit(0).alias("at"), no_strings().alias("out"))

            def add(acc: Column, f: Column) -> Column:
                before = F.substr(text, acc["at"] + 1, f["lo"] - acc["at"])
                return F.struct(f["hi"].alias("at"), F.concat(acc["out"], F.array(before, find(f["form"]))).alias("out"))

            return F.aggregate(
                m["forms"], start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
            )

        return F.struct(
            with_lookup(m["values"], m["tokens"], pieces).alias("text"), m["values"].alias("values"), m["tokens"].alias("tokens"),
            matches.alias("matches"), F.size(F.filter(m["forms"], lambda f: f["coded"])).alias("encoded"),
        )

    return let(let(forms, numbered), written)


def redact_encoded(
    df: DataFrame, text: str, patterns: Sequence[Pattern] | None = None, name: str = "redacted"
) -> DataFrame:
    """``df`` with a column like that of :func:`palimpsest.operators.redact.redact`, which also finds values in encoded forms.

    The struct has ``encoded`` added, the number of values that stood in an encoded form.  A
    base64, hexadecimal or escaped run that a value reaches into gets the value's token as a whole, so its
    neighbours in the same run go with it; in text between runs a value is cut out to the character.
    ``values`` holds what stood in the text: the encoded form.  Two forms of one value have two tokens.

    A text without encoded values gets what ``redact`` gives.  Runs are decoded ``DEPTH`` levels deep.
    Base64 needs ten characters or more and a capital letter after the first, hexadecimal digits
    fourteen; a run that does not decode to readable text is left as text.  Where there are encoded values, each
    value found costs a walk through the text.  No shuffle; works on streams.
    """
    source, units, deep, r, placed = F.col(text), F.col("_units"), F.col("_deep"), F.col("_r"), F.col("_placed")
    coded = lambda spans: F.exists(spans, lambda u: u["coded"])
    plain = lambda r: F.struct(*(r[c].alias(c) for c in ("text", "values", "tokens", "matches")), F.lit(0).alias("encoded"))
    # Step by step: in one expression the steps would be nested deeper than Spark's analyzer goes.
    steps = (
        df.withColumn("_units", F.when(source.rlike(_RUN), _units(source)))
        .withColumn("_deep", F.when(coded(units), _deep(units)))
        .withColumn("_r", redact(F.coalesce(deep["text"], source), patterns))
        .withColumn("_placed", F.when(deep.isNotNull(), _placed(_found(r), deep["spans"])))
        .withColumn("_placed", F.when(coded(placed), placed))
        .withColumn("_plain", F.when(deep.isNull(), r).when(placed.isNull(), redact(source, patterns)))
    )
    done = F.when(placed.isNotNull(), _assembled(source, placed, reserved_numbers(source), r["matches"])).otherwise(plain(F.col("_plain")))
    return steps.select(*df.columns, done.alias(name))
