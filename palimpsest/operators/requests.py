"""JSON requests to content blocks and back.

Bodies are read as VARIANT, because a message's ``content`` may be a string or
an array of parts.  A request stays one row: its messages are an array column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.expr import let
from palimpsest.operators.rules import trim_space

MESSAGE = (
    "struct<is_object:boolean,role:string,content:string,file_path:string,"
    "command:string,is_tool_result:boolean,is_system:boolean>"
)


def _kind(value: Column) -> Column:
    return F.coalesce(F.split_part(F.schema_of_variant(value), F.lit("<"), F.lit(1)), F.lit("VOID"))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string_member(value: Column, name: str) -> Column:
    """A member's value if it is a JSON string, else NULL."""
    return let(
        _member(value, name),
        lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def messages(body: Column) -> Column:
    """The ``messages`` array of a request body; NULL for other JSON or no JSON."""
    return F.try_variant_get(F.try_parse_json(body), "$.messages", "array<variant>")


def message_text(message: Column, with_nested: bool = True) -> Column:
    """The text of a message: its string content, or the ``text`` and ``content``
    strings of its content parts, each followed by a newline."""

    def part_text(part: Column) -> Column:
        found = [_string_member(part, "text")] + ([_string_member(part, "content")] if with_nested else [])
        return F.concat(*(F.coalesce(F.concat(f, F.lit("\n")), F.lit("")) for f in found))

    def of(content: Column) -> Column:
        parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda p: _kind(p) == "OBJECT")
        return (
            F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string"))
            .when(_kind(content) == "ARRAY", F.array_join(F.transform(parts, part_text), ""))
            .otherwise(F.lit(""))
        )

    return let(_member(message, "content"), of)


def _header_line(content: Column, names: str) -> Column:
    """The rest of the first line that starts with one of the names and a colon."""
    line = F.regexp_extract(content, rf"(?mid)^[^\S\n]*(?:{names}):(.*)$", 1)
    return F.when(F.contains(content, F.lit(":")), trim_space(line)).otherwise(F.lit(""))


def declared_path(content: Column) -> Column:
    """The path after the first ``file:`` or ``path:`` line head, ``""`` if none."""
    return _header_line(content, "file|path")


def declared_command(content: Column) -> Column:
    """The command after the first ``command:`` or ``cmd:`` line head, ``""`` if none."""
    return _header_line(content, "command|cmd")


def _block(message: Column) -> Column:
    role = F.coalesce(_string_member(message, "role"), F.lit(""))
    calls = _member(message, "tool_calls").isNotNull()
    answers = F.coalesce(_string_member(message, "tool_call_id"), F.lit("")) != ""
    return let(
        F.struct(message_text(message).alias("content"), role.alias("role")),
        lambda m: F.struct(
            (_kind(message) == "OBJECT").alias("is_object"),
            m["role"].alias("role"),
            m["content"].alias("content"),
            declared_path(m["content"]).alias("file_path"),
            declared_command(m["content"]).alias("command"),
            (m["role"].isin("tool", "assistant") & (calls | answers)).alias("is_tool_result"),
            (m["role"] == "system").alias("is_system"),
        ).cast(MESSAGE),
    )


def parse_blocks(body: Column) -> Column:
    """One block per message, in order, as ``array<struct<...>>``.

    Empty for bodies without messages.  Messages that are not objects keep their
    place with ``is_object = false`` and are no content blocks.
    """
    return F.coalesce(F.transform(messages(body), _block), F.array().cast(f"array<{MESSAGE}>"))


def rebuild_body(body: Column, contents: Column) -> Column:
    """The body with new message contents; ``contents`` has NULL where nothing changes.

    All other members are kept.  Members come out in key order.
    """

    def with_content(message: Column, content: Column) -> Column:
        members = F.try_variant_get(message, "$", "map<string,variant>")
        others = F.to_json(F.map_filter(members, lambda k, _: k != "content"))
        own = F.to_json(F.struct(content.alias("content")))
        joined = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substr(others, F.lit(2)))
        return F.when(content.isNull(), F.to_json(message)).when(others == "{}", own).otherwise(joined)

    def rebuilt(found: Column) -> Column:
        return F.concat(
            F.lit("["), F.array_join(F.zip_with(found, contents, with_content), ","), F.lit("]")
        )

    def whole(found: Column) -> Column:
        members = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
        changed = F.transform_values(
            members, lambda k, v: F.when(k == "messages", F.try_parse_json(rebuilt(found))).otherwise(v)
        )
        return F.to_json(changed)

    untouched = F.coalesce(F.size(F.filter(contents, lambda c: c.isNotNull())) == 0, F.lit(True))
    return F.when(untouched, body).otherwise(F.coalesce(let(messages(body), whole), body))
