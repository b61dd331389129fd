"""Restoring responses that arrive in chunks.

A token may be split over chunks.  Realigning the chunks, so that none ends
inside a token, is all that needs state; restoring itself is the same expression
as for whole texts.  The held tail is at most 64 characters per response, which is
longer than any token: ``functions/patterns.py`` bounds the categories.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.expr import lookup_table
from palimpsest.functions.tokens import MAX_TOKEN
from palimpsest.operators.restore import categories_of, restore, restore_exact, restore_fuzzy

MAX_TAIL = MAX_TOKEN
_QUOTE = "[\"'`]?"
# A spelling that the fuzzy restorer takes: more digits or a closing quote may follow.
_SPELLED = f"{_QUOTE}TG[:_][A-Z]+[:_][0-9]+{_QUOTE}"
# A start of a token or of a spelling, down to the bare bracket, quote or letter.
_STARTED = rf"(?:{_QUOTE}(?:TG[:_][A-Z]+[:_][0-9]*|TG[:_][A-Z]*|TG?)?|\[(?:TG:[A-Z]*:?[0-9]*|TG?)?)"
# What is held at the end of a text, possibly nothing.
TAIL_REGEX = f"(?:{_SPELLED})?{_STARTED}"
# All characters that may be held: what is held lies within the run of them at the end of a text.
_HELD_CHARS = "\"'`[:_ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

CHUNK_SCHEMA = "response_id string, seq bigint, chunk string, is_last boolean"
_ALIGNED = "response_id string, seq bigint, text string"


#: A response that sends nothing for so long is taken to have broken off.
IDLE_MS = 600_000


def realign_stream(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Move the start of a split token to the next chunk of its response.

    ``chunks`` is a stream ``(response_id, seq, chunk, is_last)``.  A row with
    ``is_last`` releases what is held; so does a response that sends nothing for
    ``idle_ms`` (None: waits for ever), with the number of its last chunk.  A chunk that
    comes in a later batch than one with a higher number passes through on its own: what
    is held neither joins it nor is lost.  Empty texts are not emitted.

    With a time-to-live Spark goes on with batches without data.  For a run over what
    is there use :func:`palimpsest.streaming.streams.run_available`, which ends.
    """
    tail_regex, max_tail = TAIL_REGEX, MAX_TAIL

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import re

        import pandas as pd

        held, last_seq = state.get if state.exists else ("", -1)
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({"response_id": [key[0]], "seq": [last_seq], "text": [held]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        ended, seqs, texts = False, [], []
        for seq, chunk, is_last in zip(rows["seq"], rows["chunk"], rows["is_last"]):
            chunk, ended = chunk or "", ended or bool(is_last)
            if seq < last_seq:
                if chunk:
                    seqs.append(int(seq))
                    texts.append(chunk)
                continue
            text, last_seq = held + chunk, int(seq)
            tail = "" if is_last else re.search(tail_regex + r"\Z", text[-max_tail:]).group()
            text, held = text[:len(text) - len(tail)], tail
            if text:
                seqs.append(last_seq)
                texts.append(text)
        if ended and not held:
            state.remove()
        else:
            state.update((held, last_seq))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"response_id": [key[0]] * len(seqs), "seq": seqs, "text": texts})

    released = chunks.groupBy("response_id").applyInPandasWithState(
        release,
        _ALIGNED,
        "held string, last_seq bigint",
        "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    # Rows from Python workers cannot be shuffled as they are (for a join with a large
    # mapping, say); an expression over them makes them rows that can.
    return released.select("response_id", "seq", F.coalesce("text", F.lit("")).alias("text"))


# Stretches of a response that a batch job handles on their own.
STRETCH_CHUNKS = 1 << 12


def _numbered(chunks: DataFrame) -> DataFrame:
    """The chunks that have text, with their place ``n`` in the response: from 0, without gaps.

    Ranks are taken within stretches of ``seq``; the counts of the stretches before are
    added, so that no task goes through a whole response.
    """
    rows = chunks.filter(F.length("chunk") > 0).select(
        "response_id", "seq", "chunk", F.floor(F.col("seq") / STRETCH_CHUNKS).alias("part")
    )
    before = Window.partitionBy("response_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("response_id", "part")
        .agg(F.count("*").alias("size"))
        .select(
            F.col("response_id").alias("of"),
            F.col("part").alias("of_part"),
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("response_id", "part").orderBy("seq", "chunk"))
    same = F.col("response_id").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("of_part"))
    return (
        rows.withColumn("rank", rank)
        .join(offsets, same)
        .select("response_id", "seq", "chunk", (F.col("offset") + F.col("rank") - 1).alias("n"))
    )


def realign(chunks: DataFrame) -> DataFrame:
    """The same for a finished archive of chunks, without state.

    What is held before a chunk only depends on the last 64 characters before it, and of
    these on the run at their end of characters that can be held.  Most chunks end such a run,
    so few have to look back, over at most 64 chunks that have text.  Empty chunks and gaps in
    ``seq`` do not matter.  A long response is cut into stretches, each with the chunks
    around it as context, so that no task has to go through a whole response.  A
    response's last chunk releases what is held, whether it is marked as the last or the
    response broke off.
    """
    stretch = F.floor(F.col("n") / STRETCH_CHUNKS)
    place = F.col("n") % STRETCH_CHUNKS
    copies = F.array_compact(
        F.array(
            stretch,
            F.when(place >= STRETCH_CHUNKS - MAX_TAIL, stretch + 1),
            F.when(place == 0, stretch - 1),
        )
    )
    end = F.right("chunk", F.lit(MAX_TAIL))
    rows = (
        _numbered(chunks)
        .withColumn("stretch", F.explode(copies))
        .withColumn("run", F.right(end, F.length(end) - F.length(F.rtrim(end, F.lit(_HELD_CHARS)))))
        .withColumn("ends", (F.length("run") < F.length(end)).cast("int"))
    )
    in_order = Window.partitionBy("response_id", "stretch").orderBy("n")
    # A run goes on until a chunk ends it; the chunks that a run before them reaches are together.
    reached = (
        rows.withColumn("last_run", F.lag("run").over(in_order))
        .withColumn("together", F.coalesce(F.sum("ends").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("next", F.lead("n").over(in_order))
    )
    so_far = Window.partitionBy("response_id", "stretch", "together").orderBy("n").rowsBetween(1 - MAX_TAIL, 0)
    tail = rf"({TAIL_REGEX})\z"

    def held(run: Column) -> Column:
        return F.when(run == "", run).otherwise(F.regexp_extract(F.right(run, F.lit(MAX_TAIL)), tail, 1))

    joined = F.concat("held", "chunk")
    run_after = F.when(F.col("ends") == 1, F.col("run")).otherwise(F.concat("before", "run"))
    kept = F.when(F.col("next").isNull(), F.lit("")).otherwise(held(run_after))
    return (
        reached.withColumn("before", F.right(F.array_join(F.collect_list("last_run").over(so_far), ""), F.lit(MAX_TAIL)))
        .filter(F.col("stretch") == stretch)
        .withColumn("held", held(F.col("before")))
        .select("response_id", "seq", F.substr(joined, F.lit(1), F.length(joined) - F.length(kept)).alias("text"))
        .filter(F.length("text") > 0)
    )


def restore_chunks(aligned: DataFrame, mapping: DataFrame, restorer=restore_fuzzy) -> DataFrame:
    """Restore realigned chunks with ``mapping (request_id, tokens, values)``.

    A response without a mapping passes through.  Works on streams and tables.  A
    mapping's lookup table and categories are worked out before the join, once for a
    response and not for each of its chunks; a restorer other than this package's is
    called without them.
    """
    text, tokens, values, table = (F.col(c) for c in ("text", "tokens", "values", "table"))
    by_response = mapping.select(
        F.col("request_id").alias("response_id"),
        "tokens",
        "values",
        lookup_table(F.col("tokens"), F.col("values")).alias("table"),
        categories_of(F.col("tokens")).alias("categories"),
    )
    if restorer is restore_fuzzy:
        done = restore_fuzzy(text, tokens, values, table, F.col("categories"))
    elif restorer in (restore, restore_exact):
        done = restorer(text, tokens, values, table)
    else:
        done = restorer(text, tokens, values)
    joined = aligned.join(by_response, "response_id", "left")
    return joined.select("response_id", "seq", F.when(tokens.isNotNull(), done).otherwise(text).alias("text"))
