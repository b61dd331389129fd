"""Restoring responses in chunks whose mapping arrives in a stream as well.

Chunks and mappings meet in keyed state, in whatever order they come: a response holds its own
mapping, entry by entry, the start of a token at its end, and the pieces with tokens for which
no mapping has come yet.  So a micro-batch reads no mapping but those of its own responses, and
of these no entry but those its chunks ask for.  Each call to the state and each row costs as much as
many characters: a response's chunks that follow one another in a file come as one row, and
the state is not asked for what it cannot have.

Whatever is held goes on when a response has been silent for a time, by the events' own stamps.
A clock, a stream of stamps, moves the time on when no response does: after the last event of a
run over what is there, :func:`run_responses` lets it strike, so that nothing waits for a later run.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.operators.restore import restore_fuzzy
from palimpsest.session import settings
from palimpsest.streaming.chunks import _HELD_CHARS, MAX_TAIL, TAIL_REGEX
from palimpsest.streaming.scopes import STATE_STORE

CHUNKS = "response_id string, seq bigint, chunk string, is_last boolean, at timestamp"
MAPPINGS = "request_id string, tokens array<string>, values array<string>, at timestamp"
CLOCK = "at timestamp"

#: A response that is silent for so long has ended, or broken off; its mapping is forgotten then.
IDLE = dt.timedelta(minutes=10)
#: How much later than others, by its stamp, an event may come without its response being taken for silent.
DELAY = dt.timedelta(0)

#: Entries of a mapping, and characters of them, that are kept with what is known of the response;
#: beyond that each is an entry of the state by itself, and only those asked for are read.
FEW, FEW_CHARS = 32, 4096
_OPEN = "held string, last_seq bigint, mapped boolean, at bigint, timed boolean, tokens array<string>, values array<string>, ords array<int>, more boolean"

# A token, or a spelling of one that is restored as well.
_SPELLED = r"TG[:_]([A-Z]+)[:_]([0-9]+)"
_PIECES = "response_id string, seq bigint, part int, text string, tokens array<string>, values array<string>"
_Piece = Row("response_id", "seq", "part", "text", "tokens", "values")
_TOGETHER = "response_id string, seqs array<bigint>, chunks array<string>, lasts array<boolean>, micros bigint"
RESTORED = "response_id string, seq bigint, part int, text string"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the chunks of a response that follow one another in a batch, with the latest of their stamps."""
    for batch in batches:
        if not batch.num_rows:
            continue
        response, seq, chunk, last, micros = batch.columns
        code = response.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        offsets = pa.array(np.append(first, len(code)), pa.int32())
        none = np.iinfo(np.int64).min
        latest = np.maximum.reduceat(micros.fill_null(none).to_numpy(), first)
        lists = [pa.ListArray.from_arrays(offsets, column) for column in (seq, chunk, last)]
        yield pa.RecordBatch.from_arrays(
            [response.take(pa.array(first)), *lists, pa.array(latest, mask=latest == none)],
            names=["response_id", "seqs", "chunks", "lasts", "micros"],
        )


class _Restorer(StatefulProcessor):
    """Takes frames of single events."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        import re

        self.handle = handle
        self.mapping = handle.getMapState("mapping", "token string", "value string, ord int")
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getListState("waiting", "seq bigint, text string")
        self.tail = re.compile(f"{TAIL_REGEX}\\Z")
        self.spelled = re.compile(_SPELLED)

    def _entries(self, text: str, known: dict, stored: bool) -> tuple[list[str], list[str]]:
        """What the mapping has for the text, and for the values that this brings in, in the mapping's order."""
        found, asked = {}, [text]
        while asked:
            asking = asked.pop()
            for category, number in self.spelled.findall(asking) if "TG" in asking else ():
                token = f"[TG:{category}:{number}]"
                if token in found:
                    continue
                if token not in known:
                    there = stored and self.mapping.containsKey((token,))
                    known[token] = self.mapping.getValue((token,)) if there else None
                if known[token] is not None:
                    found[token] = known[token]
                    asked.append(known[token][0])
        tokens = sorted(found, key=lambda t: found[t][1])
        return tokens, [found[t][0] for t in tokens]

    def _held(self, text: str) -> str:
        """The start of a token at the end, which lies in the run there of characters that can be held."""
        end = text[-MAX_TAIL:]
        run = end[len(end.rstrip(_HELD_CHARS)) :]
        return self.tail.search(run).group() if run else ""

    def _rows(self, key, pieces: list[tuple[int, str]], mapped: bool, tail: tuple[int, str], known: dict, stored: bool) -> list[Row]:
        """``known`` are entries at hand; the others are in the state, if any are (``stored``)."""
        parts = [(seq, 0, text) for seq, text in pieces] + [(tail[0], 1, tail[1])]
        return [_Piece(key[0], *p, *(self._entries(p[2], known, stored) if mapped else ([], []))) for p in parts if p[2]]

    def _worked(self, key, chunks: list[tuple[int, str, bool]], mappings: list[tuple[list[str], list[str]]], ms: int | None) -> list[Row]:
        """The pieces that a response's events of a micro-batch, the latest at ``ms``, make ready."""
        if key[0] is None:
            # The clock, and chunks of no response, which have no mapping.
            return self._rows(key, [(seq, chunk) for seq, chunk, _ in chunks], False, (0, ""), {}, False)
        before = tuple(self.open.get() or ())
        held, last_seq, had, at, timed, *entries, stored = before or ("", -1, False, 0, False, [], [], [], False)
        at = at if ms is None else max(at, ms)
        few = {t: (v, i) for t, v, i in zip(*entries)}
        # Without entries of their own the state need not be asked for them.
        fresh: dict[str, tuple[str, int]] = {}
        for tokens, values in mappings:
            for i, (token, value) in enumerate(zip(tokens, values)):
                if token not in few and token not in fresh and not (stored and self.mapping.containsKey((token,))):
                    fresh[token] = (value, i)
        mapped, known, more = had or bool(mappings), few | fresh, stored
        if len(known) <= FEW and sum(len(t) + len(v or "") for t, (v, _) in known.items()) <= FEW_CHARS:
            few |= fresh
        else:
            for token, entry in fresh.items():
                self.mapping.updateValue((token,), entry)
            more = more or bool(fresh)
        ready: list[tuple[int, str]] = []
        # Pieces wait from a batch before until the first mapping comes.
        if before and mapped and not had and self.waiting.exists():
            ready += [(seq, text) for seq, text in self.waiting.get()]
            self.waiting.clear()
        wait: list[tuple[int, str]] = []
        for seq, chunk, is_last in sorted(chunks, key=lambda x: x[0]):
            if seq < last_seq:
                # What comes late passes on its own: what is held neither joins it nor is lost.
                text = chunk
            else:
                text, last_seq = held + chunk, seq
                held = "" if is_last else self._held(text)
                text = text[: len(text) - len(held)]
            (ready if mapped or "TG" not in text else wait).append((seq, text))
        if wait:
            self.waiting.appendList([(seq, text) for seq, text in wait])
        if not timed:
            # One timer a response; when it strikes it looks whether the response was silent.
            self.handle.registerTimer(at + self.idle_ms)
        self.open.update((held, last_seq, mapped, at, True, list(few), [v for v, _ in few.values()], [i for _, i in few.values()], more))
        return self._rows(key, ready, mapped, (0, ""), known, stored)

    def _expired(self, key, timerValues) -> list[Row]:
        held, last_seq, mapped, at, _, *entries, more = self.open.get()
        if at + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(at + self.idle_ms)
            return []
        # Only a response without a mapping has pieces that wait.
        left = [] if mapped else [(seq, text) for seq, text in self.waiting.get()]
        out = self._rows(key, left, mapped, (last_seq, held), {t: (v, i) for t, v, i in zip(*entries)}, more)
        if left:
            self.waiting.clear()
        if more:
            self.mapping.clear()
        self.open.clear()
        return out

    def _frame(self, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in rows], columns=["response_id", "seq", "part", "text", "tokens", "values"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for frame in rows for e in frame.itertuples(index=False)]
        chunks = [(int(e.seq), e.chunk or "", e.is_last) for e in events if e.kind == "chunk"]
        mappings = [(e.tokens, e.values) for e in events if e.kind == "mapping"]
        yield self._frame(self._worked(key, chunks, mappings, max(int(e.ms) for e in events)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._expired(key, timerValues))

    def close(self) -> None:
        pass


class _RowRestorer(_Restorer):
    """Takes rows of chunks that came together, and of mappings; for few rows a frame costs more than the work."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chunks, mappings, latest = [], [], None
        for row in rows:
            if row.kind == "chunk":
                chunks += zip(row.seqs, row.chunks, row.lasts)
            elif row.kind == "mapping":
                mappings.append((row.tokens, row["values"]))
            if row.ms is not None:
                latest = row.ms if latest is None else max(latest, row.ms)
        yield from self._worked(key, chunks, mappings, latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._expired(key, timerValues)


# The process that keeps a stream's state gets the processor as it is, and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def restore_responses_stream(
    chunks: DataFrame,
    mappings: DataFrame,
    clock: DataFrame | None = None,
    idle: dt.timedelta = IDLE,
    delay: dt.timedelta = DELAY,
    restorer: Callable = restore_fuzzy,
) -> DataFrame:
    """Restored pieces ``(response_id, seq, part, text)`` of responses, from streams as in ``CHUNKS`` and ``MAPPINGS``.

    ``seq`` is that of the chunk that completed the piece; a tail that was held until its response fell
    silent follows the last one, as its part 1.

    A mapping may come before, between or after the chunks of its response; pieces with tokens
    wait for it, others do not.  A second mapping of a response adds entries, of equal tokens the first
    counts.  A row with ``is_last`` releases what is held at the end; so does silence for ``idle``, which
    also releases pieces without a mapping, as they are, and ends the response's state.  A
    mapping that waits longer than ``idle`` for its first chunk is forgotten.  Empty texts are not emitted.
    Chunks of no response pass through.

    Silence is told by the stamps ``at``, against the latest stamp of any event less ``delay``; the
    ``clock`` has stamps only.  Events older than that are worked on all the same.  A task holds the
    chunks of one response in one micro-batch.  Start the query within ``settings(spark, STATE_STORE)``, or use
    :func:`run_responses`.
    """
    none = F.lit(None)
    strings = none.cast("array<string>")
    together = chunks.select(
        "response_id", F.coalesce("seq", F.lit(-1).cast("bigint")), F.coalesce("chunk", F.lit("")),
        F.coalesce("is_last", F.lit(False)), F.unix_micros("at"),
    ).mapInArrow(_together, _TOGETHER)
    events = together.select(
        "response_id", F.lit("chunk").alias("kind"), "seqs", "chunks", "lasts",
        strings.alias("tokens"), strings.alias("values"), F.timestamp_micros("micros").alias("at"),
    ).unionByName(
        mappings.filter("request_id IS NOT NULL").select(
            F.col("request_id").alias("response_id"), F.lit("mapping").alias("kind"), "tokens", "values", "at",
        ),
        allowMissingColumns=True,
    )
    if clock is not None:
        events = events.unionByName(clock.select("at", F.lit("clock").alias("kind")), allowMissingColumns=True)
    stamped = events.withWatermark("at", f"{int(delay.total_seconds() * 1000)} milliseconds")
    # The stamp itself does not go on: an event behind the watermark is late, not lost.
    plain = stamped.select("response_id", "kind", "seqs", "chunks", "lasts", "tokens", "values", F.unix_millis("at").alias("ms"))
    pieces = plain.groupBy("response_id").transformWithState(
        _RowRestorer(int(idle.total_seconds() * 1000)), outputStructType=_PIECES, outputMode="Append", timeMode="EventTime"
    )
    text, tokens = F.col("text"), F.col("tokens")
    return pieces.select(
        "response_id", "seq", "part", F.when(F.size(tokens) > 0, restorer(text, tokens, F.col("values"))).otherwise(text).alias("text")
    )


def strike(spark: SparkSession, clock: str, at: dt.datetime | None = None) -> None:
    """Write a stamp, by default that of now, to the clock's folder."""
    stamp = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    spark.range(1).select(stamp.alias("at")).coalesce(1).write.mode("append").parquet(clock)


def run_responses(stream: DataFrame, output: str, checkpoint: str, clock: str, at: dt.datetime | None = None) -> None:
    """Write what is there to Parquet, then what has been silent until ``at`` (by default now), and stop.

    ``clock`` is the folder of the clock that ``stream`` was built with.  It strikes when all events
    that were there are worked on, and not before: a response is not taken for silent while its chunks
    are still to be read.
    """
    spark = stream.sparkSession
    for last in (False, True):
        if last:
            strike(spark, clock, at)
        with settings(spark, STATE_STORE):
            query = (
                stream.writeStream.format("parquet")
                .option("checkpointLocation", checkpoint)
                .outputMode("append")
                .trigger(availableNow=True)
                .start(output)
            )
            query.awaitTermination()
