"""Path rules from tables of any size: an index of globs, and joins on equal keys.

Every glob has parts that a path it matches must have as well: its leading segments, its
last one, the beginning or end of that, any other whole segment, or three characters in a
row.  Of these the one is taken that the fewest of the given paths have.  Paths and globs
meet where they share it, and the glob's regex decides.  What no such part can be found for
is kept in the expression, like the rules of a :class:`palimpsest.operators.rules.RuleSet`.

A glob that many rules have is looked up once: of its rules in a layer only the last can decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dialect import glob_body, split_braces
from palimpsest.functions.expr import let
from palimpsest.functions.paths import expand_home, expand_home_literal
from palimpsest.functions.tiers import BLOCKED, PUBLIC
from palimpsest.operators.rules import DEFAULTS, PRESET, PROJECT, USER
from palimpsest.session import Workspace

#: Characters of a last segment's beginning or end that are a key.
EDGE = 8
#: Globs without any literal part, at most; more are refused rather than cut.
MAX_UNANCHORED = 200
#: Alternatives that the braces of a glob are written out to; one with more is looked at as it stands.
MAX_ALTERNATIVES = 64

#: A glob with a key that at most so many paths have is not looked up by three characters.
FEW = 1000

_META = set("*?[{\\")
_GLOB = "pattern string, regex string, keys array<struct<kind:string,key:string>>"


def _literal_runs(segment: str) -> list[str]:
    """What stands between the wildcards of a segment; nothing if it has classes, braces or escapes."""
    return [] if set(segment) & set("[{\\") else [r for r in segment.replace("?", "*").split("*") if r]


def glob_keys(glob: str) -> list[tuple[str, str]]:
    """Parts that every path the glob matches has, as ``(kind, key)``."""
    segments = glob.split("/")
    if set("[{\\") & set(glob):
        # A class or an escape may hold a slash: only what stands before it is sure.
        cut = min(glob.index(c) for c in "[{\\" if c in glob)
        segments = glob[:cut].split("/")[:-1] + ["*"]
    plain = [not _META & set(s) for s in segments]
    if all(plain):
        return [("exact", glob)]
    keys = []
    leading = plain.index(False)
    if "/".join(segments[:leading]):
        keys.append(("prefix", "/".join(segments[:leading])))
    last = segments[-1]
    whole = len("/".join(segments)) == len(glob)
    if whole and plain[-1]:
        keys.append(("last", last))
    elif whole and last != "**":
        if _literal_runs(last) and last[0] not in "*?":
            keys.append(("start", _literal_runs(last)[0][:EDGE]))
        if _literal_runs(last) and last[-1] not in "*?":
            keys.append(("end", _literal_runs(last)[-1][-EDGE:]))
    keys += [("segment", s) for s, p in zip(segments[:-1], plain) if p and s]
    runs = [r for s, p in zip(segments, plain) if not p for r in _literal_runs(s)]
    keys += [("three", r[i : i + 3]) for r in runs for i in range(len(r) - 2)]
    return list(dict.fromkeys(keys))


def _indexed(home: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pattern in batch["pattern"]:
                for alternative in split_braces(expand_home_literal(pattern, home), MAX_ALTERNATIVES):
                    body = glob_body(alternative)
                    if body is not None:
                        keys = [{"kind": k, "key": v} for k, v in glob_keys(alternative)]
                        rows.append((pattern, rf"(?s)\A(?:{body})\z", keys))
            yield pd.DataFrame(rows, columns=["pattern", "regex", "keys"])

    return work


def deciding_rules(rules: DataFrame) -> DataFrame:
    """The path rules of a table ``(kind, agent, layer, ord, pattern, tier, source)`` that can decide: each glob's last in a layer."""
    path_rules = rules.filter("kind = 'path' AND pattern IS NOT NULL").select(
        F.coalesce("agent", F.lit("")).alias("agent"), F.col("layer").cast("int"),
        F.col("ord").cast("bigint"), "pattern", F.col("tier").cast("int"), "source",
    )
    return path_rules.groupBy("pattern", "agent", "layer").agg(F.max(F.struct("ord", "tier", "source")).alias("last"))


def index_globs(patterns: DataFrame, home: str, space: Workspace) -> DataFrame:
    """The globs of a column ``pattern``, each once, with regexes and keys: a row for each of their alternatives.

    A malformed glob matches nothing and is left out.
    """
    return space.written(patterns.select("pattern").distinct().mapInPandas(_indexed(home), _GLOB))


def _path_keys(path: Column, kinds: set[str]) -> Column:
    """The keys of the given kinds that a path has."""

    def pairs(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

    def of(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        edge = F.sequence(F.lit(1), F.least(F.length(last), F.lit(EDGE)))
        made = {
            "exact": F.array(path),
            "prefix": F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/")),
            "last": F.array(last),
            "start": F.when(last != "", F.transform(edge, lambda k: F.left(last, k))).otherwise(F.array().cast("array<string>")),
            "end": F.when(last != "", F.transform(edge, lambda k: F.right(last, k))).otherwise(F.array().cast("array<string>")),
            "segment": F.array_distinct(segments),
            "three": F.when(
                F.length(path) > 2,
                F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(path) - 2), lambda i: F.substr(path, i, F.lit(3)))),
            ).otherwise(F.array().cast("array<string>")),
        }
        return F.flatten(F.array(*(pairs(k, made[k]) for k in sorted(kinds))))

    return let(F.split(path, "/", -1), of)


def _key_hash(kind: Column, key: Column) -> Column:
    """A key as a number; should two have the same, the regex tells them apart."""
    return F.xxhash64(kind, key)


def _rarest(globs: DataFrame, paths: DataFrame, kinds: set[str]) -> DataFrame:
    """Each glob's key of these kinds that the fewest paths have, ``(pattern, regex, n, h)``; ``n`` is 0 if no path has it."""
    of_paths = paths.select(F.explode(_path_keys(F.col("full"), kinds)).alias("k")).select(_key_hash(F.col("k.kind"), F.col("k.key")).alias("h"))
    counts = of_paths.groupBy("h").agg(F.count("*").alias("n"))
    keys = globs.select("pattern", "regex", F.inline("keys")).filter(F.col("kind").isin(*kinds))
    counted = keys.select("pattern", "regex", _key_hash(F.col("kind"), F.col("key")).alias("h")).join(counts, "h", "left")
    least = counted.groupBy("pattern", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("k"))
    return least.select("pattern", "regex", "k.n", "k.h")


def _met(index: DataFrame, paths: DataFrame, space: Workspace) -> DataFrame | None:
    """``(full, pattern)``: the paths that the globs with keys match; None if there is no such glob."""
    anchored = index.filter(F.size("keys") > 0)
    # At most seven kinds.
    kinds = {r["kind"] for r in anchored.select(F.explode("keys.kind").alias("kind")).distinct().collect()}
    if not kinds:
        return None
    three = {"three"} & kinds
    chosen = None
    if kinds - three:
        chosen = space.written(_rarest(anchored, paths, kinds - three))
    if three:
        # A path has dozens of these: they are counted for globs only that have no rare key besides.
        rest = anchored.filter(F.exists("keys", lambda k: k["kind"] == "three"))
        if chosen is not None:
            rest = rest.join(chosen.filter(F.col("n") <= FEW).select("pattern", "regex"), ["pattern", "regex"], "left_anti")
        rest = space.written(rest)
        if not rest.isEmpty():
            by_three = _rarest(rest, paths, three)
            both = by_three if chosen is None else chosen.unionByName(by_three)
            least = both.groupBy("pattern", "regex").agg(F.min(F.struct("n", "h")).alias("k"))
            chosen = space.written(least.select("pattern", "regex", "k.n", "k.h"))
        else:
            kinds -= three
    # Globs with a key that no path has match nothing and end here.
    chosen = chosen.filter(F.col("n") > 0).select("pattern", "regex", "h")
    path_keys = paths.select("full", F.explode(_path_keys(F.col("full"), kinds)).alias("k")).select(
        "full", _key_hash(F.col("k.kind"), F.col("k.key")).alias("h")
    )
    return path_keys.join(chosen, "h").filter(F.regexp_like("full", F.col("regex"))).select("full", "pattern")


def _resolved(best: dict[int, Column]) -> Column:
    """One verdict from those of the layers: what people wrote first, then blocks of the defaults, then presets."""
    base = best[DEFAULTS]
    shipped = F.when(base["tier"] == BLOCKED, base).otherwise(F.coalesce(best[PRESET], base))
    return F.coalesce(best[PROJECT], best[USER], shipped)


def classify_many(
    paths: DataFrame, column: str, rules: DataFrame, home: str, agent: str | None = None, space: Workspace | None = None
) -> DataFrame:
    """``(path, tier, source)`` of the distinct paths of a table, and ``agent`` if a column of agents is named.

    ``rules`` is a table ``(kind, agent, layer, ord, pattern, tier, source)`` of any size; of the rules of
    a layer that match the one with the largest ``ord`` decides.  Results are those of
    :func:`palimpsest.operators.rules.classify_path` with the same rules.

    Paths and globs are made distinct first, and a path and a glob come together once, where they share the
    glob's rarest key, so there is neither a cross join nor a rule that every path is held against, except
    globs without three literal characters in a row, a whole segment or an edge (``/*/?``): of those at
    most ``MAX_UNANCHORED`` are allowed and stay in the expression.  Null paths are left out.
    """
    space = space or Workspace(paths.sparkSession)
    named = [F.lit("").alias("agent")] if agent is None else [F.coalesce(agent, F.lit("")).alias("agent")]
    asked = paths.select(F.col(column).alias("path"), *named).filter("path IS NOT NULL").distinct()
    asked = space.written(asked.withColumn("full", expand_home(F.col("path"), home)))
    paths = space.written(asked.select("full").distinct())
    deciding = space.written(deciding_rules(rules))
    index = index_globs(deciding, home, space)

    loose = index.filter(F.size("keys") == 0).limit(MAX_UNANCHORED + 1).collect()
    if len(loose) > MAX_UNANCHORED:
        raise ValueError(f"more than {MAX_UNANCHORED} globs without a literal part")
    found = _met(index, paths, space)
    if loose:
        hits = F.array(*(F.when(F.col("full").rlike(r["regex"]), F.lit(r["pattern"])) for r in loose))
        more = paths.select("full", F.explode(F.array_compact(hits)).alias("pattern"))
        found = more if found is None else found.unionByName(more)
    public = F.struct(F.lit(PUBLIC).alias("tier"), F.lit("default").alias("source"))
    keep = ["path"] if agent is None else ["path", "agent"]
    if found is None:
        return asked.select(*keep, public["tier"].alias("tier"), public["source"].alias("source"))
    # A glob with several alternatives may meet a path more than once, which changes no maximum.
    last = lambda layer: F.max(F.when(F.col("layer") == layer, F.col("last"))).alias(f"l{layer}")
    layers = (DEFAULTS, PRESET, USER, PROJECT)
    verdicts = found.join(deciding, "pattern").groupBy("full", F.col("agent").alias("of")).agg(*(last(x) for x in layers))
    verdicts = space.written(verdicts.select("full", "of", _resolved({x: F.col(f"l{x}") for x in layers}).alias("v")))
    general = verdicts.filter("of = ''").select(F.col("full").alias("g_full"), F.col("v").alias("general"))
    own = verdicts.filter("of <> ''").select(F.col("full").alias("o_full"), "of", F.col("v").alias("own"))
    judged = asked.join(general, F.col("full") == F.col("g_full"), "left").join(
        own, (F.col("full") == F.col("o_full")) & (F.col("agent") == F.col("of")), "left"
    )
    source = F.concat(F.col("own.source"), F.lit(" (agent:"), "agent", F.lit(")"))
    return judged.select(
        *keep,
        F.coalesce("own.tier", "general.tier", F.lit(PUBLIC)).alias("tier"),
        F.coalesce(source, "general.source", F.lit("default")).alias("source"),
    )
