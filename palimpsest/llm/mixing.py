"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
A flow routes the words of patterns to the sources' targets; using a document again
costs more each time (convex), so repetition comes only after all words were used
once.  Within a pattern, whole documents are then selected in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import words
from palimpsest.session import Workspace

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
TOTAL = 1.5
#: How often a document may be used, and no target exceeds this many times its source.
MAX_USES = 2
#: Steps of the seeded order within which documents are added up one by one.
STEPS = 65536
#: Steps that are first summed up together, so that no running sum goes over more rows than this.
BLOCK = 256
#: A document over this share of a pattern's amount, and over 1 / MANY of the pattern, is outsize: so fewer than MANY are.
SHARE = 1 / 256
MANY = 1000
#: Documents of a pattern looked at in one round of closing the gap that is left.
ROUND = 2000


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MAX_USES) -> list[float]:
    """Shares of ``total`` times all sizes by weight; what exceeds ``most`` times a source is shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    left, open_ = total * sum(sizes), set(range(len(sizes)))
    while open_:
        all_weights = sum(weight[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weight[i] / all_weights > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / all_weights
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def route(capacities: dict[tuple[int, ...], int], quotas: Sequence[int], uses: int = MAX_USES) -> dict[tuple[tuple[int, ...], int], int]:
    """Min-cost flow of words from patterns (sets of source numbers) to source quotas.

    The n-th use of a pattern's words costs n - 1 a word.  Successive shortest paths on
    a graph of patterns and sources; returns the words for each (pattern, source).
    """
    patterns = sorted(capacities)
    start, end = 0, 1
    pattern_at = {p: 2 + i for i, p in enumerate(patterns)}
    source_at = {s: 2 + len(patterns) + s for s in range(len(quotas))}
    edges: list[list[int]] = []  # to, capacity left, cost
    out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(quotas))]

    def add(a: int, b: int, capacity: int, cost: int) -> int:
        out[a].append(len(edges))
        edges.append([b, capacity, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    for p in patterns:
        for n in range(uses):
            add(start, pattern_at[p], capacities[p], n)
    whole = sum(quotas) + 1
    carried = {(p, s): add(pattern_at[p], source_at[s], whole, 0) for p in patterns for s in p}
    for s, quota in enumerate(quotas):
        add(source_at[s], end, quota, 0)
    while True:
        cost: dict[int, int] = {start: 0}
        came: dict[int, int] = {}
        queue, waiting = deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                b, capacity, price = edges[e]
                if capacity > 0 and cost[a] + price < cost.get(b, 1 << 62):
                    cost[b], came[b] = cost[a] + price, e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if end not in came:
            break
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = edges[came[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {key: edges[e ^ 1][1] for key, e in carried.items() if edges[e ^ 1][1]}


def outsize(sizes: Sequence[int], places: Sequence[float], rest: int, small: int) -> list[bool]:
    """Which of the outsize documents, in their seeded order, are taken towards ``rest``.

    ``places`` are their places in the order of all, from 0 to 1, ``small`` the words of the
    other documents.  Taken is what comes within the share that ``rest`` is of all and fits;
    then, while the others cannot fill what is left, the next that fits.
    """
    share = rest / max(1, small + sum(sizes))
    taken, left = [False] * len(sizes), rest
    for needed in (False, True):
        for i, n in enumerate(sizes):
            if not taken[i] and n <= left and (left > small if needed else places[i] < share):
                taken[i] = True
                left -= n
    return taken


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sources: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    total: float = TOTAL,
    seed: int = 17,
) -> DataFrame:
    """For every document how many words the mix takes from it: 0, or once or twice its size.

    ``sources`` is an array column with the sources a document belongs to; by default
    that of its ``source``.  Sources are ordered by code point, null last; like
    patterns they are few enough for the driver, which sees sums alone.  In a pattern
    the documents come in the order of a seeded hash, whole.  The few outsize ones are taken
    or refused first; of the others, sums of the order's blocks, then of a block's steps, find
    the step where the amount is reached, and only this step's documents are added up one by
    one.  Further documents, chosen by size, close the gap until none brings the sum closer.

    A null or empty text has no words and is not taken; a null source is a source of
    its own; a null id is a document like any other; repeated rows count each, but
    of rows that are equal in id and text none or all close a gap; an empty table
    gives an empty one.  Reruns agree.  Returns doc_id, th (hash of the text), size,
    members (numbers of the sources), sources, source_size and target (of the first
    source) and taken.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    sources = F.array("source") if sources is None else sources
    text = F.coalesce(F.col(text_column), F.lit(""))
    sized = space.written(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.xxhash64(text).alias("th"),
            F.size(words(text)).cast("long").alias("size"),
            F.sort_array(F.array_distinct(sources)).alias("sources"),
        ).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "th"))
        .withColumn("step", F.pmod("order", F.lit(STEPS)).cast("int"))
    )
    sums = [(r["sources"] or [], r["size"]) for r in sized.groupBy("sources").agg(F.sum("size").alias("size")).collect()]
    names = sorted({s for own, _ in sums for s in own if s is not None}) + [None] * any(None in own for own, _ in sums)
    number = {s: i for i, s in enumerate(names)}
    capacities = {tuple(sorted(number[s] for s in own)): n for own, n in sums}
    sizes = [sum(n for p, n in capacities.items() if i in p) for i in range(len(names))]
    wanted = targets(sizes, weights, total)
    flow = route(capacities, [round(t) for t in wanted])
    amount = {p: sum(n for (q, _), n in flow.items() if q == p) for p in capacities}

    rows = []
    for own, n in sums:
        p = tuple(sorted(number[s] for s in own))
        first = p[0] if p else None
        whole, rest = divmod(amount[p], n) if n else (0, 0)
        rows.append((own, list(p), sizes[first] if p else 0, wanted[first] if p else 0.0, whole, rest))
    plan = spark.createDataFrame(
        rows, "own array<string>, members array<int>, source_size bigint, target double, whole bigint, rest bigint"
    )
    # One row for each pattern.
    key = lambda c: F.to_json(F.struct(c.alias("s")), {"ignoreNullFields": "false"})  # noqa: E731  nulls compare too
    own = F.coalesce("sources", F.array().cast("array<string>"))
    planned = sized.join(F.broadcast(plan), key(own) == key(F.col("own"))).drop("own")
    pattern = "members"

    def same(id_column: str, th_column: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(id_column)) & (F.col("th") == F.col(th_column))

    id_type = sized.schema["doc_id"].dataType.simpleString()
    # Steps go round with the order's remainder, which is the place in the seeded order.
    least = F.greatest(F.col("rest") * SHARE, F.col("all") / MANY)
    totals = spark.createDataFrame([(m, n) for (_, m, *_), (_, n) in zip(rows, sums)], "all_members array<int>, all bigint")
    big = (
        planned.join(F.broadcast(totals), F.col(pattern) == F.col("all_members"))
        .filter((F.col("size") > least) | (F.col("size") > F.col("rest")))
        .filter("rest > 0")
    )
    refused = F.col("size") > F.col("rest")
    large: dict[tuple[int, ...], list] = {}
    for r in big.filter(~refused).select(pattern, "step", "order", "doc_id", "th", "size", "rest", "all").collect():
        large.setdefault(tuple(r[pattern]), []).append(r)
    # What is left for the small documents: those that are neither outsize nor larger than the amount.
    over = {tuple(r[pattern]): r["n"] for r in big.groupBy(pattern).agg(F.sum("size").alias("n")).collect()}
    decided, left_over = [], []
    for (_, m, _, _, _, rest), (_, n) in zip(rows, sums):
        merged: dict[tuple, list] = {}
        for r in sorted(large.get(tuple(m), []), key=lambda r: (r["step"], r["order"], r["th"], r["size"])):
            merged.setdefault((r["doc_id"], r["th"]), [0, r["step"] / STEPS])[0] += r["size"]
        taken = outsize([x for x, _ in merged.values()], [x for _, x in merged.values()], rest, n - over.get(tuple(m), 0))
        decided += [(*k, yes) for k, yes in zip(merged, taken)]
        left_over.append((m, n, rest - sum(x for (x, _), yes in zip(merged.values(), taken) if yes)))
    first = spark.createDataFrame(decided, f"o_id {id_type}, o_th bigint, outsize boolean")
    shares = spark.createDataFrame(left_over, "r_members array<int>, all bigint, left bigint")
    # ``aside``: true or false for the outsize, which then count for nothing in the sums.
    planned = (
        planned.join(F.broadcast(shares), F.col(pattern) == F.col("r_members"))
        .join(F.broadcast(first), same("o_id", "o_th"), "left")
        .withColumn("aside", F.when(refused & (F.col("rest") > 0), False).otherwise(F.col("outsize")))
        .withColumn("whole_size", F.col("size"))
        .withColumn("size", F.when(F.col("aside").isNull(), F.col("size")).otherwise(0))
        .withColumn("rest", F.col("left"))
        .drop("r_members", "all", "left", "o_id", "o_th", "outsize")
    )

    def reached(sums: DataFrame, at: str, before: Column) -> DataFrame:
        """The first place of each pattern where its amount is reached, and the sum before: one row a pattern."""
        run = before + F.sum("n").over(Window.partitionBy(pattern).orderBy(at))
        first = (
            sums.select(pattern, "rest", at, "n", run.alias("sum"))
            .filter(F.col("sum") >= F.col("rest"))
            .groupBy(pattern)
            .agg(F.min_by(F.struct(at, (F.col("sum") - F.col("n")).alias("before")), at).alias("at"))
            .select(F.col(pattern).alias("at_members"), F.col(f"at.{at}").alias(f"at_{at}"), F.col("at.before").alias("before"))
        )
        return spark.createDataFrame(first.collect(), first.schema)

    blocked = planned.withColumn("block", F.floor(F.col("step") / BLOCK).cast("int"))
    by_block = blocked.groupBy(pattern, "rest", "block").agg(F.sum("size").alias("n"))
    block = reached(by_block, "block", F.lit(0))
    inside = (F.col(pattern) == F.col("at_members")) & (F.col("block") == F.col("at_block"))
    steps = blocked.join(F.broadcast(block), inside).groupBy(pattern, "rest", "before", "step").agg(F.sum("size").alias("n"))
    limits = reached(steps, "step", F.col("before"))
    marked = planned.join(F.broadcast(limits), F.col(pattern) == F.col("at_members"), "left").drop("at_members")
    last = F.coalesce(F.col("step") == F.col("at_step"), F.lit(False))
    one_by_one = F.sum("size").over(Window.partitionBy(pattern).orderBy("order", "doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, 0))
    # Where the amount is nowhere reached, the small documents are too few and all are taken.
    base = marked.filter(~last).withColumn("chosen", F.coalesce(F.col("step") < F.col("at_step"), F.lit(True)))
    edge = marked.filter(last).withColumn("chosen", F.col("before") + one_by_one <= F.col("rest"))
    state = space.written(
        base.unionByName(edge)
        .withColumn("chosen", F.coalesce("aside", F.col("chosen") & (F.col("size") > 0)))
        .withColumn("filled", F.when(F.col("chosen"), F.col("size")).otherwise(0))
        .withColumn("size", F.col("whole_size"))
    )
    closing: list[tuple] = []
    gaps = {
        tuple(r["members"]): r["gap"]
        for r in state.groupBy(pattern, "rest").agg(F.sum("filled").alias("s"))
        .select(pattern, (F.col("rest") - F.col("s")).alias("gap")).collect()
    }
    closes = f"x_id {id_type}, x_th bigint, closes boolean"
    open_gaps = {p: gap for p, gap in gaps.items() if gap > 0}
    while open_gaps:
        want = spark.createDataFrame([(list(p), gap) for p, gap in open_gaps.items()], "gap_members array<int>, gap bigint")
        free = (
            state.filter(~F.col("chosen") & (F.col("size") > 0))
            .join(F.broadcast(want), F.col(pattern) == F.col("gap_members"))
            .withColumn("off", F.abs(F.col("gap") - F.col("size")))
            .filter(F.col("off") < F.col("gap"))
            .join(F.broadcast(spark.createDataFrame(closing, closes)), same("x_id", "x_th"), "left_anti")
        )
        still = {}
        for p in open_gaps:
            # The nearest to the gap, by pattern: a bounded number, from each task as many at most.
            near = free.filter(F.col(pattern) == F.array(*(F.lit(i) for i in p)) if p else F.size(pattern) == 0)
            found = near.orderBy("off", "order", "doc_id", "th").select("doc_id", "th", "size").limit(ROUND).collect()
            alike: dict[tuple, int] = {}
            for r in found:
                alike[r["doc_id"], r["th"]] = alike.get((r["doc_id"], r["th"]), 0) + r["size"]
            gap, before = open_gaps[p], len(closing)
            while alike:
                k = min(alike, key=lambda k: abs(gap - alike[k]))
                if abs(gap - alike[k]) >= abs(gap):
                    break
                gap -= alike.pop(k)
                closing.append((*k, True))
            if gap > 0 and len(closing) > before:
                still[p] = gap
        open_gaps = still
    extra = spark.createDataFrame(closing, closes)
    chosen = F.col("chosen") | F.coalesce("closes", F.lit(False))
    return state.join(
        F.broadcast(extra), same("x_id", "x_th"), "left"
    ).select(
        "doc_id", "th", "size", "members", "sources", "source_size", "target",
        (F.col("size") * (F.col("whole") + chosen.cast("long"))).alias("taken"),
    )
