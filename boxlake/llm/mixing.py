"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a flow
routes the patterns' words to the sources' quotas, where a further repetition of a pattern
costs more than the one before, so that nothing is repeated while fresh words are left.
What a pattern has to give is then taken from its documents in a seeded order.

Patterns that share no source don't affect each other: each connected set of patterns is a
flow of its own, solved in a task of its own from one row per pattern.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.common import n_words
from boxlake.operators.clusters import connected_components
from boxlake.session import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SEED = 17
# Documents of a bucket on average; the seeded order is kept by bucket, and only in the
# bucket where a pattern's share ends document by document.
BUCKET = 128


# ------------------------------------------------------------------ flow

def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a largest flow of least cost:
    cheapest augmenting paths one after the other."""
    ends, room, price, out = [], [], [], [[] for _ in range(n)]
    for a, b, capacity, cost in edges:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(c)
            price.append(p)
    while True:
        distance: list[float] = [float("inf")] * n
        by, queued = [-1] * n, [False] * n
        distance[source], line = 0, deque([source])
        while line:
            x = line.popleft()
            queued[x] = False
            for e in out[x]:
                y = ends[e]
                if room[e] > 0 and distance[x] + price[e] < distance[y]:
                    distance[y], by[y] = distance[x] + price[e], e
                    if not queued[y]:
                        queued[y] = True
                        line.append(y)
        if by[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = ends[by[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def _solve(max_repeats: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        """One connected set of patterns: `pattern, words, members, quotas`."""
        rows = rows.sort_values("pattern")
        quota: dict[int, int] = {}
        for members, quotas in zip(rows.members, rows.quotas):
            quota.update(zip(members, quotas))
        sinks = {s: 2 + len(rows) + i for i, s in enumerate(sorted(quota))}
        edges = []
        for p, words in enumerate(rows.words):
            edges += [(0, 2 + p, int(words), (r + 1) ** 2) for r in range(max_repeats)]
        for p, members in enumerate(rows.members):
            edges += [(2 + p, sinks[s], max_repeats * int(rows.words.iloc[p]), 0) for s in sorted(members)]
        edges += [(sinks[s], 1, int(q), 0) for s, q in quota.items()]
        flow = min_cost_flow(2 + len(rows) + len(sinks), edges, 0, 1)
        given = [sum(flow[p * max_repeats : (p + 1) * max_repeats]) for p in range(len(rows))]
        return pd.DataFrame({"pattern": rows.pattern, "give": given})

    return solve


def route(patterns: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`pattern, give`: the words to take from each pattern. `patterns` has `pattern, words,
    members` (numbers of its sources) and `quotas` (words wanted by each of these)."""
    numbered = patterns.select("pattern", "words", "members", "quotas", F.element_at("members", 1).alias("node"))
    edges = patterns.select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b")).filter("a <> b")
    groups = connected_components(edges, [])
    grouped = numbered.join(groups, "node", "left").withColumn("part", F.coalesce("root", "node"))
    return grouped.groupBy("part").applyInPandas(
        lambda rows: _solve(max_repeats)(rows), "pattern string, give long"
    )


# ------------------------------------------------------------------ targets

def targets(sizes: DataFrame, words: int | None = None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`source, source_size, target` of `source, source_size`. Sources in the order of code
    points, null last, weigh `weights` in turn and share all words (`words`, or the sum of
    the sizes, which counts words of several sources more than once); a target stops at
    `max_repeats` times its source's size, and the others share the excess by weight: each
    gets weight * level for the one level at which the sum is right."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place))
    cap = F.col("source_size") * max_repeats
    before = Window.orderBy(cap / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) if words is None else F.lit(words)
    done = F.sum(cap).over(before) - cap  # of the sources that reach their cap earlier
    left = F.sum("w").over(everything) - (F.sum("w").over(before) - F.col("w"))
    tried = weighed.withColumn("level", (total - done) / left).withColumn("cap", cap)
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.coalesce(F.max(open_).over(everything), F.lit(0.0))  # the first open one
    capped = F.max(open_).over(everything).isNull()
    return tried.select(
        "source",
        "source_size",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.least(level * F.col("w"), F.col("cap"))).alias("target"),
    )


# ------------------------------------------------------------------ documents

def pick(docs: DataFrame, give: DataFrame, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """`docs` (`row, pattern, size`, the id of a row in `row`) with `taken`: the words taken,
    a multiple of the size. Whole passes over a pattern first; the rest of `give` from its
    documents in a seeded order, where a document that is too large is passed over."""
    counted = docs.filter("size > 0").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")
    )
    plan = counted.join(give, "pattern").select(
        "pattern",
        F.ceil(F.col("n") / bucket).alias("buckets"),
        F.floor(F.col("give") / F.col("words")).alias("passes"),
        (F.col("give") % F.col("words")).alias("rest"),
    )
    order = F.xxhash64("row", F.lit(seed))
    dealt = docs.join(plan, "pattern", "left").withColumn("o", order).withColumn("bucket", F.pmod("o", F.coalesce("buckets", F.lit(1))))
    sums = dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("b_words"), F.max("rest").alias("b_rest"))
    running = F.sum("b_words").over(Window.partitionBy("pattern").orderBy("bucket"))
    begun = sums.select("pattern", "bucket", (F.col("b_rest") - running + F.col("b_words")).alias("left"), "b_words")
    placed = dealt.join(begun, ["pattern", "bucket"], "left")
    passes = F.coalesce("passes", F.lit(0))
    ends = (F.col("left") > 0) & (F.col("left") < F.col("b_words"))
    placed = cut_lineage(placed.withColumn("ends", F.coalesce(ends, F.lit(False))))
    whole = placed.filter(~F.col("ends")).select(
        "row", "pattern", "size", ((passes + F.coalesce((F.col("left") >= F.col("b_words")).cast("int"), F.lit(0))) * F.col("size")).alias("taken")
    )

    def add(acc: Column, x: Column) -> Column:
        fits = (x["size"] > 0) & (x["size"] <= acc["left"])
        mark = F.struct(x["row"].alias("row"), x["size"].alias("size"), fits.cast("int").alias("more"))
        return F.struct(
            F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
            F.concat(acc["rows"], F.array(mark)).alias("rows"),
        )

    row_type = docs.schema["row"].dataType.simpleString()
    start = F.struct(
        F.col("left"), F.array().cast(f"array<struct<row:{row_type},size:bigint,more:int>>").alias("rows")
    )
    # One bucket for each pattern: its documents are few.
    last = placed.filter("ends").groupBy("pattern").agg(
        F.sort_array(F.collect_list(F.struct("o", "row", "size"))).alias("list"),
        F.max("left").alias("left"),
        F.max("passes").alias("passes"),
    )
    last = last.select("pattern", "passes", F.inline(F.aggregate("list", start, add)["rows"]))
    last = last.select("row", "pattern", "size", ((F.col("passes") + F.col("more")) * F.col("size")).alias("taken"))
    return whole.unionByName(last)


def mix_sources(docs: DataFrame, members: Column, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """`doc_id, sources, size, taken` for each row of `docs` (`doc_id, text`), given the
    array of its sources. A null source is one of its own, an empty array none. Texts
    without words have size 0 and give nothing; rows that repeat an id count each."""
    named = F.array_sort(F.array_distinct(members))
    sized = docs.select("doc_id", n_words(F.col("text")).alias("size"), named.alias("sources"))
    sized = cut_lineage(sized.withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})))
    member = F.xxhash64(F.col("source"), F.col("source").isNull())
    split = cut_lineage(sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")))
    total = split.filter(F.size("sources") > 0).agg(F.sum("words")).first()[0] or 0
    split = split.select("pattern", "words", F.explode("sources").alias("source"))
    wanted = targets(split.groupBy("source").agg(F.sum("words").alias("source_size")), total, weights, max_repeats)
    wanted = wanted.withColumn("number", member)
    patterns = (
        split.filter("words > 0")
        .withColumn("number", member)
        .join(wanted.select("number", F.round("target").cast("long").alias("quota")), "number")
        .groupBy("pattern", "words")
        .agg(F.sort_array(F.collect_list(F.struct("number", "quota"))).alias("s"))
        .select("pattern", "words", F.col("s.number").alias("members"), F.col("s.quota").alias("quotas"))
    )
    give = cut_lineage(route(cut_lineage(patterns), max_repeats))
    row = F.struct("doc_id", "sources")
    taken = pick(sized.select(row.alias("row"), "pattern", "size"), give, seed)
    return taken.select("row.doc_id", "row.sources", "size", "taken")


def mix_by_source(docs: DataFrame) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken` of documents with one source each
    (`doc_id, text, source`)."""
    mixed = mix_sources(docs, F.array("source")).withColumn("source", F.element_at("sources", 1)).drop("sources")
    mixed = cut_lineage(mixed)
    sizes = targets(mixed.groupBy("source").agg(F.sum("size").alias("source_size")))
    sizes = sizes.withColumnRenamed("source", "_s")
    return mixed.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )
