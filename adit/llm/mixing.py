r"""Mixing sources to target weights, by a minimum-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. Each source has a
quota of tokens: a weighted share of the budget, but never over ``repeats`` times its
tokens; what is above is shared again by weight. A flow routes the
capacity of patterns to the quotas of their sources: a pattern's tokens may be taken up to ``repeats`` times, the k-th time
at a cost of 2 k - 1, so that costs are convex and repetitions are spread as evenly as
memberships allow. Patterns that share no source, directly or through others, are networks of their own, each solved in a task.

Then documents are selected. A pattern's flow is whole passes over all of its documents
and a rest; the documents of the rest are the first by a seeded hash whose sizes fit into it, a
running sum over ranges of rows. The gap that is left, less than one document, is filled by up to ``FILL`` documents of each
binary order of size that come next, the largest first. Documents are taken whole.

Defined cases: a null source is one of its own and comes last, and an empty list of sources is a null source; a null or
empty text has size 0 and is taken 0 times; without weights for it a source has weight 0 and quota 0; ties of the seeded hash go by size; rows that repeat are documents of their own; very long
texts only count; an empty table gives no rows; where a pattern's sources have quotas that its
members cannot fill, all it can give is taken; input columns named as the results, in any case, are replaced, all others are kept. A
connected network of over ``MOST_PATTERNS`` patterns (not documents) is an error.
"""

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm.near_dedup import components
from adit.llm.store import running, split_join, written

WORDS = "[^\\x20\\x09-\\x0D]+"
FILL, MOST_PATTERNS = 64, 50_000


def size(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cycled(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The sources with ``weight``: by code point, null last, they have the weights in turn, which repeat."""
    ranked = running(sources.withColumn("none", F.col("source").isNull()), [], ["none", "source"], "k").drop("none")
    return ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("k", F.lit(len(weights))).cast("int"))).drop("k")


def quotas(sources: DataFrame, budget: float, repeats: int) -> DataFrame:
    """The sources (source, size, weight) with ``target``: shares of the budget by weight, none over repeats * size.

    A round gives each open source its share of what the full ones leave; it ends when none
    is over its bound. The rate rises from round to round, as in Newton's method, so rounds are few.
    """
    rate, full = 0.0, F.lit(False)
    while True:
        left = sources.select("size", "weight", full.alias("full")).agg(F.sum(F.when(F.col("full"), F.col("size") * repeats)).alias("used"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")).first()
        over = rate
        rate = (budget - (left.used or 0)) / left.open if left.open else rate
        if rate == over or not left.open:
            return sources.withColumn("target", F.least(F.col("size") * float(repeats), F.col("weight") * rate))
        full = F.col("weight") * rate > F.col("size") * repeats


def flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Tokens from each pattern to each of its sources: as many as can flow, at the least cost, the k-th use of a pattern's tokens costing 2 k - 1.

    Primal-dual: shortest distances by cost, then augmentations within the arcs on shortest paths, until no path is left.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    to, room, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int, price: int) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((most, 0))
        cost.extend((price, -price))
        return len(to) - 2

    for p in range(n_p):
        for k in range(repeats):
            arc(start, p, capacity[p], 2 * k + 1)
    links = [{s: arc(p, n_p + s, capacity[p] * repeats, 0) for s in members[p]} for p in range(n_p)]
    for s in range(n_s):
        arc(n_p + s, end, quota[s], 0)
    while True:
        far = [1 << 60] * (end + 1)
        far[start], line, queued = 0, deque([start]), [False] * (end + 1)
        while line:
            v = line.popleft()
            queued[v] = False
            for e in out[v]:
                if room[e] and far[v] + cost[e] < far[to[e]]:
                    far[to[e]] = far[v] + cost[e]
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        line.append(to[e])
        if far[end] == 1 << 60:
            return [{s: room[e + 1] for s, e in x.items() if room[e + 1]} for x in links]
        at, on, path, v = [0] * (end + 1), [False] * (end + 1), [], start
        on[start] = True
        while True:  # depth first over arcs of shortest paths; an arc that led nowhere is not tried again
            if v == end:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                for u in [to[e] for e in path]:
                    on[u] = False
                path, v = [], start
            elif at[v] < len(out[v]):
                e = out[v][at[v]]
                if room[e] and not on[to[e]] and far[v] + cost[e] == far[to[e]]:
                    path.append(e)
                    v = to[e]
                    on[v] = True
                else:
                    at[v] += 1
            elif v == start:
                break
            else:
                on[v] = False
                v = to[path.pop() ^ 1]
                at[v] += 1


def routed(patterns: DataFrame, sources: DataFrame, repeats: int, most: int = MOST_PATTERNS) -> DataFrame:
    """(pattern, source, tokens): the flow from patterns (pattern, sources array<string>, size) to the quotas of sources (source, target)."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  a source that may be null, as a key
    arcs = patterns.select("pattern", "size", F.explode("sources").alias("source")).withColumn("key", key(F.col("source")))
    arcs = written(arcs.join(sources.select(key(F.col("source")).alias("key"), F.floor("target").cast("long").alias("quota")), "key"), "arcs")
    ends = arcs.groupBy("pattern").agg(F.min("key").alias("low"))
    edges = written(arcs.join(ends, "pattern").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct(), "shared")
    if edges.isEmpty():
        arcs = arcs.withColumn("net", F.col("key"))
    else:
        net = components(edges).select(F.col("v").alias("key"), F.col("root").alias("net"))
        arcs = arcs.join(net, "key", "left").withColumn("net", F.coalesce("net", "key"))

    def solve(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("pattern", "ascending"), ("key", "ascending")]).to_pylist()
        names, keys = list(dict.fromkeys(r["pattern"] for r in rows)), list(dict.fromkeys(r["key"] for r in rows))
        if len(names) > most:
            raise ValueError(f"{len(names)} patterns in one network; the most is {most}")
        p, s = ({x: k for k, x in enumerate(v)} for v in (names, keys))
        capacity, members, quota = [0] * len(names), [[] for _ in names], [0] * len(keys)
        for r in rows:
            capacity[p[r["pattern"]]], quota[s[r["key"]]] = r["size"], r["quota"]
            members[p[r["pattern"]]].append(s[r["key"]])
        found = flow(capacity, members, quota, repeats)
        made = [(n, keys[k], v) for n, x in zip(names, found) for k, v in x.items()]
        return pa.table({"pattern": pa.array([m[0] for m in made], pa.string()), "key": pa.array([m[1] for m in made], pa.string()), "tokens": pa.array([m[2] for m in made], pa.int64())})

    found = arcs.groupBy("net").applyInArrow(solve, "pattern string, key string, tokens long")
    return found.select("pattern", F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "tokens")


def taken(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (pattern, size, seeded, place, ...) with ``copies``: how often each is taken, so that a pattern's sizes come near its tokens.

    ``wanted``: (pattern, size, n, tokens), the sizes and number of a pattern's documents, and what it shall give.
    """
    heavy = wanted.select("pattern", "n")
    due = wanted.select("pattern", F.floor(F.col("tokens") / F.col("size")).cast("long").alias("passes"), (F.col("tokens") % F.col("size")).alias("rest")).where("passes is not null")
    sums = running(rows, ["pattern"], ["seeded", "size", "place"], "before", "size")
    sums = split_join(sums, due, ["pattern"], how="left", heavy=heavy).na.fill(0, ["passes", "rest"])
    after = F.col("before") + F.col("size")
    sums = written(sums.withColumn("fits", (F.col("size") > 0) & (after <= F.col("rest"))), "sums")

    # of each order of size about FILL documents that did not fit, by a hash of their place in the sum, so that equal rows part
    order, open_ = F.length(F.bin("size")), sums.where("size > 0 and not fits and rest > 0")
    used = sums.where("fits").groupBy("pattern").agg(F.max(after).alias("used"))
    counts = open_.groupBy("pattern", order.alias("order")).agg(F.count(F.lit(1)).alias("m"))
    counts = counts.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("order", "m"))).alias("counts"))
    gaps = written(due.join(counts, "pattern").join(used, "pattern", "left").select("pattern", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("gap"), "counts"), "gaps")
    some = split_join(open_.select("pattern", "before", "size"), gaps, ["pattern"], heavy=heavy).where(F.col("size") <= F.col("gap"))
    draw = F.conv(F.substring(F.md5(F.col("before").cast("string")), 1, 8), 16, 10).cast("long")
    some = some.where(draw * F.element_at("counts", order) < FILL * (1 << 32))
    listed = some.groupBy("pattern").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "before"))).alias("x"))
    nothing = F.array().cast("array<bigint>")
    step = lambda a, x: F.when(a["gap"] + x["minus"] >= 0, F.struct((a["gap"] + x["minus"]).alias("gap"), F.array_append(a["got"], x["before"]).alias("got"))).otherwise(a)
    got = F.aggregate("x", F.struct(F.col("gap").alias("gap"), nothing.alias("got")), step)["got"]
    filled = written(listed.select("pattern", F.explode(got).alias("before"), F.lit(1).alias("filled")), "filled")
    out = sums.join(filled, ["pattern", "before"], "left")
    copies = F.col("passes") + F.when(F.col("fits") | (F.col("filled").isNotNull() & (F.col("size") > 0)), 1).otherwise(0)
    return out.select(*rows.columns, F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] | DataFrame, share: float = 1.5, repeats: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, sources) of the mix.

    ``source_col``: a string, or an array of strings where sources overlap. ``weights``: in turn for the sources
    by code point, or a table (source, weight). ``share``: tokens of the mix, as a share of all there are.

    documents: id_col, source_col, size, copies and taken (size * copies); texts don't move. sources: source, size, weight and target.
    """
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    members = F.array_sort(F.array_distinct(F.when(F.size(source_col) > 0, F.col(source_col)).otherwise(F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source_col).cast("string"))
    seeded = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), members.alias("sources"), F.md5(F.to_json(members)).alias("pattern"), size(F.col(text_col)).alias("size"), seeded.alias("seeded"), F.monotonically_increasing_id().alias("place"))
    rows = written(rows, "sizes")
    patterns = written(rows.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "patterns")
    sources = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    if isinstance(weights, DataFrame):
        key = lambda x: F.coalesce(F.concat(F.lit("="), x["source"]), F.lit(""))
        told = weights.groupBy("source").agg(F.max("weight").cast("double").alias("weight"))
        sources = sources.join(told, key(sources) == key(told), "left").select(sources["source"], sources["size"], F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sources = cycled(sources, weights)
    sources = written(sources, "sources")
    total = patterns.agg(F.sum("size")).first()[0] or 0
    sources = written(quotas(sources, share * total, repeats), "targets")
    tokens = routed(patterns.drop("n"), sources, repeats).groupBy("pattern").agg(F.sum("tokens").alias("tokens"))
    wanted = written(patterns.join(tokens, "pattern", "left").select("pattern", "size", "n", F.coalesce("tokens", F.lit(0)).alias("tokens")), "wanted")
    out = taken(rows.drop("sources"), wanted)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "copies", (F.col("size") * F.col("copies")).alias("taken")), sources
