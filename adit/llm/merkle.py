"""Merkle manifest of a dataset: leaves, subroots by group, a root, and a path for every row.

A leaf is the SHA-256 of a row's columns. Within a group (a language, say) leaves
have a row number; while a group has more than one node, the number is
floor-divided by ``fanout`` and each run's sorted children are hashed into a parent.
The last node of a group is its subroot; the subroots, ordered by group, are the leaves of
one more such tree, whose last node is the root. Levels are tables; each has
1 / fanout of the rows of the one below.

Paths are made downwards: a node's path is its siblings in its run, to the left and to the right, before the
path of its parent, which one join a level brings. What moves is one row a run, not one
a document and level; a path has fanout - 1 hashes a level. folded() hashes a leaf up its path.

Row numbers come from ranges of rows (store.running()), so that a group of all rows is spread over tasks.

Defined cases: a group is told by a string column and null is a group of its own, which comes first; a null column is
``-``, an empty one ``0:``; null ids come first within a group, rows of the same id by their leaves; repeated rows are leaves of their own; very long texts
are hashed in one task each; a group of one row has its leaf as subroot, one group's subroot is the root, and an empty proof is the hash of
no bytes; an empty table gives no rows; only the columns that are named are read, whatever the others are called.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.llm.store import running, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: list[Column]) -> Column:
    """The hash of columns in turn: ``-`` for a null, else bytes, a colon and the value."""
    said = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]))


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z; lower() is right, and fast, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """From the leaves (g, i, n, h, ...), n of a group in all: the runs (g, i, n, kids) of each level upwards, and the last node (g, h) of each group.

    The kids of the lowest runs are the leaves with all their columns.
    """
    runs, done, most = [], nodes.where("n = 1").select("g", "h"), nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = F.struct("i", *[c for c in nodes.columns if c not in ("g", "i", "n")])
        parent = F.floor(F.col("i") / fanout).cast("long").alias("i"), F.ceil(F.col("n") / fanout).cast("long").alias("n")
        runs.append(written(nodes.where("n > 1").groupBy("g", *parent).agg(F.array_sort(F.collect_list(kid)).alias("kids")), "runs"))
        nodes = runs[-1].select("g", "i", "n", digest(F.array_join("kids.h", "")).alias("h"))
        done = done.unionByName(nodes.where("n = 1").select("g", "h"))
        most = -(-most // fanout)
    return runs, written(done, "last")


def paths(leaves: DataFrame, runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves (g, h, ...) with ``path``, for each level the texts of siblings to the left and right, and ``last``, the group's last node.

    ``tops``: (g, path, last), where each group's path goes on.
    """
    above = None
    for run in reversed(runs):
        parents = run.where("n = 1").join(tops, "g").select("g", "i", "kids", "path", "last")
        if above is not None:
            parents = parents.unionByName(run.where("n > 1").join(above, ["g", "i"]).select(*parents.columns))
        each = parents.select("g", "kids", "path", "last", F.posexplode("kids").alias("k", "kid"))
        text = lambda first, n: F.array_join(F.slice("kids.h", first, n), "")
        side = F.struct(text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 2, F.size("kids")).alias("right"))
        above = each.select("g", "kid.*", F.concat(F.array(side), F.col("path")).alias("path"), "last")
        if run is not runs[0]:
            above = written(above.select("g", "i", "path", "last"), "paths")
    alone = leaves.where("n = 1").drop("i", "n").join(tops, "g")
    return alone if above is None else above.select(*alone.columns).unionByName(alone)


def proof(path: Column) -> Column:
    """The hash of all siblings of a path, level by level from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, fanout: int = 8, columns: tuple[str, ...] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id_col, leaf, subroot, root and path (see paths()), and the columns of ``keep``, which move with it and so should be small."""
    keep = keep or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))  # null first, then bytewise
    rows = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("h"), F.monotonically_increasing_id().alias("place"), *[v.alias(f"k_{k}") for k, v in keep.items()])
    leaves = written(running(written(rows, "leaves"), ["g"], ["id", "h", "place"], "i", total="n").drop("place"), "numbered")
    runs, last = levels(leaves, fanout)

    subroots = running(last.select(F.lit("").alias("g"), F.col("g").alias("group"), "h"), ["g"], ["group"], "i", total="n")
    subroots = written(subroots, "subroots")
    upper, top = levels(subroots, fanout)
    root = F.lit((top.first() or {"h": None})["h"])
    ends = subroots.where("i = 0").select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), root.cast("string").alias("last"))
    tops = written(paths(subroots, upper, ends).select(F.col("group").alias("g"), "path", F.col("h").alias("last")), "tops")
    out = paths(leaves, runs, tops)
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), F.col("last").alias("subroot"), root.cast("string").alias("root"), "path", *[F.col(f"k_{k}").alias(k) for k in keep])
