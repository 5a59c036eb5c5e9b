"""MinHash near-dedup with SetSketch registers.

Every document's set of word shingles is sketched by ``REGISTERS`` truncated
minima of exponential variables, kept on an exponential scale of base ``BASE``
(a register is a small integer; sketches of two sets merge by the element-wise
maximum). Equal runs of ``BAND`` registers name a bucket. Candidates of a bucket
are compared by the joint maximum-likelihood estimate of the Jaccard
similarity from their registers and known set sizes, and what that leaves is
confirmed on the full sets. Linked sets are merged into components.

How groups of any size are handled: equal sets are one vertex from the start;
in each bucket all members are first paired with two pivots, not with each
other; members of buckets that are then still in several components are paired
through an exact prefix filter, which looks only at pairs of different
components that share a rare shingle. All pairs, of whatever bucket, pass the
same joint estimate and the same check. Nothing is capped: a crowd of m sets that
all lie just below the threshold, and so never merge, can cost up to m^2 / 2 pairs
there. Keys that many rows share (a bucket, a shingle, a set, a component) are dealt
to several tasks. A pair of similarity 0.8 shares no bucket with a chance of about 5e-8.

Only the texts of candidates are shuffled: a bitmap of fixed size leaves the others
where they are, and copies of a text are one row before they move.

Defined cases: a null or empty text has an empty set and is linked with
nothing; rows with equal texts are linked whatever their ids; a null id takes no part
in the choice of the smallest id; very long texts are one set of their own size in one task;
an empty table gives no rows; extra columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.store import KeyFilter, split_join, written

REGISTERS, BAND = 128, 4
BASE, LEVELS = 1.001, 65534
RATE = 20.0
#: Counters that order shingles by frequency, sent to every task (8 bytes each).
SLOTS = 1 << 20
LONGS = 8


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers of the sets ``h[first[i]:first[i+1]]``: uint16, one row a set.

    Register i of a set is floor(1 - log_BASE(x_i)) within [0, LEVELS + 1], x_i
    the smallest exponential variable of rate RATE that its elements draw; the
    draw is -log(1 - u) / RATE with u a 64-bit hash of the element, so that the
    minimum may be taken over the hashes.
    """
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    starts = first[:-1][full]
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, REGISTERS, dtype=np.uint64)
    low = np.empty((REGISTERS, len(full)), np.uint64)
    step = np.searchsorted(starts, np.arange(0, len(h), 1 << 15))
    for a, b in zip(step, [*step[1:], len(full)]):  # so many sets that the work stays in the cache
        if a == b:
            continue
        lo, hi = starts[a], first[full[b - 1] + 1]
        part, at, tmp = h[lo:hi], starts[a:b] - lo, np.empty(hi - lo, np.uint64)
        for i in range(REGISTERS):
            np.multiply(part, mult[i], out=tmp)
            tmp += add[i]
            low[i, a:b] = np.minimum.reduceat(tmp, at)
    x = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    level = np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)) + LEVELS // 2
    out[full] = np.clip(level, 0, LEVELS + 1).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sketched sets."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each run of BAND registers; the place of the run is part of it."""
    packed = np.ascontiguousarray(regs).view(np.uint64)  # BAND registers of 16 bits
    return kernels.mix(packed ^ kernels.mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64)))


def similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity of pairs.

    With the sizes known, registers of the two sets are larger in a, larger in b
    or equal with chances that depend on the similarity alone; the likelihood of
    the three counts is concave in it and is maximised on a grid.
    """
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    top = np.minimum(u / v, v / u)
    j = np.linspace(0.0, 1.0, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p_more, p_less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    p_same = np.maximum(1 - p_more - p_less, 1e-12)
    fit = more * np.log(p_more) + less * np.log(p_less) + (REGISTERS - more - less) * np.log(p_same)
    return j[np.arange(len(j)), fit.argmax(1)]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's elements once, sorted."""
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _sets(batch, width: int):
    """(first row, last row, hashes, first) for groups of the batch's texts."""
    data, offs = kernels.text_buffers(batch.column("text"))
    for i, j in kernels.groups(offs):
        h, _, _, first = kernels.words(data, offs[i : j + 1], "space")
        yield i, j, *_distinct(*kernels.shingles(h, first, width))


def _digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that name a set, as rows of 16 bytes."""
    n = len(first) - 1
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        for k in range(2):
            out[full, k] = np.add.reduceat(kernels.mix(h + np.uint64(k * 0x5851F42D4C957F2D + 1)), first[:-1][full])
    return out.view(np.uint8).reshape(n, 16)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    n, width = rows.shape
    offs = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def sketches(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, tk (digest of the text), sid (digest of the set), n, regs."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("tk"), F.col(text_col).alias("text"))

    def sketch(batches):
        for batch in batches:
            for i, j, h, first in _sets(batch, width):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tk"), _binary(_digest(h, first)), pa.array(np.diff(first)), _binary(registers(h, first).view(np.uint8))],
                    ["id", "tk", "sid", "n", "regs"],
                )

    return rows.mapInArrow(kernels.released(sketch), f"id {kind.simpleString()}, tk binary, sid binary, n long, regs binary")


def _bucketed(sets: DataFrame) -> DataFrame:
    """(bucket, sid, n), a row for each band of each set."""

    def keys(batches):
        for batch in batches:
            if len(batch):
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(batch), REGISTERS)
                flat = pa.array(bands(regs).view(np.int64).ravel())
                offs = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (REGISTERS // BAND))
                yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.ListArray.from_arrays(offs, flat)], ["sid", "n", "b"])

    return sets.mapInArrow(kernels.released(keys), "sid binary, n long, b array<long>").select(F.explode("b").alias("bucket"), "sid", "n")


def _near(part, least: float) -> np.ndarray:
    """Which pairs of a batch (na, nb, ra, rb) have an estimate of ``least`` or more."""
    out = np.zeros(len(part), bool)
    for at in range(0, len(part), 4096):
        some = part.slice(at, 4096)
        ra, rb = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint16).reshape(len(some), REGISTERS) for c in ("ra", "rb"))
        out[at : at + len(some)] = similarity(ra, rb, *(some.column(c).to_numpy().astype(float) for c in ("na", "nb"))) >= least
    return out


def _likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate is ``least`` or more."""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def keep(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(_near(batch, least)))

    both = split_join(pairs.join(a, "a"), b, ["b"], pairs.select("b"))  # b may be in many pairs
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(kernels.released(keep), "a binary, b binary")


def _full_sets(ids: DataFrame, sketched: DataFrame, docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """(sid, n, regs, members): the full sets, sorted, of the given sids, with their sketches."""
    ids = written(ids.distinct(), "asked")
    of = sketched.select("sid", "tk").where("sid is not null").groupBy("sid").agg(F.min("tk").alias("tk"))
    texts = written(of.join(ids, "sid", "left_semi"), "needed")
    named = docs.select(F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("tk"), F.col(text_col).alias("text"))
    named = KeyFilter(texts, "tk").marked(named, "maybe", F.col("tk")).where("maybe").select("tk", "text")

    def to_set(batches):
        for batch in batches:
            for i, j, h, first in _sets(batch, width):
                offs = (first * 8).astype(np.int64)
                full = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(i, j - i), pa.array(np.diff(first)), _binary(registers(h, first).view(np.uint8)), full.cast(pa.binary())], ["sid", "n", "regs", "members"])

    # equal texts give equal sets: one row of each is enough, taken before texts move
    return written(named.dropDuplicates(["tk"]).join(texts, "tk").select("sid", "text").mapInArrow(kernels.released(to_set), "sid binary, n long, regs binary, members binary"), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int, least: float) -> DataFrame:
    """Those of the pairs (a, b, ...) whose estimate is ``least`` or more and that 100 * intersection >= percent * union holds for, on the full sets."""
    a, b = (full.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"), F.col("members").alias(f"m{c}")) for c in "ab")
    schema = T.StructType(pairs.schema.fields)

    def verify(batches):
        for batch in batches:
            ok = _near(batch, least)
            for k in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[int(k)].as_buffer(), np.uint64) for c in ("ma", "mb"))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * common >= percent * (len(both) - common)
            yield batch.select(schema.names).filter(pa.array(ok))

    met = split_join(pairs.join(a, "a"), b, ["b"], pairs.select("b"))  # b may be in many pairs
    return met.select(*schema.names, "na", "nb", "ra", "rb", "ma", "mb").mapInArrow(kernels.released(verify), schema)


def _rarity(full: DataFrame) -> np.ndarray:
    """How often shingles of the sets occur, in SLOTS counters by hash: any fixed order of
    shingles is right for _prefix_pairs(), and this one is near that of their frequencies."""

    def count(batches):
        for batch in batches:
            if len(batch):
                members = np.frombuffer(b"".join(batch.column("members").to_pylist()), np.uint64)
                slot, n = np.unique((members % np.uint64(SLOTS)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

    rows = full.mapInArrow(kernels.released(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    out = np.ones(SLOTS, np.int64)
    out[rows["slot"]] = rows["n"]
    return out


def _prefix_pairs(full: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of different components that may be linked; exact, without a look at all pairs of a group.

    In one order of all shingles, from rare to common, two sets that are linked
    share a shingle among the first (1 - percent / 100) of each, and the first one they share
    stands so early that what follows can still make up the overlap that a link
    needs. A passage that many documents share is common, so it stands last.
    Besides, every row carries the parity of its set's shingles in 64 * LONGS
    bins: the overlap is at most half of what the sizes exceed the bins that differ.
    """
    spark = full.sparkSession
    rarity = spark.sparkContext.broadcast(_rarity(full))

    def prefixes(batches):
        order = rarity.value
        for batch in batches:
            sid, key, place, size, bits = [], [], [], [], []
            for name, members in zip(batch.column("sid").to_pylist(), batch.column("members").to_pylist()):
                h = np.frombuffer(members, np.uint64)
                n = len(h)
                first = n - -(-percent * n // 100) + 1
                odd = np.packbits((np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.int64)
                h = h[np.lexsort((h, order[(h % np.uint64(SLOTS)).astype(np.int64)]))[:first]]
                sid += [name] * len(h)
                key.append(h.view(np.int64))
                place.append(np.arange(len(h)))
                size.append(np.full(len(h), n))
                bits.append(np.tile(odd, (len(h), 1)))
            if sid:
                flat = np.concatenate(bits)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (key, place, size)), *(pa.array(flat[:, k].copy()) for k in range(LONGS))], ["sid", "key", "place", "n", *odd_bins])

    odd_bins = [f"odd{k}" for k in range(LONGS)]
    rows = full.mapInArrow(kernels.released(prefixes), f"sid binary, key long, place long, n long, {', '.join(f'{c} long' for c in odd_bins)}").join(roots, "sid")
    rows = written(rows, "prefix_rows")
    shared = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rows = written(split_join(rows, shared, ["key"], rows.select("key")), "prefixes")
    x, y = (rows.select("key", F.col("sid").alias(c), F.col("root").alias(f"root_{c}"), F.col("place").alias(f"p{c}"), F.col("n").alias(f"n{c}"), *(F.col(k).alias(k + c) for k in odd_bins)) for c in "ab")
    differ = sum((F.bit_count(F.col(k + "a").bitwiseXOR(F.col(k + "b"))) for k in odd_bins), F.lit(0))
    most = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)  # overlap, if this shingle is the first in common
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.least(most, (F.col("na") + F.col("nb") - differ) / 2) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return split_join(x, y, ["key"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near).select("a", "b", "root_a", "root_b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b); root is the same within a component.

    Each round maps a vertex to the smallest of its neighbours and itself,
    follows that map once more and contracts the edges. Vertices are digests,
    so the order among neighbours is as good as random and the number of rounds
    grows with the logarithm of the largest component. Rows are two digests; where one
    vertex has very many, adaptive execution splits the join.
    """
    edges = written(edges.distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("r"))
        near = written(near, "near")
        hop = near.select(F.col("v").alias("r"), F.col("r").alias("r2"))
        to = written(near.join(hop, "r").select("v", F.col("r2").alias("root")), "hop")
        if labels is None:
            labels = to
        else:
            then = to.select(F.col("v").alias("root"), F.col("root").alias("next"))
            labels = written(labels.join(then, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "labels")
        ra, rb = to.select(F.col("v").alias("a"), F.col("root").alias("ra")), to.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = written(edges, "contracted")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, slack: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose shingle sets are similar.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of ``width``-word shingles. ``slack``: an estimate may lie so far
    below the threshold before a pair is dropped without a look at the full sets
    (0.2 is over five standard deviations of the estimate at 0.8).

    Returns one row a document: id_col, tk (MD5 of the text, 16 bytes), root (names
    the component, 16 bytes; null for an empty set), n_shingles, component_id (the smallest id that links reach,
    itself included) and kept (id_col = component_id, or no id to compare).
    """
    sketched = written(sketches(docs, width, id_col, text_col), "sketches")
    sets = written(sketched.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), F.count(F.lit(1)).alias("copies")), "distinct")
    least = max(percent / 100 - slack, 0.0)
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  sizes that allow a link

    rows = _bucketed(sets)
    # Two pivots a bucket: the smallest set, in which others may lie, and one that is as good as random.
    pivots = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "sid")).alias("p"), F.min(F.struct("sid", "n")).alias("q"))
    pivots = written(pivots.where("size > 1").select("bucket", "size", F.array(F.struct("p.sid", "p.n"), F.struct("q.sid", "q.n")).alias("pivots")), "pivots")
    some = KeyFilter(pivots, "bucket").marked(rows, "maybe", F.col("bucket")).where("maybe").drop("maybe")
    members = written(split_join(some, pivots, ["bucket"], heavy=pivots.select("bucket", "size")), "members")  # the rows of buckets with more than one set
    first = members.select("sid", "n", F.explode(F.array_distinct("pivots")).alias("p")).where((F.col("sid") != F.col("p.sid")) & near(F.col("n"), F.col("p.n")))
    tested = written(first.select(F.col("sid").alias("a"), F.col("p.sid").alias("b")).distinct(), "tested")
    likely = written(_likely(tested, sets, least), "likely")  # by their sketches alone, so that full sets are needed for these only
    ids = likely.select(F.col("a").alias("sid")).union(likely.select(F.col("b").alias("sid")))
    labels = components(_confirmed(likely, _full_sets(ids, sketched, docs, width, text_col), percent, least))

    rest = members.where("size > 2").select("bucket", "sid").join(labels.select(F.col("v").alias("sid"), "root"), "sid", "left")
    rest = written(rest.select("bucket", "sid", F.coalesce("root", "sid").alias("root")), "rest")
    still = rest.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    roots = written(split_join(rest, still, ["bucket"], how="left_semi", heavy=pivots.select("bucket", "size")).select("sid", "root").distinct(), "roots")
    if not roots.isEmpty():
        full = _full_sets(roots.select("sid"), sketched, docs, width, text_col)
        more = written(_prefix_pairs(full, roots, percent), "more")
        found = written(_confirmed(more, full, percent, least).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "root_links")
        if not found.isEmpty():  # components of components
            over = components(found).select(F.col("v").alias("root"), F.col("root").alias("over"))
            known = labels.unionByName(roots.join(labels.select(F.col("v").alias("sid")), "sid", "left_anti").select(F.col("sid").alias("v"), "root"))
            labels = written(known.join(over, "root", "left").select("v", F.coalesce("over", "root").alias("root")), "labels")

    low = sketched.where("n > 0").groupBy("sid").agg(F.min("id").alias("low"))
    low = low.join(labels.select(F.col("v").alias("sid"), "root"), "sid", "left").select("sid", "low", F.coalesce("root", "sid").alias("root"))
    low = written(low, "low")
    ends = written(low.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("size")), "ends")
    named = written(split_join(low, ends.drop("size"), ["root"], heavy=ends.select("root", "size")).select("sid", "root", "component"), "components")
    filled = sketched.where("n > 0").select("id", "tk", "n", "sid")
    out = split_join(filled, named, ["sid"], heavy=sets.select("sid", "copies")).select("id", "tk", "root", "n", "component")
    empty = sketched.where("n = 0").select("id", "tk", F.lit(None).cast("binary").alias("root"), "n", F.lit(None).cast(sketched.schema["id"].dataType).alias("component"))
    component = F.coalesce("component", "id")
    return out.unionByName(empty).select(F.col("id").alias(id_col), "tk", "root", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
