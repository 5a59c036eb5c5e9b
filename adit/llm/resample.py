r"""Importance resampling of documents towards a target distribution, by hashed word n-grams.

A byte automaton reads Arrow's UTF-8 buffers: a table tells word bytes from
others, words begin and end where neighbouring bytes differ in class, and
CRC-32 states of all words advance together, eight bytes a step, through tables.
The state of a run of words comes from those of its words: a table, by the number of bytes
that follow, carries a state over the next word, whose own checksum is added. A feature
is a run of 1 to ``LONGEST`` words, A-Z as a-z, joined by one space; its bucket is the
checksum of its bytes modulo ``buckets``.

Both sides are counted over all rows: each task sums into one array of
``buckets`` numbers, which it gives out once. A bucket's gain is the floored, scaled log-ratio of its smoothed
chances in the target and in the documents; a document's weight is the sum of the
gains of its features. Seeded Gumbel noise on the weights makes the largest scores a
draw without replacement. They are ranked by ranges of scores, no task
having all of them.

Defined cases: a null or empty text has no features, weight 0 and is never drawn while
``min_words`` is positive; rows that repeat are documents of their own, a null id is hashed as an empty one and stands
last among ties; rows equal in score and id are ordered arbitrarily; very long texts are read in pieces; an empty target or table of documents is a
distribution of smoothing alone; without documents there are no rows; input columns named as the results, in any case, are replaced,
all others are kept.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.store import running, unused, written

LONGEST, BUCKETS = 3, 10_000
#: Words of more bytes have their checksum from zlib and are carried over bit by bit of their length.
LONG = 64
_POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def _slices() -> np.ndarray:
    """For each of eight bytes, by its distance from the last: what it adds to the state, uint32[8, 256]."""
    t = np.zeros((8, 256), np.uint32)
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(_POLYNOMIAL), v >> 1)
    t[0] = v
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & 0xFF] ^ (t[k - 1] >> 8)
    return t


def _carried(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Linear map of states by a uint32[4, 256] table of their bytes."""
    return table[0][state & 0xFF] ^ table[1][(state >> 8) & 0xFF] ^ table[2][(state >> 16) & 0xFF] ^ table[3][state >> 24]


@lru_cache(maxsize=1)
def _doublings() -> list[np.ndarray]:
    """Tables that carry a state over 1, 2, 4, ... zero bytes."""
    bytes_ = np.arange(256, dtype=np.uint32)
    one = np.stack([_slices()[0][bytes_], *(bytes_ << np.uint32(8 * k - 8) for k in range(1, 4))])
    out = [one]
    for _ in range(31):
        out.append(np.stack([_carried(row, out[-1]) for row in out[-1]]))
    return out


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Tables by number of zero bytes up to LONG + 1, as one row: uint32[(LONG + 2) * 4 * 256]."""
    identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [identity]
    for _ in range(LONG + 1):
        out.append(np.stack([_carried(row, _doublings()[0]) for row in out[-1]]))
    return np.concatenate([x.ravel() for x in out])


def carried(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States (uint32) carried over n zero bytes each."""
    at = np.minimum(n, LONG + 1) * 1024
    t = _shifts()
    out = t[at + (state & 0xFF)] ^ t[at + 256 + ((state >> 8) & 0xFF)] ^ t[at + 512 + ((state >> 16) & 0xFF)] ^ t[at + 768 + (state >> 24)]
    over = np.flatnonzero(n > LONG + 1)
    if len(over):
        s, left = state[over], n[over]
        for k, table in enumerate(_doublings()):
            on = (left >> k) & 1 == 1
            s[on] = _carried(s[on], table)
        out[over] = s
    return out


@lru_cache(maxsize=1)
def _zeros() -> np.ndarray:
    """Checksums of 0 to LONG zero bytes: they turn linear states into checksums."""
    return np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], np.uint32)


@lru_cache(maxsize=1)
def _low() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def checksums(piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges of ``piece``, A-Z as a-z.

    Ranges are read from their end back to whole steps of eight bytes: zeros before
    a range leave a state of zero as it is.
    """
    if not len(start):
        return np.zeros(0, np.uint32)
    padded = np.zeros(len(piece) + 8, np.uint8)
    np.take(np.frombuffer(_low(), np.uint8), piece, out=padded[8:])
    lanes = np.ndarray((len(piece) + 1,), "<u8", buffer=padded, strides=(1,))  # lanes[e]: the eight bytes before place e
    t, length = _slices(), end - start
    short = length <= LONG
    state = np.zeros(len(start), np.uint32)
    steps = np.where(short, (length + 7) // 8, 0)
    for step in range(int(steps.max()), 0, -1):
        some = np.arange(len(start)) if step == 1 and short.all() else np.flatnonzero(steps >= step)
        back = length[some] - 8 * (step - 1)  # bytes from the first of the range to the end of this step
        word = lanes[end[some] - 8 * (step - 1)]
        word = (word >> (8 * np.maximum(8 - back, 0)).astype(np.uint64)) << (8 * np.maximum(8 - back, 0)).astype(np.uint64)
        word ^= state[some]
        b = word.view(np.uint8).reshape(-1, 8)
        s = t[7][b[:, 0]]
        for k in range(1, 8):
            s ^= t[7 - k][b[:, k]]
        state[some] = s
    out = state ^ _zeros()[np.minimum(length, LONG)]
    for i in np.flatnonzero(~short):
        out[i] = zlib.crc32(padded[8 + start[i] : 8 + end[i]])
    return out


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    """What carries over a word of n bytes from the space before it: the checksum of a space, carried over n zeros."""
    n = np.arange(LONG + 1)
    return carried(np.full(len(n), zlib.crc32(b" "), np.uint32), n)


def features(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS):
    """(bucket of each feature, first, words): of the documents ``data[offs[i]:offs[i+1]]`` in turn; ``first`` as in kernels.words()."""
    crc, start, end, first = kernels.words(data, offs, "alnum", checksums)
    crc, length, n = crc.astype(np.uint32), end - start, np.diff(first)
    spaced = crc ^ _spaces()[np.minimum(length, LONG)]  # checksum of a space and the word
    for i in np.flatnonzero(length > LONG):
        spaced[i] = crc[i] ^ carried(np.array([zlib.crc32(b" ")], np.uint32), length[i : i + 1])[0]
    doc = np.repeat(np.arange(len(n)), n)
    made, home = [crc], [doc]
    state, at = crc, np.arange(len(crc))
    for k in range(1, LONGEST):
        more = at[: max(len(crc) - k, 0)]
        inside = doc[more] == doc[more + k] if len(more) else np.zeros(0, bool)
        state = carried(state[: len(more)], length[more + k] + 1) ^ spaced[more + k]  # across documents too: left out below
        made.append(state[inside])
        home.append(doc[more][inside])
    count = sum(np.maximum(n - k, 0) for k in range(LONGEST))
    order = np.argsort(np.concatenate(home), kind="stable")
    bucket = (np.concatenate(made) % np.uint32(buckets)).astype(np.int32)[order]
    return bucket, np.concatenate([[0], np.cumsum(count)]), n


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any; one row a bucket and task is shuffled."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offs = kernels.text_buffers(batch.column(0))
            for i, j in kernels.groups(offs):
                total += np.bincount(features(data, offs[i : j + 1], buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s of S features of the documents and t of T of the target."""
    s, t = (bucket_counts(x, buckets, text_col).withColumnRenamed("n", c) for x, c in ((docs, "s"), (target, "t")))
    rows = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0).toPandas()  # of a stated number of rows
    s, t = (rows.sort_values("bucket")[c].to_numpy(np.int64) for c in "st")
    ratio = (t + 1.0) * (float(s.sum()) + buckets) / ((s + 1.0) * (float(t.sum()) + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_features and weight."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    new = {"n_words": T.LongType(), "n_features": T.LongType(), "weight": T.LongType()}
    schema = T.StructType([f for f in docs.schema.fields if f.name in kernels.others(docs.columns, new)] + [T.StructField(k, v) for k, v in new.items()])

    def weigh(batches):
        gain = sent.value
        for batch in batches:
            data, offs = kernels.text_buffers(batch.column(text_col))
            for i, j in kernels.groups(offs):
                bucket, first, n = features(data, offs[i : j + 1], len(gain))
                yield kernels.append(batch.slice(i, j - i), {"n_words": pa.array(n.astype(np.int64)), "n_features": pa.array(np.diff(first).astype(np.int64)), "weight": pa.array(kernels.row_sums(gain[bucket], first))})

    return docs.mapInArrow(weigh, schema)


def drawn(rows: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Rows of weighed() with score and rank: the floor(percent * N / 100) highest scores of the N rows with ``min_words`` words or more have ranks 1, 2, ...

    A bound from an approximate percentile leaves the low scores out of the
    ranking; it is checked to hold rows enough, and is lowered if not.
    """
    names = kernels.others(rows.columns, ["score", "rank"])
    place = unused(rows, "place")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = rows.select(*[f"`{c}`" for c in names], (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias(place))
    scored = written(scored, "scored")
    able = F.col("n_words") >= min_words
    n = scored.agg(F.count_if(able)).first()[0]
    most, share, bound = n * percent // 100, 1.0 - percent / 100.0, None
    while most and bound is None:
        share -= 0.01
        low = scored.where(able).agg(F.percentile_approx("score", max(share, 0.0), 1000)).first()[0]
        if share <= 0 or scored.where(able & (F.col("score") >= low)).count() >= most:
            bound = low if share > 0 else -(1 << 63)
    high = able & (F.col("score") >= F.lit(bound if most else (1 << 63) - 1).cast("long")) & F.lit(bool(most))
    key, last = unused(scored, "key"), unused(scored, "no_id")
    top = scored.where(high).withColumn(key, -F.col("score")).withColumn(last, F.col(id_col).isNull())
    top = running(top, [], [key, last, id_col, place], "rank")
    top = top.withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1)).drop(key, last, place)
    rest = scored.where(~high).drop(place).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_features, weight, score and rank (null: not drawn).

    All columns are written once on the way; with weighed() and drawn() a caller can leave texts out between the two.
    """
    return drawn(weighed(docs, gains(docs, target, buckets, text_col), text_col), percent, min_words, seed, id_col)
