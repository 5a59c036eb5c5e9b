"""Shared-folder tables that cut lineage between the steps of a job, and joins that stand hot keys."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, as no machine-local folder would do.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_adit_shared", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext._adit_shared = f"file://{tempfile.mkdtemp(prefix='adit-')}"
    return spark.sparkContext._adit_shared


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/adit/{uuid.uuid4().hex}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    The result survives lost executors, has no lineage, and its size is known
    to the planner, so that a join broadcasts it only below the session's
    threshold.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a key filter, whatever the number of keys.
FILTER_BITS = 1 << 24
#: Rows of one key that may meet in a task, and the least number of such keys that may be told apart.
HOT_ROWS, HOT_KEYS = 1024, 20_000


class KeyFilter:
    """A bitmap of hashed keys: rows that surely have none of them need no join.

    The bits are kept 64 to a row, so the table has at most FILTER_BITS / 64 rows of two numbers and is
    broadcast at every size of the input. With very many keys all bits are set and every row goes on to the join.
    """

    def __init__(self, keys: DataFrame, *names: str):
        h = self._slot([F.col(c) for c in names])
        rows = keys.select(F.shiftright(h, 6).alias("word"), self._bit(h).alias("bit"))
        self.bits = written(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")

    @staticmethod
    def _slot(key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS).cast("long"))

    @staticmethod
    def _bit(slot: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))

    def marked(self, rows: DataFrame, name: str, *key: Column) -> DataFrame:
        """The rows with a boolean column: false where the key is surely not among the keys."""
        word, bits = unused(rows, "kf_word"), unused(rows, "kf_bits")
        slot = self._slot(list(key))
        at = rows.join(F.broadcast(self.bits.toDF(word, bits)), F.shiftright(slot, 6) == F.col(word), "left")
        hit = F.col(bits).bitwiseAND(self._bit(slot)) != 0
        return at.withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, bits)


def split_join(many: DataFrame, one: DataFrame, on: list[str], counts: DataFrame | None = None, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """The join of ``many`` with ``one`` (of few rows a key), where a key of ``many`` may be hot.

    ``counts``: rows of ``many``, or more, as keys, if not ``many`` itself is to be counted; ``heavy``: keys
    with their number of rows (the last column), if that is known already.
    A key of more than HOT_ROWS rows is dealt to several tasks, to each of which
    the rows of ``one`` are sent. Keys are told apart from so many rows on that
    at most HOT_KEYS of them can exist, so that their table can be broadcast.
    """
    n, parts, salt = (unused(many, unused(one, c)) for c in ("hot_rows", "hot_parts", "hot_salt"))
    if heavy is None:
        sized = (many if counts is None else counts).groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    else:
        sized = heavy.toDF(*on, n)
    sized = sized.where(F.col(n) > HOT_ROWS)
    total = sized.agg(F.sum(n)).first()[0]
    if not total:
        return many.join(one, on, how)
    sized = written(sized, "hot") if heavy is None else sized
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(sized.where(F.col(n) > least).select(*on, F.ceil(F.col(n) / least).cast("int").alias(parts)))
    # dealt by what a row holds and by its task: the same when a task is repeated, and equal rows of several tasks part
    plain = [F.col(f"`{f.name}`") for f in many.schema.fields if f.name not in on and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    deal = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col(parts)).cast("int")
    dealt = many.join(hot, on, "left").withColumn(salt, F.when(F.col(parts).isNotNull(), deal).otherwise(0)).drop(parts)
    sent = one.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(sent, [*on, salt], how).drop(salt)


def running(rows: DataFrame, group: list[str], order: list[str], name: str, add: str | None = None, total: str | None = None) -> DataFrame:
    """The rows with ``name``: how many rows of their group, or which sum of the long column ``add``, stand before them; ``total``: a name for that of the whole group.

    It is what row_number() - 1, or a running sum, gives over a window partitioned by ``group`` and ordered by
    ``group`` and ``order`` (nulls first), but no task gets a whole group: rows are dealt by range, numbered or summed within a
    range in its order, and shifted by what the ranges before hold of the same group, a table of a
    row for each range and group. Columns of ``order`` that tell all rows apart let a group of any make be cut.
    """
    part, at, shift = (unused(rows, c) for c in ("range_part", "range_at", "range_shift"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if add is None:
        place = F.monotonically_increasing_id()  # the number of the range above 33 bits for the place in it
        dealt = dealt.withColumn(at, place).withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    else:
        schema = T.StructType([*dealt.schema.fields, T.StructField(at, T.LongType())])

        def sums(batches):
            total = 0
            for batch in batches:
                x = np.cumsum(batch.column(add).to_numpy(zero_copy_only=False))
                before = total + np.concatenate([[0], x[:-1]]) if len(x) else x
                total += int(x[-1]) if len(x) else 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.astype(np.int64))], [*batch.schema.names, at])

        dealt = dealt.mapInArrow(sums, schema).withColumn(part, F.spark_partition_id().cast("long"))
    dealt = written(dealt, "dealt")
    size = F.count(F.lit(1)) if add is None else F.sum(add)
    parts = dealt.groupBy(*group, part).agg(size.alias("n"), F.min(at).alias("first"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(part)) - F.col("n")
    whole = F.sum("n").over(Window.partitionBy(*group))
    parts = written(parts.select(*group, part, (before - F.col("first")).alias(shift), *([whole.alias(total)] if total else [])), "ranges")
    on = [dealt[c].eqNullSafe(parts[c]) for c in group] + [dealt[part] == parts[part]]
    return dealt.join(parts, on).select(*[dealt[f"`{c}`"] for c in rows.columns], (dealt[at] + parts[shift]).alias(name), *([parts[total]] if total else []))
