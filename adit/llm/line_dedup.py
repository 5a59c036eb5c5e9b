r"""Line dedup with DataFrame functions alone.

Every text is split at \n. A line's key is the line without ``[\x20\x09-\x0D]``
at its ends and with A-Z lower-cased. Keys are hashed to 128 bits, each
document counts once for a key, and keys of enough documents lose all their
lines; the others are joined again by position.

The counts are summed on the map side, so that a line of a third of all
documents is one row a task; the key hashes are kept as a small table, so that
the texts are normalised once. Positions to drop are looked up by the digest of
a text, not by id: equal texts are decided once, and null or repeated ids do no
harm. Only texts that may lose a line are shuffled, and those of which there are
many copies are dealt to several tasks.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_key_chars`` are never dropped; every row is a document of its own, also
where rows repeat; input columns named ``n_lines``, ``n_dropped`` or as the text
are replaced, all others are kept.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.llm.store import KeyFilter, split_join, unused, written

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The normalised line. lower() is right, and fast, where all characters are ASCII."""
    cut = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, string.ascii_uppercase, string.ascii_lowercase))


def _hash(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def line_hashes(docs: DataFrame, min_key_chars: int = 1, text_col: str = "text") -> DataFrame:
    """tk (digest of the text) and keys: the hash of each line's key, null where the key is too short."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keys = F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= min_key_chars, _hash(k)))
    return docs.select(_digest(text_col).alias("tk"), keys.alias("keys"))


def frequent_keys(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(h, g) of the keys that ``min_docs`` documents or more have."""
    each = hashes.select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null")
    return each.groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h", "g")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, text_col: str = "text") -> DataFrame:
    """The documents without the lines whose key is in ``min_docs`` documents or more.

    Returns the input's columns with the text replaced by what is kept, and
    n_lines (before) and n_dropped.
    """
    hashes = written(line_hashes(docs, min_key_chars, text_col), "lines")
    often = written(frequent_keys(hashes, min_docs), "frequent")
    lines = hashes.select("tk", F.posexplode("keys").alias("pos", "k")).where("k is not null")
    lines = lines.select("tk", "pos", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    maybe = KeyFilter(often, "h", "g").marked(lines, "maybe", F.col("h"), F.col("g")).where("maybe").drop("maybe")
    tk, dropped, lines, flag = (unused(docs, c) for c in ("text_digest", "gone", "lines", "may_lose"))
    # copies of a text have the same positions: a set on the map side
    gone = split_join(maybe, often, ["h", "g"]).groupBy("tk").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    gone = written(gone.select(F.col("tk").alias(tk), F.col("pos").alias(dropped)), "gone")

    # a digest and a flag are all that texts without such lines need
    named = KeyFilter(gone, tk).marked(docs.withColumn(tk, _digest(text_col)), flag, F.col(tk))
    out = split_join(named.where(flag).drop(flag), gone, [tk], hashes.select(F.col("tk").alias(tk)), "left").drop(tk)
    out = out.unionByName(named.where(f"not {flag}").drop(flag, tk).withColumn(dropped, F.lit(None).cast("array<int>")))
    out = out.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    # The kept lines are the runs between positions to drop: one slice a run, so that the work is linear.
    n = F.size(lines)
    from_, to = F.concat(F.array(F.lit(-1)), F.col(dropped)), F.concat(F.col(dropped), F.array(n))
    runs = F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda r: F.slice(F.col(lines), r["a"] + 2, r["b"] - r["a"] - 1))
    kept = F.when(F.col(dropped).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    new = {text_col: kept, "n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long")}
    names = [c for c in docs.columns if c == text_col or c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[(new[c].alias(c) if c == text_col else F.col(f"`{c}`")) for c in names], *[new[c].alias(c) for c in ("n_lines", "n_dropped")])
