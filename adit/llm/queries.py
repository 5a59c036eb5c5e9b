"""The queries opN_<name> of the operators, over whole tables, with their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.llm import bpe, decontaminate, langid, line_dedup, merkle, mixing, near_dedup, quality, resample, sampling, secrets, topk, toxicity, warc
from adit.llm.store import new_path, split_join, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, out = table(spark, sf_dir, "labels"), sampling.held_out("doc_id", 5, 0)
    featured = written(quality.features(table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    scored = quality.score(featured, quality.fit(featured, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate: doc_id, word_index, secret, score and predicted (score of 0.5 or more). The source stands for the path."""
    docs = table(spark, sf_dir, "documents")
    spoken = secrets.language(docs)
    forest = secrets.train(secrets.with_features(secrets.labelled_candidates(secrets.labelled_findings(spark)), *spoken))
    found = secrets.scored(secrets.with_features(secrets.candidates(docs, path_col="source"), *spoken), forest)
    return found.select(F.col("id").alias("doc_id"), F.col("at").alias("word_index"), F.col("candidate").alias("secret"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.with_revisits(table(spark, sf_dir, "pages"), min_bytes=0)
    files = written(warc.write_archives(rows, new_path(spark, "warc")), "files")
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = sampling.held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, labels.where(~out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    hit = decontaminate.n_hit()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), sampling.held_out("doc_id", 4, 2)
    model = langid.fit(docs.where(~out).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).drop("text")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    weights = resample.weighed(docs, resample.gains(docs, target)).drop("text")
    return resample.drawn(weights, percent=5, min_words=20, seed=42).select("doc_id", "n_features", "weight", "score", "rank")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also copies: how often the mix takes the document."""
    docs, sources = mixing.mix(table(spark, sf_dir, "documents"), (3.0, 1.0, 2.0), share=1.5, repeats=2)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    targets = sources.select(key, F.col("size").alias("source_size"), "target")
    return split_join(docs.withColumn("key", key), targets, ["key"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose crc32 3 divides are checked with a text whose A-Z are lower-cased."""
    told = [F.col(c) if c != "text" else merkle.ascii_lower(F.col("text")) for c in merkle.COLUMNS]
    tampered = F.when(sampling.bucket("doc_id", 3) == 0, merkle.leaf(told))
    found = merkle.manifest(table(spark, sf_dir, "documents"), fanout=8, keep={"tampered": tampered})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict:
    return dict(ORACLES)


#: A-Z to a-z, and white space at the ends, in DuckDB
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a string's UTF-8 bytes: a step of eight bits is linear in each bit of a byte, whose masks these are
_CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)
_CRC_STEP = "c >> 8"
for _k, _v in enumerate(_CRC_BITS):
    _CRC_STEP = f"xor({_CRC_STEP}, ((xor(c, b) >> {_k}) & 1) * {_v})"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: " + _CRC_STEP + ", 4294967295), 4294967295)"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(strlen({0}) || ':' || {0}, '-'))"
_SIDES = "string_agg(h, '') OVER (PARTITION BY g, level, i // 8 ORDER BY i ROWS BETWEEN {} AND {})"
_SIDES = f"coalesce({_SIDES.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, '') AS l, coalesce({_SIDES.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}, '') AS r"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
        k AS (SELECT doc_id, line, pos, {_LOW.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op3_near_dedup": rf"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.v),
        m AS (SELECT v, min(r) AS component_id FROM r GROUP BY v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_warc": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
        d AS (SELECT h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS b FROM (SELECT DISTINCT h FROM p))
        SELECT page_id, n AS payload_bytes, b AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (h, n) JOIN d USING (h)""",
    "op8_decontaminate": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
        q AS MATERIALIZED (
            SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
        p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM q)),
        h AS MATERIALIZED (SELECT doc_id, i, p.n, item_id FROM p JOIN q ON q.n = p.n AND q.g = array_to_string(w[i:i + p.n - 1], ' ')),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_resample": rf"""
        WITH a AS MATERIALIZED (
            SELECT true AS target, NULL AS doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark
            UNION ALL SELECT false, doc_id, {_WORDS.format("coalesce(text, '')")} FROM documents),
        x AS (SELECT target, doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM a, (VALUES (1), (2), (3)) t(k)),
        f AS MATERIALIZED (SELECT target, doc_id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM x GROUP BY ALL),
        b AS MATERIALIZED (SELECT g, {_CRC.format("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)),
        c AS (SELECT bucket, sum(n) FILTER (target) AS t, sum(n) FILTER (NOT target) AS s FROM f JOIN b USING (g) GROUP BY bucket),
        z AS (SELECT CAST(sum(n) FILTER (target) AS DOUBLE) AS t, CAST(sum(n) FILTER (NOT target) AS DOUBLE) AS s FROM f),
        v AS (SELECT bucket, floor(1000 * ln((coalesce(c.t, 0) + 1.0::DOUBLE) * (z.s + 10000) / ((coalesce(c.s, 0) + 1.0::DOUBLE) * (z.t + 10000)))) AS gain FROM c, z),
        w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN v USING (bucket) WHERE NOT target GROUP BY doc_id),
        d AS (SELECT a.doc_id, len(a.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     CAST('0x' || substr(sha256('42:' || a.doc_id), 1, 8) AS BIGINT) AS h FROM a LEFT JOIN w USING (doc_id) WHERE NOT target),
        e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= 20)
        SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM e LEFT JOIN o USING (doc_id)""",
    "op12_mixing": rf"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT) AS seeded FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS whole FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
        o AS (SELECT *, sum(whole) OVER () AS total, coalesce(sum(2 * whole) OVER (ORDER BY 2 * whole / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                     sum(weight) OVER (ORDER BY 2 * whole / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
        r AS (SELECT min_by((1.5::DOUBLE * CAST(total AS DOUBLE) - CAST(used AS DOUBLE)) / open, used) AS rate FROM o
              WHERE (1.5::DOUBLE * CAST(total AS DOUBLE) - CAST(used AS DOUBLE)) / open * weight <= 2 * whole),
        t AS MATERIALIZED (SELECT source, whole, least(2.0::DOUBLE * whole, weight * rate) AS target FROM w, r),
        p AS (SELECT *, CASE WHEN whole > 0 THEN CAST(floor(target) AS BIGINT) // whole ELSE 0 END AS passes, CASE WHEN whole > 0 THEN CAST(floor(target) AS BIGINT) % whole ELSE 0 END AS rest FROM t),
        m AS (SELECT d.*, whole, target, passes, rest, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY seeded, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        x AS MATERIALIZED (SELECT *, size > 0 AND before + size <= rest AS fits FROM m),
        g AS (SELECT source, max(rest) - coalesce(max(before + size) FILTER (fits), 0) AS gap FROM x WHERE rest > 0 GROUP BY source),
        u AS (SELECT source, length(bin(size)) AS o, count(*) AS n FROM x WHERE size > 0 AND NOT fits AND rest > 0 GROUP BY ALL),
        c AS MATERIALIZED (
            SELECT x.source, before, size, gap, row_number() OVER (PARTITION BY x.source ORDER BY size DESC, before) AS k
            FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source JOIN u ON x.source IS NOT DISTINCT FROM u.source AND u.o = length(bin(size))
            WHERE size > 0 AND NOT fits AND size <= gap AND CAST('0x' || substr(md5(CAST(before AS VARCHAR)), 1, 8) AS BIGINT) * u.n < 64 * 4294967296),
        f AS (SELECT source, 0 AS k, gap AS gap, CAST(NULL AS BIGINT) AS before FROM c WHERE k = 1
              UNION ALL SELECT f.source, c.k, CASE WHEN size <= f.gap THEN f.gap - size ELSE f.gap END, CASE WHEN size <= f.gap THEN c.before END
                        FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source AND c.k = f.k + 1)
        SELECT doc_id, size, whole AS source_size, target, size * copies AS taken, copies
        FROM (SELECT x.*, CASE WHEN size = 0 THEN 0 ELSE passes + CAST(fits OR f.before IS NOT NULL AS INTEGER) END AS copies
              FROM x LEFT JOIN (SELECT * FROM f WHERE before IS NOT NULL) f ON f.source IS NOT DISTINCT FROM x.source AND f.before = x.before AND size > 0)""",
    "op13_manifest": f"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format("text")} AS leaf,
                   CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(_LOW.format("text"))} ELSE {_LEAF.format("text")} END AS told FROM documents),
        a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
        t AS MATERIALIZED (SELECT g, 0 AS level, i, n, leaf AS h FROM a
            UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 8, n),
        s AS MATERIALIZED (SELECT g AS lang, '*' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM t WHERE n = 1),
        u AS MATERIALIZED (SELECT g, 0 AS level, i, n, h FROM s
            UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY g, level, i // 8, n),
        x AS MATERIALIZED (SELECT g, level, i, {_SIDES} FROM (SELECT * FROM t UNION ALL SELECT * FROM u) WHERE n > 1),
        p AS (SELECT a.*, 0 AS level, i AS node, told AS h, '' AS siblings FROM a
            UNION ALL SELECT p.* REPLACE (p.level + 1 AS level, p.node // 8 AS node, sha256(x.l || p.h || x.r) AS h, siblings || x.l || x.r AS siblings) FROM p JOIN x ON x.g = p.g AND x.level = p.level AND x.i = p.node),
        e AS MATERIALIZED (SELECT doc_id, leaf, s.h AS subroot, s.g, 0 AS level, s.i AS node, p.h AS h, siblings, s.n FROM p JOIN s ON s.lang = p.g
                           WHERE p.level = (SELECT max(level) FROM t WHERE t.g = p.g)),
        q AS (SELECT * FROM e
            UNION ALL SELECT q.* REPLACE (q.level + 1 AS level, q.node // 8 AS node, sha256(x.l || q.h || x.r) AS h, siblings || x.l || x.r AS siblings, (q.n + 7) // 8 AS n) FROM q JOIN x ON x.g = q.g AND x.level = q.level AND x.i = q.node)
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM q, (SELECT h AS root FROM u WHERE n = 1) WHERE n = 1""",
}
