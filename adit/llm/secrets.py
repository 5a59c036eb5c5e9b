r"""Secret scans with DataFrame functions and a random forest.

Candidates are runs of 16 or more key signs (letters, digits, ``+/_-``, up to two
``=`` at the end) with at least one digit, within the words of a text, and every
value that is assigned to a name like token or password, or quoted after one,
whatever its length and signs. A quoted value ends at its quote, in its line; a
bare one at white space, a quote or the next assignment, without closing
punctuation. A random forest removes false positives. It looks at a candidate's length and signs, at
its character transitions (their mean log-odds under those of the corpus's words, and how often the kind
of sign changes), at the share that words of the corpus cover, at the path, and at the
neighbouring words (a telling name, words of digests and ids, an assignment, quotes).

The forest is trained from labelled findings: any table of texts with a value and
whether it is a secret. labelled_findings() makes one: keys of well-known formats and
passwords among what is taken for them (digests, ids, numbers, encoded text, names, placeholders), with names, places
and paths drawn apart from the labels where both occur. These are made data: how well they stand for the secrets of a
corpus is not measured.

All steps are DataFrame functions on the JVM: candidates are found in place,
without a shuffle; words are counted over all texts; the forest sees at most ``most`` distinct findings, by a hash of
each and of both labels, so its scores are not shares of the whole table.

Defined cases: null or empty texts have no candidates; every occurrence is a
finding, so repeated rows repeat theirs; without findings of both labels all
scores are the only label (0 without any); a null path is an empty one; very long values are one candidate; without
texts the corpus has no words: nothing is covered and all transitions are alike; of equally frequent words the first in
order belong to the dictionary; extra columns are not read.
"""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.llm.store import written

SPACES = r"[ \t\r\n\x0b\f]+"
SIGNS = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
NAMES = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private)"
#: A telling name with the rest of its word and perhaps one word more
_NAME = NAMES + r"[\w.\-]*+(?:[ \t]++[\w.\-]++)??[\"'`\])]*+"
#: An assignment, perhaps after a type, and the scheme of a credential
_SET = r"\s*+(?::[ \t]*+[\w.\[\]]++[ \t]++(?==))?[!:=]{1,3}>?"
_SCHEME = r"[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?"
#: Inside quotes; the quote is group {0}. Bare: not another name with its colon, to the next assignment.
_QUOTED = r"([\"'`])((?:\\.|(?!\{0})[^\\\r\n])++)(?=\{0})"
_BARE = r"([\"'`]?)((?![\w.\-]++:(?:\s|$))(?:(?![,;&][\w.\-]++[ \t]*+[:=])[^\s\"'`\x{{FDD1}}])++)"
#: Before a value: groups 1, 3, 4, 6, 7, 9, 11; values assigned in quotes, assigned bare, and quoted after a name: 5, 8, 12
_VALUES = "(?i)(" + _NAME + _SET + r")(?:(\s*+)" + _QUOTED.format(4) + "|(" + _SCHEME + ")" + _BARE.format() + ")|(" + _NAME + r"[\s(]++)" + _QUOTED.format(11)
#: Signs that no text should hold mark the start and the end of a value.
_START, _END = "\ufdd0", "\ufdd1"
FEATURES = ("length", "digits", "uppers", "signs", "changes", "repeats", "transitions", "covered", "test_path", "config_path", "named", "assigned", "quoted", "digest_near", "holes")
#: Words near digests, ids and numbers that are no secrets
OTHERS = r"(?i)(commit|sha|md5|digest|checksum|etag|uuid|guid|hash|order|invoice|card|phone|version|build|session_id|trace|image|data:)"
#: Letters and digits, and everything else: what transitions are counted between
_KINDS = 37


def _values(text: Column) -> tuple[Column, Column]:
    """The words of ``text`` with values marked, and the values in order, each with the part of its word before it."""
    marked = F.regexp_replace(F.translate(text, _START + _END, "\ufffd\ufffd"), F.lit(_VALUES), F.lit(f"$1$3$4$6$7$9$11{_START}$5$8$12{_END}"))
    marked = F.when(text.rlike(NAMES), marked)
    parts = F.split(marked, _START)
    before = F.transform(parts, lambda p: F.substring_index(F.translate(F.replace(p, F.lit(_END), F.lit("")), "\t\r\n\x0b\f", "     "), " ", -1))
    value = F.transform(parts, lambda p: F.substring_index(p, _END, 1))
    bare = lambda lead, v: F.when(lead.rlike("[\"'`]$"), v).otherwise(F.rtrim(v, F.lit(",;.)}]>")))
    # the first part has no value before it, the last none after
    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.get(before, k - 1).alias("lead"), bare(F.get(before, k - 1), F.get(value, k)).alias("value")))
    return F.split(marked, SPACES), F.when(F.size(parts) > 1, found)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, path, at, candidate, word, before, before2, after, lead): a row for each candidate; ``at`` counts words from 0, ``lead`` is its word up to it."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9]") | F.col("text").rlike(NAMES))
    marked, values = _values(F.col("text"))
    rows = rows.select("id", "path", F.split("text", SPACES).alias("w"), marked.alias("m"), values.alias("v"))
    hits = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(F.get("w", i)) >= 16) & F.get("w", i).rlike(SIGNS) & F.get("w", i).rlike("[0-9]"))
    hits = F.transform(hits, lambda i: F.struct(i.alias("at"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("string").alias("value")))
    # a word has as many values as marks
    ats = F.flatten(F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.array_repeat(i, F.regexp_count(F.get("m", i), F.lit(_START)))))
    named = F.zip_with(ats, "v", lambda i, x: F.struct(i.alias("at"), x["lead"].alias("lead"), x["value"].alias("value")))
    rows = rows.withColumn("x", F.explode(F.concat(hits, F.when(F.col("v").isNotNull(), named).otherwise(F.filter(hits, lambda _: F.lit(False))))))
    near = lambda k: F.coalesce(F.get("w", F.col("x.at") + k), F.lit(""))
    rows = rows.select("id", "path", "x.at", "x.lead", "x.value", near(0).alias("word"), near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"))
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({SIGNS})"), 1), lambda c: c.rlike("[0-9]"))
    # a value that is a run is a candidate as such already
    found = F.when(F.col("value").isNull(), runs).when((F.length("value") > 0) & ~F.array_contains(runs, F.col("value")), F.array("value"))
    rows = rows.withColumn("candidate", F.explode(found))
    return rows.select("id", "path", "at", "candidate", "word", "before", "before2", "after", F.coalesce("lead", F.split_part("word", F.col("candidate"), F.lit(1))).alias("lead"))


def _rate(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def _steps(word: Column) -> Column:
    """The transitions of a word as numbers: 37 * kind + next kind; a-z are 0 to 25, digits 26 to 35, all others 36."""
    codes = F.transform(F.split(F.lower(word), ""), lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c.rlike("^[0-9]$"), F.ascii(c) - 22).otherwise(36))
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * _KINDS + b)


def language(docs: DataFrame, text_col: str = "text", words: int = 20_000, shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """What the corpus's words are like: (dictionary, transitions), counted over all texts.

    dictionary: (piece), its ``words`` most frequent words of ``shortest`` letters a-z or more; a table of bounded size.
    transitions: one row, ``odds``: for each transition ln(p / uniform) within words, smoothed.
    """
    each = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("w")).where("w <> ''")
    counts = written(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    dictionary = written(counts.where(F.length("w") >= shortest).orderBy(F.desc("n"), "w").limit(words).select(F.col("w").alias("piece")), "dictionary")
    steps = counts.select("n", F.explode(_steps(F.col("w"))).alias("step")).groupBy("step").agg(F.sum("n").alias("n"))
    every = docs.sparkSession.range(_KINDS * _KINDS).select(F.col("id").cast("int").alias("step")).join(F.broadcast(steps), "step", "left")
    entry = F.struct("step", (F.coalesce("n", F.lit(0)) + 1.0).alias("n"))
    rows = every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["n"]).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    return dictionary, written(rows.withColumn("total", total).select(F.transform("n", lambda x: F.ln(x / F.col("total") * (_KINDS * _KINDS))).alias("odds")), "transitions")


def _covered(found: DataFrame, dictionary: DataFrame, shortest: int = 4) -> DataFrame:
    """(candidate, covered): the share of each distinct candidate that words of the dictionary, of any length, cover, where any does."""
    low, first = F.lower("candidate"), F.substring("piece", 1, shortest).alias("first")
    at = F.explode(F.sequence(F.lit(1), F.length("candidate") - shortest + 1)).alias("at")
    cut = found.select("candidate").distinct().where(F.col("candidate").rlike("(?i)[a-z]{%d}" % shortest)).select("candidate", at)
    cut = cut.select("candidate", "at", F.substring(low, F.col("at"), F.lit(shortest)).alias("first"))
    # of a stated number of words, met by their first letters
    hits = cut.join(F.broadcast(dictionary.select(first, "piece")), "first").where(F.substring(low, F.col("at"), F.length("piece")) == F.col("piece"))
    ends = hits.groupBy("candidate", "at").agg(F.max(F.length("piece")).alias("n"))
    signs = ends.select("candidate", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("k")).distinct()
    return signs.groupBy("candidate").agg((F.count(F.lit(1)) / F.length("candidate")).alias("covered"))


def with_features(found: DataFrame, dictionary: DataFrame, transitions: DataFrame) -> DataFrame:
    """The candidates with FEATURES as double columns f_<name>; see language() for the two tables."""
    found = written(found, "found")
    context = F.concat_ws(" ", "before2", "before", "lead")
    steps = F.transform(_steps(F.col("candidate")), lambda k: F.get("odds", k))
    values = {
        "length": F.ln(F.length("candidate")), "digits": _rate("[0-9]"), "uppers": _rate("[A-Z]"), "signs": _rate("[^A-Za-z0-9]"),
        "changes": _rate("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "repeats": _rate(r"(.)(?=\1)"),
        "transitions": F.coalesce(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(steps), F.lit(0)), F.lit(0.0)), "covered": F.coalesce("covered", F.lit(0.0)),
        "test_path": F.col("path").rlike("(?i)(test|example|sample|mock|docs?/)").cast("int"), "config_path": F.col("path").rlike(r"(?i)(\.env|config|settings|\.ya?ml|\.ini|\.properties)").cast("int"),
        "named": context.rlike(NAMES).cast("int"), "assigned": context.rlike(r"[=:]\s*[\"'`]?$").cast("int"), "quoted": F.col("word").rlike("[\"'`]").cast("int"),
        "digest_near": context.rlike(OTHERS).cast("int"), "holes": F.col("candidate").rlike(r"(?i)(^[<${%]|\$\{|x{4,}|\*{3,}|\.{3}|your[_-]|example|changeme|placeholder|environ|getenv)").cast("int"),
    }
    rows = found.join(_covered(found, dictionary), "candidate", "left").crossJoin(F.broadcast(transitions))  # one row
    return rows.select(*found.columns, *[v.cast("double").alias(f"f_{k}") for k, v in values.items()])


def _drawn(alphabet: str, n: Column | int, seed: int) -> Column:
    """n signs of the alphabet, by the row's id."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")


def _one_of(values: tuple[str, ...], seed: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))).cast("int"))


def labelled_findings(spark: SparkSession, n: int = 8_000) -> DataFrame:
    """Made texts (id, path, text, value, label): ``n`` rows in equal parts of the kinds below, half of them secrets."""
    lower, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    upper, alnum = lower.upper(), lower + lower.upper() + digit
    join, size = F.concat, lambda lo, hi, seed: (F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(hi - lo + 1))).cast("int")
    word = lambda seed: _one_of(("river", "table", "green", "window", "people", "garden", "number", "report", "market", "paper", "summer", "letter"), seed)
    name = _one_of(("token", "api_key", "apiKey", "secret", "password", "AUTH_TOKEN", "client_secret", "passwd", "access_key", "credential"), 1)
    other = _one_of(("commit", "sha1", "md5", "checksum", "etag", "uuid", "order", "invoice", "version", "build", "trace", "image"), 2)
    quote = _one_of(('"', "'", ""), 3)
    to_name = lambda v: join(name, _one_of((" = ", "=", ": ", ' := '), 4), quote, v, quote)
    to_other = lambda v: join(other, _one_of((" ", ": ", "=", " = "), 5), quote, v, quote)
    bare = lambda v: join(word(6), F.lit(" "), v)
    secrets = [
        (_drawn(hexa, 40, 11), to_name), (_drawn(hexa, 32, 12), to_name), (_drawn(alnum, size(20, 44, 13), 14), to_name), (join(F.lit("AKIA"), _drawn(upper + digit, 16, 15)), bare),
        (join(F.lit("ghp_"), _drawn(alnum, 36, 16)), bare), (join(F.lit("sk_live_"), _drawn(alnum, 24, 17)), to_name), (join(F.lit("xoxb-"), _drawn(digit, 12, 18), F.lit("-"), _drawn(alnum, 24, 19)), bare),
        (join(F.lit("AIza"), _drawn(alnum + "_-", 35, 20)), to_name), (join(_drawn(alnum + "+/", size(38, 62, 21), 22), F.lit("==")), to_name), (join(_drawn(alnum, size(6, 10, 23), 24), _one_of(("!", "$", "#", "%"), 25), _drawn(alnum, 2, 26)), to_name),
        (_drawn(hexa.upper(), 40, 27), to_name), (join(F.lit("eyJ"), _drawn(alnum, 33, 28), F.lit("."), _drawn(alnum + "_-", 40, 29)), to_name),
    ]
    group = lambda k, seed: _drawn(hexa, k, seed)
    innocent = [
        (_drawn(digit, 16, 31), bare), (_drawn(digit, size(16, 24, 32), 33), to_other), (_drawn(hexa, 40, 34), to_other), (_drawn(hexa, 64, 35), to_other),
        (join(group(8, 36), F.lit("-"), group(4, 37), F.lit("-"), group(4, 38), F.lit("-"), group(4, 39), F.lit("-"), group(12, 40)), to_other),
        (join(word(41), F.lit("-"), word(42), F.lit("-"), word(43), F.lit("-20"), _drawn(digit, 2, 44)), bare), (join(word(45), F.lit("_"), word(46), F.lit("_"), word(47), _drawn(digit, 2, 48)), to_name),
        (join(F.lit("YOUR_"), F.upper(name), F.lit("_HERE_"), _drawn(digit, 4, 49)), to_name), (join(F.lit("<"), word(50), F.lit(">")), to_name), (word(51), to_name), (join(F.lit("${"), F.upper(name), F.lit("}")), to_name),
        (join(_drawn("x", 16, 52), _drawn(digit, 3, 53)), to_name),
    ]
    kinds = [(*k, 1) for k in secrets] + [(*k, 0) for k in innocent]
    kind, value, said, label = F.pmod("id", F.lit(len(kinds))), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for k, (v, place, truth) in enumerate(kinds):
        value, said, label = F.when(kind == k, v).otherwise(value), F.when(kind == k, place(v)).otherwise(said), F.when(kind == k, truth).otherwise(label)
    path = F.when(F.pmod(F.xxhash64("id", F.lit(61)), F.lit(3)) > label, _one_of(("tests/test_login.py", "docs/start.md", "examples/run.sh", "", "src0", "src7"), 62)).otherwise(_one_of((".env", "config/app.yaml", "src/settings.py", "deploy/main.tf", "", "src3"), 63))
    text = join(word(64), F.lit(" "), word(65), F.lit(" "), said, F.lit(" "), word(66))
    return spark.range(n).select("id", path.alias("path"), text.alias("text"), value.alias("value"), label.cast("double").alias("label"))


def labelled_candidates(findings: DataFrame) -> DataFrame:
    """The candidates of labelled texts (id, path, text, value, label), with the label of the value that they are or lie in."""
    found = candidates(findings, "id", "text", "path")
    told = findings.select("id", "value", "label")
    return found.join(told, "id").where(F.col("value").contains(F.col("candidate"))).drop("value")


def train(labelled: DataFrame, most: int = 5_000, trees: int = 20, depth: int = 5) -> RandomForestClassificationModel | float:
    """A forest from findings with ``label``; a constant if the whole table doesn't have both labels.

    Copies of a finding count once. Of each label come half of ``most`` at least, or all there are.
    """
    key, names = ["candidate", "word", "before", "after"], [f"f_{k}" for k in FEATURES]
    known = labelled.where("label is not null").groupBy(*key, "label").agg(F.min(F.struct(*names)).alias("f"))
    known = written(known.select(*key, "label", "f.*"), "labelled")
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return float(next(iter(n), 0.0))
    part = lambda a, b: known.where(F.col("label") == a).orderBy(F.xxhash64(*key), *key).limit(max(most // 2, most - n[b]))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(part(0.0, 1.0).unionByName(part(1.0, 0.0)))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11).fit(vectors.select("features", "label"))


def scored(featured: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """(id, at, candidate, score): how likely each finding is a secret."""
    if isinstance(model, float):
        return featured.select("id", "at", "candidate", F.lit(model).alias("score"))
    vectors = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(featured)
    return model.transform(vectors).select("id", "at", "candidate", vector_to_array("probability")[1].alias("score"))
