"""Readers of survey files as DataFrames: trajectories, targets, matrices, run results, scans, point clouds, configs."""

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed names of a dataset's files; of several the first that is there counts.
SURVEY_FILES = {
    "ref_ply": ("rtc_clean_1cm.ply",), "targets_ref": ("targets_leica.txt",), "caps": ("caps.txt",), "targets_mobile": ("targets_livox.txt",),
    "trajectory": ("trajectory.txt", "trajectory_transformed.txt"), "registration": ("transformation_matrix.txt", "tranformation_matrix.txt", "registration_livox_to_leica.txt"),
}
TUM = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")
_PLY_TYPES = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "<u1", "uint8": "<u1", "char": "<i1", "int8": "<i1", "short": "<i2", "ushort": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4"}


def trajectory(spark: SparkSession, path: str, run_id: str = "run") -> DataFrame:
    """Lines ``t x y z qx qy qz qw`` without comments; ``seq`` is the order in the file. Four numbers are enough.

    Lines are read in splits of the file: their order is that of the splits and of the lines within each.
    With several files each is a run of its own, named ``run_id`` and its file name.
    """
    if path.lower().endswith(".ply"):
        raise ValueError("a point cloud is no trajectory: it has no times")
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    rows = text.where(~F.col("value").rlike(r"^\s*(#|$)")).select("file", "line", F.split(F.trim("value"), r"[\s,]+").alias("v"))
    number = [F.try_element_at("v", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(TUM)]
    rows = rows.select("file", "line", F.size("v").alias("n"), *number).where("n >= 4")
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    many = F.count_distinct("file")
    several = rows.agg(many.alias("files")).first().files > 1
    name = F.concat(F.lit(run_id + "/"), F.element_at(F.split("file", "/"), -1)) if several else F.lit(run_id)
    return rows.select(name.alias("run_id"), "seq", *TUM)


def registered_trajectory(spark: SparkSession, path: str, matrix: list[list[float]], run_id: str = "run") -> DataFrame:
    """A trajectory in the reference frame: its places under the 4x4 matrix; every line must have all eight numbers."""
    from adit.operators.trajectory import transformed

    traj = trajectory(spark, path, run_id)
    if bad := traj.where(" or ".join(f"{c} is null" for c in TUM)).limit(1).collect():
        raise ValueError(f"{path}: line {bad[0].seq} of the poses lacks some of {' '.join(TUM)}")
    return transformed(traj, matrix)


def targets(spark: SparkSession, path: str, cloud_id: str) -> DataFrame:
    """Rows ``id x y z`` or ``x y z``, by commas or blanks, with or without a header; idx counts from 0."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = text.where(~F.col("value").rlike(r"^\s*(#|$)")).select("line", F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+").alias("v"))
    last = lambda k: F.try_element_at("v", F.when(F.size("v") >= 4, F.lit(k + 2)).otherwise(F.lit(k + 1))).try_cast("double")
    rows = rows.select("line", *[last(k).alias(c) for k, c in enumerate("xyz")]).where("x is not null and y is not null and z is not null")
    return rows.select(F.lit(cloud_id).alias("cloud_id"), (F.row_number().over(Window.orderBy("line")) - 1).alias("idx"), "x", "y", "z")


def rims(spark: SparkSession, path: str) -> DataFrame:
    """(mouth, x, y, z): the last three numbers of each line of CSV files, a mouth a file."""
    v = F.split(F.trim("value"), r"\s*,\s*")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("mouth"), F.slice(v, F.size(v) - 2, 3).alias("v"))
    return rows.select("mouth", *[F.col("v")[k].try_cast("double").alias(c) for k, c in enumerate("xyz")]).where("x is not null and y is not null and z is not null")


def registration(spark: SparkSession, path: str) -> list[list[float]]:
    """A 4x4 matrix of numbers; anything else is an error."""
    rows = [list(map(float, r.value.replace(",", " ").split())) for r in spark.read.text(path).where("trim(value) <> ''").limit(17).collect()]
    if len(rows) != 4 or any(len(r) != 4 for r in rows):
        raise ValueError(f"{path} does not hold a 4x4 matrix")
    return rows


def run_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """summary.json of all runs below ``path`` (<dataset>/<rep>/<stamp>/summary.json); unreadable ones and those without results are left out.

    ``schema``: DDL of the parts to read, ``results`` among them. Dataset, rep and stamp come from the path.
    """
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(path)
    parts = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/([^/]+)/summary\.json$", 0)
    rows = raw.withColumn("file", parts).where("_corrupt_record is null and results is not null").drop("_corrupt_record")
    return rows.select(*[F.split("file", "/")[k].alias(c) for k, c in enumerate(("dataset", "rep", "stamp"))], *[c for c in rows.columns if c != "file"])


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, mtime) of input files: what a run was made from."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def first_of(listing: DataFrame, names: list[str]) -> DataFrame:
    """For each folder the first of ``names``, in this order, that is there and not empty."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("path", "/"), -1))
    rows = listing.where("bytes > 0").withColumn("rank", rank).where("rank > 0").withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    return rows.groupBy("folder").agg(F.min_by("path", "rank").alias("path"))


def commented_json(text: str) -> str:
    """JSON without comments; signs within strings stay as they are."""
    return re.sub(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or " ", text, flags=re.S)


def configs(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value): the leaves of commented JSON files, by dotted names; values as JSON text."""
    import json

    from adit.operators.sweep import flat

    def leaves(frames):
        for f in frames:
            rows = [(Path(p).name, k, json.dumps(v)) for p, c in zip(f["path"], f["content"]) for k, v in flat(json.loads(commented_json(c.decode()))).items()]
            yield pd.DataFrame(rows, columns=["file", "name", "value"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "content")
    return found.mapInPandas(leaves, "file string, name string, value string")


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ between two config trees, or that one of them lacks."""
    left, right = a.select("file", "name", F.col("value").alias("before")), b.select("file", "name", F.col("value").alias("after"))
    return left.join(right, ["file", "name"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def sweep_space(spark: SparkSession, path: str) -> DataFrame:
    """(name, dist, lo, hi, values) of the parameters of a sweep file: ``name:`` lines below ``parameters:`` with ``key: value`` lines below each."""
    text = spark.read.text(path, wholetext=True).first().value  # a file of settings
    rows, name, own, inside, depth = [], None, {}, False, None
    for line in (x.split(" #")[0].rstrip() for x in text.splitlines()):
        at, said = len(line) - len(line.lstrip()), line.strip()
        if not said or said.startswith("#"):
            continue
        if at == 0:
            inside = said == "parameters:"
        elif inside and said.startswith("- "):
            own.setdefault("values", []).append(said[2:].strip().strip("'\""))
        elif inside and (depth is None or at <= depth) and said.endswith(":"):
            depth, name, own = at, said[:-1], {}
            rows.append((name, own))
        elif inside and name:
            key, _, value = said.partition(":")
            value = value.strip()
            if key == "value":
                own["values"] = [value.strip("'\"")]
            elif value.startswith("["):
                own[key] = [x.strip().strip("'\"") for x in value.strip("[]").split(",")]
            elif value:
                own[key] = value
    number = lambda v: None if v is None else float(v)
    made = [(n, o.get("distribution"), number(o.get("min")), number(o.get("max")), o.get("values") or None) for n, o in rows]
    return spark.createDataFrame(made, "name string, dist string, lo double, hi double, values array<string>")


def scan_points(messages: DataFrame) -> DataFrame:
    """Points of raw scan messages (scan_id, header_t, point_step, fields array<struct<name, offset, datatype>>, data).

    Fields are found by name (reflectivity for intensity; time, offset_time or t
    for timestamp); a message without x gives no rows. ``t`` is the raw time, or that of the header where a message
    has none (``timed`` is false); no intensity is 0, an unknown datatype is read as float32.
    """
    kinds = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
    alias = {"reflectivity": "intensity", "time": "timestamp", "offset_time": "timestamp", "t": "timestamp"}

    def decode(frames):
        for f in frames:
            for scan, header, step, fields, data in f[["scan_id", "header_t", "point_step", "fields", "data"]].itertuples(index=False):
                by = {alias.get(x["name"], x["name"]): x for x in fields}
                if "x" not in by:
                    continue
                kind = np.dtype({"names": list(by), "formats": [kinds.get(x["datatype"], "<f4") for x in by.values()], "offsets": [x["offset"] for x in by.values()], "itemsize": step})
                p = np.frombuffer(data, kind, len(data) // step)
                get = lambda c, other=np.nan: p[c].astype(float) if c in by else np.full(len(p), other)  # noqa: B023, E731
                yield pd.DataFrame({"scan_id": scan, "header_t": header, "pid": np.arange(len(p)), "x": get("x"), "y": get("y"), "z": get("z"), "intensity": get("intensity", 0.0), "t": get("timestamp", header), "timed": "timestamp" in by})

    return messages.mapInPandas(decode, "scan_id long, header_t double, pid long, x double, y double, z double, intensity double, t double, timed boolean")


def point_times(points: DataFrame) -> DataFrame:
    """``t`` in seconds: of four readings (absolute or after the header; seconds or nanoseconds) the one whose median of a scan is closest to the header."""
    readings = [F.col("t"), F.col("t") * 1e-9, F.col("header_t") + F.col("t"), F.col("header_t") + F.col("t") * 1e-9]
    best = points.groupBy("scan_id").agg(F.array_min(F.array(*[F.struct(F.abs(F.median(r) - F.first("header_t")).alias("off"), F.lit(k).alias("k")) for k, r in enumerate(readings)])).alias("best"))
    rows = points.join(best.select("scan_id", F.col("best.k").alias("reading")), "scan_id")
    told = F.element_at(F.array(*readings), F.col("reading") + 1)
    return rows.withColumn("t", F.when(F.col("timed"), told).otherwise(F.col("header_t")) if "timed" in points.columns else told).drop("reading", "timed")


def custom_times(points: DataFrame) -> DataFrame:
    """``t`` from a message's time base and a point's offset, both in nanoseconds."""
    return points.withColumn("t", (F.col("timebase") + F.col("offset_time")) * 1e-9)


def ply_header(raw: bytes) -> tuple[int, int, str, list[tuple[str, str]], bool]:
    """(where the points begin, points, format, [(name, numpy type)], does more follow) of a PLY file's first bytes.

    Elements of plain numbers may stand before the points; one with lists there is an error.
    """
    end = raw.index(b"end_header")
    size = raw.index(b"\n", end) + 1
    kind, elements = "", []
    for line in raw[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and elements:
            elements[-1][2].append((w[-1], None if w[1] == "list" else _PLY_TYPES[w[1]]))
    at = next((k for k, e in enumerate(elements) if e[0] == "vertex"), len(elements))
    if any(t is None for _, _, props in elements[: at + 1] for _, t in props):
        raise ValueError("lists before the end of the points")
    before = elements[:at]
    skip = sum(n for _, n, _ in before) if kind == "ascii" else sum(n * np.dtype(props).itemsize for _, n, props in before)
    _, n, props = elements[at] if at < len(elements) else ("", 0, [])
    if kind == "ascii":  # so many lines
        for _ in range(skip):
            size = raw.index(b"\n", size) + 1
        skip = 0
    return size + skip, n, kind, props, at + 1 < len(elements)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, first: int):
        self.path, self.start, self.stop, self.first = path, start, stop, first


def _head(f) -> bytes:
    """A PLY file's first bytes, to the end of its header at least."""
    size = 1 << 16
    while True:
        f.seek(0)
        raw = f.read(size)
        if b"end_header" in raw and raw.find(b"\n", raw.index(b"end_header")) >= 0:
            return raw
        if len(raw) < size or size >= 1 << 28:
            raise ValueError("no end of the header")
        size *= 4


def ply_bounds(raw: bytes) -> list[float] | None:
    """Lowest and highest x, y and z that a header's ``bounds`` comment tells, if it has one."""
    told = re.search(rb"^comment bounds ([^\n]+)$", raw[: raw.index(b"end_header")], re.M)
    return [float(v) for v in told[1].split()] if told else None


class _PlyReader(DataSourceReader):
    """Reads ranges of points (binary) or of bytes (ASCII) of one file, or of all in a folder, as Arrow batches; not of files whose bounds are outside ``low`` and ``high``."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.low, self.high = {c: -np.inf for c in "xyz"}, {c: np.inf for c in "xyz"}

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(name).type != fs.FileType.Directory:
            return [self.path]
        found = store.get_file_info(fs.FileSelector(name))
        return [f"{self.path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(".ply")]

    @staticmethod
    def _open(path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)

    def partitions(self):
        found, files = [], self._files()
        for k, path in enumerate(files):
            with self._open(path) as f:
                raw = _head(f)
                size, n, kind, _, more = ply_header(raw)
                whole, bounds = f.size(), ply_bounds(raw)
            if not n and len(files) == 1:
                raise ValueError(f"{path} has no points")
            if bounds and any(bounds[m] > self.high[c] or bounds[3 + m] < self.low[c] for m, c in enumerate("xyz")):
                continue
            first, last, step = (size, whole, self.rows * 32) if kind == "ascii" else (0, n, self.rows)
            if kind == "ascii" and more:  # where the points end is known by counting lines only
                step = max(whole, 1)
            found += [_Range(path, at, min(at + step, last), k << 40) for at in range(first, last, step)]
        return found

    def read(self, partition: _Range):
        import pyarrow as pa

        def batch(pid: np.ndarray, p) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pid + partition.first), *(pa.array(np.asarray(p[c], float)) for c in "xyz")], ["pid", "x", "y", "z"])

        with self._open(partition.path) as f:
            size, n, kind, props, _ = ply_header(_head(f))
            if kind == "ascii":
                names = [c for c, _ in props]
                at, text = _lines(f, partition.start, partition.stop, size)
                lines = [x for x in text.split(b"\n") if x.strip()][:n]
                if lines:
                    v = np.array([x.split()[: len(names)] for x in lines], float)
                    ends = np.cumsum([len(x) + 1 for x in lines])  # ids rise with the place in the file
                    yield batch(at + np.concatenate([[0], ends[:-1]]).astype(np.int64), {c: v[:, names.index(c)] for c in "xyz"})
                return
            order = ">" if "big" in kind else "<"
            record = np.dtype([(c, t.replace("<", order)) for c, t in props])
            for k in range(partition.start, partition.stop, 100_000):
                m = min(100_000, partition.stop - k)
                f.seek(size + k * record.itemsize)
                yield batch(np.arange(k, k + m, dtype=np.int64), np.frombuffer(f.read(m * record.itemsize), record))


class _PrunedPlyReader(_PlyReader):
    """The reader where filters on x, y and z are handed down: the bounds that they leave."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            c = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if c in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[c] = max(self.low[c], float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[c] = min(self.high[c], float(f.value))
            yield f  # rows of the files that are read are filtered by Spark


def _lines(f, start: int, stop: int, first: int) -> tuple[int, bytes]:
    """(place, text) of the whole lines that begin in [start, stop); ``first``: where the first line of all begins."""
    f.seek(start - (start > first))
    text = f.read(stop - start + (start > first))
    if start > first:  # the line before belongs to the range before
        cut = text.find(b"\n") + 1
        start, text = start - 1 + cut, text[cut:] if cut else b""
    while text and not text.endswith(b"\n") and (more := f.read(4096)):
        cut = more.find(b"\n")
        text += more if cut < 0 else more[: cut + 1]
    return start, text


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: (pid, x, y, z) of a file or of a folder's files, read in ranges of about ``rowsPerPartition`` points;
    ``df.write.format("ply").save(path)``: a folder of files of up to ``rowsPerFile`` points, see sinks.PlyWriter.

    pid numbers the points in their order: by their place among the points, or in an ASCII file by that of their line in bytes; above 40
    bits it numbers the files. Option ``prune``: files are left out by their bounds; it needs spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "pid long, x double, y double, z double"

    def reader(self, schema):
        kind = _PrunedPlyReader if self.options.get("prune", "false").lower() == "true" else _PlyReader
        return kind(self.options["path"], int(self.options.get("rowsPerPartition", 1_000_000)))

    def writer(self, schema, overwrite: bool):
        from adit.sources.sinks import PlyWriter

        return PlyWriter(self.options["path"], schema.names, int(self.options.get("rowsPerFile", 1_000_000)), overwrite)


def ply(spark: SparkSession, path: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    """A point cloud; an empty one is an error."""
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").option("rowsPerPartition", rows_per_partition).load(path)


def submap(content: bytes, points: bytes, intensities: bytes | None = None) -> pd.DataFrame:
    """World points of one submap dump: float32 xyz, turned by the 4x4 matrix after ``T_world_origin`` (identity without one)."""
    m = np.eye(4)
    if (at := content.find(b"T_world_origin")) >= 0:
        m = np.array(content[at + len(b"T_world_origin") :].lstrip(b" :").split()[:16], float).reshape(4, 4)
    p = np.frombuffer(points, "<f4").reshape(-1, 3).astype(float) @ m[:3, :3].T + m[:3, 3]
    i = np.frombuffer(intensities, "<f4").astype(float) if intensities else np.full(len(p), np.nan)
    return pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": i})


def submaps(spark: SparkSession, path: str) -> DataFrame:
    """All submap dumps below ``path``, in world coordinates: (submap, x, y, z, intensity)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    parts = found.groupBy(F.element_at(F.split("path", "/"), -2).alias("submap")).agg(*[F.max(F.when(name == n, F.col("content"))).alias(c) for c, n in (("data", "data.txt"), ("points", "points_compact.bin"), ("intensity", "intensities_compact.bin"))])

    def decode(frames):
        for f in frames:
            for s, d, p, i in f.itertuples(index=False):
                yield submap(d or b"", p, i).assign(submap=s)[["submap", "x", "y", "z", "intensity"]]

    return parts.where("points is not null").mapInPandas(decode, "submap string, x double, y double, z double, intensity double")


def ply_bytes(x: np.ndarray, names: list[str], comments: tuple[str, ...] = ()) -> bytes:
    """A binary PLY file of float32 columns."""
    if x.ndim != 2 or x.shape[1] != len(names):
        raise ValueError("as many columns as names")
    return ply_columns({n: x[:, k].astype("<f4") for k, n in enumerate(names)}, comments)


def ply_columns(columns: dict[str, np.ndarray], comments: tuple[str, ...] = ()) -> bytes:
    """A binary PLY file of columns of their own kinds: floats of 4 or 8 bytes, integers of 1 to 4.

    x, y and z come first; columns of unequal lengths, kinds that PLY lacks and comments of several lines are errors.
    """
    if [c for c in columns][:3] != ["x", "y", "z"]:
        raise ValueError("x, y and z come first")
    n = {len(v) for v in columns.values()}
    if len(n) != 1:
        raise ValueError(f"columns of {sorted(n)} values")
    kinds = {"f4": "float", "f8": "double", "u1": "uchar", "i1": "char", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint"}
    said = {c: np.asarray(v).dtype.str[1:] for c, v in columns.items()}
    if wrong := {c: k for c, k in said.items() if k not in kinds}:
        raise ValueError(f"no PLY kinds: {wrong}")
    if any("\n" in c for c in comments):
        raise ValueError("a comment is one line")
    head = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element vertex {n.pop()}", *(f"property {kinds[k]} {c}" for c, k in said.items()), "end_header"]
    rows = np.empty(len(columns["x"]), [(c, "<" + k) for c, k in said.items()])
    for c, v in columns.items():
        rows[c] = v
    return ("\n".join(head) + "\n").encode() + rows.tobytes()
