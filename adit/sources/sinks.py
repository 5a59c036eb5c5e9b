"""Sinks: run folders, run indexes, reports, point clouds, patched configs."""

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from adit.sources.readers import commented_json, ply_bytes, ply_columns


def run_folder(df: DataFrame, path: str, dataset: str, rep: str, stamp: str) -> str:
    """The new folder dataset/rep/stamp with the results as ``volumes``; one that has them already is an error."""
    out = f"{path.rstrip('/')}/{dataset}/{rep}/{stamp}"
    df.write.mode("error").parquet(f"{out}/volumes")
    return out


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def run_record(spark: SparkSession, folder: str, summary: dict, log: list[str]) -> None:
    """summary.json, where readers.run_summaries() looks for it, and run.log beside the results of a run."""
    _put(spark, f"{folder}/summary.json", json.dumps(summary, indent=2, default=str).encode())
    _put(spark, f"{folder}/run.log", ("\n".join(log) + "\n").encode())


def trial_summaries(metrics: DataFrame, path: str) -> None:
    """A JSON line a trial, in a folder a trial."""
    metrics.write.mode("overwrite").partitionBy("trial_id").json(path)


def mesh_tables(meshed: DataFrame, path: str) -> None:
    """The vertices and faces of a mesh (see volume.faces()) as two Parquet tables, of any size."""
    from adit.operators.volume import vertices

    vertices(meshed).write.mode("overwrite").parquet(f"{path.rstrip('/')}/vertices")
    meshed.select("cloud_id", "a", "b", "c").write.mode("overwrite").parquet(f"{path.rstrip('/')}/faces")


def mesh_ply(meshed: DataFrame, path: str, most: int = 2_000_000) -> tuple[int, int]:
    """One cloud's mesh as one PLY file on the driver, up to ``most`` faces; larger ones belong in mesh_tables(). Returns (vertices, faces)."""
    from adit.operators.volume import vertices

    f = meshed.select("a", "b", "c").limit(most + 1).toPandas().to_numpy(np.int64)
    if len(f) > most:
        raise ValueError(f"more than {most} faces")
    v = vertices(meshed).orderBy("vid").select("vid", "x", "y", "z").toPandas()
    place = np.searchsorted(v["vid"].to_numpy(), f)
    rows = np.zeros(len(f), [("n", "u1"), ("v", "<i4", 3)])
    rows["n"], rows["v"] = 3, place
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(v)}", *(f"property double {c}" for c in "xyz"), f"element face {len(f)}", "property list uchar int vertex_indices", "end_header"]
    Path(path).write_bytes(("\n".join(head) + "\n").encode() + v[["x", "y", "z"]].to_numpy("<f8").tobytes() + rows.tobytes())
    return len(v), len(f)


def ply_parts(points: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z"), most: int = 1_000_000) -> DataFrame:
    """Write a cloud of any size as PLY files of up to ``most`` points, a few a task; returns (path, points) of each, when run.

    Columns keep their kinds. File names are new in each attempt of a task: keep what is returned, and read only the files that it names.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        held, done = [], []

        def close(rows: pa.Table):
            name = f"part-{uuid.uuid4().hex}.ply"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(ply_columns({c: rows.column(c).to_numpy() for c in columns}))
            done.append((f"{path.rstrip('/')}/{name}", len(rows)))

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= most:
                whole = pa.Table.from_batches(held)
                close(whole.slice(0, most))
                held = whole.slice(most).to_batches()
        if sum(map(len, held)):
            close(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "points"])

    return points.select(*columns).mapInArrow(write, "path string, points long")


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class PlyWriter(DataSourceArrowWriter):
    """Writes a cloud of any size as a folder of PLY files, whose headers tell their bounds.

    Tasks write into a folder of the job's own below the target. Only when all are done are their files moved
    into the target, and only those of the tasks that counted; a job that fails leaves nothing of its own. Columns keep their kinds: x, y and z first,
    whole numbers of 64 bits as 32.
    """

    def __init__(self, path: str, names: list[str], most: int, overwrite: bool):
        self.path, self.names, self.most, self.overwrite = path.rstrip("/"), names, most, overwrite
        self.own = f"{self.path}/_job-{uuid.uuid4().hex}"

    def _store(self):
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/{self.own.rsplit('/', 1)[1]}"

    def _columns(self, rows: pa.Table) -> dict[str, np.ndarray]:
        def plain(c: str) -> np.ndarray:
            v = rows.column(c).to_numpy()
            if v.dtype == np.int64:
                if len(v) and np.abs(v).max() >= 1 << 31:
                    raise ValueError(f"{c} does not fit 32 bits")
                return v.astype(np.int32)
            return v.astype(np.uint8) if v.dtype in (bool, object) else v

        return {c: plain(c) for c in ("x", "y", "z", *[n for n in self.names if n not in ("x", "y", "z")])}

    def write(self, iterator):
        store, _, own = self._store()
        store.create_dir(own, recursive=True)
        held, done = [], []

        def close(rows: pa.Table) -> None:
            columns, name = self._columns(rows), f"part-{uuid.uuid4().hex}.ply"
            bounds = " ".join(repr(float(f(columns[c]))) for f in (np.min, np.max) for c in "xyz")
            with store.open_output_stream(f"{own}/{name}", compression=None) as out:
                out.write(ply_columns(columns, (f"bounds {bounds}",)))
            done.append(name)

        for batch in iterator:
            held.append(batch)
            while sum(map(len, held)) >= self.most:
                whole = pa.Table.from_batches(held)
                close(whole.slice(0, self.most))
                held = whole.slice(self.most).to_batches()
        if sum(map(len, held)):
            close(pa.Table.from_batches(held))
        return _Written(done)

    def commit(self, messages):
        store, root, own = self._store()
        store.create_dir(root, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".ply")] if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{own}/{name}", f"{root}/{name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages):
        store, _, own = self._store()
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


def pcd(points: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z", "intensity"), most: int = 20_000_000) -> int:
    """A thinned map as one binary PCD file on the driver, up to ``most`` points; larger ones go to Parquet."""
    rows = points.select(*[F.col(c).cast("float") for c in columns]).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    n = len(columns)
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(columns), "SIZE" + " 4" * n, "TYPE" + " F" * n, "COUNT" + " 1" * n, f"WIDTH {len(rows)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(rows)}", "DATA binary"]
    Path(path).write_bytes(("\n".join(head) + "\n").encode() + rows.to_numpy("<f4").tobytes())
    return len(rows)


def materialize_config(spark: SparkSession, default_dir: str, target_dir: str, params: dict, mapping: dict[str, tuple[str, str]], strict: bool = False) -> list[str]:
    """A config tree with the values of ``params`` (nested or dotted) set, each file written once; returns the names that ``mapping`` lacks.

    ``mapping``: name to (file, dotted path). Unknown names are an error if ``strict``, else they are told. A file that the
    default tree lacks is an error. The target is made anew. A config tree is a dozen small files.
    """
    from adit.operators.sweep import flat

    given = flat(params)
    unknown = sorted(set(given) - set(mapping))
    if unknown and strict:
        raise KeyError(f"no such parameters: {', '.join(unknown)}")
    files = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in spark.read.format("binaryFile").load(default_dir).select("path", "content").collect()}
    patches: dict[str, dict[str, object]] = {}
    for name, value in given.items():
        if name in mapping:
            file, path = mapping[name]
            patches.setdefault(file, {})[path] = value
    if lost := sorted(set(patches) - set(files)):
        raise FileNotFoundError(f"{default_dir} lacks {', '.join(lost)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(target_dir)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for file, text in files.items():
        _put(spark, f"{target_dir.rstrip('/')}/{file}", (patched_config(text, patches[file]) if file in patches else text).encode())
    return unknown


def append_index(runs: DataFrame, path: str, methods: list[str], digits: int = 3) -> None:
    """Append one CSV row a run (dataset, rep, stamp, cloud_id) with a column a method, blank where missing."""
    wide = runs.groupBy("dataset", "rep", "stamp", "cloud_id").pivot("method", methods).agg(F.max("volume"))
    text = [F.when(F.col(m).isNull(), "").otherwise(F.format_string(f"%.{digits}f", m)).alias(m) for m in methods]
    wide.select("dataset", "rep", F.col("stamp").cast("string"), "cloud_id", *text).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; NULLs stay as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def markdown(df: DataFrame, title: str, digits: int = 3, most: int = 1000) -> str:
    """A report table of at most ``most`` rows; longer results belong in write_tables()."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    say = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(say, r)) + " |" for r in rows]) + "\n"


def profile_ply(cells: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z", "interpolated"), most: int = 2_000_000, comments: tuple[str, ...] = ()) -> dict[str, float]:
    """A profile cloud (one point a grid cell) as one PLY file on the driver, up to ``most`` points; larger clouds go to Parquet."""
    rows = cells.select(*[F.col(c).cast("float") for c in columns]).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    Path(path).write_bytes(ply_bytes(rows.to_numpy(), list(columns), comments))
    n = int(rows["interpolated"].sum()) if "interpolated" in rows else 0
    return {"n_points": len(rows), "n_interpolated": n, "frac_interpolated": n / len(rows) if len(rows) else 0.0}


def patched_config(text: str, patch: dict[str, object]) -> str:
    """A commented JSON file with values set at dotted paths; missing parents are made."""
    config = json.loads(commented_json(text))
    for path, value in patch.items():
        at, *rest = config, *path.split(".")
        for k in rest[:-1]:
            at = at.setdefault(k, {})
        at[rest[-1]] = value
    return json.dumps(config, indent=2)
