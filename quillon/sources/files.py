"""Sources and sinks: CSV, gzipped TSV, Parquet with fallback, optional and required inputs, snapshots, caching and documents."""

from __future__ import annotations

import argparse
import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def modified(spark: SparkSession, path: str) -> int:
    """Latest modification in ms of a file or of anything in a folder."""
    fs, where = _fs(spark, path)
    status = fs.getFileStatus(where)
    return max([status.getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(where))]) if status.isDirectory() else status.getModificationTime()


def work_dir(spark: SparkSession) -> str:
    """A new folder for tables that are written and read again: in spark.checkpoint.dir, or on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/quillon-{uuid.uuid4().hex}"
    fs, where = _fs(spark, folder)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return folder


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, *, line_breaks: bool = False) -> DataFrame:
    """A delimited file by its suffix, all columns as text unless a schema is given. Spreadsheets and unknown suffixes raise ValueError.

    line_breaks: values may hold line breaks, which makes a file one task; without it Spark splits files.
    """
    name = path.lower()
    if name.endswith((".xlsx", ".xls", ".xlsm")):
        raise ValueError(f"{path}: spreadsheets are not read; save the first sheet as CSV")
    if not name.endswith((".csv", ".csv.gz")):
        raise ValueError(f"{path}: unknown file type")
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, *, nulls: tuple[str, ...] = ("\\N",), partitions: int | None = None) -> DataFrame:
    """A tab-separated file without quoting; `nulls` are missing values. A gzip file is one task, so `partitions` deals its rows out."""
    rows = spark.read.csv(path, sep="\t", quote="", header=True, nullValue=nulls[0] if nulls else None, schema=schema, mode="PERMISSIVE")
    more = list(nulls[1:])
    if more:
        rows = rows.select(*[F.when(~F.col(f.name).isin(more), F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in rows.schema])
    return rows.repartition(partitions) if partitions else rows


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles with NaN turned into null."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def load(spark: SparkSession, stem: str, *, required: bool = True, schema: StructType | str | None = None) -> DataFrame | None:
    """stem.parquet if it exists, else stem.csv, else FileNotFoundError (or None if not required)."""
    if exists(spark, f"{stem}.parquet"):
        return spark.read.parquet(f"{stem}.parquet")
    if exists(spark, f"{stem}.csv"):
        return read_table(spark, f"{stem}.csv", schema)
    if required:
        raise FileNotFoundError(f"neither {stem}.parquet nor {stem}.csv exists")
    return None


def require(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError naming all paths that don't exist."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def optional(spark: SparkSession, path: str, schema: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """read(path), or an empty table of the schema where there is none."""
    return read(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes within values are doubled, as read_table reads them."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_sample(df: DataFrame, path: str, order: str, n: int = 250) -> None:
    """The first n rows by an explicit order (a top-k, not a sort of all)."""
    write_csv(df.orderBy(order).limit(n), path)


def write_reviews(df: DataFrame, root: str, filters: dict[str, str], order: str) -> None:
    """One file set for each named condition, all from one copy of the table that is written first."""
    table = snapshot(df, f"{root}/_all")
    for name, condition in filters.items():
        write_csv(table.filter(condition).orderBy(order), f"{root}/{name}")


def fresh(spark: SparkSession, outputs: list[str], inputs: list[str], refresh: bool = False) -> bool:
    """Whether the oldest output is no older than the newest input that exists."""
    if refresh or not all(exists(spark, p) for p in outputs):
        return False
    newest = max((modified(spark, p) for p in inputs if exists(spark, p)), default=0)
    return min(modified(spark, p) for p in outputs) >= newest


def cached(spark: SparkSession, path: str, inputs: list[str], make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The Parquet table at path, made anew when an input is newer."""
    if not fresh(spark, [path], inputs, refresh):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """An exact copy, written and read again as the only input from then on."""
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class unchanged:
    """Context that raises RuntimeError if a path's modification time differs when it ends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self):
        self.before = modified(self.spark, self.path)
        return self

    def __exit__(self, *failure):
        if not failure[0] and modified(self.spark, self.path) != self.before:
            raise RuntimeError(f"{self.path} was changed while it was read")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def dictionary_text(title: str, df: DataFrame, notes: dict[str, str] | None = None) -> str:
    """A Markdown data dictionary of a table."""
    rows = [f"| {f.name} | {f.dataType.simpleString()} | {(notes or {}).get(f.name, '')} |" for f in df.schema]
    return "\n".join([f"# {title}", "", "| column | type | note |", "| --- | --- | --- |", *rows, ""])


def feature_notes(title: str, manifest: list[dict]) -> str:
    """A Markdown page of features by group: included ones with their notes, left-out ones with the reason."""
    lines = [f"# {title}", "", f"Included: {sum(r['included'] for r in manifest)} of {len(manifest)} columns.", ""]
    for group in sorted({r["feature_group"] for r in manifest}):
        lines += [f"## {group}", ""]
        for r in sorted((r for r in manifest if r["feature_group"] == group), key=lambda r: r["column_name"]):
            lines.append(f"- `{r['column_name']}` ({r['role']}): {r['note']}" + (f"; {r['drop_reason']}" if r["drop_reason"] else ""))
        lines.append("")
    return "\n".join(lines)


@dataclass(frozen=True)
class Paths:
    """Roots of raw, interim and processed data."""

    raw: str
    interim: str
    processed: str

    @classmethod
    def read(cls, path: str) -> Paths:
        """From a flat `key: value` file; keys may end in _dir or _root."""
        with open(path, encoding="utf-8") as f:
            pairs = [line.split("#")[0].partition(":") for line in f if ":" in line.split("#")[0]]
        found = {k.strip().removesuffix("_dir").removesuffix("_root"): v.strip().strip("\"'") for k, _, v in pairs if v.strip()}
        return cls(found["raw"], found["interim"], found["processed"])


def fingerprint(values: dict) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()


def run_steps(steps: dict[str, Callable[[bool], None]], args: list[str] | None = None) -> list[str]:
    """Run the named steps in order in this process, stopping at the first failure; --refresh and --only NAME are flags."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--refresh", action="store_true")
    parser.add_argument("--only", action="append", choices=list(steps))
    given = parser.parse_args(args)
    chosen = [n for n in steps if not given.only or n in given.only]
    for name in chosen:
        steps[name](given.refresh)
    return chosen
