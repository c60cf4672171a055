"""Sources and sinks: tracks as gzip CSV by directory scan, members of archives, manifests with digests, JSON."""

from __future__ import annotations

import gzip
import io
import itertools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.columns import number

from . import readers


def application_folder(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, spark.checkpoint.dir; a session of one machine may do without (tests), a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Removes what this application has written to its folder (``settled`` tables, intermediate files). Frames that read it are of no use afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@lru_cache
def own_folder(application: str) -> str:
    """One temporary folder for an application without spark.checkpoint.dir."""
    return tempfile.mkdtemp(prefix="spark-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as a table of the shared folder and read again: for rows that several jobs need."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tracks(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """sec, value, tid as gzip CSV: tracks are dealt into ``buckets`` files by their id, so that many small tracks are not as many files."""
    rows.select("sec", "value", F.col("tid").cast("string").alias("tid")).repartition(buckets, "tid").sortWithinPartitions("tid", "sec").write.option("compression", "gzip").option("header", True).csv(path)


def read_tracks(spark: SparkSession, *roots: str) -> DataFrame:
    """tid, sec, value of all tracks below the roots; the first root that has a track wins. Text that is no number is NULL.

    A track is a folder tid=... of its own, or has its id (a text) in the third column of shared files. The first two columns count, whatever they are
    called; a track with one column has no rows, and so has one without a file.
    """
    out = None
    for i, root in enumerate(roots):
        raw = spark.read.schema("first string, second string, tid string").option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(root)
        one = raw.where("second is not null").select("tid", number("first").alias("sec"), number("second").alias("value"), F.lit(i).alias("root"))
        out = one if out is None else out.unionByName(one)
    if len(roots) == 1:
        return out.drop("root")
    first = out.groupBy("tid").agg(F.min("root").alias("root"))
    return out.join(first, ["tid", "root"], "left_semi").drop("root")


def tracks_of(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid and readings (an array by time) of every wanted track; one that was not found has none."""
    held = tracks.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("sec", "value"))).alias("readings"))
    return wanted.select("tid").join(held, "tid", "left").withColumn("readings", F.coalesce("readings", F.expr("cast(array() as array<struct<sec:double,value:double>>)")))


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV table with a header, all columns as text; a byte order mark before the header is no part of the first name."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False).csv(path)
    return raw.toDF(*[c.lstrip("\ufeff").strip('"') for c in raw.columns])


def tracks_round_trip(rows: DataFrame) -> DataFrame:
    path = shared_path(rows.sparkSession, "tracks")
    write_tracks(rows, path)
    return read_tracks(rows.sparkSession, path)


def zipped(rows: DataFrame, key: str, text: str, member: str = "data/signal.csv.gz") -> DataFrame:
    """key, content: a zip archive per row that holds the text as a gzip member."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b[text]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr(member, gzip.compress((t or "").encode()))
                out.append(held.getvalue())
            yield pd.DataFrame({key: b[key], "content": out})

    return rows.select(key, text).mapInPandas(pack, f"{key} long, content binary")


#: Lines of a member that are handed on at once.
LINES = 50_000


def archive_member(archives: DataFrame, suffix: str, missing: str = "error") -> DataFrame:
    """case_id, sec, value: rows of the first member of each archive whose name ends in the suffix, with or without .gz.

    Text that is no number is NULL, and a line of one column has no value. An archive without such a member is an error; with
    ``missing`` "empty" it has no rows. An archive is one value of its row, of 2 GB at most; its member is read line by line.
    """
    if missing not in ("error", "empty"):
        raise ValueError(f"missing must be error or empty, not {missing}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, content in zip(b["case_id"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.endswith((suffix, f"{suffix}.gz"))), None)
                    if name is None and missing == "error":
                        raise ValueError(f"archive {key} has no member {suffix}")
                    if name is None:
                        continue
                    with z.open(name) as member:
                        start = member.peek(2)[:2]
                        lines = (x for x in (gzip.open(member) if start == b"\x1f\x8b" else member) if x.strip(b"\r\n"))
                        first = next(lines, b"").removeprefix(b"\xef\xbb\xbf")
                        lines = itertools.chain([first] if first.strip() else [], lines)
                        while part := [readers.cells(x.rstrip(b"\r\n")) for x in itertools.islice(lines, LINES)]:
                            yield pd.DataFrame({"case_id": key, "sec": [x for x, _ in part], "value": [y for _, y in part]})

    rows = archives.mapInPandas(read, "case_id long, sec double, value double")
    return rows.select("case_id", number("sec").alias("sec"), number("value").alias("value"))


def manifest(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """name (path relative to the root), bytes, sha256 of every file below the root, of any size. Of files given by ``only``, those outside the root are left out."""
    readers.register(spark)
    found = spark.read.format("file_digest").load(root)
    if only is None:
        return found
    inside = os.path.realpath(root)
    names = [os.path.relpath(os.path.realpath(p), inside) for p in only]
    return found.where(F.col("name").isin([n for n in names if not n.startswith("..")]))


def manifest_faults(now: DataFrame, saved: DataFrame) -> DataFrame:
    """name and what is wrong: missing, unexpected or changed."""
    a, b = now.withColumnsRenamed({"bytes": "b1", "sha256": "s1"}), saved.withColumnsRenamed({"bytes": "b2", "sha256": "s2"})
    rows = a.join(b, "name", "full_outer")
    fault = F.when(F.col("s1").isNull(), "missing").when(F.col("s2").isNull(), "unexpected").when((F.col("s1") != F.col("s2")) | (F.col("b1") != F.col("b2")), "changed")
    return rows.select("name", fault.alias("fault")).where("fault is not null")


def write_table(df: DataFrame, path: str, mark: bool = True) -> None:
    """All columns as text in CSV files with a header, which begins with a byte order mark, as spreadsheets write it."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    first, *rest = text.columns
    text.toDF(("\ufeff" if mark else "") + first, *rest).write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a stable order within files, NaN and NULL as null."""
    clean = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    df.withColumns(clean).sortWithinPartitions(*order).write.option("ignoreNullFields", False).json(path)


def write_waves(rows: DataFrame, path: str, key: str, order: list[str], step: str, value: str) -> None:
    """Waveforms as CSV, time and value, a file key=... for each key: ``step`` is the column of sample times. A task streams its keys' samples into one file after the other."""
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    text = rows.select(name.alias("_name"), *order, F.col(step).cast("string").alias("_time"), F.col(value).cast("string").alias("_value"))
    store, root = readers.opened(path)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = readers.opened(path)
        held, out, n = None, None, 0
        for b in batches:
            lines = (b["_time"].fillna("") + "," + b["_value"].fillna("") + "\n").tolist()
            for k, same in itertools.groupby(zip(b["_name"], lines, strict=True), key=lambda x: x[0]):
                if k != held:
                    if out:
                        out.close()
                    held, out, n = k, store.open_output_stream(f"{root}/{quote(k, safe='=')}.csv", compression=None), n + 1
                    out.write(b"time,wave\n")
                out.write("".join(x for _, x in same).encode())
        if out:
            out.close()
        yield pd.DataFrame({"files": [n]})

    text.repartition("_name").sortWithinPartitions("_name", *order).select("_name", "_time", "_value").mapInPandas(write, "files long").agg(F.sum("files")).first()


def wave_prefix(spark: SparkSession, path: str, seconds: float) -> DataFrame:
    """file, idx, sec, value, read_bytes: the first seconds of every waveform below the path; no more of a file is read than that takes."""
    readers.register(spark)
    return spark.read.format("wave_prefix").option("seconds", seconds).load(path)
