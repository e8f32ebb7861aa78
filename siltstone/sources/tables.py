"""Reading and writing of the records: tables, page folders, JSON arrays and keyed results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schemas import CHUNK, EVAL_RESULT, PROGRAM_STATE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, *, files: int = 8) -> DataFrame:
    """The files of a table as a stream, ``files`` at a time, be it a folder or one file."""
    path = f"{folder}/{name}.parquet"
    known = spark.read.parquet(path)
    arriving = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files)
    if len(held := known.inputFiles()) == 1 and held[0].endswith(f"/{name}.parquet"):  # a stream reads folders only
        return arriving.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return arriving.parquet(path)


def page_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, html of the ``*.html`` files of a folder; bytes that don't decode are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)

    @F.pandas_udf("string")
    def decoded(content):
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return files.select("path", decoded("content").alias("html"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of objects, an object a line, as the only file of a folder; written by one task, row after row."""

    def lines(frames):
        import pandas as pd

        before = "["
        for frame in frames:
            if len(frame):
                out = frame["value"].tolist()
                yield pd.DataFrame({"value": [(before if i == 0 else ",") + x for i, x in enumerate(out)]})
                before = ","
        yield pd.DataFrame({"value": ["]" if before == "," else "[]"]})

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages (file, html) as a table with a row for each file name; of several pages of one name the last by url stays."""
    last = pages.groupBy("file").agg(F.max_by("html", "url").alias("html"))
    last.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def stamp(spark: SparkSession, path: str) -> str:
    """A hash of names, sizes and times of the files of a table: another one once the table has changed."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, seen = files.listFiles(store, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def chunk_source(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Chunks from a Parquet folder, or from the fallback; an error that names the path if neither is there."""
    for p in (path, fallback):
        if p and exists(spark, p):
            return spark.read.schema(CHUNK).parquet(p)
    raise FileNotFoundError(f"chunks not found at {path}: build them first")


def load_or_build(spark: SparkSession, path: str, build, *, force: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it isn't there or if forced."""
    if force or not is_written(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str = "label") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new, key, "left_anti").select(new.columns).unionByName(new)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a table that is replaced as a whole, ascending."""
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and is_written(spark, f"{path}/{n}"))


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results of the last whole version; none if there is no version or it can't be read."""
    try:
        out = spark.read.schema(EVAL_RESULT).parquet(f"{path}/version={_versions(spark, path)[-1]}")
        out.limit(1).count()
        return out
    except Exception:  # noqa: BLE001 a missing or broken file is an empty history
        return spark.createDataFrame([], EVAL_RESULT)


def save_results(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The results at ``path`` with those of ``new`` in place of equal labels.

    They are written as a new version beside the old one, which counts until the new one is whole; of the versions before,
    the last is kept.
    """
    before = _versions(spark, path)
    number = max(before, default=0) + 1
    upserted(saved_results(spark, path), new).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in before[:-1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return saved_results(spark, path)


def save_program(spark: SparkSession, path: str, predictors: DataFrame, retriever: dict) -> None:
    """A program: its predictors (instructions and demonstrations) and its retriever's state (the index and k)."""
    predictors.select(*spark.createDataFrame([], PROGRAM_STATE).columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/predictors")
    save_state(spark, f"{path}/retriever", retriever)


def load_program(spark: SparkSession, path: str, retriever: dict) -> tuple[DataFrame, dict]:
    """Predictors and retriever state at ``path``, or none and the given one where no program was saved."""
    there = is_written(spark, f"{path}/predictors")
    predictors = spark.read.schema(PROGRAM_STATE).parquet(f"{path}/predictors") if there else spark.createDataFrame([], PROGRAM_STATE)
    return predictors, load_state(spark, f"{path}/retriever", retriever)


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small JSON object as a text file on any file system Spark knows."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str, default: dict) -> dict:
    return default | json.loads(spark.read.text(path).first()[0]) if exists(spark, path) else dict(default)
