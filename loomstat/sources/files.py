"""Reading and writing files: CSV with multi-line fields, JSON lines that may be malformed, Parquet, metadata."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomstat.operators.contracts import ContractError, assert_columns

#: Columns of a raw article export after translation of its headers.
RAW = ("row_index", "doc_id", "publisher", "title", "date", "time", "author", "word_count", "language", "company", "industry", "subject", "region", "page", "article_type", "abstract")
BODIES = tuple(f"body_{i}" for i in range(1, 14))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | StructType) -> DataFrame:
    """CSV under an explicit schema; fields may hold line ends and quotes."""
    schema = columns if isinstance(columns, StructType) else StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A workbook read on the driver, as text; it needs an optional package. Convert large ones to Parquet once."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e


def read_any(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW + BODIES) -> DataFrame:
    """By suffix; anything else is an error."""
    suffix = Path(path).suffix.lower()
    readers: dict[str, Callable[[], DataFrame]] = {".csv": lambda: read_csv(spark, path, columns), ".parquet": lambda: spark.read.parquet(path), ".xlsx": lambda: read_excel(spark, path), ".json": lambda: spark.read.json(path), ".orc": lambda: spark.read.orc(path)}
    if suffix not in readers:
        raise ContractError(f"no reader for {suffix or 'a path without suffix'}")
    return readers[suffix]()


def translate(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by a map; all of its sources must be there."""
    assert_columns(df, *names)
    return df.select([F.col(f"`{a}`").alias(b) for a, b in names.items()])


def clean_articles(raw: DataFrame, order: str | Column = "row_index") -> DataFrame:
    """Bodies joined, prefix, number of words and day parsed, first of equal (title, prefix) kept."""
    from loomstat.operators.measure import keep_first

    body = F.concat_ws(" ", *[F.col(c) for c in BODIES if c in raw.columns])
    df = raw.withColumn("body", body).withColumn("primary_body", F.substring("body", 1, 50))
    df = df.withColumns({"word_count": F.expr("try_cast(replace(word_count, ' words', '') as int)"), "date": F.to_date("date", "yyyy/MM/dd")})
    return keep_first(df, ["title", "primary_body"], [order]).drop(*BODIES)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text, blank ones skipped, so that malformed ones remain visible."""
    return spark.read.text(path).where(F.trim("value") != "")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns))).write.mode("errorifexists").text(path)


def content_hash(df: DataFrame) -> str:
    """Order-free hash of the rows, by one aggregation."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    n, s = df.agg(F.count(F.lit(1)), F.sum(h)).first()
    return hashlib.sha256(f"{df.dtypes}|{n}|{s}".encode()).hexdigest()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quoted line ends, for export; the folder must not exist."""
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _fs(spark: SparkSession, path: str) -> tuple:
    """A Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    pointer, fs = _fs(spark, f"{path}/_CURRENT")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a table as a version named by its content, and point to it; False if it is the one pointed to already.

    The rows are computed once. A version is never touched again and the pointer is replaced in one step, so that a
    reader sees the old table or the new one whenever a writer dies.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    version = content_hash(spark.read.parquet(staged))[:32]
    old, (from_, fs), (to, _) = _current(spark, path), _fs(spark, staged), _fs(spark, f"{path}/v-{version}")
    if fs.exists(to):
        fs.delete(from_, True)
    else:
        fs.rename(from_, to)
    if old == version:
        return False
    (draft, _), (pointer, _) = _fs(spark, f"{path}/_pointer-{uuid.uuid4().hex}"), _fs(spark, f"{path}/_CURRENT")
    out = fs.create(draft)
    out.write(version.encode())
    out.close()
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, pointer, options)
    return True


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``write_if_changed`` points to."""
    version = _current(spark, path)
    if version is None:
        raise ContractError(f"no table at {path}")
    return spark.read.parquet(f"{path}/v-{version}")


def cached_reference(spark: SparkSession, path: str, fetch: Callable[[str], None] | None = None) -> DataFrame | None:
    """A small reference table kept in a file, which ``fetch`` makes if it isn't there; None if it can't."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        try:
            if fetch is None:
                return None
            fetch(path)
        except OSError:
            return None
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def reference_names(current: DataFrame | None, historical: DataFrame | None, born_after: str = "1940-01-01") -> DataFrame | None:
    """Both tables as one, of the historical only people born after a day (compared as text)."""
    if historical is not None and "birthday" in historical.columns:
        historical = historical.where(F.col("birthday") > born_after)
    tables = [t for t in (current, historical) if t is not None]
    if not tables:
        return None
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True)


@contextlib.contextmanager
def tee(path: str) -> Iterator[None]:
    """What is printed inside goes to a report file too."""
    with open(path, "w", encoding="utf-8") as report:

        class Both:
            def write(self, text: str) -> int:
                report.write(text)
                return out.write(text)

            def flush(self) -> None:
                report.flush()
                out.flush()

        out = sys.stdout
        with contextlib.redirect_stdout(Both()):  # type: ignore[type-var]
            yield


def reserve_root(path: str, under: str) -> Path:
    """A new folder whose name ends in _vN or -vN inside an approved one; it must not exist."""
    p, base = Path(path).resolve(), Path(under).resolve()
    if base not in p.parents:
        raise ContractError("the folder is outside the approved one")
    if not re.search(r"[_-]v\d+$", p.name):
        raise ContractError("the name must end in a version")
    p.mkdir(parents=True, exist_ok=False)
    return p


def write_metadata(path: str, **payload: object) -> str:
    """JSON beside results; returns the run id, which is the hash of the payload."""
    text = json.dumps(payload, sort_keys=True, default=str)
    run_id = hashlib.sha256(text.encode()).hexdigest()[:16]
    Path(path).write_text(json.dumps({"run_id": run_id, **payload}, sort_keys=True, indent=1, default=str))
    return run_id


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def lineage(spark: SparkSession, inputs: dict[str, str], outputs: dict[str, str], **settings: object) -> dict:
    """Hashes of what went in and came out, and the settings; the run id depends on inputs and settings alone."""
    def hashes(paths: dict[str, str]) -> dict[str, dict[str, str]]:
        # a row for each file of a few named paths
        return {name: {Path(r["path"]).name: r["sha256"] for r in file_hashes(spark, p).orderBy("path").collect()} for name, p in paths.items()}

    made = {"inputs": hashes(inputs), "settings": settings}
    run_id = hashlib.sha256(json.dumps({"inputs": {k: sorted(v.values()) for k, v in made["inputs"].items()}, "settings": settings}, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return {"run_id": run_id, **made, "outputs": hashes(outputs), "software": {"python": sys.version.split()[0], "spark": spark.version}}


class Catalog:
    """Named tables of one root folder, read when asked for and registered as views."""

    def __init__(self, spark: SparkSession, root: str, names: dict[str, str]) -> None:
        self.spark, self.root, self.names = spark, root.rstrip("/"), names

    def __getitem__(self, name: str) -> DataFrame:
        df = read_any(self.spark, f"{self.root}/{self.names[name]}")
        df.createOrReplaceTempView(name)
        return df


def annotate_from_files(requests: DataFrame, responses: DataFrame, key: str = "custom_id") -> DataFrame:
    """Results joined to requests by id; the last of repeated results wins, and requests without one keep not_scored."""
    from loomstat.operators.measure import keep_first

    last = keep_first(responses, [key], [F.col("line_no").desc()])
    return requests.join(last.drop("line_no"), key, "left").withColumn("llm_error_type", F.coalesce("llm_error_type", F.lit("not_scored")))
