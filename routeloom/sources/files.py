"""JSON, source-tree and sink connectors."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values.
SUFFIXES = [".cjs", ".cs", ".ex", ".exs", ".go", ".java", ".js", ".jsx", ".kt", ".mjs", ".php", ".py", ".rb", ".rs", ".ts", ".tsx"]
SKIPPED = [
    ".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", ".venv", "venv", "__pycache__", "target", "test", "tests",
    "__tests__", "spec", "specs", "mock", "mocks", "fixture", "fixtures", "example", "examples", "doc", "docs",
]
SKIPPED_FOR_DESCRIPTIONS = [".git", "node_modules", "vendor", "dist", "build", ".venv", "venv"]
TEST_FILE = r"^test_|_test\.(go|py)$|\.test\.|\.spec\.|tests\.py$"
DESCRIPTION = r"(?=.*\.(json|yaml|yml)$)(.*(openapi|swagger)|api\.(json|yaml|yml)$)"
MAX_BYTES = 1_000_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; a bad line is an error, a missing file is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def relative_path(spark: SparkSession, root: str, path: Column) -> Column:
    """What follows the root in a file's address; an address outside the root stays as it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    # Addresses differ in how many slashes follow the scheme.
    plain = lambda c: F.regexp_replace(c, "^([a-zA-Z][a-zA-Z0-9+.-]*):/+", "$1:/")
    base = re.sub("^([a-zA-Z][a-zA-Z0-9+.-]*):/+", r"\1:/", whole)
    own = plain(path)
    return F.when(own.startswith(base), F.substring(own, F.lit(len(base) + 1), F.length(own))).otherwise(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document as one row; a missing file gives no row, a bad one is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet: all columns are text, quotes are doubled, a field may hold line ends; empty stays empty."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, length, content of every file under ``root``; unreadable ones aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    return files.select(relative_path(spark, root, F.col("path")).alias("rel_path"), "length", "content")


def in_folders(names: list[str]) -> Column:
    folders = F.split("rel_path", "/")
    return F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*[F.lit(x) for x in names]))


def source_files(files: DataFrame) -> DataFrame:
    """Sources among ``files`` (rel_path, length, content) without tests, skipped folders and large files."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.where((F.col("length") <= MAX_BYTES) & suffix.isin(*SUFFIXES) & ~name.rlike(TEST_FILE) & ~in_folders(SKIPPED))


def description_files(files: DataFrame) -> DataFrame:
    """API descriptions among ``files``, by name; tests and examples count."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    return files.where(name.rlike("^" + DESCRIPTION) & ~in_folders(SKIPPED_FOR_DESCRIPTIONS))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A sheet in one file (a sheet is for people, so it is small), its columns as listed; other columns are left out, missing ones are empty."""
    if columns is not None:
        df = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as one JSON document with sorted keys, put in place of the old one only when it is whole."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    system = target.getFileSystem(conf)
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"could not write {path}")
