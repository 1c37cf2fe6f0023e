"""Source trees as tables: scan, filters, hashes, search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import EXTENSIONS, language_of_path

#: Directories that are left out, and the largest file taken.
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", "target", "venv", "__pycache__")
MOST_BYTES = 10 * 1024 * 1024


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any directories, ``*`` within one, ``?`` one character."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
            k += 1
    return f"^{out}$"


def matches(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    ok = F.lit(not include)
    for g in include or []:
        ok = ok | path.rlike(glob_pattern(g))
    for g in exclude or []:
        ok = ok & ~path.rlike(glob_pattern(g))
    return ok


def is_binary(content: Column) -> Column:
    """A zero byte among the first 1024."""
    return F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?00")


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, extensions=tuple(EXTENSIONS), most: int = MOST_BYTES, hidden: bool = False) -> DataFrame:
    """(path, relative_path, size, modified, language, content, hash) of a tree's text files.

    Names and sizes are tested before the contents are read: path, length and time come from the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').split('://')[-1])}/", "")
    rows = files.withColumn("relative_path", relative).where(F.col("length") <= most)
    for name in IGNORED:
        rows = rows.where(~F.concat(F.lit("/"), "relative_path").contains(f"/{name}/"))
    if not hidden:
        rows = rows.where(~F.concat(F.lit("/"), "relative_path").rlike(r"/\."))
    rows = rows.where(F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9+]+)$", 1)).isin(*extensions)).where(matches(F.col("relative_path"), include, exclude))
    rows = rows.where(~is_binary(F.col("content")))
    return rows.select("path", "relative_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), language_of_path(F.col("relative_path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def search_names(files: DataFrame, text: str, case: bool = False, most: int = 100, path: str = "relative_path") -> DataFrame:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.contains(name, F.lit(text)) if case else F.contains(F.lower(name), F.lit(text.lower()))
    return files.where(hit).orderBy(path).limit(most)


def directory_stats(files: DataFrame, path: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """(totals, files and bytes by language)."""
    total = files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.avg("size").alias("avg_size"), F.max_by(path, F.struct("size", path)).alias("largest"))
    return total, files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, k: int = 10, path: str = "relative_path") -> DataFrame:
    """The k largest files, with their place."""
    best = files.orderBy(F.desc("size"), path).limit(k)
    return best.select(path, "size")


def by_extension(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """(extension, n_files, bytes): without a dot there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def project_id(path: Column) -> Column:
    """A stable key of a project: by its path, not its content."""
    return F.substring(F.sha2(path, 256), 1, 16)
