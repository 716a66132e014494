"""Sources of histories, knowledge notes and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import glob_pattern

#: How a log is to be printed: git log --numstat -M --format=%x1e%H%x1f%aI%x1f%an%x1f%ae%x1f%s
RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = "%x1e%H%x1f%aI%x1f%an%x1f%ae%x1f%s"


def renamed(path: Column) -> Column:
    """The new path of a rename, written 'old => new' or 'dir/{old => new}/file'."""
    braced = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.regexp_replace(braced, r"^.* => (.*)$", "$1")
    return F.regexp_replace(whole, "//", "/")


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits (hash, date, author_name, author_email, message, files) from logs in LOG_FORMAT, one record a commit."""
    records = spark.read.option("lineSep", RECORD).text(path).where(F.length("value") > 0)
    return parse_git_log(records)


def parse_git_log(records: DataFrame) -> DataFrame:
    """The same from a column value with one record a row. Binary files count 0 lines."""
    head = F.split(F.split("value", "\n")[0], FIELD)
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t"))

    def change(line):  # noqa: ANN001, ANN202
        f = F.split(line, "\t")
        count = lambda c: F.when(c == "-", 0).otherwise(c.cast("int"))
        return F.struct(renamed(f[2]).alias("path"), count(f[0]).alias("added"), count(f[1]).alias("removed"))

    return records.select(head[0].alias("hash"), head[1].alias("date"), head[2].alias("author_name"), head[3].alias("author_email"), head[4].alias("message"), F.transform(lines, change).alias("files"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge notes: (path, id, kind, status, relates_to, text) from Markdown files with a head of 'key: value'."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value"))
    return parse_notes(whole)


def parse_notes(notes: DataFrame) -> DataFrame:
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)

    def key(name: str):  # noqa: ANN202
        found = F.regexp_extract(head, rf"(?m)^{re.escape(name)}:[ \t]*(.*)$", 1)
        return F.when(found != "", F.trim(F.regexp_replace(found, "^[\"']|[\"']$", "")))

    refs = F.regexp_extract(head, r"(?m)^relates_to:[ \t]*\[(.*)\]", 1)
    relates = F.transform(F.filter(F.split(refs, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), "[\"']", ""))
    return notes.select("path", key("id").alias("id"), F.upper(key("type")).alias("kind"), key("status").alias("status"), relates.alias("relates_to"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?|\s+\z", "").alias("text"))


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, whether it takes back) of a .gitignore's lines, in order."""
    out = []
    for raw in text.split("\n"):
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!").replace("\\ ", " ")
        folder, body = line.endswith("/"), line.strip("/")
        anchored = "/" in line.rstrip("/")
        pattern = glob_pattern(body).removeprefix("^").removesuffix("$")
        out.append(("^" + ("" if anchored else "(?:.*/)?") + pattern + ("/.*" if folder else "(?:/.*)?") + "$", back))
    return out


def discover(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), ignore: bool = True) -> DataFrame:
    """(path, mtime, length) of the files below root that some include glob and no exclude glob matches, by path; hidden
    files and, with ignore, those that root's .gitignore names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(re.sub("^[a-z]+:/*", "/", base)), "")
    hit = F.lit(False)
    for g in include:
        hit |= relative.rlike(glob_pattern(g))
    for g in exclude:
        hit &= ~relative.rlike(glob_pattern(g))
    if ignore:
        left = F.lit(False)
        for pattern, back in ignore_rules(_small_text(spark, base + ".gitignore")):  # the last rule that matches decides
            left = F.when(relative.rlike(pattern), F.lit(not back)).otherwise(left)
        hit &= ~left & ~relative.rlike(r"(^|/)\.")
    return files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), "length").where(hit).orderBy("path")


def _small_text(spark: SparkSession, path: str) -> str:
    """The text of a small file, empty where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_wire(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes or edges from JSON lines in wire form (id, nodeType, name, file, exported, metadata / src, dst, edgeType)."""
    if kind == "nodes":
        df = spark.read.schema("id string, nodeType string, name string, file string, exported boolean, metadata string, semanticId string").json(path)
        return df.select(F.coalesce("semanticId", "id").alias("id"), F.col("nodeType").alias("node_type"), "name", "file", "exported", F.xxhash64("name", "file", "metadata").alias("content_hash"), "metadata")
    return spark.read.schema("src string, dst string, edgeType string, metadata string").json(path).select("src", "dst", F.col("edgeType").alias("edge_type"), "metadata")
