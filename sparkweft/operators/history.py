"""Analytics over a commit history: (hash, date, author_ref, files array<struct<path, added, removed>>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(commits: DataFrame, since: str | None = None) -> DataFrame:
    """One row for each file of each commit. ISO dates compare as text."""
    df = commits if since is None else commits.where(F.col("date") >= since)
    return df.select("hash", "date", "author_ref", F.explode("files").alias("f")).select("hash", "date", "author_ref", "f.path", "f.added", "f.removed")


def churn(commits: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, commits, added, removed), most commits first."""
    out = file_changes(commits, since).groupBy("path").agg(F.countDistinct("hash").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return out if limit is None else out.orderBy(F.desc("commits"), "path").limit(limit)


def co_change(commits: DataFrame, least: float = 0.0, path: str | None = None) -> DataFrame:
    """(path, other, together, support): files of the same commits; support is the share of path's commits.

    A self-join on the commit. Each pair of files is counted once, the lesser first, and mirrored after the counting;
    with a path only its own partners are joined. A commit of n files has n (n - 1) / 2 pairs: of a very large commit
    Spark splits the rows over tasks, and pairs are counted before they are shuffled.
    """
    files = file_changes(commits, None).select("hash", "path").distinct()
    totals = (files if path is None else files.where(F.col("path") == path)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    if path is None:
        met = files.join(files.withColumnRenamed("path", "other"), "hash").where("path < other").groupBy("path", "other").agg(F.count(F.lit(1)).alias("together"))
        sides = F.explode(F.array(F.struct(F.col("path").alias("path"), F.col("other").alias("other")), F.struct(F.col("other").alias("path"), F.col("path").alias("other"))))
        together = met.select(sides.alias("p"), "together").select("p.path", "p.other", "together")
    else:
        together = files.where(F.col("path") == path).join(files.withColumnRenamed("path", "other"), "hash").where("path != other").groupBy("path", "other").agg(F.count(F.lit(1)).alias("together"))
    return together.join(totals, "path").select("path", "other", "together", (F.col("together") / F.col("n")).alias("support")).where(F.col("support") >= least)


def ownership(commits: DataFrame, authors: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(path, author, commits, added, removed); the author's name where (id, name) knows it, else the reference."""
    files = file_changes(commits)
    files = files if path is None else files.where(F.col("path") == path)
    out = files.groupBy("path", "author_ref").agg(F.countDistinct("hash").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    if authors is not None:
        out = out.join(authors.select(F.col("id").alias("author_ref"), "name"), "author_ref", "left")
        return out.select("path", F.coalesce("name", "author_ref").alias("author"), "commits", "added", "removed")
    return out.withColumnRenamed("author_ref", "author")


def archaeology(commits: DataFrame) -> DataFrame:
    """(path, first_date, first_author, last_date, last_author, commits); equal dates are ordered by hash."""
    at = F.struct("date", "hash")
    return file_changes(commits).groupBy("path").agg(
        F.min("date").alias("first_date"), F.min_by("author_ref", at).alias("first_author"), F.max("date").alias("last_date"), F.max_by("author_ref", at).alias("last_author"), F.countDistinct("hash").alias("commits")
    )


def normalized_authors(commits: DataFrame) -> DataFrame:
    """(id, name, emails, aliases) from (author_name, author_email, date): one author for each e-mail in lower case,
    named as in the latest commit."""
    email = F.lower(F.trim("author_email"))
    return commits.groupBy(email.alias("id")).agg(F.max_by("author_name", F.struct("date", "author_name")).alias("name"), F.sort_array(F.collect_set("author_email")).alias("emails"), F.sort_array(F.collect_set("author_name")).alias("aliases"))


def new_commits(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("hash"), "hash", "left_anti").select(*found.columns)
