"""Fix labels from messages and fault labels from blame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changerisk.fixed_values import COMMIT_ID_LENGTH, FIX_KEYWORDS
from changerisk.functions import text


def label_fix(commits: DataFrame, message: str = "message", keywords: Sequence[str] = FIX_KEYWORDS) -> DataFrame:
    """Set ``fix`` to 1 or 0."""
    return commits.withColumn("fix", text.is_fix_commit(F.col(message), keywords).cast("int"))


def label_initial(commits: DataFrame, message: str = "message") -> DataFrame:
    """``buggy`` and ``fix`` as they are before blame is known: both the keyword match."""
    return label_fix(commits, message).withColumn("buggy", F.col("fix"))


def szz_candidates(
    fix_changes: DataFrame, suffixes: text.Suffixes, files_per_fix: int | None = None, path: str = "file_path"
) -> DataFrame:
    """Relevant files to blame: all of each fix commit, or the first ``files_per_fix`` in file order.

    ``fix_changes`` holds fix_commit_id, file_ordinal and the path, for fix commits that have a
    parent. The rank filter is a constant, so Spark keeps only the first few per task before
    the shuffle.
    """
    order = Window.partitionBy("fix_commit_id").orderBy("file_ordinal", path)
    relevant = fix_changes.filter(text.file_is_relevant(F.col(path), suffixes))
    if files_per_fix is None:
        return relevant
    return relevant.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= files_per_fix).drop("_rank")


def szz_blamed(blame_lines: DataFrame, id_length: int = COMMIT_ID_LENGTH) -> DataFrame:
    """Distinct commit ids named by blame output lines."""
    commit = text.blamed_commit(F.col("line"), id_length)
    return blame_lines.select(commit.alias("commit_id")).filter("commit_id is not null").distinct()


def label_by_blame(
    commits: DataFrame,
    fix_changes: DataFrame,
    blame_lines: DataFrame,
    suffixes: text.Suffixes,
    *,
    message: str = "message",
    parents: str = "parents",
    files_per_fix: int | None = None,
    path: str = "file_path",
) -> DataFrame:
    """``fix`` and ``buggy`` of all commits, from fix messages and blame output.

    ``commits``: commit_id, message and the number of parents; ``fix_changes``: fix_commit_id,
    file_ordinal and the path; ``blame_lines``: fix_commit_id, the path and the line. Only fix
    commits that have a parent are followed, and of their blame lines only those of candidate
    files. Commits named there are faulty.
    """
    labelled = label_fix(commits, message)
    fixes = labelled.filter((F.col("fix") == 1) & (F.col(parents) > 0)).select(F.col("commit_id").alias("fix_commit_id"))
    candidates = szz_candidates(fix_changes.join(fixes, "fix_commit_id", "left_semi"), suffixes, files_per_fix, path)
    lines = blame_lines.join(candidates.select("fix_commit_id", path).distinct(), ["fix_commit_id", path], "left_semi")
    return szz_label(labelled, szz_blamed(lines))


def szz_label(commits: DataFrame, blamed: DataFrame, key: str = "commit_id") -> DataFrame:
    """``buggy`` = 1 for blamed commits, else 0."""
    marks = blamed.select(key).distinct().withColumn("_blamed", F.lit(1))
    marked = commits.drop("buggy").join(marks, key, "left")
    return marked.withColumn("buggy", F.coalesce("_blamed", F.lit(0))).drop("_blamed")
