"""Who wrote the lines of a file, replayed from the patches of the change table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import require_columns
from changerisk.functions import text
from changerisk.operators.labels import label_fix, szz_candidates, szz_label
from changerisk.runtime import freeze

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.MULTILINE)
#: Runs of lines of a hunk: added, dropped, notes on line ends, unchanged. A line with "@" is a run of its own.
_LINES = re.compile(
    r"((?:\+[^\n]*+\n?+)++)|((?:-[^\n]*+\n?+)++)|((?:\\[^\n]*+\n?+)++)|@[^\n]*+\n?+|(?:\n|[^@+\-\\\n][^\n]*+\n?+)++"
)
#: Rows of a result batch.
_BATCH = 8192

Run = tuple[int, str | None]


def patch_edits(patch: str | None) -> list[int]:
    """Edits of a unified diff as triples: old lines before it, lines dropped, lines added."""
    patch, numbers, place = patch or "", [], 0
    while hunk := _HUNK.search(patch, place):
        old_left, new_left = (1 if g is None else int(g) for g in hunk.group(2, 3))
        old = int(hunk.group(1)) - (1 if old_left else 0)
        open_edit = False
        place = patch.find("\n", hunk.end()) + 1
        while place and place < len(patch) and (old_left > 0 or new_left > 0):
            run = _LINES.match(patch, place)
            place, kind = run.end(), run.lastindex
            if kind == 3:
                continue
            lines = patch.count("\n", run.start(), place) + (patch[place - 1] != "\n")
            if kind is None:
                lines = min(lines, max(old_left, new_left))
                old, old_left, new_left, open_edit = old + lines, old_left - lines, new_left - lines, False
                continue
            if not open_edit:
                numbers += [old, 0, 0]
                open_edit = True
            # The hunk ends with its last line, whatever follows.
            if kind == 1:
                lines = lines if old_left > 0 else min(lines, new_left)
                numbers[-1] += lines
                new_left -= lines
            else:
                lines = lines if new_left > 0 else min(lines, old_left)
                numbers[-2] += lines
                old, old_left = old + lines, old_left - lines
        if not place:
            break
    return numbers


def edited(runs: Sequence[Run], edits: Sequence[int], owner: str) -> list[Run]:
    """Runs (lines, owner) of a file after an owner's edits. Lines older than the table have no owner.

    Neighbouring runs have different owners. Runs behind the last edit are taken over as they are.
    """
    done: list[Run] = []
    place = at_run = used = 0  # old lines passed, the run they end in, and lines passed of it
    last = len(runs)
    for at, drop, add in zip(edits[::3], edits[1::3], edits[2::3]):
        for count, keep in ((at - place, True), (drop, False)):
            while count > 0 and at_run < last:
                length, who = runs[at_run]
                taken = min(length - used, count)
                if keep:
                    _put(done, taken, who)
                count, used = count - taken, used + taken
                if used == length:
                    at_run, used = at_run + 1, 0
            if keep and count > 0:
                _put(done, count, None)
        _put(done, add, owner)
        place = at + drop
    if at_run < last:
        length, who = runs[at_run]
        _put(done, length - used, who)
        done += runs[at_run + 1 :]
    return done


def _put(done: list[Run], count: int, who: str | None) -> None:
    if count > 0 and done and done[-1][1] == who:
        done[-1] = (done[-1][0] + count, who)
    elif count > 0:
        done.append((count, who))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _edits(patches: pd.Series) -> pd.Series:
    return patches.map(patch_edits)


def path_families(changes: DataFrame, old: str = "old_path", new: str = "new_path") -> DataFrame:
    """(project, path, family) of all paths that a rename links: the smallest path of their group.

    Smallest neighbours and jumps to the group found so far, until nothing changes. Only paths of
    renames take part.
    """
    renames = changes.filter(F.col(old) != F.col(new)).select("project", F.col(old).alias("a"), F.col(new).alias("b"))
    edges = freeze(renames.union(renames.select("project", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = freeze(edges.groupBy("project", F.col("a").alias("path")).agg(F.least("path", F.min("b")).alias("family")))
    while True:
        beside = edges.join(labels.withColumnRenamed("path", "b"), ["project", "b"])
        nearest = beside.groupBy("project", F.col("a").alias("path")).agg(F.min("family").alias("_near"))
        jumps = labels.select("project", F.col("path").alias("family"), F.col("family").alias("_jump"))
        smallest = F.least("family", "_near", "_jump")
        found = labels.join(nearest, ["project", "path"]).join(jumps, ["project", "family"])
        found = freeze(found.select("project", "path", smallest.alias("family"), (smallest != F.col("family")).alias("moved")))
        labels = found.drop("moved")
        if found.filter("moved").isEmpty():
            return labels


def replay_blame(changes: DataFrame, asked: DataFrame | None = None, *, seq: str = "seq") -> DataFrame:
    """Owners of the lines that a file had before a commit changed it.

    ``changes``: project, commit_id, the commit's place ``seq`` in its project, ordinal, old_path,
    new_path, patch and source_code; ``asked``: (project, commit_id) to report, all if not given.
    Returns project, commit_id, file_path, blamed and lines, one row per owner; files that were
    empty or new have none, and lines older than the table a null owner.

    Patches become edits where they lie. Edits, without texts, meet by file, in order, and a task
    holds no more of them than one batch: its state is the run of lines per owner of one family
    of files. A change without patch adds its ``source_code``, or moves the lines it finds; one
    without a new path ends the file. Edits of one commit see the files as they were before it.
    """
    require_columns(changes, ["project", "commit_id", seq, "ordinal", "old_path", "new_path", "patch", "source_code"])

    def path(name: str) -> Column:
        return text.normalize_path(F.nullif(F.col(name), F.lit("")))

    source_lines = F.size(F.split(F.regexp_replace("source_code", r"\n\z", ""), "\n"))
    whole = F.array(F.lit(0), F.lit(0), source_lines).cast("array<bigint>")
    added = F.col("patch").isNull() & F.col("old").isNull() & (F.length("source_code") > 0)
    rows = changes.withColumns({"old": path("old_path"), "new": path("new_path")}).filter("coalesce(new, old) is not null")
    rows = rows.select(
        "project", "commit_id", F.col(seq).cast("bigint").alias("seq"), "ordinal", "old", "new",
        F.when(added, whole).otherwise(_edits("patch")).alias("edits"),
    )
    if asked is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        marks = asked.select("project", "commit_id").distinct().withColumn("asked", F.lit(True))
        rows = rows.join(marks, ["project", "commit_id"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    moved = path_families(changes.withColumns({"old_path": path("old_path"), "new_path": path("new_path")}))
    rows = rows.withColumn("path", F.coalesce("new", "old")).join(moved, ["project", "path"], "left")
    rows = rows.withColumn("family", F.coalesce("family", "path")).drop("path")
    ordered = rows.repartition("project", "family").sortWithinPartitions(
        "project", "family", "seq", "commit_id", "ordinal", "old", "new"
    )
    kind = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    schema = f"project {kind['project']}, commit_id {kind['commit_id']}, file_path string, blamed {kind['commit_id']}, lines bigint"
    return ordered.mapInArrow(_replay, schema)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = commit = None
    files: dict[str, list[Run]] = {}
    gone: set[str] = set()
    made: dict[str, list[Run]] = {}
    out: list[tuple] = []
    names = ["project", "commit_id", "file_path", "blamed", "lines"]
    for batch in batches:
        types = [batch.schema.field("project").type, batch.schema.field("commit_id").type, pa.string()]
        types += [types[1], pa.int64()]
        columns = [batch.column(c).to_pylist() for c in ("project", "family", "seq", "commit_id", "old", "new", "asked")]
        edits, ends = batch.column("edits").flatten().to_pylist(), batch.column("edits").value_lengths().to_pylist()
        start = 0
        for project, of, seq, who, old, new, asked, length in zip(*columns, ends):
            own, start = edits[start : start + (length or 0)], start + (length or 0)
            if (project, of) != family:
                family, commit, files, gone, made = (project, of), None, {}, set(), {}
            if (seq, who) != commit:
                for name in gone:
                    files.pop(name, None)
                files.update(made)
                commit, gone, made = (seq, who), set(), {}
            before = files.get(old if old is not None else new, []) if old is not None or new not in gone else []
            if asked and before:
                owners: dict[str | None, int] = {}
                for count, owner in before:
                    owners[owner] = owners.get(owner, 0) + count
                out += [(project, who, new or old, owner, n) for owner, n in owners.items()]
            if new is None:
                gone.add(old)
            else:
                if old is not None and old != new:
                    gone.add(old)
                # Several changes of one file in one commit follow each other.
                made[new] = edited(made.get(new, before), own, who)
            if len(out) >= _BATCH:
                yield _as_batch(out, names, types)
                out = []
        if out:
            yield _as_batch(out, names, types)
            out = []


def _as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names)


def label_by_replay(
    commits: DataFrame,
    changes: DataFrame,
    suffixes: text.Suffixes,
    *,
    message: str = "message",
    files_per_fix: int | None = None,
    seq: str = "seq",
) -> DataFrame:
    """``fix`` and ``buggy`` of all commits from the change table alone, without blame output.

    ``commits``: project, commit_id and message; ``changes``: as in ``replay_blame``. Faulty are the
    commits that own a line which a relevant file of a fix commit had before the fix.
    """
    labelled = label_fix(commits, message)
    fixes = labelled.filter("fix = 1").select("project", "commit_id")
    owners = replay_blame(changes, fixes, seq=seq).filter("blamed is not null")
    if files_per_fix is None:  # a path is relevant by itself
        return _marked(labelled, owners.filter(text.file_is_relevant(F.col("file_path"), suffixes)))
    path = text.changed_path(F.col("old_path"), F.col("new_path"))
    touched = changes.join(fixes, ["project", "commit_id"], "left_semi").select(
        "project", "commit_id", F.struct("project", "commit_id").alias("fix_commit_id"),
        F.col("ordinal").alias("file_ordinal"), path.alias("file_path"),
    )
    wanted = szz_candidates(touched, suffixes, files_per_fix).select("project", "commit_id", "file_path").distinct()
    return _marked(labelled, owners.join(wanted, ["project", "commit_id", "file_path"], "left_semi"))


def _marked(labelled: DataFrame, owners: DataFrame) -> DataFrame:
    blamed = owners.select(F.struct("project", F.col("blamed").alias("commit_id")).alias("_commit"))
    marked = szz_label(labelled.withColumn("_commit", F.struct("project", "commit_id")), blamed, "_commit")
    return marked.drop("_commit")
