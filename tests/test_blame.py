"""Owners of lines, replayed from patches, against lists of lines."""

import difflib
import random
import re

import pytest

from changerisk.operators.blame import edited, label_by_replay, patch_edits, path_families, replay_blame

CHANGES = (
    "project string, commit_id string, seq bigint, ordinal int, old_path string, new_path string, "
    "patch string, source_code string"
)


def patch_of(old, new, context):
    return "\n".join(difflib.unified_diff(old, new, "a", "b", lineterm="", n=context))


def owned(old, owners, new, who):
    """Owners of the new lines, from the same matching that the patch was made of."""
    found = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
        found += owners[a:b] if tag == "equal" else [who] * (d - c)
    return found


def random_history(seed, commits=60):
    dice = random.Random(seed)
    files, rows, expected = {}, [], {}
    for seq in range(commits):
        who, next_files = f"c{seq}", dict(files)
        names = dice.sample(["a.py", "b.py", "d/c.py", "e.md"], dice.randint(1, 3))
        for ordinal, name in enumerate(names):
            old, owners = files.get(name, ([], []))
            if owners:
                expected[who, name] = {w: owners.count(w) for w in set(owners)}
            kind = dice.random()
            if name in files and kind < 0.1:
                rows.append(("p", who, seq, ordinal, name, None, None, None))
                next_files.pop(name)
                continue
            new = [line for line in old if dice.random() > 0.2]
            for _ in range(dice.randint(0, 4)):
                new.insert(dice.randint(0, len(new)), dice.choice(["--x", "++y", "", "z", f"n{seq}"]))
            target = name
            if name in files and kind > 0.85:
                free = [n for n in ("f.py", "g/h.py", "k.py") if n not in next_files]
                target = free[0] if free else name
            if target != name:
                expected[who, target] = expected.pop((who, name), None) or {}
                next_files.pop(name)
            next_files[target] = (new, owned(old, owners, new, who))
            rows.append(("p", who, seq, ordinal, name if name in files else None, target, patch_of(old, new, dice.choice([0, 1, 3])), "unused"))
        files = next_files
    return rows, {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_random_histories(spark, seed):
    rows, expected = random_history(seed)
    found = {}
    for r in replay_blame(spark.createDataFrame(rows, CHANGES).repartition(7)).collect():
        found.setdefault((r["commit_id"], r["file_path"]), {})[r["blamed"]] = r["lines"]
    assert found == expected and any(rows[i][4] and rows[i][5] and rows[i][4] != rows[i][5] for i in range(len(rows)))


def test_edits_of_patches():
    assert patch_edits(None) == patch_edits("") == patch_edits("no hunk") == []
    # Lines that look like file headers inside a hunk are lines; a missing last line break is none.
    assert patch_edits("--- a\n+++ b\n@@ -2,2 +2 @@ f\n--- x\n-y\n+++ z\n\\ No newline at end of file") == [1, 2, 1]
    assert patch_edits("@@ -0,0 +1,2 @@\n+a\n+b\n@@ -4 +6,0 @@\n-c") == [0, 0, 2, 3, 1, 0]
    # Lines older than the table have no owner, also beyond all known ones.
    assert edited([], [2, 1, 3], "c") == [(2, None), (3, "c")]
    assert edited([(2, "a"), (2, "b")], [1, 2, 0], "c") == [(1, "a"), (1, "b")]


def test_swaps_families_and_odd_rows(spark):
    one, two = "@@ -0,0 +1 @@\n+1", "@@ -0,0 +1,2 @@\n+1\n+2"
    rows = [
        ("p", "c1", 1, 0, None, "a.py", one, None),
        ("p", "c1", 1, 1, "", "b.py", None, "x\ny\nz\n"),
        ("p", "c2", 2, 0, "a.py", "b.py", None, None),
        ("p", "c2", 2, 1, "b.py", "a.py", two, None),
        ("p", "c3", 3, 0, "a.py", "a.py", None, None),
        ("p", "c3", 3, 1, "b.py", "b.py", None, None),
        ("p", "c3", 3, 2, None, None, one, None),
        ("q", "c3", 3, 0, "a.py", "a.py", one, None),
    ]
    changes = spark.createDataFrame(rows, CHANGES)
    families = {(r["project"], r["path"]): r["family"] for r in path_families(changes.filter("old_path <> ''")).collect()}
    assert families == {("p", "a.py"): "a.py", ("p", "b.py"): "a.py"}
    asked = spark.createDataFrame([("p", "c3"), ("q", "c3"), ("p", "none")], "project string, commit_id string")
    found = {tuple(r) for r in replay_blame(changes, asked).collect()}
    assert found == {("p", "c3", "a.py", "c2", 2), ("p", "c3", "a.py", "c1", 3), ("p", "c3", "b.py", "c1", 1)}
    assert replay_blame(changes.limit(0)).collect() == []


def test_labels_from_the_change_table(spark):
    one = "@@ -0,0 +1 @@\n+1"
    rows = [
        ("p", "c1", 1, 0, None, "a.py", one, None),
        ("p", "c2", 2, 0, None, "a.md", one, None),
        ("p", "c3", 3, 0, "a.py", "a.py", "@@ -1 +1 @@\n-1\n+2", None),
        ("p", "c4", 4, 0, "a.md", "a.md", "@@ -1 +1 @@\n-1\n+2", None),
        ("p", "c4", 4, 1, "a.py", "a.py", "@@ -1 +1 @@\n-2\n+3", None),
    ]
    log = [("p", "c1", "add", 5), ("p", "c2", None, 6), ("p", "c3", "change", 7), ("p", "c4", "fix bug", 8), ("q", "c3", "x", 9)]
    commits = spark.createDataFrame(log, "project string, commit_id string, message string, extra int")
    found = label_by_replay(commits, spark.createDataFrame(rows, CHANGES), (".py",))
    assert {(r["project"], r["commit_id"], r["fix"], r["buggy"], r["extra"]) for r in found.collect()} == {
        ("p", "c1", 0, 0, 5), ("p", "c2", 0, 0, 6), ("p", "c3", 0, 1, 7), ("p", "c4", 1, 0, 8), ("q", "c3", 0, 0, 9)
    }


def plain_edits(patch):
    """Edits line by line."""
    edits, old, old_left, new_left, open_edit = [], 0, 0, 0, False
    for line in patch.split("\n"):
        if old_left <= 0 and new_left <= 0:
            if hunk := re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@", line):
                old_left, new_left = (1 if g is None else int(g) for g in hunk.group(2, 3))
                old, open_edit = int(hunk.group(1)) - (1 if old_left else 0), False
        elif line[:1] in ("+", "-"):
            if not open_edit:
                edits.append([old, 0, 0])
            open_edit, drop = True, line[0] == "-"
            edits[-1][1 if drop else 2] += 1
            old, old_left, new_left = old + drop, old_left - drop, new_left - (not drop)
        elif line[:1] != "\\":
            old, old_left, new_left, open_edit = old + 1, old_left - 1, new_left - 1, False
    return [number for edit in edits for number in edit]


def test_edits_of_odd_patches():
    dice = random.Random(3)
    lines = ["+x", "+", "-y", "--- a", "+++ b", " z", "", "\\ no end", "@ at", "@@ -1 +1 @@", "@@ -3,2 +3,4 @@ f", "@@ -9,0 +2,3 @@", "\rq"]
    for _ in range(3000):
        patch = "\n".join(dice.choices(lines, k=dice.randint(0, 14)))
        assert patch_edits(patch) == plain_edits(patch), patch
    assert patch_edits("@@ -0,0 +1,300000 @@" + "\n+x" * 300_000) == [0, 0, 300_000]


def test_labels_read_the_patches_once(spark):
    """Relevance is a matter of the path alone, unless the files of a fix are counted."""
    commits = spark.createDataFrame([("p", "c1", "fix")], "project string, commit_id string, message string")
    changes = spark.createDataFrame([("p", "c1", 1, 0, None, "a.py", None, "x")], CHANGES).filter("ordinal <> 987654")
    plans = [label_by_replay(commits, changes, (".py",), files_per_fix=n)._jdf.queryExecution().optimizedPlan().toString() for n in (None, 5)]
    assert [plan.count("987654") for plan in plans] == [1, 2]
