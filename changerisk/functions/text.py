"""Column expressions on messages, paths and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.fixed_values import FIX_KEYWORDS, TEXT_SEPARATOR

Suffixes = Sequence[str] | Column


def is_fix_commit(message: Column, keywords: Sequence[str] = FIX_KEYWORDS) -> Column:
    """Whether the message contains a keyword, also inside a word; null messages do not."""
    pattern = "|".join(f"\\Q{word}\\E" for word in keywords)
    return F.coalesce(F.lower(message).rlike(pattern), F.lit(False))


def normalize_path(path: Column) -> Column:
    """Forward slashes only, case kept."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def history_path(path: Column) -> Column:
    """Key under which the history of a file is kept: forward slashes, lower case."""
    return F.lower(normalize_path(path))


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for dot files, trailing dots and plain names."""
    name = F.substring_index(path, "/", -1)
    end = F.substring_index(name, ".", -1)
    has_suffix = (F.length(end) > 0) & (F.length(name) - F.length(end) >= 2)
    return F.when(has_suffix, F.concat(F.lit("."), F.lower(end))).otherwise(F.when(path.isNotNull(), ""))


def file_is_relevant(path: Column, suffixes: Suffixes) -> Column:
    """Whether the suffix is in the set; the set may be a column of arrays. Null paths are not."""
    if isinstance(suffixes, Column):
        return F.coalesce(F.array_contains(suffixes, file_suffix(path)), F.lit(False))
    # One reference to the path, matched from its end; a bare suffix is a dot file, which has none.
    ends = "|".join(f"\\Q{suffix}\\E" for suffix in suffixes)
    return F.coalesce(path.rlike(rf"(?is)^.*[^/](?:{ends})\z"), F.lit(False))


def _given(path: Column) -> Column:
    return F.nullif(path, F.lit(""))


def changed_path(old_path: Column, new_path: Column) -> Column:
    """The path a change is recorded under: the new one, else the old one."""
    return normalize_path(F.coalesce(_given(new_path), _given(old_path)))


def directory(path: Column) -> Column:
    """Parent directory; null for files at the root."""
    name = F.substring_index(path, "/", -1)
    return _given(F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(name) - 1, F.lit(0))))


def subsystem(path: Column) -> Column:
    """First path component; a file at the root is its own subsystem."""
    return F.when(path.startswith("/"), F.lit("/")).otherwise(F.substring_index(path, "/", 1))


def author_key(name: Column, email: Column) -> Column:
    """Author name, else e-mail address, else 'unknown'."""
    return F.coalesce(_given(name), _given(email), F.lit("unknown"))


def patch_text(path: Column, patch: Column, source_code: Column) -> Column:
    """One file's part of a commit diff: a header line, then the patch, else the whole source."""
    body = F.coalesce(_given(patch), _given(source_code), F.lit(""))
    return F.concat(F.lit("--- "), path, F.lit("\n"), body)


def embedding_input(message: Column, diff: Column) -> Column:
    """Message and diff as one text; nulls count as empty."""
    empty = F.lit("")
    return F.concat(F.coalesce(message, empty), F.lit(TEXT_SEPARATOR), F.coalesce(diff, empty))


def blamed_commit(line: Column, id_length: int) -> Column:
    """Commit id of a blame header line; null for content lines (TAB first) and other headers."""
    token = F.split(F.trim(line), r"\s+")[0]
    return F.when(~line.startswith("\t") & (F.length(token) == id_length), token)
