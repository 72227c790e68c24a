"""Row predicates, paths, texts, joins and set operations."""

from pyspark.sql import functions as F

from changerisk.fixed_values import FILES_PER_FIX
from changerisk.functions import text
from changerisk.functions.vectors import expand_embedding, vector_norm
from changerisk.operators import clean, fusion, joins, labels, models, sampling
from changerisk.operators.blame import label_by_replay, replay_blame
from changerisk.operators.history import commit_diff_text, diff_chunks, plain_diff_text, recent_n_commits
from changerisk.operators.ordering import prior_in_key
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import (
    HISTORY,
    LABELLED_ORDERS,
    SUFFIXES,
    change_history,
    commits,
    file_changes,
    labelled_orders,
    scored_orders,
)


@query(
    "filter_years",
    f"SELECT commit_id, year(author_date) AS year FROM ({LABELLED_ORDERS}) WHERE year(author_date) BETWEEN 1996 AND 2000",
)
def filter_years(t):
    kept = sampling.filter_years(labelled_orders(t), first=1996, last=2000)
    return kept.select("commit_id", F.year("author_date").cast("bigint").alias("year"))


def documents_with_labels(t):
    return t.documents.join(t.labels, "doc_id", "left")


@query("drop_missing_target", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing_target(t):
    return clean.drop_missing_target(documents_with_labels(t), "quality").select("doc_id", "lang", "quality")


@query("select_features", f"SELECT commit_id, project, buggy, CAST(epoch(author_date) AS BIGINT) AS epoch FROM ({LABELLED_ORDERS})")
def select_features(t):
    df = labelled_orders(t).withColumn("epoch", F.unix_timestamp(F.col("author_date").cast("timestamp")))
    return clean.select_features(df, ["epoch", "project"], keep=["commit_id"])


@query(
    "is_fix_commit",
    "SELECT event_id, event_type, regexp_matches(lower(event_type), 'fix|bug|error|issue|patch|resolve|hotfix') AS is_fix FROM events",
)
def is_fix_commit(t):
    return t.events.select("event_id", "event_type", text.is_fix_commit(F.col("event_type")).alias("is_fix"))


@query("label_fix", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fix FROM events")
def label_fix(t):
    return labels.label_fix(t.events, "event_type").select("event_id", "fix")


@query("label_initial", HISTORY + """
    SELECT commit_id, CASE WHEN message = 'new' THEN 0 ELSE 1 END AS fix, CASE WHEN message = 'new' THEN 0 ELSE 1 END AS buggy
    FROM commits""")
def label_initial(t):
    return labels.label_initial(commits(t)).select("commit_id", "fix", "buggy")


@query(
    "file_is_relevant",
    r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1)) IN ('.html', '.com') AS relevant
        FROM pages""",
)
def file_is_relevant(t):
    return t.pages.select("page_id", text.file_is_relevant(F.col("url"), (".html", ".com")).alias("relevant"))


@query("relevant_path", HISTORY + "SELECT DISTINCT commit_id, relevant FROM paths WHERE relevant IS NOT NULL")
def relevant_path(t):
    return change_history(t).relevant_files().select("commit_id", "relevant")


@query("commit_filter", HISTORY + "SELECT DISTINCT commit_id FROM paths WHERE relevant IS NOT NULL")
def commit_filter(t):
    return change_history(t).commit_filter()


@query("recent_n_commits", HISTORY + """
    SELECT project, commit_id FROM commits
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY author_date DESC, commit_id DESC) <= 2000""")
def recent_n(t):
    return recent_n_commits(commits(t), 2000).select("project", "commit_id")


@query("head_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def head_sample(t):
    return sampling.head_sample(t.orders, "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("skip_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 1100")
def skip_tail(t):
    return sampling.skip_tail(t.orders, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("merge_on_key", "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def merge_on_key(t):
    return joins.merge_on_key(t.documents.drop("text"), t.labels, "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic")


@query("semi_commits", f"""
    SELECT commit_id, project, buggy FROM ({LABELLED_ORDERS}) c
    WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
                  WHERE l_returnflag = 'R' AND o.o_orderkey = c.commit_id AND o.o_orderpriority = c.project)""")
def semi_commits(t):
    traversed = labelled_orders(t).drop("author_date")
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("commit_id"))
    listed = joins.merge_on_key(returned, traversed.select("project", "commit_id"))
    return joins.semi_commits(traversed, listed).select("commit_id", "project", "buggy")


@query("pending_rows", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(t):
    return joins.pending_rows(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


def _fix_changes(t):
    fixes = labels.label_fix(commits(t)).filter("fix = 1").select(F.col("commit_id").alias("fix_commit_id"))
    changed = file_changes(t).select(
        F.col("commit_id").alias("fix_commit_id"), F.col("ordinal").alias("file_ordinal"), F.col("new_path").alias("file_path")
    )
    return changed.join(fixes, "fix_commit_id", "left_semi")


@query("szz_candidates", HISTORY + """
    SELECT commit_id AS fix_commit_id, ordinal AS file_ordinal, changed AS file_path FROM paths
    WHERE message <> 'new' AND counted
    QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ordinal, changed) <= 21""")
def szz_candidates(t):
    return labels.szz_candidates(_fix_changes(t), SUFFIXES, FILES_PER_FIX)


@query("szz_blamed", """
    SELECT DISTINCT sha1(CAST(l_orderkey AS VARCHAR)) AS commit_id FROM lineitem WHERE l_linestatus = 'F'""")
def szz_blamed(t):
    sha = F.sha1(F.col("l_orderkey").cast("string"))
    other = F.sha1(F.col("l_partkey").cast("string"))
    number = F.col("l_linenumber").cast("string")
    lines = F.array(
        F.when(F.col("l_linestatus") == "F", F.concat_ws(" ", sha, number, number, F.lit("1"))),
        F.lit("author-mail <someone@example.com>"),
        F.concat(F.lit("previous "), other, F.lit(" a.py")),
        F.concat(F.lit("\t"), other, F.lit(" in a content line")),
    )
    return labels.szz_blamed(t.lineitem.select(F.explode(lines).alias("line")).filter("line is not null"))


@query("label_by_blame", HISTORY + """,
    fixes AS (SELECT commit_id FROM commits WHERE message <> 'new' AND commit_id % 5 <> 0),
    candidates AS (SELECT DISTINCT commit_id, changed FROM paths WHERE counted AND commit_id IN (SELECT commit_id FROM fixes)),
    blamed AS (SELECT sha1(CAST(commit_id % 977 AS VARCHAR)) AS id FROM candidates WHERE changed NOT LIKE '%7.py')
    SELECT sha1(CAST(commit_id AS VARCHAR)) AS commit_id, CASE WHEN message <> 'new' THEN 1 ELSE 0 END AS fix,
           CASE WHEN sha1(CAST(commit_id AS VARCHAR)) IN (SELECT id FROM blamed) THEN 1 ELSE 0 END AS buggy
    FROM commits""")
def label_by_blame(t):
    sha = lambda column: F.sha1(F.col(column).cast("string"))
    log = commits(t).withColumn("parents", F.when(F.col("commit_id") % 5 == 0, 0).otherwise(1))
    log = log.withColumn("commit_id", sha("commit_id"))
    changed = file_changes(t).select(
        F.col("commit_id").alias("number"), F.col("ordinal").alias("file_ordinal"), F.col("new_path").alias("file_path")
    )
    changed = changed.withColumn("fix_commit_id", sha("number"))
    # Each file's blame names one commit; of some files only content lines are left.
    named = F.concat_ws(" ", F.sha1((F.col("number") % 977).cast("string")), F.lit("1 1 1"))
    line = F.when(F.col("file_path").endswith("7.py"), F.concat(F.lit("\t"), named)).otherwise(named)
    blame = changed.select("fix_commit_id", "file_path", line.alias("line"))
    labelled = labels.label_by_blame(log, changed.drop("number"), blame, SUFFIXES)
    return labelled.select("commit_id", "fix", "buggy")


#: Each order adds lines on top of its suppliers' files, and every fifth ends them.
REPLAYED = """
    WITH touched AS (
        SELECT l_suppkey AS file, l_orderkey AS commit_id, CAST(sum(l_quantity) AS BIGINT) AS added,
               l_orderkey % 5 = 0 AS ended
        FROM lineitem GROUP BY ALL),
    spans AS (SELECT *, sum(CAST(ended AS INT)) OVER (PARTITION BY file ORDER BY commit_id) AS life FROM touched),
    lives AS (SELECT *, CASE WHEN ended THEN life - 1 ELSE life END AS seen FROM spans),
    owners AS (
        SELECT a.file, a.commit_id, b.commit_id AS blamed, b.added AS lines
        FROM lives a JOIN lives b ON a.file = b.file AND a.seen = b.life AND b.commit_id < a.commit_id AND NOT b.ended)"""


def _patched_files(t):
    file = F.concat(F.lit("part/"), F.col("l_suppkey").cast("string"), F.lit(".py"))
    touched = t.lineitem.groupBy(file.alias("file"), F.col("l_orderkey").alias("commit_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("added")
    )
    added = F.col("added").cast("string")
    patch = F.concat(F.lit("@@ -0,0 +1,"), added, F.lit(" @@"), F.repeat(F.lit("\n+x"), F.col("added").cast("int")))
    return touched.select(
        F.lit("p").alias("project"), "commit_id", F.col("commit_id").alias("seq"), F.lit(0).alias("ordinal"),
        F.col("file").alias("old_path"), F.when(F.col("commit_id") % 5 != 0, F.col("file")).alias("new_path"),
        F.when(F.col("commit_id") % 5 != 0, patch).alias("patch"), F.lit("").alias("source_code"),
    )


@query("replay_blame", REPLAYED + """
    SELECT commit_id, 'part/' || CAST(file AS VARCHAR) || '.py' AS file_path, blamed, lines FROM owners""")
def replayed(t):
    return replay_blame(_patched_files(t)).drop("project")


@query("label_by_replay", REPLAYED + """
    SELECT o_orderkey AS commit_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fix,
           CASE WHEN o_orderkey IN (SELECT blamed FROM owners JOIN orders f ON f.o_orderkey = owners.commit_id
                                    WHERE f.o_orderstatus = 'F') THEN 1 ELSE 0 END AS buggy
    FROM orders""")
def labels_of_replay(t):
    message = F.when(F.col("o_orderstatus") == "F", "fix it").otherwise("add")
    log = t.orders.select(F.lit("p").alias("project"), F.col("o_orderkey").alias("commit_id"), message.alias("message"))
    return label_by_replay(log, _patched_files(t), SUFFIXES).select("commit_id", "fix", "buggy")


@query("szz_label", HISTORY + """,
    touched AS (SELECT DISTINCT project, changed, commit_id, pos, message FROM paths WHERE counted),
    blamed AS (
        SELECT message, lag(commit_id) OVER (PARTITION BY project, changed ORDER BY pos) AS earlier FROM touched)
    SELECT commit_id, CASE WHEN commit_id IN (SELECT earlier FROM blamed WHERE message <> 'new' AND earlier IS NOT NULL)
                           THEN 1 ELSE 0 END AS buggy
    FROM commits""")
def szz_label(t):
    history = change_history(t)
    log = labels.label_fix(commits(t))
    positions, span = history.positions()
    changed = text.changed_path(F.col("old_path"), F.col("new_path"))
    touched = (
        history.changes.select("commit_id", changed.alias("file"))
        .filter(text.file_is_relevant(F.col("file"), SUFFIXES)).distinct()
        .join(positions.hint("merge"), "commit_id").withColumn("one", F.lit(1))
    )
    before = prior_in_key(touched, ["project", "file"], "one", "commit_id", span=span)
    fixes = log.filter("fix = 1").select("commit_id")
    blamed = before.join(fixes, "commit_id", "left_semi").filter("prior_last is not null")
    blamed = blamed.select(F.col("prior_last").alias("commit_id"))
    return labels.szz_label(log, blamed).select("commit_id", "buggy")


@query("predictions_join", """
    SELECT o_orderkey AS commit_id, o_orderpriority AS project, CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, round(o_totalprice / 500000.0::DOUBLE, 4) AS score
    FROM orders""")
def predictions_join(t):
    meta = labelled_orders(t).withColumn("epoch", F.unix_timestamp(F.col("author_date").cast("timestamp")))
    joined = models.predictions_join(scored_orders(t), meta.drop("author_date", "buggy"))
    return joined.select("commit_id", "project", "epoch", "label", F.round("score", 4).alias("score"))


@query("fuse_features", HISTORY + """
    SELECT commit_id, la, nf, o_custkey AS customer, round(o_totalprice, 2) AS price, aexp
    FROM size JOIN orders ON o_orderkey = commit_id JOIN author_history USING (commit_id)""")
def fuse_features(t):
    history = change_history(t)
    orders = t.orders.select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("customer"), F.round("o_totalprice", 2).alias("price")
    )
    return fusion.fuse_features(
        [
            history.change_metrics().select("commit_id", "la", "nf"),
            orders,
            history.author_experience().select("commit_id", "aexp"),
        ]
    )


@query("union_datasets", f"SELECT commit_id, project, buggy FROM ({LABELLED_ORDERS}) UNION ALL SELECT event_id, event_type, 0 FROM events")
def union_datasets(t):
    orders = labelled_orders(t).select("commit_id", "project", "buggy")
    events = t.events.select(F.col("event_id").alias("commit_id"), F.col("event_type").alias("project"), F.lit(0).alias("buggy"))
    return joins.union_datasets(orders.filter("buggy = 1"), orders.filter("buggy = 0"), events)


@query("distinct_projects", "SELECT DISTINCT o_orderpriority AS project FROM orders")
def distinct_projects(t):
    return joins.distinct_projects(labelled_orders(t))


@query("dedupe_by_key", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity) = 1""")
def dedupe_by_key(t):
    lines = t.lineitem.select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return clean.dedupe_by_key(lines, "l_orderkey", ["l_shipdate"]).drop("l_shipdate")


@query("dedupe_keep_none", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1""")
def dedupe_keep_none(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return clean.dedupe_by_key(lines, "l_orderkey", keep=False)


@query("duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents")
def duplicate_rows(t):
    return joins.duplicate_rows(t.documents.select("text", "lang"))


@query("normalize_path", "SELECT page_id, url AS path, lower(url) AS history_key FROM pages")
def normalize_path(t):
    windows = F.translate("url", "/", "\\")
    return t.pages.select(
        "page_id", text.normalize_path(windows).alias("path"), text.history_path(windows).alias("history_key")
    )


@query("commit_diff_text", HISTORY + r"""
    SELECT commit_id, string_agg('--- ' || changed || chr(10) || patch, chr(10) || chr(10) ORDER BY ordinal, changed, patch) AS diff
    FROM paths WHERE counted GROUP BY commit_id""")
def commit_diff(t):
    history = change_history(t)
    return commit_diff_text(history.changes, SUFFIXES).select("commit_id", "diff")


def _turns_as_changes(t):
    return t.conversations.select(
        "conv_id", F.col("turn").alias("ordinal"), F.col("role").alias("new_path"), F.col("text").alias("patch")
    )


@query("plain_diff_text", "SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, ''))) AS diff_md5 FROM conversations GROUP BY conv_id")
def plain_diff(t):
    return plain_diff_text(_turns_as_changes(t), ["conv_id"]).select("conv_id", F.md5("diff").alias("diff_md5"))


@query("diff_chunks", """
    WITH parts AS (
        SELECT conv_id, row_number() OVER turns AS n,
               CASE WHEN row_number() OVER turns = 1 THEN '' ELSE chr(10) END || coalesce(text, '') AS part
        FROM conversations WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, '')))),
    placed AS (
        SELECT *, coalesce(sum(length(part)) OVER before, 0) AS first_char,
               coalesce(sum(greatest(1, (length(part) + 99) // 100)) OVER before, 0) AS first_chunk
        FROM parts WINDOW before AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pieces AS (SELECT *, unnest(generate_series(0, greatest(1, (length(part) + 99) // 100) - 1)) AS i FROM placed)
    SELECT conv_id, CAST(first_chunk + i AS BIGINT) AS chunk, CAST(first_char + 100 * i AS BIGINT) AS start,
           substr(part, CAST(100 * i + 1 AS BIGINT), 100) AS text
    FROM pieces""")
def chunked_diff(t):
    return diff_chunks(_turns_as_changes(t), ["conv_id"], chunk_chars=100)


@query("embedding_input", """
    SELECT doc_id, md5(CASE WHEN lang = 'en' THEN '' ELSE lang END || ' [SEP] ' || text) AS input_md5 FROM documents""")
def embedding_input(t):
    message = F.when(F.col("lang") != "en", F.col("lang"))
    return t.documents.select("doc_id", F.md5(text.embedding_input(message, F.col("text"))).alias("input_md5"))


@query("expand_embedding", "SELECT vec_id, " + ", ".join(
    f"round(embedding[{i}]::DOUBLE, 6) AS pca_{i}" for i in range(1, 65)) + " FROM embeddings")
def expand(t):
    wide = expand_embedding(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    return wide.select("vec_id", *[F.round(c, 6).alias(c) for c in wide.columns if c != "vec_id"])


@query("vector_norm", """
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings""")
def norm(t):
    return t.embeddings.select("vec_id", F.round(vector_norm(F.col("embedding")), 4).alias("norm"))


