"""License scan by diagonal voting, with DataFrame functions only.

All rolling word k-grams of all texts are joined, by hash, to the positions they have in license
templates. A template that occurs unbroken puts all its k-grams on one diagonal (position in the
text minus position in the template); an added or missing word moves the rest to a neighbouring
diagonal. Votes are counted per diagonal, neighbouring diagonals with overlapping places are
merged, and a merged span is verified: the words that agree must be in order, and cover enough of
the template.

Templates are a fixed list, so their side of the join is small and broadcast. A text is exploded
into its k-grams inside the task that reads it; only votes are shuffled, keyed by document,
template and place, so neither a long text nor a frequent phrase makes a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changerisk.llm.common import text_or_empty

#: Words of a gram: the shortest phrase has two.
K = 2

#: Phrases whose unbroken occurrences are the base of every scan (fixed values).
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further templates, found also with words added or missing (fixed values).
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "distributed under the boost software license version 1 0": "bsl",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights": "cc0",
    "subject to the terms of the common development and distribution license": "cddl",
    "you can redistribute it under the terms of the artistic license": "artistic",
}

#: Characters that separate words once A-Z are small; all others make words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Share of a template's grams that a verified span holds, and how far its diagonals may lie apart.
COVER = 0.7
DRIFT = 3


def words_of(text: Column) -> Column:
    """Words of a text after A-Z become small.

    Other capitals become small as well, which moves no word boundary and makes no template word.
    """
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda word: word != "")


def _template_grams(spark: SparkSession) -> DataFrame:
    """``gram, template, label, exact, grams, at``: all k-grams of the templates.

    Template -1 has one empty gram, which every text has once as well, so that each row of the
    input is in the result.
    """
    rows, number = [("", -1, "", False, 1, 0)], 0
    for exact, templates in ((True, BASE_PHRASES), (False, TEMPLATES)):
        for phrase, label in templates.items():
            words = phrase.split()
            last = len(words) - K + 1
            rows += [(" ".join(words[at : at + K]), number, label, exact, last, at) for at in range(last)]
            number += 1
    schema = "gram string, template int, label string, exact boolean, grams int, at int"
    return spark.createDataFrame(rows, schema).coalesce(1)


def _votes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each k-gram of a text that a template has, after hashes and then words agree."""
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), words_of(text_or_empty(text)).alias("words")
    )
    gram = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - K, F.lit(0))),
        lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(K)]),
    )
    rolling = F.when(F.size("words") >= K, gram).otherwise(F.array().cast("array<string>"))
    listed = words.select("row", "id", F.size("words").cast("bigint").alias("n_words"), F.concat(F.array(F.lit("")), rolling).alias("g"))
    grams = listed.select("row", "id", "n_words", F.posexplode("g").alias("pos", "gram"))
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    templates = _template_grams(docs.sparkSession).withColumn("hash", F.xxhash64("gram")).withColumnRenamed("gram", "own")
    return grams.join(F.broadcast(templates), "hash").filter("gram = own").drop("hash", "own", "gram")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, places, spans`` for every row of the input.

    ``places`` lists the unbroken base phrases (``start, label``), ``spans`` the verified spans of
    the longer templates (``start, words, label, cover``), both ordered. Null and empty texts have
    neither. Rows are told apart by their place in the input, so repeated and null ids have their
    own results.
    """
    kind = ["row", "template", "label", "exact", "grams"]
    votes = _votes(docs, key, text).repartition("row")
    # One line per diagonal; on one, a place in the template is one place in the text.
    diagonals = votes.withColumn("diagonal", F.col("pos") - 1 - F.col("at")).groupBy(*kind, "diagonal").agg(
        F.any_value("id").alias("id"),
        F.any_value("n_words").alias("n_words"),
        F.array_sort(F.collect_list("at")).alias("hits"),
    )
    place = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(place) > DRIFT, F.lit(False)) | F.col("exact")
    diagonals = diagonals.withColumn("apart", apart.cast("int"))
    diagonals = diagonals.withColumn("cluster", F.sum("apart").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    agreed = F.flatten(
        F.collect_list(
            F.transform("hits", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), at.alias("at")))
        )
    )
    spans = diagonals.groupBy(*kind, "cluster").agg(
        F.any_value("id").alias("id"), F.any_value("n_words").alias("n_words"), F.array_sort(agreed).alias("agreed")
    )
    # Verified: grams in the order of the template, counted along the text.
    step = lambda kept, hit: F.when(
        hit["at"] > kept["last"], F.struct(hit["at"].alias("last"), (kept["n"] + 1).alias("n"))
    ).otherwise(kept)
    in_order = F.aggregate("agreed", F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), step, lambda kept: kept["n"])
    spans = spans.withColumn("cover", in_order / F.col("grams"))
    start = F.col("agreed")[0]["pos"].cast("bigint")
    end = F.element_at("agreed", -1)["pos"].cast("bigint")
    whole = F.col("exact") & (F.col("cover") == 1)
    verified = ~F.col("exact") & (F.col("template") >= 0) & (F.col("cover") >= COVER)
    found = F.struct(
        start.alias("start"), (end - start + K).alias("words"), F.col("label").alias("label"), F.col("cover").alias("cover")
    )
    return spans.groupBy("row").agg(
        F.any_value("id").alias(key),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(whole, F.struct(start.alias("start"), F.col("label").alias("label"))))).alias("places"),
        F.array_sort(F.collect_list(F.when(verified, found))).alias("spans"),
    ).drop("row")


def license_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and labels of base phrases, all labels, and a score.

    The score is 1 where a base phrase stands, else the largest share of a template that a verified
    span covers, else 0. Of spans that overlap, those with the largest share give labels. Label lists are distinct, sorted and comma-joined; empty if there are none.
    """
    scan = license_scan(docs, key, text)
    starts = F.transform("places", lambda place: place["start"])
    base = F.transform("places", lambda place: place["label"])
    rival = lambda a, b: (
        (b["cover"] > a["cover"]) & (b["start"] < a["start"] + a["words"]) & (a["start"] < b["start"] + b["words"])
    )
    strongest = F.filter("spans", lambda a: ~F.exists("spans", lambda b: rival(a, b)))
    own = F.transform(strongest, lambda span: span["label"])
    best = F.greatest(F.array_max(F.transform("spans", lambda span: span["cover"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan.select(
        key,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
