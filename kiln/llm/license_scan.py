"""Licence scan by a trained paragraph classifier (operator 9).  DataFrame, SQL and Spark ML only.

Paragraphs stand between blank lines.  Their lines, and overlapping windows of WINDOW words over their
joined lines, are judged, so a notice of up to WINDOW / 2 words is seen whole however it is wrapped; a
paragraph has a row for each family that one of them confirms, or one row if none does.  Multinomial logistic regression with a lasso penalty on hashed word 1- and
2-grams names the licence family of a paragraph or calls it unknown.  Its features are the grams that the notices hold; others tell no
family.  It learns from notices
(TEMPLATES, whole, in halves and set among words of the corpus) and from every line of the corpus without
licence words but the quarter, by hash of its text, that is left out; lines of equal features are counted as one row with a weight, and together
they weigh UNKNOWN_WEIGHT rows, so that the notices count alike in a corpus of any size.  A family is accepted above the
probability that no left-out unknown line reaches (and 0.5 at least), and confirmed if
the paragraph holds CONFIRM of the word 3-grams of one of its notices.

Only paragraphs with a cue can be confirmed: of every notice less than CONFIRM of the 3-grams hold none of
CUES (a test counts them), so other paragraphs are left out without loss.

Null and empty texts have no paragraphs.  Repeated rows are scanned each.  Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kiln.llm.shared import stored

#: Public licence notices by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the BSD License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0": ["This work is dedicated to the public domain under the CC0 1.0 Universal License."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "Unauthorized copying of this file is prohibited. All rights reserved."],
}
_GAP = r"[\W_]+"
CUES = ("licen[sc]e", "copyright", f"rights{_GAP}reserved", "permission", "redistribut", f"public{_GAP}domain", "prohibited", "permitted",
        f"released{_GAP}under", "hereby", f"granted{_GAP}free", f"this{_GAP}software", f"associated{_GAP}documentation", f"free{_GAP}software",
        "gnu", "apache", "mozilla", f"creative{_GAP}commons", f"cc{_GAP}by", "cc0", f"without{_GAP}modification", f"binary{_GAP}forms", f"source{_GAP}code")
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
UNKNOWN_WEIGHT, FEATURES, CONFIRM, LASSO = 3000.0, 1 << 14, 0.6, 0.0005
_HAS_CUE = "(?i)(" + "|".join(CUES) + ")"
WINDOW = 48


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; version numbers stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{N}+(?:\.\p{N}+)+|[\p{L}\p{N}]+)"), F.lit(1))


def has_cue(text: Column) -> Column:
    """Whether ``text`` matches _HAS_CUE.  A cue is looked for only in texts that hold its literal parts, which is far cheaper."""
    def held(low: Column) -> Column:
        each = [reduce(and_, [low.contains(x.partition("[")[0]) for x in cue.split(_GAP)]) & text.rlike(f"(?i){cue}") for cue in CUES]
        return reduce(or_, each)
    return F.exists(F.array(F.lower(text)), held)


def grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def _notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string")


def notice_grams(spark: SparkSession) -> list[str]:
    """The distinct word 1- and 2-grams of all notices."""
    words = words_of(F.col("text"))
    rows = _notices(spark).select(F.explode(F.concat(words, grams(words, 2))).alias("g")).distinct().collect()
    return sorted(r["g"] for r in rows)


def _held_grams(rows: DataFrame, known: list[str]) -> DataFrame:
    """Adds the ``words`` of ``text``, and as ``grams`` the ``known`` grams that they hold, once each, sorted.

    The words are a column of their own: within the grams' expression they would be taken from the text anew for every gram.
    A pair can only be known if both its words are."""
    words = F.col("words")
    pairs = F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: p["a"].isin(known) & p["b"].isin(known))
    both = F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))
    held = F.concat(F.filter(words, lambda g: g.isin(known)), F.filter(both, lambda g: g.isin(known)))
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("grams", F.array_sort(F.array_distinct(held)))


def _vectors(rows: DataFrame) -> DataFrame:
    """Adds the sparse 0/1 ``features`` of ``grams``."""
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)


def paragraphs(docs: DataFrame, where: str | None = None) -> DataFrame:
    """(doc_id, paragraph, text) of the non-empty lines, of those that match ``where`` if given."""
    rows = docs.select("doc_id", "text")
    if where:
        rows = rows.where(F.col("text").rlike(where))
    rows = rows.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("paragraph", "text")).where(F.length(F.trim("text")) > 0)
    return rows.where(F.col("text").rlike(where)) if where else rows


def passages(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, text): the lines and windows with a cue word, by paragraph."""
    blocks = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(has_cue(F.col("text")))
              .select("row", "doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "text"))
              .where(has_cue(F.col("text"))))
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))    # without comment marks
    half = WINDOW // 2
    blocks = blocks.withColumn("tokens", tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("tokens") - WINDOW) / half).cast("int")))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("tokens", i * half + 1, WINDOW), " "))
    parts = F.array_distinct(F.concat(F.split("text", r"\n"), windows))
    return blocks.select("row", "doc_id", "paragraph", F.explode(parts).alias("text")).where(has_cue(F.col("text")))


def _training_rows(docs: DataFrame, known: list[str]) -> DataFrame:
    """(label, grams, weight, left_out): notices in several settings, and all corpus lines without a cue as unknown."""
    spark = docs.sparkSession
    notices = spark.createDataFrame([(float(FAMILIES.index(f)), t) for f, ts in TEMPLATES.items() for t in ts], "label double, text string")
    plain = paragraphs(docs).where(~has_cue(F.col("text")))
    left_out = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    counted = stored(_held_grams(plain.select("text", left_out.alias("left_out")), known)
                     .groupBy("grams", "left_out").agg(F.count("*").alias("n")), "unknown-lines")
    n = counted.where("not left_out").agg(F.sum("n")).first()[0] or 1
    # each notice among the first words of 32 corpus paragraphs
    fill = plain.where(~left_out).select("text", F.xxhash64("text").alias("key")).orderBy("key", "text").limit(32)
    fills = [r["fill"] for r in fill.select(F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("fill")).collect()] or [""]
    around = notices.withColumn("fill", F.explode(F.array(*[F.lit(x) for x in fills])))
    half = F.expr("array_join(slice(split(text, ' '), 1, greatest(4, cast(ceil(size(split(text, ' ')) * 0.7) as int))), ' ')")
    made = (notices.select("label", "text")
            .unionByName(around.select("label", F.concat_ws(" ", "fill", "text").alias("text")))
            .unionByName(around.select("label", F.concat_ws(" ", "text", "fill").alias("text")))
            .unionByName(notices.select("label", half.alias("text"))))
    bare = spark.createDataFrame([(0.0, x) for x in ("The license of this dog is lost.", "You need a driving licence.", "Permission was denied.",
                                                     "The rights of the people.", "A version of the general public.", "He was permitted to leave.")], "label double, text string")
    made = _held_grams(made.unionByName(bare), known).select("label", "grams", F.lit(1.0).alias("weight"), F.lit(False).alias("left_out"))
    return made.unionByName(counted.select(F.lit(0.0).alias("label"), "grams", (F.col("n") * (UNKNOWN_WEIGHT / n)).alias("weight"), "left_out"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of every paragraph with a cue
    word; a paragraph has several rows if several families are found in it.  ``family`` is ``unknown`` unless the classifier accepts one and a notice confirms it."""
    known = notice_grams(docs.sparkSession)
    rows = stored(_vectors(_training_rows(docs, known)).select("label", "features", "weight", "left_out"), "licence-training")
    model = LogisticRegression(family="multinomial", regParam=LASSO, elasticNetParam=1.0, maxIter=40, weightCol="weight").fit(rows.where("not left_out"))
    scored = model.transform(rows.where("left_out")).select(vector_to_array("probability").alias("p"))
    tops = scored.agg(*[F.max(F.element_at("p", i + 1)).alias(f"m{i}") for i in range(model.numClasses)]).first()
    bars = [max(0.5, tops[i] or 0.0) if i else 2.0 for i in range(model.numClasses)]

    found = _vectors(_held_grams(passages(docs), known))
    found = model.transform(found).withColumn("p", vector_to_array("probability"))
    bar = F.array(*[F.lit(float(b)) for b in bars])
    names = F.array(*[F.lit(f) for f in FAMILIES])
    found = found.withColumn("k", F.col("prediction").cast("int") + 1).withColumn("probability", F.element_at("p", F.col("k")))
    three = grams(F.col("words"), 3)
    kept = _notices(docs.sparkSession).select("family", F.array_distinct(grams(words_of(F.col("text")), 3)).alias("g")).collect()
    of = {f: [r["g"] for r in kept if r["family"] == f] for f in TEMPLATES}

    def held(gs: list[str]) -> Column:
        return F.size(F.array_intersect(F.col("three"), F.array(*[F.lit(g) for g in gs]))) / F.lit(float(len(gs)))

    similarity = F.lit(0.0)
    for i, f in enumerate(FAMILIES[1:], 2):
        scores = [held(gs) for gs in of[f] if gs]
        similarity = F.when(F.col("k") == i, F.greatest(*scores) if len(scores) > 1 else scores[0]).otherwise(similarity)
    found = found.withColumn("three", three).withColumn("similarity", similarity)
    sure = (F.col("probability") > F.element_at(bar, F.col("k"))) & (F.col("similarity") >= CONFIRM)
    found = found.select("row", "doc_id", "paragraph", F.when(sure, F.element_at(names, F.col("k"))).otherwise(UNKNOWN).alias("family"),
                         F.struct(sure.alias("confirmed"), "similarity", "probability").alias("best"))
    found = found.groupBy("row", "doc_id", "paragraph", "family").agg(F.max("best").alias("best"))
    any_sure = F.max("best.confirmed").over(Window.partitionBy("row", "paragraph"))
    return found.withColumn("any_sure", any_sure).where("best.confirmed or not any_sure").select(
        "doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family", "best.probability", "best.similarity", "best.confirmed")
