"""License scan by diagonal voting.

Every run of ``GRAM`` words of a text is joined, by its hash and then its words, with the places where it stands in the
templates.  A match at text position p and template position t votes for the diagonal p - t: a notice quoted word for word
puts all its votes on one diagonal.  Inserted or missing words move the votes to a neighbouring diagonal, so diagonals at
most ``SLACK`` apart are merged into one span, but for those that hold all of the template's runs: each is a span of its own,
so short notices that follow each other don't grow into one too long.  A span is verified if it holds enough of the template's runs within
about the template's length.  Short phrases are templates too, but need every run on one diagonal.

Votes, not texts, are shuffled: the template table is broadcast (its size is fixed by the argument), and each text also
sends one marker row, so documents without any match come out of the same single scan.

Edge cases: a null text is empty and has no labels; texts of any length are scanned whole; rows that repeat both id and text
give equal results, one each; rows that repeat only the id are kept apart; an empty table gives an empty result; other
columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharedrift.llm.common import text_key
from sharedrift.sources.tables import written_once

# --- fixed values: what marks a license -----------------------------------------------------------------------------
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either"
              " version 3 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
)
# --- end of fixed values --------------------------------------------------------------------------------------------
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
SLACK = 3
MIN_COVERAGE = 0.75
MAX_STRETCH = 1.5


def license_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _grams(words: str) -> Column:
    """All runs of GRAM words, in order of their place."""
    last = F.size(words) - GRAM
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, GRAM), " "))).otherwise(
            F.array().cast("array<string>"))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, exact, n_grams, at, gram): the places of all runs of the templates."""
    rows = [(n, label, n < len(phrases), text) for n, (label, text) in enumerate([*phrases, *notices])]
    if any(len(text.split()) < GRAM for _, _, _, text in rows):
        raise ValueError(f"a template needs {GRAM} words")
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, text string")
    return table.withColumn("_words", F.split("text", " ")).withColumn("_grams", _grams("_words")).select(
        "template", "label", "exact", F.size("_grams").alias("n_grams"), F.posexplode("_grams").alias("at", "gram"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document and span found: doc_id, _text, template, label, exact, start, end, coverage; and one marker row
    per distinct document (template null) with n_words and copies."""
    known = templates(docs.sparkSession, phrases, notices).withColumn("_hash", F.xxhash64("gram"))
    marker = known.limit(1).select(
        *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns if c != "_hash"],
        F.lit(0).cast("long").alias("_hash"))
    worded = docs.select("doc_id", text_key(F.col("text")).alias("_text"), license_words(F.col("text")).alias("_words"))
    # the run without a gram is the marker; it stands behind the last one
    runs = worded.select(
        "doc_id", "_text", F.size("_words").alias("n_words"),
        F.posexplode(F.concat(_grams("_words"), F.array(F.lit(None).cast("string")))).alias("place", "_gram"),
    ).withColumn("_hash", F.when(F.col("_gram").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("_gram")))
    matches = runs.join(F.broadcast(known.union(marker)), "_hash").filter(F.col("_gram").eqNullSafe(F.col("gram")))
    votes = written_once(matches.groupBy(
        "doc_id", "_text", "n_words", "template", "label", "exact", "n_grams",
        (F.col("place") - F.coalesce("at", "place")).alias("diagonal"),
    ).agg(
        F.count_distinct("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"),
        F.count(F.lit(1)).alias("copies")))
    whole = votes.filter("votes = n_grams").select(
        "doc_id", "_text", "template", "label", "exact", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("n_grams") + GRAM - 1).alias("end"), F.lit(1.0).alias("coverage"),
        F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"))
    along = Window.partitionBy("doc_id", "_text", "template").orderBy("diagonal")
    merged = votes.filter("NOT exact AND votes < n_grams").withColumn(
        "_new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True)).cast("int"),
    ).withColumn("_span", F.sum("_new").over(along)).groupBy(
        "doc_id", "_text", "template", "label", "exact", "n_grams", "_span",
    ).agg(F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + GRAM).alias("end"))
    verified = merged.withColumn("coverage", F.least(F.col("votes") / F.col("n_grams"), F.lit(1.0))).filter(
        (F.col("coverage") >= MIN_COVERAGE)
        & (F.col("end") - F.col("start") <= (F.col("n_grams") + GRAM - 1) * MAX_STRETCH)).select(
            "doc_id", "_text", "template", "label", "exact", "start", "end", "coverage",
            F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"))
    markers = votes.filter("template IS NULL").select(
        "doc_id", "_text", "template", "label", "exact", F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"), F.lit(None).cast("double").alias("coverage"), "n_words", "copies")
    return whole.unionByName(verified).unionByName(markers)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, phrase places (n_base, first_word, last_word, base_labels), labels, score."""
    def joined(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    exact = F.coalesce("exact", F.lit(False))
    found = scan(docs).groupBy("doc_id", "_text").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("copies").alias("_copies"),
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        joined(exact).alias("base_labels"), joined(F.lit(True)).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop(
        "_copy", "_copies", "_text")
