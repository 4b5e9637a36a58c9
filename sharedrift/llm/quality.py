"""Quality rules with cross-document line frequency, in Spark expressions only.

Lines are normalised (words in lower case, one space between) and hashed.  For every host and line the distinct documents
that hold it are counted; copies of a text count as one document, known by the hash of the whole text, so that a
text which is merely copied keeps its lines.  Lines in more than ``LINE_LIMIT`` documents of a host are boilerplate and removed;
documents left with less than ``MIN_KEPT`` of their words are depleted and rejected, as are those that fail the base
rules (too few words, too many repeated ones).

Edge cases: a null text has no words and fails; a null source is a host of its own; rows that repeat id, source and text
give equal results, one each; other rows with the same id are kept apart; an empty table gives an empty result; other
columns are ignored by the measures and kept by ``kept_documents`` and ``cleaned_documents``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift.llm.common import SPACE, text_key, unwrapped, whole_row, words_of
from sharedrift.sources.tables import written_once

LINE_LIMIT = 10
MIN_KEPT = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
KEY = ["doc_id", "source", "_text"]


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words covered by three-word windows that occur more than once.

    Windows are sorted by hash with their places, so equal ones are neighbours; the places of repeated ones, sorted, cover
    three words each, less what the next one covers too.  Each array is a column of its own, made once per row.
    """
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 2), lambda i: F.struct(
        F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)).alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(F.col("n_words") >= 3, F.sort_array(windows)))
    rows = rows.withColumn("_same", F.zip_with(
        "_sorted", F.slice("_sorted", F.lit(2), F.size("_sorted")),
        lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    rows = rows.withColumn("_places", F.sort_array(F.array_compact(F.zip_with(
        F.zip_with("_same", F.concat(F.array(F.lit(False)), "_same"), lambda a, b: F.coalesce(a, F.lit(False)) | b),
        "_sorted", lambda twice, window: F.when(twice, window["i"])))))
    covered = F.aggregate(
        F.zip_with("_places", F.slice("_places", F.lit(2), F.size("_places")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_places") > 0, covered), F.lit(0).cast("long")))


def measures(docs: DataFrame) -> DataFrame:
    """The key and the base measures of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    rows = docs.select("doc_id", "source", "text", words_of(F.col("text")).alias("_words"), lines.alias("_lines"))
    rows = rows.select(
        "doc_id", "source", text_key(F.col("text")).alias("_text"), "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    return _with_repeats(rows.withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0).cast("long")))).drop(
        "_words", "_sorted", "_same", "_places")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_words(docs: DataFrame) -> DataFrame:
    """(key, line, n): every line with a word, its 128-bit hash, and its number of words."""
    split = docs.select(
        "doc_id", "source", text_key(F.col("text")).alias("_text"),
        F.explode(F.filter(F.transform(F.split("text", "\n"), _normal), lambda line: line != "")).alias("_line"))
    return split.select(*KEY, F.unhex(F.md5("_line")).alias("line"), (
        F.length("_line") - F.length(F.replace("_line", F.lit(" "))) + 1).alias("n"))


def boilerplate(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(source, line) of the lines that stand in more than ``limit`` distinct documents of their host.

    Repeats are merged in two steps, both with map-side sums, so a line that a third of all documents hold is no hot key.
    """
    once = lines.groupBy("source", "line", "_text").agg(F.lit(1).alias("one"))
    return once.groupBy("source", "line").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") > limit).drop("_docs")


def judge(docs: DataFrame, limit: int = LINE_LIMIT, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per document: the key, the measures, n_removed_words, base_failed and kept."""
    found = measures(docs).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.first(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    lines = written_once(line_words(docs))  # split and hashed once, for the counts and for the sums
    common = boilerplate(lines, limit)
    # the lines of a document are summed before they meet its measures
    removed = lines.alias("l").join(common.alias("c"), F.expr("l.source <=> c.source AND l.line = c.line"), "left_semi").groupBy(
        *KEY).agg(F.sum("n").alias("_removed"))
    joined = found.alias("d").join(
        removed.alias("r"), F.expr("d.doc_id <=> r.doc_id AND d.source <=> r.source AND d._text = r._text"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        "d.*", F.coalesce(F.col("_removed") / F.col("_copies"), F.lit(0)).cast("long").alias("n_removed_words")).withColumn(
            "base_failed", failed).withColumn(
                "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_kept * F.col("n_words")))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document, repeated rows repeated."""
    found = judge(docs)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop(
        "_copy", "_copies", "_text")


def _kept_rows(docs: DataFrame, limit: int) -> DataFrame:
    """The rows of documents that are kept, each whole in ``row``, with their keys.  Texts pass one shuffle, unsorted."""
    rejected = judge(docs, limit).filter("NOT kept").select(*KEY)
    rows = docs.select("doc_id", "source", text_key(F.col("text")).alias("_text"), whole_row(docs).alias("row"))
    return rows.alias("d").join(rejected.hint("shuffle_hash").alias("r"), F.expr(
        "d.doc_id <=> r.doc_id AND d.source <=> r.source AND d._text <=> r._text"), "left_anti")


def kept_documents(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """The rows of documents that are kept, with all their columns."""
    return unwrapped(_kept_rows(docs, limit), "row", docs.columns)


def cleaned_documents(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """The rows of documents that are kept, with all their columns, their texts without the boilerplate lines.

    Other lines stay as they are, in their order; a text without boilerplate is unchanged.
    """
    kept, common = _kept_rows(docs, limit), boilerplate(line_words(docs), limit)
    lines = kept.select(*KEY, F.col("row.text").alias("text")).dropDuplicates(KEY).select(
        *KEY, F.posexplode(F.split("text", "\n")).alias("at", "_own")).withColumn("line", F.unhex(F.md5(_normal(F.col("_own")))))
    left = lines.alias("l").join(common.alias("c"), F.expr("l.source <=> c.source AND l.line = c.line"), "left_anti").groupBy(
        *KEY).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("at", "_own"))), lambda x: x["_own"]), "\n").alias("cleaned"))
    joined = kept.alias("d").join(
        left.alias("r"), F.expr("d.doc_id <=> r.doc_id AND d.source <=> r.source AND d._text = r._text"), "left")
    # kept documents have words left, so each has lines
    return joined.select(*[F.col("cleaned").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
