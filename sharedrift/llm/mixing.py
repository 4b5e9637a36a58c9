"""Mixing sources to target weights with a low-discrepancy schedule, in Spark expressions only.

The mix is a sequence of slots, each of ``block_words`` words (the last of a source may be shorter).  A source owns as many
neighbouring cells of the unit interval as its target has blocks; slot n stands at the n-th van der Corput point and
belongs to the source in whose cumulative stretch the point falls, so every stretch of the sequence holds the sources
in their target proportions.  Ranking the slots of a source numbers its blocks; documents, shuffled by a hash and laid end
to end (over and over, if the target exceeds the source), are cut into blocks of the same size, and slots and blocks are
joined by (source, number).

Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows
are separate documents; with no words at all every target is 0; an empty table gives an empty result; columns with other
names are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharedrift.llm.common import WORD
from sharedrift.sources.tables import written_once

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MAX_EPOCHS = 3  # a target stops at this many times its source's size
BLOCK_WORDS = 1024
SEED = 11
SHUFFLE_GROUP = 4096  # documents ordered by one task; groups are ranges of the shuffling hash
SLOT_GROUP = 65536  # slots ranked by one task


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in("text").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: weight, source_size, n_docs, target.

    Targets share the sum of all sizes by weight, capped at ``epochs`` times the source's size with the excess reshared.
    Sources reach their cap in order of cap over weight, so the fixed point is a prefix sum over the source rows.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights)) + 1)
    filling = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast(
        "double") / F.sum("weight").over(from_here)
    capped = F.col("_cap") <= F.col("_level") * F.col("weight")
    # the level at which the first source stays below its cap holds for all after it
    shared = F.min(F.when(~capped, F.struct("_turn", "_level"))).over(Window.partitionBy())["_level"]
    return (
        by_source.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * epochs)
        .withColumns({"_level": level, "_turn": F.row_number().over(filling)})
        .withColumn("_shared", shared)
        .withColumn("target", F.when(
            F.col("_shared").isNull() | (F.col("_cap") <= F.col("_shared") * F.col("weight")), F.col("_cap").cast("double"))
            .otherwise(F.col("_shared") * F.col("weight")))
        .select("source", "weight", "source_size", "n_docs", "target")
    )


def _reverse_bits(n: Column, bits: Column) -> Column:
    """The van der Corput point of n in base 2, as an integer out of 2^bits."""
    return F.reverse(F.lpad(F.bin(n), bits, "0"))


def schedule(wanted: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots: (slot, source, rank, words).  ``wanted`` has source and target.

    Cell j of the cumulative weights is visited at the n for which the reversed bits of n are j, so every cell is visited
    once and a source gets exactly the blocks of its target.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cells = wanted.withColumn("_words", F.round("target").cast("long")).withColumn(
        "_blocks", F.ceil(F.col("_words") / block_words)).withColumns({
            "_first": F.sum("_blocks").over(ordered) - F.col("_blocks"),
            "_bits": F.length(F.bin(F.sum("_blocks").over(Window.partitionBy()))),
        }).filter("_blocks > 0")
    # a source's cells are listed in chunks first, so a source with most of the cells is not listed by one task
    chunks = cells.withColumn("_from", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("_blocks") - 1, F.lit(SLOT_GROUP).cast("long")))).repartition("source", "_from")
    slots = chunks.withColumn("_cell", F.explode(F.sequence(
        F.col("_first") + F.col("_from"),
        F.col("_first") + F.least(F.col("_from") + SLOT_GROUP, F.col("_blocks")) - 1))).select(
            "source", "_words", "_blocks",
            F.conv(_reverse_bits(F.col("_cell"), F.col("_bits")), 2, 10).cast("long").alias("slot"),
        ).withColumn("_group", F.floor(F.col("slot") / SLOT_GROUP))
    # rank within the source: slots in earlier groups, then order within the group
    counts = slots.groupBy("source", "_group").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_group")) - F.col("_n")).drop("_n")
    # slots are listed from a few source rows, so their estimated size is far too small: joins with them are never broadcast
    ranked = slots.hint("merge").alias("s").join(counts.hint("merge").alias("c"), F.expr("s.source <=> c.source AND s._group = c._group")).select(
        "s.*", "_before").withColumn("rank", F.col("_before") + F.row_number().over(
            Window.partitionBy("source", "_group").orderBy("slot")) - 1)
    return ranked.select("slot", "source", "rank", F.least(
        F.lit(block_words), F.col("_words") - F.col("rank") * block_words).alias("words"))


def shuffled(sized: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents with words, and the place of their first word in their source's shuffled order (``_at``)."""
    spread = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / SHUFFLE_GROUP))).cast("int")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = sized.filter("size > 0").alias("d").join(wanted.alias("w"), F.expr("d.source <=> w.source")).select(
        "d.*", "w.source_size", "w.target", order.alias("_order"),
        F.expr("shiftrightunsigned(xxhash64({0}, d.doc_id), 1)".format(seed)).alias("_key"), spread.alias("_spread"),
    ).withColumn("_group", F.expr("shiftright(_key, 63 - _spread)"))
    starts = docs.groupBy("source", "_group").agg(F.sum("size").alias("_n")).withColumn(
        "_start", F.sum("_n").over(Window.partitionBy("source").orderBy("_group")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("source", "_group").orderBy("_key", "_order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    return docs.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source AND d._group = s._group")).select(
        "d.*", "_start").withColumn("_at", F.col("_start") + F.sum("size").over(within) - F.col("size")).select(
            "doc_id", "source", "size", "source_size", "target", "_at")


def blocks(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pieces of documents by block: (source, block, doc_id, _at, first word in the block, words)."""
    words = F.round("target").cast("long")
    passes = placed.withColumn("_epoch", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((words - 1) / F.col("source_size"))))).filter(words > 0).withColumn(
            "_from", F.col("_epoch") * F.col("source_size") + F.col("_at")).filter(F.col("_from") < words)
    cut = passes.withColumn("_to", F.col("_from") + F.col("size")).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words))))
    first = F.greatest(F.col("_from") - F.col("block") * block_words, F.lit(0))
    return cut.select(
        "source", "block", "doc_id", "_at", "size", first.alias("_first"),
        (F.least(F.col("_to") - F.col("block") * block_words, F.lit(block_words)) - first).alias("_n"))


def mix(sized: DataFrame, wanted: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix: (slot, source, doc_id, size, _at, taken), a row per slot and document piece; ``taken`` words of it."""
    slots, cut = schedule(wanted, block_words), blocks(shuffled(sized, wanted, seed), block_words)
    taken = F.least(F.col("_n"), F.col("words") - F.col("_first"))
    return slots.hint("merge").alias("s").join(cut.alias("b"), F.expr("s.source <=> b.source AND s.rank = b.block")).select(
        "s.slot", "s.source", "b.doc_id", "b.size", "b._at", taken.alias("taken")).filter("taken > 0")


def taken_by_document(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sized = written_once(sizes(docs))
    wanted = written_once(targets(sized))
    # a document with words is known by its place in its source
    taken = mix(sized, wanted).groupBy("source", "_at").agg(F.sum("taken").alias("taken"))
    placed = shuffled(sized, wanted).alias("p").join(
        taken.alias("t"), F.expr("p.source <=> t.source AND p._at = t._at"), "left").select(
            "p.doc_id", "p.source", "p.size", "p.source_size", "p.target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    empty = sized.filter("size = 0").alias("d").join(wanted.alias("w"), F.expr("d.source <=> w.source")).select(
        "d.doc_id", "d.source", "d.size", "w.source_size", "w.target", F.lit(0).cast("long").alias("taken"))
    return placed.unionByName(empty)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents, each as often as the mix takes it in whole or in part.

    Rows are known by id, source and text size; rows alike in all three share out what the mix takes of them.
    """
    key = ["doc_id", "source", "size"]
    passes = F.ceil(F.col("taken") / F.col("size"))
    taken = taken_by_document(docs).filter("taken > 0").groupBy(*key).agg(F.sort_array(
        F.collect_list(passes), asc=False).alias("_passes"))
    named = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        words_in("text").alias("_size"))
    joined = named.join(taken, (
        F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))))
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(F.md5("_doc.text"))
    return joined.withColumn("_times", F.get("_passes", F.row_number().over(alike) - 1)).filter("_times > 0").withColumn(
        "_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")
