"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbouring turns of one role become one run; runs
are concatenated.  Template of a run, with its turns' texts between separators:

    <s>[ROLE]user[/ROLE]first text[NEXT]second text</s>

Control strings inside roles and texts are escaped (``<`` as ``&lt;``, ``[`` as ``&lsqb;``, and an ``&`` that would read as
one of these as ``&amp;``), so the template's own marks are the only ones in the output, and reading back is exact.

Edge cases: a null text or role is empty; null conversation ids form one conversation; null turns sort first; rows with
the same turn are ordered by role and text, and repeated rows stay repeated; an empty table gives an empty result; columns
beyond the four named ones are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: control strings of this and other common chat templates -----------------------------------------
OPEN, CLOSE, ROLE, END_ROLE, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]"
CONTROLS = (OPEN, CLOSE, ROLE, END_ROLE, NEXT, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
# --- end of fixed values --------------------------------------------------------------------------------------------
ENTITIES = (("&amp;", "&amp;amp;"), ("&lt;", "&amp;lt;"), ("&lsqb;", "&amp;lsqb;"))
ESCAPES = ENTITIES + tuple((c, c.replace("<", "&lt;").replace("[", "&lsqb;")) for c in CONTROLS)


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "&lt;"), ("[", "&lsqb;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and its loss mask, ``loss_spans``: (first byte, bytes) of every text of
    the trained role, in order, as offsets into the UTF-8 form of ``formatted``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    collected = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("_t")).groupBy(
        "conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    # runs of one role: where each starts, then the slice up to the next start
    size = F.size("_turns")
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.col("_turns")[i]["role"] != F.col("_turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    runs = collected.withColumn("_starts", starts).withColumn("_ends", F.concat(
        F.slice("_starts", F.lit(2), F.size("_starts")), F.array(size))).withColumn("_runs", F.zip_with(
            "_starts", "_ends", lambda a, b: F.struct(
                F.col("_turns")[a]["role"].alias("role"),
                F.transform(F.slice("_turns", a + 1, b - a), lambda t: t["text"]).alias("texts"))))
    # pieces of the output, in order; a piece under the loss mask is one text of the trained role
    pieces = F.flatten(F.transform("_runs", lambda r: F.concat(
        F.array(F.struct(
            F.concat(F.lit(OPEN + ROLE), escape(r["role"]), F.lit(END_ROLE)).alias("s"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(r["texts"], lambda t, i: F.array(
            F.struct(F.when(i > 0, F.lit(NEXT)).otherwise("").alias("s"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("s"), (r["role"] == trained_role).alias("loss"))))),
        F.array(F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("loss"))))))
    pieced = runs.select("conv_id", pieces.alias("_pieces"))
    # spans chunk by chunk: a list that grows turn by turn is copied each time, so it must not be the whole conversation
    width = F.ceil(F.sqrt(F.size("_pieces"))).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(1), F.size("_pieces"), width), lambda first: F.slice("_pieces", first, width))
    chunked = pieced.withColumn("_chunks", chunks).withColumn("_sizes", F.transform("_chunks", lambda chunk: F.aggregate(
        chunk, F.lit(0).cast("long"), lambda total, p: total + F.octet_length(p["s"]))))
    starts_at = F.aggregate(
        "_sizes", _walk(F.lit(0).cast("long"), "array<long>"),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")),
        lambda acc: acc["found"])
    spans = F.flatten(F.zip_with("_chunks", "_starts_at", lambda chunk, at: F.aggregate(
        chunk, _walk(at, "array<struct<start:long,n:long>>"),
        lambda acc, p: F.struct(
            (acc["at"] + F.octet_length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["found"], F.array(F.struct(
                acc["at"].alias("start"), F.octet_length(p["s"]).cast("long").alias("n"))))).otherwise(
                    acc["found"]).alias("found")),
        lambda acc: acc["found"])))
    return chunked.withColumn("_starts_at", starts_at).select(
        "conv_id", F.array_join(F.transform("_pieces", lambda p: p["s"]), "").alias("formatted"),
        spans.alias("loss_spans"))


def _walk(at: Column, found: str) -> Column:
    return F.struct(at.alias("at"), F.expr(f"CAST(array() AS {found})").alias("found"))


def read_turns(formatted: Column) -> Column:
    """Turns read back from formatted text: array of (role, text), one per original row."""
    runs = F.slice(F.split(formatted, CLOSE, -1), F.lit(1), F.size(F.split(formatted, CLOSE, -1)) - 1)
    # each run is split once, before its texts are looked at
    halves = F.transform(runs, lambda run: F.split(run, r"\[/ROLE\]", 2))
    return F.flatten(F.transform(halves, lambda half: F.transform(
        F.split(half[1], r"\[NEXT\]", -1), lambda text: F.struct(
            unescape(F.substring(half[0], len(OPEN + ROLE) + 1, 2147483647)).alias("role"),
            unescape(text).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped, nothing between."""
    # the array of one element names the bytes, so they are made once and not for each span
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-8")), lambda raw: F.array_join(F.transform(
        spans, lambda s: unescape(F.decode(
            F.substring(raw, (s["start"] + 1).cast("int"), s["n"].cast("int")), "UTF-8"))), "")), F.lit(0))
