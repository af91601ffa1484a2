"""Line deduplication over a suffix array of line sequences.

The texts of a corpus are sequences of line ids. Suffixes that begin with the same lines are brought
together by prefix doubling: the rank after round k orders suffixes by their first 2^k lines, and the
next rank is the rank within each group by the rank 2^k lines further on. A group of suffixes that share
their first m lines is an interval of that order whose longest common prefix is at least m; taken at the
depth m where a suffix has ``min_words`` words, and by the mirrored depth from a run's end, the intervals
cover every maximal repeated run exactly. In each interval the first suffix stays, and the lines that the
others share with it are deleted. Neighbouring intervals of one text merge to its maximal runs.

What keeps it small: a line that occurs once ends every run, so only stretches of repeated lines of at
least ``min_words`` words get ranks; every line has a word, so no depth beyond ``min_words`` lines is
asked for and log2(min_words) rounds do, however long a text or a run is. Ranks of a group come from
counts of its distinct next ranks, so that a group of any size is one row per next rank and task, and a
group with very many next ranks is summed in ``PARTS`` parts.

Defined results: a null text has no lines and stays null; lines without a word neither count nor break
a run and stay; order is by (doc_id, text hash, line), null doc_id first; rows with equal doc_id and text
are one document, treated alike; overlapping copies within a text keep what the first one shows, so that
a line repeated on end is cut down to its first lines; an empty table gives an empty table; other columns
are carried along, but for those named like the added ones (x_doc, x_key, x_lines, x_removed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.tables import without
from aerolake.session import cut

MIN_WORDS = 50
#: Parts in which the next ranks of one group are summed.
PARTS = 64

_WORDS = r"[^\x20\x09-\x0D]+"


def document_key(text: str = "text") -> Column:
    return F.xxhash64(F.col("doc_id"), F.col(text))


def document_place() -> Column:
    """The order of documents, null first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def numbered_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(s_doc, s_key, s_at, s_line, s_id, s_words): the lines with a word; s_at numbers them, s_line all lines, from 0."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.struct(
        i.alias("s_line"), F.xxhash64(line).alias("s_id"), F.regexp_count(line, F.lit(_WORDS)).alias("s_words")))
    worded = docs.select(document_place().alias("s_doc"), document_key(text).alias("s_key"), F.posexplode(F.filter(lines, lambda s: s["s_words"] > 0)).alias("s_at", "s"))
    return worded.select("s_doc", "s_key", "s_at", "s.*")


def repeated_stretches(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """The lines that occur twice or more and stand in an unbroken stretch of at least ``min_words`` words; s_stretch names it."""
    lines = numbered_lines(docs, text)
    # Written, so that the join has exchanges of its own on both sides, of which Spark splits a line that is very common.
    often = cut(lines.groupBy(F.col("s_id").alias("o_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("o_id"))
    shared = lines.join(often, F.col("s_id") == F.col("o_id"), "left_semi").dropDuplicates(["s_doc", "s_key", "s_at"])
    whole = Window.partitionBy("s_doc", "s_key").orderBy("s_at")
    found = shared.withColumn("s_stretch", F.col("s_at") - F.row_number().over(whole))
    stretch = Window.partitionBy("s_doc", "s_key", "s_stretch")
    return found.withColumn("w", F.sum("s_words").over(stretch)).filter(F.col("w") >= min_words).drop("w")


def _next_rank(rows: DataFrame, step: int) -> DataFrame:
    """Appends the rank by 2 * step lines to the ranks by 1, 2, .., step lines. A suffix that ends comes first."""
    stretch = Window.partitionBy("s_doc", "s_key", "s_stretch").orderBy("s_at")
    ahead = rows.withColumn("r", F.element_at("ranks", -1)).withColumn("n_id", F.lead("s_id", step).over(stretch)).withColumn("n_r", F.lead("r", step).over(stretch))
    kinds = ahead.groupBy("s_id", "r", "n_id", "n_r").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "part", F.coalesce(F.shiftrightunsigned("n_id", 58), F.lit(-1)))
    group = Window.partitionBy("s_id", "r", "part").orderBy(F.col("n_id").asc_nulls_first(), F.col("n_r").asc_nulls_first())
    kinds = kinds.withColumn("below", F.coalesce(F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = kinds.groupBy("s_id", "r", "part").agg(F.sum("n").alias("n"))
    lower = F.sum("n").over(Window.partitionBy("s_id", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("s_id").alias("p_id"), F.col("r").alias("p_r"), F.col("part").alias("p_part"), F.coalesce(lower, F.lit(0)).alias("lower"))
    ranked = kinds.join(parts, (F.col("s_id") == F.col("p_id")) & (F.col("r") == F.col("p_r")) & (F.col("part") == F.col("p_part"))).select(
        F.col("s_id").alias("k_id"), F.col("r").alias("k_r"), F.col("n_id").alias("k_n_id"), F.col("n_r").alias("k_n_r"), (F.col("r") + F.col("lower") + F.col("below")).alias("rank"))
    same = (F.col("s_id") == F.col("k_id")) & (F.col("r") == F.col("k_r")) & F.col("n_id").eqNullSafe(F.col("k_n_id")) & F.col("n_r").eqNullSafe(F.col("k_n_r"))
    return ahead.join(ranked, same).select(*[c for c in rows.columns if c != "ranks"], F.concat("ranks", F.array("rank")).alias("ranks"))


def suffix_ranks(stretches: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``ranks``, an array: by the first 1, 2, 4, ... lines, up to the last power of two within ``min_words``.

    The suffixes in the order of (s_id, last rank) are the suffix array to that depth: a rank counts the suffixes
    with the same first line that are smaller. Each round is written, so that lineage stays short."""
    table = cut(stretches.withColumn("ranks", F.array(F.lit(0).cast("long"))))
    step = 1
    while 2 * step <= min_words:
        table, step = cut(_next_rank(table, step)), 2 * step
    return table


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(s_doc, s_key, s_at, m): the shortest runs of m lines with at least ``min_words`` words, from each line on and
    from each line back. Every line has a word, so that no more than ``min_words`` lines are looked at."""
    stretch = Window.partitionBy("s_doc", "s_key", "s_stretch").orderBy("s_at")

    def shortest(words: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("m"))
        last = F.aggregate(words, start, lambda a, w: F.struct(
            (a["words"] + F.when(a["words"] >= min_words, 0).otherwise(w)).alias("words"), (a["m"] + F.when(a["words"] >= min_words, 0).otherwise(1)).alias("m")))
        return F.transform(F.array(last), lambda s: F.when(s["words"] >= min_words, s["m"]))[0]

    on = shortest(F.collect_list("s_words").over(stretch.rowsBetween(0, min_words - 1)))
    back = shortest(F.reverse(F.collect_list("s_words").over(stretch.rowsBetween(1 - min_words, 0))))
    both = lines.select("s_doc", "s_key", "s_at", on.alias("on"), back.alias("back"))
    found = both.select("s_doc", "s_key", F.inline(F.array(
        F.struct(F.col("s_at").alias("s_at"), F.col("on").alias("m")), F.struct((F.col("s_at") - F.col("back") + 1).alias("s_at"), F.col("back").alias("m")))))
    return found.filter("m is not null").distinct()


def repeated_runs(ranked: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(s_doc, s_key, s_at, m, f_doc, f_key, f_at): every shortest repeated run that is a later copy, and its first copy.

    The interval of the suffixes that share m lines is named by the ranks of two overlapping runs of 2^k lines, one
    at the front and one at the end of the m lines, with 2^k <= m < 2^(k + 1)."""
    runs = _windows(ranked, min_words).withColumn("k", F.floor(F.log2(F.col("m") + 0.5)).cast("int"))
    runs = runs.withColumn("e_at", F.col("s_at") + F.col("m") - F.pow(F.lit(2), F.col("k")).cast("int"))
    at = ranked.select("s_doc", "s_key", "s_at", "s_id", "ranks")
    head = runs.join(at, ["s_doc", "s_key", "s_at"]).select(
        "s_doc", "s_key", "s_at", "m", "k", "e_at", F.struct("s_id", F.get("ranks", F.col("k")).alias("r")).alias("head"))
    found = head.join(at.withColumnRenamed("s_at", "e_at"), ["s_doc", "s_key", "e_at"]).select(
        "s_doc", "s_key", "s_at", "m", "head", F.struct("s_id", F.get("ranks", F.col("k")).alias("r")).alias("tail"))
    place = F.struct(F.col("s_doc"), F.col("s_key"), F.col("s_at"))
    found = cut(found)
    first = cut(found.groupBy(F.col("m").alias("f_m"), F.col("head").alias("f_head"), F.col("tail").alias("f_tail")).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    same = (F.col("m") == F.col("f_m")) & (F.col("head") == F.col("f_head")) & (F.col("tail") == F.col("f_tail"))
    later = found.join(first, same).filter(place != F.col("first"))
    return later.select("s_doc", "s_key", "s_at", "m", F.col("first.s_doc").alias("f_doc"), F.col("first.s_key").alias("f_key"), F.col("first.s_at").alias("f_at"))


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """(x_doc, x_key, x_lines): of every text with later copies, the numbers of its lines to delete, without repeats."""
    ranked = suffix_ranks(repeated_stretches(docs, min_words, text), min_words)
    places = repeated_runs(ranked, min_words).select("s_doc", "s_key", F.explode(F.sequence(F.col("s_at"), F.col("s_at") + F.col("m") - 1)).alias("s_at")).distinct()
    return ranked.join(places, ["s_doc", "s_key", "s_at"]).groupBy(F.col("s_doc").alias("x_doc"), F.col("s_key").alias("x_key")).agg(
        F.collect_list("s_line").alias("x_lines"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """The documents with later copies of repeated runs deleted from their texts, and ``x_removed``, the number of lines."""
    docs = without(docs, ("x_doc", "x_key", "x_lines", "x_removed"))
    gone = deleted_lines(docs, min_words, text)
    joined = docs.join(gone, (document_place() == F.col("x_doc")) & (document_key(text) == F.col("x_key")), "left")
    listed = F.coalesce(F.col("x_lines"), F.array().cast("array<int>"))

    def others(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), listed)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cleaned = F.when(F.col("x_lines").isNull(), F.col(text)).otherwise(F.transform(F.array(F.split(F.col(text), "\n", -1)), others)[0])
    return joined.select(*[cleaned.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns], F.size(listed).cast("long").alias("x_removed"))
