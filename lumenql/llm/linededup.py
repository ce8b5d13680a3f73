"""Deletes later copies of repeated line runs, by a suffix array over line-id sequences. DataFrame functions only.

Lines that occur once cannot be repeated and drop out first; what is left are islands of
neighbouring repeated lines, and islands under ``min_words`` words drop out too. Every position
of an island starts a suffix (up to the island's end). Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: a round pairs the rank of a position with that of the position as many
lines on, range-sorts the distinct pairs over the cluster, and numbers them in order. A rank leaves
room for all suffixes that share it, so a round renumbers only those that still tie and could yet
differ; whatever has become unique, or equal to its island's end, keeps the rank it has. When
nothing ties that could still differ, the ranks are the suffix array.

Equal ranks of one round are an interval of the suffix array with a common prefix of that many
lines. Going back from the longest to the single line, each interval is split by the rank of what
follows its prefix; in each part the first position in corpus order stays as witness and all later
ones move into the part, their prefix longer by that round's lines. So each position ends in the
innermost interval in which it is not first: its longest run that occurred before. Runs of at
least ``min_words`` words are maximal repeats, and the lines of later copies are deleted.

No step gathers a group: intervals are only aggregated to their first position, and hot lines are
the long side of sort-merge joins with a written table of one row a key, which adaptive execution
splits. A position enters the way back at the longest round that ranked it, so the rounds of long
runs see only the positions that have such runs.

Defined results: corpus order is (doc_id, text hash, line number), null ids first. Null texts stay
null with 0 lines; an empty text is one line without words. Rows that repeat id and text count as
one occurrence and are all treated alike. A document whose lines all go keeps its row, with ''.
Extra columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, bits_for, hash_bits, may_occur

MIN_WORDS = 50
END = -1  # what follows an island's last line


def numbered(df: DataFrame, *by: str, name: str) -> DataFrame:
    """Increasing numbers in the order of the unique key ``by``: a range sort, then place in partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def ranked(groups: DataFrame, old: str, *by: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``rank`` of each row of ``groups`` (n members each), and whether any has ``more``.

    The rank is the old rank plus the members of its group that sort before by ``by``. A group may
    span range partitions; what its earlier partitions hold is added up on the driver, a row a partition.
    """
    placed = scratch.keep("order", numbered(groups, old, *by, name="id").withColumn("part", F.shiftright("id", 33)))
    ends = placed.groupBy("part", old).agg(F.sum("n").alias("n"), F.bool_or("more").alias("more"))
    ends = ends.groupBy("part").agg(F.min(old).alias("low"), F.max(old).alias("high"), F.max_by("n", old).alias("n"), F.bool_or("more").alias("more"))
    carry, group, held, more = [], None, 0, False
    for part, low, high, n, others in sorted(tuple(r) for r in ends.collect()):  # a row a partition
        if low == group:
            carry.append((part, low, held))
        held, group, more = n + (held if low == group == high else 0), high, more or others
    before = F.coalesce(F.sum("n").over(W.partitionBy("part", old).orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.col(old) + before
    if carry:
        held = placed.sparkSession.createDataFrame(carry, f"part long, {old} long, held long")
        placed = placed.join(F.broadcast(held), ["part", old], "left")  # a row a partition
        rank = rank + F.coalesce("held", F.lit(0))
    return placed.withColumn("rank", rank).drop("id", "part", "held"), more


def islands(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """p (place in corpus order), doc_id, h, pos, rem (lines to the island's end), cw (words up to here), w, r."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))  # hashed before the lines part
    lines = texts.select("doc_id", "h", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("doc_id", "h", "pos", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    repeated = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("r", F.lit(0).cast("long")).withColumn("more", F.lit(True))
    names = ranked(repeated, "r", "a", "b", scratch=scratch)[0].select("a", "b", F.col("rank").alias("r"))
    names = scratch.keep("names", names)
    bits = bits_for(names.count())
    occurs = scratch.keep("bits", hash_bits(names.select(F.col("a").alias("h")), bits))
    lines = lines.where(may_occur(F.col("a"), occurs, bits))  # most lines occur once; the join is exact
    lines = lines.select("doc_id", "h", "pos", "a", "b", F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"))
    found = lines.join(names, ["a", "b"]).select("doc_id", "h", "pos", "w", "r")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc, island = W.partitionBy("doc_id", "h"), W.partitionBy("doc_id", "h", "island")
    found = found.repartitionByRange(n, "doc_id", "h").dropDuplicates(["doc_id", "h", "pos"])
    found = found.withColumn("island", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    found = found.withColumn("rem", F.max("pos").over(island) - F.col("pos") + 1).withColumn("words", F.sum("w").over(island))
    found = found.withColumn("cw", F.sum("w").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    found = found.where(F.col("words") >= min_words).select("doc_id", "h", "pos", F.col("rem").cast("long").alias("rem"), "cw", "w", "r")
    found = scratch.keep("islands", found.sortWithinPartitions("doc_id", "h", "pos").withColumn("p", F.monotonically_increasing_id()))
    scratch.drop("names", "bits")
    return found


def suffix_array(base: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """One table a round k: p, rem, r, more of the positions that tied before it by 2**k / 2 lines and could differ.

    r is the rank by the first 2**k lines, null where no other position shares them; more tells
    whether the position is in the next round.
    """
    levels, more = [base.select("p", "rem", "r", F.lit(True).alias("more"))], True
    while more:
        k, active = len(levels) - 1, levels[-1].where("more")
        span = 1 << k
        rests = [x.where("not more and r is not null") for x in levels]
        latest = reduce(DataFrame.union, [active, *rests]).select(F.col("p").alias("at"), F.col("r").alias("next"))
        inside = active.where(F.col("rem") > span).withColumn("at", F.col("p") + span).join(latest, "at", "left").select("p", "rem", "r", "next")
        ending = active.where(F.col("rem") <= span).select("p", "rem", "r", F.lit(END).cast("long").alias("next"))
        pairs = scratch.keep("pairs", inside.union(ending))
        groups = pairs.where("next is not null").groupBy("r", "next").agg(F.count(F.lit(1)).alias("n"), (F.max("rem") > 2 * span).alias("more")).where("n > 1")
        order, more = ranked(groups, "r", "next", scratch=scratch)
        level = pairs.join(order.select("r", "next", "rank", "more"), ["r", "next"], "left").select("p", "rem", F.col("rank").alias("r"), F.coalesce("more", F.lit(False)).alias("more"))
        levels.append(scratch.keep(f"level{k + 1}", level))
    return levels


def longest_earlier(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """p, run: for each position the lines of its longest prefix that also starts at an earlier position.

    An interval is named by its first position g and the length run of its prefix. Rows are the
    positions of an interval that have not moved on; those that are not active are its witnesses.
    """
    moves, done = None, []
    for t in range(len(levels) - 1, -1, -1):
        level, span = levels[t], 1 << t
        rows = (level if moves is None else level.where("not more")).select("p", "rem", F.lit(0).cast("long").alias("run"), F.lit(-1).cast("long").alias("g"), F.lit(True).alias("active"), F.col("r").alias("next"))
        if moves is not None:
            look = level.where("r is not null").select(F.col("p").alias("at"), F.col("r").alias("next"))
            rows = rows.union(moves.withColumn("at", F.when(F.col("run") < F.col("rem"), F.col("p") + F.col("run"))).join(look, "at", "left").drop("at"))
        rows = scratch.keep(f"rows{t}", rows)
        done.append(rows.where("run = rem").select("p", "run"))
        rows, key = rows.where("run < rem"), ["g", "run", "next"]
        first = rows.where("next is not null").groupBy(key).agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        both = rows.join(scratch.keep("first", first), key, "left")
        longer = F.least(F.col("run") + span, F.col("rem"))
        here = F.struct(F.col("run").alias("run"), F.col("g").alias("g"), F.col("active").alias("active"))
        there = F.struct(longer.alias("run"), F.col("first").alias("g"), F.col("active").alias("active"))
        witness = F.struct(longer.alias("run"), F.col("first").alias("g"), F.lit(False).alias("active"))
        moved = F.col("active") & (F.col("p") > F.col("first"))
        goes = F.when(F.col("first").isNull(), F.array(here)).when(moved, F.array(there)).when(F.col("p") == F.col("first"), F.array(here, witness)).otherwise(F.array().cast("array<struct<run:bigint,g:bigint,active:boolean>>"))
        moves = both.select("p", "rem", F.explode(goes).alias("x")).select("p", "rem", "x.*").where("active or run < rem")
    done.append(moves.where("active and run > 0").select("p", "run"))
    return reduce(DataFrame.union, done)


def deleted_lines(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """doc_id, h, pos of every line to delete, h being the hash of the document's text."""
    base = islands(docs, min_words, scratch)
    runs = longest_earlier(suffix_array(base, scratch), scratch)
    ends = base.select((F.col("p") + 1).alias("end"), F.col("cw").alias("upto"))
    runs = runs.join(base.select("p", "cw", "w"), "p").withColumn("end", F.col("p") + F.col("run")).join(ends, "end")
    runs = runs.where(F.col("upto") - F.col("cw") + F.col("w") >= min_words).select("p", "end")
    per_doc = W.partitionBy("doc_id", "h").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    covered = base.select("p", "doc_id", "h", "pos").join(runs, "p", "left").withColumn("reach", F.max("end").over(per_doc))
    gone = covered.where(F.col("reach") > F.col("p")).groupBy("doc_id", "h").agg(F.collect_list("pos").alias("gone"))
    return scratch.keep("gone", gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """The columns of ``docs`` with ``text`` without later copies, and two ``counts``: lines, and deleted lines.

    Only texts that may lose lines, by a bitmap of their hashes, go through the last join's
    exchange; the join behind the bitmap is exact. All others pass as they are read. The deletions
    grow with the corpus, so they are merged, never broadcast, at any size.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    gone = deleted_lines(docs.select("doc_id", "text"), min_words, scratch).toDF("gone_id", "gone_h", "gone")
    scratch.drop_all_but("gone")
    bits = bits_for(gone.count())
    found = scratch.keep("found", hash_bits(gone.select(F.col("gone_h").alias("h")), bits))
    keyed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any names of theirs are safe so
    text, doc_id = (F.col(f"c{docs.columns.index(x)}") for x in ("text", "doc_id"))
    keyed = keyed.withColumn("h", F.xxhash64(text))
    may = may_occur(F.col("h"), found, bits)
    joined = keyed.where(may).join(gone.hint("merge"), (F.col("h") == F.col("gone_h")) & doc_id.eqNullSafe(F.col("gone_id")), "left")
    lines = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    shown = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("long")

    def columns(shown: Column, deleted: Column) -> list[Column]:
        return [*(shown if c == "text" else F.col(f"c{i}") for i, c in enumerate(docs.columns)), n_lines, deleted.cast("long")]

    changed = joined.select(*columns(shown, F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))))
    return keyed.where(~may).select(*columns(text, F.lit(0))).union(changed).toDF(*docs.columns, *counts)
