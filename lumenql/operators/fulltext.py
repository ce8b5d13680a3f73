"""Ranked full-text search over multi-level token postings.

A document's words are level 1, their two-character chunks level 2, their characters level 3, each
with the level's weight. A search takes the rows that have all terms of the query; a row's score
sums, for every query term, N / df * weight / distinct terms of the row. Postings are written by
ranges of (bucket, term, row) under folders of term buckets: a search reads the buckets of its own
terms, and a frequent term is spread over many files.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator is anything but ASCII letters, digits, and characters beyond ASCII.
SEPARATOR = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: What a text with a word has, in either case.
ANY_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
BUCKETS = 64
#: Postings that one task sorts and writes, about: the number of tasks follows the rows, not the session's shuffle partitions.
SORTED_AT_ONCE = 2_000_000


@dataclass
class FtsConfig:
    """levels to index; least length of a level-2 term; weights by level; synonyms of level-1 words."""

    levels: tuple[int, ...] = (1,)
    min_term: int = 1
    weights: dict[int, float] = field(default_factory=lambda: {1: 1.0, 2: 0.7, 3: 0.3})
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    positions: bool = True

    @classmethod
    def parse(cls, options: dict[str, str]) -> FtsConfig:
        """From the WITH options of CREATE FULLTEXT INDEX."""
        import json

        out = cls()
        if "LEVELS" in options:
            out.levels = tuple(sorted({int(x) for x in re.findall(r"\d", options["LEVELS"])}))
        out.min_term = int(options.get("MIN_TERM_LEN", out.min_term))
        for k in (1, 2, 3):
            out.weights[k] = float(options.get(f"WEIGHT_L{k}", out.weights[k]))
        out.positions = options.get("STORE_POSITION", "true").lower() in ("true", "1", "yes", "on")
        out.synonyms = {k.lower(): [w.lower() for w in v] for k, v in json.loads(options.get("SYNONYMS", "{}")).items()}
        return out


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda x: x != "")


def tokens_of(query: str) -> list[str]:
    """The same words of a query string, on the driver."""
    return [w for w in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", query.lower()) if w]


def chunks(word: Column, size: int) -> Column:
    """Pieces of ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(word) / size).cast("int") - 1, F.lit(0))), lambda i: F.substr(word, i * size + 1, F.lit(size)))


def _tagged(level: int, weight: float):
    """Makes a posting of a term."""
    return lambda w: F.struct(w.alias("term"), F.lit(level).alias("level"), F.lit(weight).alias("weight"))


def _synonyms(word: Column, config: FtsConfig) -> Column:
    table = F.create_map(*(x for k, v in config.synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return F.coalesce(table[word], F.array().cast("array<string>"))


def _possible(word: Column, terms: list[str], config: FtsConfig, levels: list[int]) -> Column:
    """Whether a posting of a word may be one of ``terms``; says no to most words before they are cut into pieces."""
    sources = [k for k, v in config.synonyms.items() if set(v) & set(terms)]
    out = word.isin(sorted({*terms, *sources})) if 1 in levels else F.lit(False)
    for level, size in ((2, 2), (3, 1)):
        for t in terms if level in levels else ():
            if len(t) <= size:  # a shorter piece is a word's last
                out = out | (F.contains(word, F.lit(t)) if len(t) == size else F.endswith(word, F.lit(t)))
    return out


def postings(rows: DataFrame, key: str, text: str, config: FtsConfig, terms: list[str] | None = None, level: int | None = None) -> DataFrame:
    """key, term, level, weight, pos for every token occurrence of every level; with ``terms`` or ``level``, only for those, and others are not made."""
    each = rows.select(F.col(key), F.posexplode(words(F.col(text))).alias("pos", "word"))
    levels = [x for x in config.levels if level in (None, x)]
    wanted = None if terms is None else sorted(set(terms))
    if wanted is not None:
        each = each.where(_possible(F.col("word"), wanted, config, levels))
    if levels == [1] and not config.synonyms:  # a word is its only posting
        out = each.select(key, F.col("word").alias("term"), F.lit(1).alias("level"), F.lit(config.weights[1]).alias("weight"), "pos")
        return out if config.positions else out.withColumn("pos", F.lit(None).cast("int"))
    made = []
    if 1 in levels:
        made.append(F.array(F.struct(F.col("word").alias("term"), F.lit(1).alias("level"), F.lit(config.weights[1]).alias("weight"))))
        if config.synonyms:
            made.append(F.transform(_synonyms(F.col("word"), config), _tagged(1, 0.9 * config.weights[1])))
    for at, size in ((2, 2), (3, 1)):
        if at in levels:
            parts = chunks(F.col("word"), size)
            if at == 2:
                parts = F.filter(parts, lambda x: F.length(x) >= config.min_term)
            if wanted is not None:
                parts = F.filter(parts, lambda x: x.isin(wanted))
            made.append(F.transform(parts, _tagged(at, config.weights[at])))
    made = made or [F.array().cast("array<struct<term: string, level: int, weight: double>>")]
    out = each.select(key, "pos", F.explode(F.concat(*made)).alias("t")).select(key, "t.term", "t.level", "t.weight", "pos")
    out = out if wanted is None else out.where(F.col("term").isin(wanted))
    return out if config.positions else out.withColumn("pos", F.lit(None).cast("int"))


def query_terms(query: str, config: FtsConfig, level: int | None = None) -> list[str]:
    """Terms of a query, repeats included: its words, or their pieces where a level is asked for."""
    found = tokens_of(query)
    size = {2: 2, 3: 1}.get(level or (1 if 1 in config.levels else min(config.levels)))
    if size:
        found = [w[i : i + size] for w in found for i in range(0, len(w), size)]
    return found


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def row_stats(rows: DataFrame, key: str, text: str, config: FtsConfig, once: bool = False) -> DataFrame:
    """key, distinct terms, and postings at most (n_terms, n_postings) of the rows that have any; counted in the row, no posting is made.

    ``once``: no key repeats, so nothing is shuffled; else the words of a key's rows are put together.
    """
    per = rows.where(F.rlike(F.col(text).cast("string"), F.lit(ANY_WORD))).select(key, words(F.col(text)).alias("w"))  # a filter on n_terms would split every text twice
    if not once:
        per = per.groupBy(key).agg(F.flatten(F.collect_list("w")).alias("w"))
    per = per.select(key, "w", F.array_distinct("w").alias("d"))
    terms, most = [], F.lit(0)
    chars = F.length(F.array_join("w", ""))
    if 1 in config.levels:
        terms.append(F.col("d"))
        if config.synonyms:
            terms.append(F.flatten(F.transform("d", lambda x: _synonyms(x, config))))
        most = most + F.size("w") * (1 + max(map(len, config.synonyms.values()), default=0))
    if 2 in config.levels:
        terms.append(F.filter(F.flatten(F.transform("d", lambda x: chunks(x, 2))), lambda x: F.length(x) >= config.min_term))
        most = most + F.ceil((chars + F.size("w")) / 2)
    if 3 in config.levels:
        terms.append(F.flatten(F.transform("d", lambda x: chunks(x, 1))))
        most = most + chars
    distinct = F.col("d") if config.levels == (1,) and not config.synonyms else F.array_distinct(F.concat(*terms))
    out = per.select(key, F.size(distinct).cast("long").alias("n_terms"), most.cast("long").alias("n_postings"))
    return out if 1 in config.levels else out.where("n_terms > 0")


def build(rows: DataFrame, key: str, text: str, config: FtsConfig, path: str, once: bool = False, stored: Column | None = None) -> None:
    """Write postings and row statistics of ``rows`` below ``path``.

    ``once``: no key repeats. ``stored``: what is written for the key, made from it after the sort, so that a narrow key is sorted.
    """
    stored = (F.col(key) if stored is None else stored).alias(key)
    row_stats(rows, key, text, config, once).select(stored, "n_terms", "n_postings").write.parquet(f"{path}/rows")
    most = rows.sparkSession.read.schema("n_postings long").parquet(f"{path}/rows").agg(F.sum("n_postings")).first()[0] or 0
    found = postings(rows, key, text, config).withColumn("bucket", bucket(F.col("term")))
    spread = found.repartitionByRange(-(-most // SORTED_AT_ONCE) or 1, "bucket", "term", key).sortWithinPartitions("bucket", "term", key)
    spread.select(stored, *(c for c in found.columns if c != key)).write.partitionBy("bucket").parquet(f"{path}/postings")


def load(spark: SparkSession, paths: list[str], key: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (of the buckets of ``terms``) and row statistics of index segments; key is the row key's name and type."""
    found = [spark.read.schema(f"{key}, term string, level int, weight double, pos int, bucket int").parquet(f"{p}/postings") for p in paths]
    stats = [spark.read.schema(f"{key}, n_terms long").parquet(f"{p}/rows") for p in paths]
    out, rows = found[0], stats[0]
    for p, r in zip(found[1:], stats[1:], strict=True):
        out, rows = out.unionByName(p), rows.unionByName(r)
    if terms is not None:
        out = out.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(sorted(set(terms))))
    return out, rows


def search(index: DataFrame, key: str, terms: list[str], level: int | None = None) -> DataFrame:
    """key of the rows that have every term (at a level, if given)."""
    wanted = sorted(set(terms))
    found = index.where(F.col("term").isin(wanted))
    if level:
        found = found.where(F.col("level") == level)
    return found.groupBy(key).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(key) if wanted else found.select(key).limit(0)


def ranked(index: DataFrame, stats: DataFrame, key: str, terms: list[str], level: int | None = None) -> DataFrame:
    """key, score of the rows that ``search`` finds; order by score descending, then key, and limit for a top-k."""
    wanted = sorted(set(terms))
    found = index.where(F.col("term").isin(wanted))
    if level:
        found = found.where(F.col("level") == level)
    per_row = found.groupBy(key, "term").agg(F.max("weight").alias("weight"))  # one row a term and document
    df = per_row.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most one row a query term
    times = F.create_map(*(x for t in wanted for x in (F.lit(t), F.lit(float(terms.count(t)))))) if wanted else None
    hits = per_row.join(F.broadcast(df), "term")
    scored = hits.groupBy(key).agg(F.sum(times[F.col("term")] * F.col("weight") / F.col("df")).alias("part"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    n_rows = stats.count()
    return scored.join(stats, key).select(key, (F.col("part") * n_rows / F.col("n_terms")).alias("score"))


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The text with every occurrence of a term, upper or lower case, between marks; longer terms first."""
    if not terms:
        return text
    pattern = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    safe = [m.replace("\\", "\\\\").replace("$", "\\$") for m in (before, after)]
    return F.regexp_replace(text, f"(?iu)((?:{pattern})+)", f"{safe[0]}$1{safe[1]}")


def positions(index: DataFrame, key: str, term: str) -> DataFrame:
    """key and the sorted places of a term."""
    return index.where(F.col("term") == term).groupBy(key).agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def index_stats(index: DataFrame, key: str) -> DataFrame:
    """n_docs and n_terms of an index."""
    return index.agg(F.count_distinct(key).alias("n_docs"), F.count_distinct("term").alias("n_terms"))
