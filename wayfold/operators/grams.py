"""Substring joins and search by grams, the character sequences of a fixed length.

A text that contains a needle contains all of the needle's grams. The containment join compares a
needle only with the texts that hold its rarest gram; the search index keeps, for each gram, the rows
whose text holds it, so that a query reads its own grams' files and verifies what holds them all.
Short needles use grams of their own length, so there is no other, slower way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.catalog import in_chinese_order
from wayfold.operators.search import TEXT, expand_tokens
from wayfold.storage import discard, materialize

#: The most distinct grams of needles that are broadcast to the texts; more are joined.
BROADCAST_GRAMS = 500_000

#: Needles of up to so many characters are looked up whole: the grams of short ones are few, and each then stands in many texts and needles.
WHOLE = 8


def grams(text: Column, size) -> Column:
    """The distinct grams of size characters; none if the text is shorter or null.

    One scan by a pattern that looks ahead at each character, so that no place is walked to from the start of the text.
    """
    pattern = F.lit(f"(?s)(?=(.{{{size}}})).") if isinstance(size, int) else F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))."))
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1))), F.array().cast("array<string>"))


def _few(df: DataFrame) -> DataFrame:
    """df, a written table, with a broadcast hint if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df


def _held(needles: DataFrame, texts: DataFrame, needle: str, text: str, size: int, on: Sequence[str] = ()) -> DataFrame:
    """(_on0.., _needle, _key, _copies), written: each distinct needle in each distinct text that agree on the columns `on`.

    _key is the text's digest, _copies how many rows it has. Only grams that some needle of the same `on` holds
    are counted and shuffled; a text meets all its candidates at once and is searched once.
    """
    ons = [f"_on{i}" for i in range(len(on))]
    same = [F.col(c).alias(o) for c, o in zip(on, ons, strict=True)]
    words = materialize(needles.select(*same, F.col(needle).alias("_needle")).filter("_needle <> ''").dropna(subset=ons or None).distinct(), "needles")
    n = F.length("_needle")
    own = words.withColumn("_size", F.when(n <= max(size, WHOLE), n).otherwise(size))
    own = materialize(own.select(*ons, "_needle", "_size", F.explode(grams(F.col("_needle"), F.col("_size"))).alias("_gram")), "needle_grams")
    wanted = materialize(own.select(*ons, "_gram").distinct(), "grams")
    every = texts.select(*same, _digest(text), F.col(text).alias("_text")).filter("_text <> ''").groupBy(*ons, "_key").agg(F.first("_text").alias("_text"), F.count("*").alias("_copies"))
    every = materialize(every.withColumn("_id", F.monotonically_increasing_id()), "texts")
    sizes = [r[0] for r in own.select("_size").distinct().orderBy("_size").collect()]  # one for each length up to max(size, WHOLE) at most
    held = every.select("_id", *ons, F.explode(F.concat(*[grams(F.col("_text"), k) for k in sizes] or [F.array().cast("array<string>")])).alias("_gram"))
    held = materialize(held.join(_few(wanted), [*ons, "_gram"], "left_semi").select("_id", *ons, "_gram"), "text_grams")
    often = held.groupBy(*ons, "_gram").agg(F.count("*").alias("_n"))
    # a gram that no text holds is the rarest of all, and its needle then meets nothing
    rarest = own.join(often, [*ons, "_gram"], "left").groupBy(*ons, "_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_x"))
    asked = materialize(rarest.filter("_x.n > 0").select(*ons, "_needle", F.col("_x.g").alias("_gram")), "grams")
    met = held.join(_few(asked), [*ons, "_gram"]).groupBy("_id").agg(F.collect_list("_needle").alias("_needles"))
    # not explode(), for which Spark would test the array's size first and so search each text twice
    true = F.filter("_needles", lambda x: F.contains("_text", x))
    pairs = materialize(met.join(every, "_id").select(*ons, "_key", "_copies", F.explode_outer(true).alias("_needle")).filter("_needle is not null"), "pairs")
    discard(words, own, wanted, every, held, asked)
    return pairs


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("_key")


def contains_pairs(needles: DataFrame, texts: DataFrame, needle: str, text: str, size: int = 3) -> DataFrame:
    """Every row of needles with every row of texts whose text contains its needle; all columns of both, whose names must differ.

    Each distinct needle is looked up by its rarest gram among the texts, or whole if it is short. Null needles,
    empty ones and null texts meet nothing. Copies of a text are told by its digest and searched once.
    """
    pairs = _held(needles, texts, needle, text, size)
    found = pairs.join(needles, pairs["_needle"] == needles[needle]).drop("_needle", "_copies")
    return found.join(texts.withColumn("_key", _digest(text)), "_key").drop("_key")


def contained_once(needles: DataFrame, texts: DataFrame, needle: str, text: str, key: str, on: Sequence[str] = (), size: int = 3) -> DataFrame:
    """The pairs of contains_pairs() that agree on the columns `on`, if a needle's key has just one of them.

    The other columns of both sides must differ in name; `on` is given once. Needles and texts that do not agree never
    meet, and a needle's pairs are counted before rows are joined to them.
    """
    pairs = _held(needles, texts, needle, text, size, on)
    ons = [f"_on{i}" for i in range(len(on))]
    told = pairs.groupBy(*ons, "_needle").agg(F.sum("_copies").alias("_n"), F.min("_key").alias("_key"))
    same = told["_needle"] == needles[needle]
    for c, o in zip(on, ons, strict=True):
        same = same & (told[o] == needles[c])
    found = needles.join(told, same).select(*[needles[c] for c in needles.columns], "_n", "_key")
    once = found.withColumn("_n", F.sum("_n").over(W.partitionBy(key))).filter("_n = 1").drop("_n")
    right = texts.withColumn("_key", _digest(text)).withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    out = once.join(right, "_key")
    for c, o in zip(on, ons, strict=True):
        out = out.filter(F.col(c) == F.col(o))
    return out.drop("_key", *ons)


@dataclass(frozen=True)
class SearchIndex:
    """rows (_id, _text, the nodes' columns) and postings (bucket, gram, ids' rows), both files in one folder."""

    rows: DataFrame
    postings: DataFrame
    size: int
    buckets: int


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(nodes: DataFrame, path: str, columns: Sequence[str] = TEXT, size: int = 3, buckets: int = 64) -> None:
    """Write the search index of the nodes' columns, joined by line ends in lower case; nulls are empty.

    Postings hold grams of 1 to size characters and lie in folders by the gram's hash, sorted by
    gram, so that a query opens the folders of its own grams and skips most of their row groups. A
    gram that many rows hold is many rows of a folder, which tasks write and read in pieces.
    """
    every = F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in nodes.columns]))
    # dealt first: a small file of many short rows would be one task's work
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes.withColumn("_id", F.monotonically_increasing_id()).withColumn("_text", every).write.mode("errorifexists").parquet(f"{path}/rows")
    rows = nodes.sparkSession.read.parquet(f"{path}/rows")
    of = F.explode(F.concat(*[grams(F.col("_text"), k) for k in range(1, size + 1)]))
    postings = rows.select("_id", of.alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    # by hash, which needs no scan for ranges; a folder has 8 pieces
    dealt = postings.repartition("bucket", F.pmod(F.hash("_id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "_id")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    kept = nodes.sparkSession.range(1).select(F.lit(size).alias("size"), F.lit(buckets).alias("buckets"))
    kept.write.mode("errorifexists").parquet(f"{path}/settings")


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    size, buckets = spark.read.parquet(f"{path}/settings").first()
    return SearchIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/postings"), size, buckets)


def holding(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """(word, _id): the rows whose text contains each word of wanted (word, lower case); empty and null words hold nothing.

    A word's postings are counted by row; only rows that hold all its grams are read and verified.
    """
    words = wanted.select("word").filter("word <> ''").distinct()
    size = F.least(F.lit(index.size), F.length("word"))
    own = materialize(words.select("word", grams(F.col("word"), size).alias("g")).select("word", F.size("g").alias("need"), F.explode("g").alias("gram")).withColumn("bucket", _bucket(F.col("gram"), index.buckets)), "words")
    # the few words are broadcast, so that their buckets prune the postings' folders; many are joined
    few = F.broadcast(own) if own.count() <= BROADCAST_GRAMS else own
    met = index.postings.join(few, ["bucket", "gram"]).groupBy("word", "_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need")
    return met.select("word", "_id").join(index.rows.select("_id", "_text"), "_id").filter(F.contains("_text", "word")).select("word", "_id")


def indexed_search(index: SearchIndex, query: str, aliases: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """(id, label, kind, region, score): the rows of search.search(), from the index instead of a scan.

    Without a limit all matches are returned, in no order. Alias candidates stay a table, however
    many there are; empty ones hold nothing.
    """
    tokens = list(dict.fromkeys(query.lower().split()))
    spark = index.rows.sparkSession
    if not tokens:
        return index.rows.limit(0).select("id", "label", "kind", "region", F.lit(0).alias("score"))
    wanted = spark.createDataFrame([(t, t) for t in tokens], "token string, word string")
    if aliases is not None:
        found = expand_tokens(query, aliases).select("token", F.col("candidate").alias("word")).filter("word <> ''")
        wanted = materialize(wanted.union(found).distinct(), "candidates")
    hits = holding(index, wanted).join(wanted, "word").select("token", "_id").distinct()
    every = hits.groupBy("_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(tokens)).select("_id")
    rows = index.rows.join(every, "_id", "left_semi")
    q = F.lit(" ".join(query.lower().split()))
    points = [F.when(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), q), n).otherwise(0) for c, n in (("label", 4), ("id", 3), ("region", 1))]
    got = rows.select("id", "label", "kind", "region", (points[0] + points[1] + points[2]).alias("score"))
    return got if limit is None else got.orderBy(F.desc("score"), in_chinese_order("label"), "id").limit(limit)


def indexed_text_filter(index: SearchIndex, q: str) -> DataFrame:
    """The rows whose indexed text contains q without case; an empty q lets all through."""
    if not q:
        return index.rows.drop("_id", "_text")
    hits = holding(index, index.rows.sparkSession.createDataFrame([(q.lower(),)], "word string"))
    return index.rows.join(hits.select("_id"), "_id", "left_semi").drop("_id", "_text")
