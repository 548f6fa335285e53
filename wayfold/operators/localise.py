"""Bilingual dictionaries and the ordered ways to look a text up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions.text import merge_plural, without_punctuation, wordset_key

#: Ways of a lookup, the most exact first: forms of the text. The dictionary holds the first two forms of its texts;
#: the last two are the same forms of the text with its last plural merged.
LEVELS = ("norm", "wordset", "singular", "singular_wordset")
FORMS = ("norm", "wordset")


def _keys(x) -> dict:
    one = merge_plural(x)
    return {"norm": without_punctuation(x), "wordset": wordset_key(x), "singular": without_punctuation(one), "singular_wordset": wordset_key(one)}


def pivot_languages(texts: DataFrame, source: str, target: str) -> DataFrame:
    """(table, id, source_text, target_text) of rows (table, id, language, text): one shuffle, first text of each language."""
    return texts.groupBy("table", "id").agg(
        F.min(F.when(F.col("language") == source, F.col("text"))).alias("source_text"), F.min(F.when(F.col("language") == target, F.col("text"))).alias("target_text"))


def dictionary(pairs: DataFrame) -> DataFrame:
    """(level, key, targets): all translations of a source text by its two forms; level is the form's number in FORMS."""
    keys = _keys(F.col("source_text"))
    rows = F.array(*[F.struct(F.lit(i).alias("level"), keys[n].alias("key")) for i, n in enumerate(FORMS)])
    d = pairs.filter("source_text is not null and target_text is not null").select(F.explode(rows).alias("k"), "target_text")
    return d.filter("k.key <> ''").groupBy("k.level", "k.key").agg(F.array_sort(F.collect_set("target_text")).alias("targets"))


def lookup(words: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """words with level and targets of the first of LEVELS that the dictionary holds; null if none."""
    keys, out = _keys(F.col(text)), words
    for i, n in enumerate(LEVELS):
        side = known.filter(F.col("level") == i % len(FORMS)).select(F.col("key").alias(f"_k{i}"), F.col("targets").alias(f"_t{i}"))
        out = out.join(side, keys[n] == F.col(f"_k{i}"), "left")
    level = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.lit(n)) for i, n in enumerate(LEVELS)])
    out = out.withColumns({"level": level, "targets": F.coalesce(*[F.col(f"_t{i}") for i in range(len(LEVELS))])})
    return out.drop(*[f"_{k}{i}" for i in range(len(LEVELS)) for k in "kt"])


def split_match(words: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, whole, joined, complete): texts looked up whole, else by their parts at brackets, slashes, commas and `to`, in order."""
    parts = F.filter(F.split(F.col(text), r"\s*[()/,]\s*|\s+to\s+"), lambda x: x != "")
    rows = words.select(key, F.posexplode(F.concat(F.array(text), parts)).alias("pos", "part"))
    got = lookup(rows, "part", known).select(key, "pos", F.get("targets", F.lit(0)).alias("t"))
    return got.groupBy(key).agg(
        F.max(F.when(F.col("pos") == 0, F.col("t"))).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "t")))), lambda x: F.coalesce(x["t"], F.lit("?"))), " ").alias("joined"),
        F.bool_and(F.when(F.col("pos") > 0, F.col("t").isNotNull())).alias("complete"))


def longest_head(words: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, head, rest, targets): the longest leading run of words that the dictionary holds."""
    w = F.split(without_punctuation(F.col(text)), " ")
    cuts = words.select(key, w.alias("w")).select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    cuts = cuts.select(key, "n", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("head"), F.expr("array_join(slice(w, n + 1, size(w)), ' ')").alias("rest"))
    found = cuts.join(known.filter("level = 0").select(F.col("key").alias("head"), "targets"), "head")
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n")))
    return found.withColumn("_r", best).filter("_r = 1").select(key, "head", "rest", "targets")


def displayed(raw, zh, level, trusted=("exact", "norm", "wordset")):
    """The translation if its level is trusted, else the raw text."""
    return F.when(level.isin(*trusted) & (F.coalesce(zh, F.lit("")) != ""), zh).otherwise(raw)


def place_names(names: DataFrame) -> DataFrame:
    """(map_id, text_id, en, zh): the first non-empty text of each language (map_id, text_id, language, pos, text)."""
    ok = names.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    first = lambda lang: F.min_by(F.when(F.col("language") == lang, F.col("text")), F.when(F.col("language") == lang, F.col("pos")))
    return ok.groupBy("map_id", "text_id").agg(first("en").alias("en"), first("zh").alias("zh"))


def apply_patches(patches: DataFrame, texts: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, refused) of templates: patches (id, field, template, sources array of text ids).

    Every {n} becomes the target text (texts: id, target) of sources[n]. Refused (id, field, reason) are
    patches without an entry in fields (id, field, original), with a source that has no target text,
    with a placeholder left over, or with a word of the template that the original does not hold.
    """
    t = texts.filter("target is not null").groupBy("id").agg(F.min("target").alias("target")).withColumnRenamed("id", "source")
    got = patches.select("id", "field", "template", "sources").join(fields.groupBy("id", "field").agg(F.min("original").alias("original")), ["id", "field"], "left")
    found = patches.select("id", "field", F.posexplode("sources").alias("n", "source")).join(t, "source").groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("n", "target"))).alias("parts"))
    got = got.join(found, ["id", "field"], "left").withColumn("parts", F.coalesce("parts", F.array().cast(dict(found.dtypes)["parts"])))
    put = F.aggregate("parts", F.col("template"), lambda a, p: F.replace(a, F.concat(F.lit("{"), p["n"].cast("string"), F.lit("}")), p["target"]))
    words = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    extra = F.array_except(words(F.regexp_replace("template", r"\{\d+\}", " ")), words(F.col("original")))
    reason = (
        F.when(F.col("original").isNull(), "no entry").when(F.size("parts") < F.size("sources"), "source without text")
        .when(put.rlike(r"\{\d+\}"), "placeholder left over").when(F.size(extra) > 0, "words not in the original")
    )
    got = got.withColumns({"text": put, "reason": reason})
    return got.filter("reason is null").select("id", "field", "text"), got.filter("reason is not null").select("id", "field", "reason")
