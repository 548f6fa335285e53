"""Operator 9: personal data by bootstrapped contextual extraction, in built-in functions only.

The base kinds are the seeds. Words to the left of seed entities become lexical patterns; patterns
and the identifier-like tokens that follow them form a bipartite graph on which confidences are
passed back and forth a few times: a pattern is as sure as the distinct instances it extracts are
on average, an instance as its patterns together. Patterns of high confidence and support then
discover identifiers that no base kind covers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.spans import SPANS, Kind, _sorted, count_kind, with_spans, written
from wayfold.storage import discard, materialize

_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nines cast out; the sum is a multiple of ten."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


#: The contract's kinds, in its order; possessive forms of its patterns, which match the same.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True),
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda m: m.rlike(_IP), r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_matches(m, '{_IP}')"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.when(F.length(m) < 12, False).otherwise(F.length(_digits(m)).between(12, 19) & luhn(_digits(m))),
         r"[0-9]([\x20-]?[0-9])+", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
]
_NAMES = [*(k.name for k in BASE), "context"]


@dataclass(frozen=True)
class PiiParams:
    """context: most words to the left that make a pattern. rounds of scoring; a pattern discovers if its
    confidence is at least confidence and support distinct seeds support it. A token is
    identifier-like if it has at least digits digits.
    """

    context: int = 2
    rounds: int = 3
    confidence: float = 0.6
    support: int = 3
    digits: int = 3


#: Identifier-like tokens: runs without white space that hold a digit or @.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _numbered(word: Column) -> Column:
    """A context's word, lower-cased; numbers and addresses are alike there."""
    return F.when(word.rlike("[0-9@]"), "#").otherwise(F.lower(word))


def scanned(docs: DataFrame, p: PiiParams, keep: bool) -> DataFrame:
    """A written table: _row (a key of the row), doc (its columns, or doc_id alone unless keep), spans (the
    contract's base spans of text) and found: (left, start, end, instance, seed) of base spans and
    identifier-like tokens, with the words to their left.

    A base span is one instance, however many tokens it covers, and a seed (1); identifier-like tokens
    that no base span touches are the others (0). left holds the last words before the instance in the
    text, lower-cased, with # for each word that holds a digit or @; fewer at the start of the text.
    """
    doc = F.struct("*") if keep else F.struct("doc_id")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_spans(d, "text", BASE, "spans")
    d = d.withColumns({"m": F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), "s": F.split("text", _TOKEN, -1)})
    # the spans of a kind are its passing matches, in order
    texts = []
    for i, k in enumerate(BASE):
        of = F.filter("spans", lambda s: s["kind"] == i)
        hits = F.filter(F.regexp_extract_all("text", F.lit(k.regex), F.lit(0)), k.passes)
        whole = F.zip_with(of, hits, lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(m).alias("text")))
        texts.append(F.when(F.size(of) > 0, whole).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")))
    d = d.withColumn("base", F.concat(*texts)).drop("text")
    fields = "start:bigint,end:bigint,stop:bigint,left:array<string>,token:string,fits:boolean"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("left"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def last(words):
        return F.when(F.size(words) > p.context, F.slice(words, -p.context, p.context)).otherwise(words)

    def step(a, x):
        piece = F.get("s", a["i"])
        here = a["at"] + F.length(piece)
        stop = here + F.length(x)
        left = last(F.concat(a["left"], F.filter(F.split(F.lower(piece), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")))
        bare = F.regexp_replace(x, F.lit(r"[.,;:!?)\]\"']+$"), F.lit(""))
        fits = (F.length(F.regexp_replace(x, F.lit("[^0-9]"), F.lit(""))) >= p.digits) | x.contains("@")
        one = F.array(F.struct(here.alias("start"), (here + F.length(bare)).alias("end"), stop.alias("stop"), left.alias("left"), bare.alias("token"), fits.alias("fits")))
        begins = F.exists("base", lambda s: (s["start"] >= here) & (s["start"] < stop))
        return F.struct((a["i"] + 1).alias("i"), stop.alias("at"), last(F.concat(left, F.array(F.lit("#")))).alias("left"), F.when(fits | begins, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def instances(f):
        def of_span(s):
            before = F.substring(f["token"], F.lit(1), (s["start"] - f["start"]).cast("int"))
            left = F.when(before.rlike(r"[A-Za-z0-9@]|[^\x00-\x7F]"), last(F.concat(f["left"], F.array(_numbered(before))))).otherwise(f["left"])
            return F.struct(left.alias("left"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("instance"), F.lit(1).alias("seed"))

        seeds = F.transform(F.filter("base", lambda s: (s["start"] >= f["start"]) & (s["start"] < f["stop"])), of_span)
        touched = F.exists("base", lambda s: (s["start"] < f["end"]) & (s["end"] > f["start"]))
        own = F.array(F.struct(f["left"].alias("left"), f["start"].alias("start"), f["end"].alias("end"), F.lower(f["token"]).alias("instance"), F.lit(0).alias("seed")))
        return F.when(f["fits"] & ~touched, F.concat(seeds, own)).otherwise(seeds)

    d = d.withColumn("found", F.aggregate("m", start, step, lambda a: a["out"])).drop("m", "s")
    return materialize(d.withColumn("found", F.flatten(F.transform("found", instances))).drop("base"), "scanned")


def mentions(rows: DataFrame) -> DataFrame:
    """(_row, pattern, start, end, instance, seed) of scanned(); without any word to the left there is no mention."""
    d = rows.select("_row", F.explode_outer("found").alias("f")).filter("f is not null")  # explode() would add a filter on the size
    pattern = F.when(F.size("f.left") > 0, F.array_join("f.left", " "))
    return d.select("_row", pattern.alias("pattern"), "f.start", "f.end", "f.instance", "f.seed").filter(F.col("pattern").isNotNull() & (F.col("start") < F.col("end")))


def pattern_confidence(found: DataFrame, p: PiiParams) -> DataFrame:
    """(pattern, confidence, seeds), written: the iterative scores of the pattern-instance graph.

    The graph has an edge for each distinct (pattern, instance), so that copies and hot patterns
    are pre-aggregated. Seeds keep confidence 1; other instances start at 0. Scores are written
    before they are joined, so that adaptive execution can split a pattern or instance of many edges.
    """
    edges = materialize(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    score = materialize(edges.groupBy("pattern").agg(F.avg("seed").alias("confidence"), F.sum("seed").alias("seeds")), "scores")
    for _ in range(p.rounds - 1):
        # noisy or over an instance's patterns; a pattern vouches with what its support warrants
        vouch = F.col("confidence") * F.col("seeds") / (F.col("seeds") + 1)
        told = edges.filter("seed = 0").join(score.filter("seeds > 0"), "pattern")
        sure = materialize(told.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - vouch, F.lit(1e-9)))))).alias("sure")), "sure")
        # instances that only their one pattern vouches for would confirm it; they keep that share
        new = edges.join(sure, "instance", "left").groupBy("pattern").agg(F.avg(F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("sure", F.lit(0.0)))).alias("confidence"), F.sum("seed").alias("seeds"))
        new = materialize(new, "scores")
        discard(score, sure)
        score = new
    discard(edges)
    return score


def _with_discovered(rows: DataFrame, p: PiiParams) -> DataFrame:
    """rows of scanned() with every: base and discovered spans."""
    found = mentions(rows)
    good = materialize(pattern_confidence(found, p).filter((F.col("confidence") >= p.confidence) & (F.col("seeds") >= p.support)).select("pattern"), "good")
    one = F.struct("start", "end", F.lit(len(BASE)).alias("kind"))
    new = materialize(found.filter("seed = 0").join(good, "pattern").groupBy("_row").agg(F.collect_list(one).cast(SPANS).alias("new")), "discovered")
    out = rows.join(new, "_row", "left")
    return out.withColumn("every", _sorted(F.concat("spans", F.coalesce("new", F.array().cast(SPANS)))))


def personal_data(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """docs (doc_id, text and any others but spans) with spans: base kinds 0 to 3, and 4 for discovered ones.

    A null text counts as empty; repeated rows are judged one by one with equal results and do not
    weigh more in the graph; a discovered span never overlaps a base span.
    """
    out = _with_discovered(scanned(docs, p, keep=True), p)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "spans"], F.col("every").alias("spans"))


def pii_digest(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """The contract's columns; texts are read once, not written and take part in no join."""
    out = _with_discovered(scanned(docs.select("doc_id", "text"), p, keep=False), p)
    counts = [count_kind(F.col("spans"), i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return out.select("doc.doc_id", *counts, F.sha2(written(F.col("spans"), _NAMES), 256).alias("base_sha256"), written(F.col("every"), _NAMES).alias("spans"))
