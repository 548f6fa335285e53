"""Operator 1: quality rules and cross-document line frequency, in built-in functions only.

For figures the texts are read once: a written table holds, for each row, the base rules' figures and its lines
as (hash of the normalised line, words). Lines are counted, compared and joined by their hashes. clean(), which
returns the texts, reads them twice instead: they are neither written nor shuffled besides its result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.storage import materialize

_SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityParams:
    """A line is common on a host (column host) if more than max(least_docs, host_percent % of the
    host's documents) distinct documents hold it; exact copies of a text are one document. A document
    is depleted if its common lines hold more than depleted_percent % of its words. min_words and repeat_percent are the base rules.
    broadcast_lines is the most common lines that clean() broadcasts; for more, rows are joined with theirs.
    """

    host: str = "source"
    least_docs: int = 20
    host_percent: int = 2
    depleted_percent: int = 70
    min_words: int = 50
    repeat_percent: int = 50
    broadcast_lines: int = 100_000


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once.

    A lambda must not name a column that is itself an expression: when a filter or a projection is
    merged with the one below, the expression takes the column's place and is computed for each
    element. A lambda's own variable cannot be replaced so.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def _normal(text: Column) -> Column:
    """Lower case, runs of white space within a line as one space; lines keep one space at their ends."""
    spaced = F.regexp_replace(F.lower(text), F.lit(r"[\x09\x0B-\x0D]"), F.lit(" "))
    return F.regexp_replace(spaced, F.lit(r"\x20{2,}"), F.lit(" "))


def line_key(line: Column) -> Column:
    """64 bits of the normalised line's hash; null for a line without a word."""
    return bound(F.trim(_normal(line)), lambda x: F.when(x != "", F.xxhash64(x)))


def line_keys(text: Column) -> Column:
    """array<struct<line, words>> of the lines with a word, in order."""
    lines = F.transform(F.split(_normal(text), "\n", -1), F.trim)
    words = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long")
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("words")))


def _covered(w: Column) -> Column:
    """How many of the words lie in a three-word window that is found twice or more."""
    windows = F.when(F.size(w) >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))

    def of_places(at):
        # each repeated window covers three words, less what the next one covers again
        gaps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_sorted(p):
        same = lambda x, j: F.coalesce(x["g"] == F.get(p, j)["g"], F.lit(False))
        return bound(F.sort_array(F.array_compact(F.transform(p, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])))), of_places)

    def of_windows(g):
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), bound(placed, of_sorted)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(bound(windows, of_windows), F.lit(0).cast("long"))


def _figures(text: Column) -> Column:
    """One struct with the contract's counts of a text; every array in it is computed once."""
    of_words = bound(_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _covered(w).alias("n_repeat_words")))
    some = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    copies = bound(some, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    return F.struct(of_words.alias("w"), symbols.alias("n_symbols"), copies.alias("n_dup_lines"))


def _base_failed(n: Column, again: Column, p: QualityParams) -> Column:
    return (n < p.min_words) | (F.lit(100) * again > F.lit(p.repeat_percent) * n)


def base_rules(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added."""
    d = docs.withColumn("_f", bound(F.coalesce("text", F.lit("")), _figures))
    n, again = F.col("_f.w.n_words"), F.col("_f.w.n_repeat_words")
    return d.withColumns({
        "n_words": n, "word_chars": F.col("_f.w.word_chars"), "n_symbols": F.col("_f.n_symbols"),
        "n_dup_lines": F.col("_f.n_dup_lines"), "n_repeat_words": again, "base_failed": _base_failed(n, again, p),
    }).drop("_f")


def _host(p: QualityParams) -> Column:
    return F.coalesce(F.col(p.host).cast("string"), F.lit(""))


def rated_rows(docs: DataFrame, p: QualityParams, keep: bool) -> DataFrame:
    """A written table of docs: _row (a key of the row), doc (its columns, or doc_id alone unless keep),
    host, copy (hash of the whole text), lines and the columns of base_rules()."""
    doc = F.struct("*") if keep else F.struct("doc_id")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), doc.alias("doc"), _host(p).alias("host"), "text")
    d = d.withColumns({"copy": F.xxhash64(F.coalesce("text", F.lit(""))), "lines": line_keys(F.coalesce("text", F.lit("")))})
    return materialize(base_rules(d, p).drop("text"), "rated")


def _exploded(rated: DataFrame, *keys: str) -> DataFrame:
    # explode() would add a filter on the array's size
    return rated.select(*keys, "host", "copy", F.explode_outer("lines").alias("l")).filter("l is not null").select(*keys, "host", "copy", "l.line", "l.words")


def common_lines(rated: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(host, line), written: lines of rows (host, copy, lines) as in rated_rows() above their host's limit.

    Distinct documents of a line are its distinct (host, line, copy): exact copies of a text are one
    document, all others count each. Both counts are pre-aggregated, so no host's rows meet in one task.
    """
    hosts = rated.groupBy("host").agg(F.count("*").alias("docs"))
    held = _exploded(rated).select("host", "line", "copy").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > p.least_docs)
    out = held.join(hosts, "host").filter(F.lit(100) * F.col("n") > F.lit(p.host_percent) * F.col("docs"))
    return materialize(out.select("host", "line"), "common")


def judged(rated: DataFrame, p: QualityParams) -> DataFrame:
    """rated with n_common_words, common (line hashes, null without any) and kept added."""
    hit = _exploded(rated, "_row").join(common_lines(rated, p), ["host", "line"])
    gone = materialize(hit.groupBy("_row").agg(F.sum("words").alias("n_common_words"), F.collect_set("line").alias("common")), "gone")
    out = rated.join(gone, "_row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    depleted = F.lit(100) * F.col("n_common_words") > F.lit(p.depleted_percent) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """docs with base_rules() and n_common_words, common, kept added.

    kept is false if the base rules fail or the document is depleted. Null and empty texts have no
    words and fail; a null host is a host of its own; repeated rows are judged one by one, and rows
    that share a doc_id by their own texts; columns of docs with the added names are replaced.
    """
    added = [*_BASE, "n_common_words", "common", "kept"]
    out = judged(rated_rows(docs, p, keep=True), p)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in added], *added)


def quality_digest(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The contract's columns and n_common_words; texts are not written and take part in no join."""
    out = judged(rated_rows(docs.select("doc_id", "text", p.host), p, keep=False), p)
    return out.select("doc.doc_id", *_BASE, "kept", "n_common_words")


def _hits(lines: Column, common: Column) -> Column:
    """Struct of common (hashes of the lines that are common) and n_common_words."""
    words = lambda x, hit: F.aggregate(F.filter(x, lambda y: F.array_contains(hit, y["line"])), F.lit(0).cast("long"), lambda a, y: a + y["words"])
    held = lambda x: bound(F.array_intersect(F.transform(x, lambda y: y["line"]), common), lambda hit: F.struct(hit.alias("common"), words(x, hit).alias("n_common_words")))
    return bound(lines, held)


def _kept_rows(docs: DataFrame, p: QualityParams) -> DataFrame:
    """(doc, common) of the kept rows of docs: the columns as a struct, and the hashes of a row's common lines or null."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(_host(p).alias("host"), F.xxhash64(text).alias("copy"), line_keys(text).alias("lines"))
    common = common_lines(rows, p)
    if common.count() > p.broadcast_lines:
        return judged(rated_rows(docs, p, keep=True), p).filter("kept").select("doc", "common")
    of_host = F.broadcast(common.groupBy("host").agg(F.collect_list("line").alias("_common")))
    met = docs.select(F.struct("*").alias("doc"), _host(p).alias("host"), text.alias("text")).join(of_host, "host", "left")
    hits = F.when(F.col("_common").isNotNull(), _hits(line_keys(F.col("text")), F.col("_common")))
    # a filter would be put below a projection and the figures computed twice
    met = met.select("doc", F.explode_outer(F.array(F.struct(bound(F.col("text"), _figures).alias("f"), hits.alias("h")))).alias("x"))
    n, again, gone = F.col("x.f.w.n_words"), F.col("x.f.w.n_repeat_words"), F.coalesce("x.h.n_common_words", F.lit(0).cast("long"))
    kept = ~_base_failed(n, again, p) & ~(F.lit(100) * gone > F.lit(p.depleted_percent) * n)
    return met.filter(kept).select("doc", F.when(gone > 0, F.col("x.h.common")).alias("common"))


def clean(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The kept documents, without their common lines; columns as in docs, n_chars anew if present."""
    out = _kept_rows(docs, p)
    stays = lambda common: lambda x: ~F.coalesce(F.array_contains(common, line_key(x)), F.lit(False))
    rest = F.array_join(F.filter(F.split("doc.text", "\n", -1), stays(F.col("common"))), "\n")
    text = F.when(F.col("common").isNotNull(), rest).otherwise(F.col("doc.text"))
    named = {c: F.col("doc")[c] for c in docs.columns} | {"text": text}
    out = out.select(*[c.alias(n) for n, c in named.items()])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM d),
lo AS (SELECT doc_id, host, md5(t) AS cp, trim(regexp_replace(lower(unnest(string_split(t, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM d),
lc AS (SELECT doc_id, host, cp, line, len(string_split(line, ' ')) AS words FROM lo WHERE line <> ''),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY 1),
common AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT cp) AS n FROM lc GROUP BY 1, 2) JOIN hosts USING (host) WHERE n > 20 AND 100 * n > 2 * docs),
gone AS (SELECT doc_id, sum(words) AS n FROM lc JOIN common USING (host, line) GROUP BY 1),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) k(k) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_common_words
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * n_common_words > 70 * n_words) AS kept, n_common_words
FROM s"""
