"""Operator 10: near-duplicate documents by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm.text import mix, shingles_of_each, slices, space_words, word_hashes
from wayfold.operators.components import connected_components
from wayfold.storage import discard, materialize

U4 = np.uint32


@dataclass(frozen=True)
class NearDupParams:
    """words in a shingle; Jaccard limit in percent; bands x rows coordinates of the signature.

    24 bands of 5 rows miss a pair at similarity 0.85 with probability (1 - 0.85^5)^24, under
    1e-6. leaders bounds the members of a bucket that one round compares with the others.
    broadcast_rows is the most ids that are broadcast to find their texts; more are joined.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5
    leaders: int = 256
    broadcast_rows: int = 200_000


def _fmix(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit numbers."""
    x = (x ^ (x >> U4(16))) * U4(0x85EBCA6B)
    x = (x ^ (x >> U4(13))) * U4(0xC2B2AE35)
    return x ^ (x >> U4(16))


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row a set: coordinate k is the least pi(sigma(x) + k) over the set.

    sigma places the items on a circle of 2^32 cells and pi permutes the cells; the same pi
    shifted by k cells serves as the k-th permutation. Sets must not be empty.
    """
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    cells = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(U4)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.empty((len(sets), coordinates), dtype=U4)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat(_fmix(cells + U4(k)), starts)
    return out


def _shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    words = [space_words(t) for t in texts]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = word_hashes(list(chain.from_iterable(words)))
    return [np.unique(s) for s in shingles_of_each(hashes, lengths, n)]


def _signature_batches(p: NearDupParams):
    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            sets = _shingle_sets(b.column("text").to_pylist(), p.shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(sets), p.bands), dtype=np.int64)
            if full:
                sig = circulant_signatures([sets[i] for i in full], p.bands * p.rows).astype(np.uint64).reshape(len(full), p.bands, p.rows)
                key = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), (len(full), p.bands))
                for r in range(p.rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                bands[full] = key.astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, p.bands), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    lists,
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _set_batches(n: int):
    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            sets = [s.astype(np.int64) for s in _shingle_sets(b.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return run


def texts_of(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows of docs whose doc_id is in ids (id): ids are broadcast if they are at most `most`."""
    small = ids.limit(most + 1).count() <= most
    keys = ids.select(F.col("id").alias("doc_id"))
    return docs.join(F.broadcast(keys) if small else keys, "doc_id", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, written; pairs is a written table.

    Only sets of these pairs are shuffled: their ids are broadcast if they are at most p.broadcast_rows.
    """
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    small = ids.count() <= p.broadcast_rows
    sets = sets.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        .filter(F.lit(100) * F.col("both") >= F.lit(p.percent) * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )
    links = materialize(found, "links")
    discard(ids)
    return links


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not yet in one component."""
    a, b = (labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _ceil_div(x, y: int):
    return F.floor((x + (y - 1)) / y).cast("long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(item, id, n, pos, short) of sets (id, items): the rarest items of each set, if another set has them too.

    Two sets that reach the similarity share one of the n - ceil(percent n / 100) + 1 rarest items of
    the larger and one of the n - ceil(2 percent n / (100 + percent)) + 1 rarest (short) of the
    smaller, in any order that holds for all sets; this one is by frequency among the given sets.
    A set that is given again counts once.
    """
    rows = sets.select("id", F.size("items").cast("long").alias("n"), F.explode("items").alias("item")).distinct()
    often = rows.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    placed = rows.join(often, "item", "left").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("x"))
    n = F.col("n")
    reach = n - _ceil_div(n * percent, 100) + 1
    near = n - _ceil_div(n * (2 * percent), 100 + percent) + 1
    cut = placed.select("id", "n", near.alias("near"), F.posexplode(F.slice("x", F.lit(1), reach.cast("int"))).alias("pos", "i"))
    return cut.filter("i.df > 1").select("i.item", "id", "n", "pos", (F.col("pos") < F.col("near")).alias("short"))


def link_classes(buckets: DataFrame, sets_for, p: NearDupParams) -> DataFrame:
    """(id, component) of all members that are linked, from buckets (bucket, id, n).

    First every member is compared with the least id of its buckets: with the least of these, then
    with the others that are still in another component. Buckets whose members then lie in one component are done. The members of
    the others would be pairs in numbers that grow with the square of a bucket, so they are put into
    finer buckets, one for each of their rarest items (prefixes()), which no link can escape. There up
    to p.leaders short members of a bucket are compared with its members in other components and
    then are short no more, until no bucket has a short member and two components. So no
    candidate link is lost, while the pairs of a round stay linear in the bucket's size.
    """
    size_fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(p.percent) * F.greatest(x, y)
    head = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("members")).filter("members > 1")
    live = materialize(buckets.join(head.select("bucket", "head"), "bucket"), "buckets")
    heads = materialize(
        live.filter((F.col("id") != F.col("head.id")) & size_fits(F.col("n"), F.col("head.n")))
        .select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = materialize(sets_for(live.select("id").distinct()), "sets")
    first = materialize(heads.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = _linked(first, sets, p)
    labels = materialize(connected_components(links, "a", "b"), "labels")
    more = _linked(materialize(_apart(heads.join(first, ["a", "b"], "left_anti"), labels), "pairs"), sets, p)
    if not more.isEmpty():
        links = materialize(links.union(more), "links")
        labels = materialize(connected_components(links, "a", "b"), "labels")
    at = live.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialize(live.select("bucket", "id").join(mixed, "bucket").select("id").distinct(), "open")
    discard(live, heads)
    if open_.isEmpty():
        discard(sets)
        return labels
    rest = materialize(prefixes(sets.join(open_, "id", "left_semi"), p.percent), "prefixes")
    while True:
        at = rest.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        alive = at.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("short").alias("s")).filter("lo < hi and s").select("item")
        left = materialize(at.join(alive, "item"), "prefixes")
        discard(rest)
        if left.isEmpty():
            discard(sets)
            return labels
        lead = left.filter("short").withColumn("r", F.row_number().over(W.partitionBy("item").orderBy("id"))).filter(F.col("r") <= p.leaders)
        lead = materialize(lead.select("item", F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("pos").alias("lpos"), F.col("comp").alias("lcomp")), "lead")
        # what two sets can share from their first common item on
        most = 1 + F.least(F.col("n") - 1 - F.col("pos"), F.col("ln") - 1 - F.col("lpos"))
        fits = (F.col("comp") != F.col("lcomp")) & (F.col("n") >= F.col("ln")) & size_fits(F.col("n"), F.col("ln")) & (most * (100 + p.percent) >= (F.col("n") + F.col("ln")) * p.percent)
        new = materialize(left.join(lead, "item").filter(fits).select(*_ordered("id", "lid")).distinct(), "pairs")
        found = _linked(new, sets, p)
        if not found.isEmpty():
            links = materialize(links.union(found), "links")
            labels = materialize(connected_components(links, "a", "b"), "labels")
        used = lead.select("item", F.col("lid").alias("id"), F.lit(True).alias("used"))
        rest = left.join(used, ["item", "id"], "left").select("item", "id", "n", "pos", (F.col("short") & F.col("used").isNull()).alias("short"))


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, any others).

    Texts with one shingle set form a class, so copies cost one comparison at most; only class
    representatives are banded and compared. A null or empty text has no shingles and stays
    alone. A repeated row is returned again with the same values; a doc_id with several texts is
    linked by any of them; rows without doc_id take the component of their text and are never kept. An empty
    table gives an empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sig = materialize(docs.mapInArrow(_signature_batches(p), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    classes = materialize(
        sig.filter("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "id", "n")
    sets_for = lambda ids: texts_of(docs, ids, p.broadcast_rows).dropDuplicates(["doc_id", "text"]).mapInArrow(_set_batches(p.shingle), "id long, items array<long>")
    labels = link_classes(buckets, sets_for, p)
    of_class = classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("class_component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
sym AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT sym.y, reach.r FROM reach JOIN sym ON sym.x = reach.x WHERE reach.r < sym.y),
c AS (SELECT x, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id"""
