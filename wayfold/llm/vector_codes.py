"""Operator 12: vectors compressed to one byte for each of their parts by codebooks of integers.

A vector's components become integers, floor(scale * x), and the vector is cut into equal parts.
Each part position has a codebook, which the driver broadcasts: its size is fixed by the
parameters. Arrow batches find each part's nearest entry by norm expansion with exact integer
matrix products; a task adds its parts up by entry, a grouped shuffle merges these sums, and the
driver divides. All numbers are exact: batches whose values are too large for 64 bits are worked
with Python's integers, and sums travel in limbs of LIMB bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.storage import materialize

LIMB = 31


@dataclass(frozen=True)
class CodeParams:
    """parts of a vector, entries of a codebook (256 at most), rounds of improvement, and the integers in 1.0.

    broadcast_labels is the most labels whose summed errors are broadcast; more are joined.
    """

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    vector: str = "embedding"
    broadcast_labels: int = 50_000

    def __post_init__(self):
        if not (0 < self.entries <= 256 and self.parts > 0 and self.rounds >= 0):
            raise ValueError("1 to 256 entries, at least one part")


def _whole(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _long_as(vectors: DataFrame, p: CodeParams) -> int | None:
    """The length that most vectors have, of those that can be cut into parts; the shorter one on a tie."""
    n = F.size(p.vector)
    row = vectors.groupBy(n.alias("n")).agg(F.count("*").alias("k")).filter((F.col("n") > 0) & (F.col("n") % p.parts == 0)).orderBy(F.desc("k"), "n").first()
    return row["n"] if row else None


def kept_vectors(df: DataFrame, p: CodeParams = CodeParams()) -> tuple[DataFrame, int]:
    """df's rows with a usable vector, and its length (0 without any row).

    Rows are left out whose vector is null, holds a null or non-finite component, or has not the
    length that most others have (a positive multiple of p.parts; the shorter on a tie).
    """
    whole = df.filter(_whole(p.vector))
    n = _long_as(whole, p)
    return (whole.filter(F.size(p.vector) == n), n) if n else (whole.limit(0), 0)


def _integer(x: float, scale: int) -> int:
    return floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers if some are too large."""
    most = np.abs(values).max(initial=0.0)
    if most * scale < 2**52:
        return np.floor(values.astype(np.float64) * scale).astype(np.int64)
    return np.array([_integer(float(x), scale) for x in values.ravel()], dtype=object).reshape(values.shape)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of vectors (n x parts x width) by codebooks (parts x entries x width), each n x parts.

    |x - c|^2 = |x|^2 - 2 xc + |c|^2; the first of equally near entries is taken.
    """
    most, width = max(_largest(vectors), _largest(codebooks)), vectors.shape[2]
    kind = np.int64 if 4 * width * most * most < 2**62 else object
    x, c = vectors.astype(kind), codebooks.astype(kind)
    codes, errors = np.empty(x.shape[:2], dtype=np.int64), np.empty(x.shape[:2], dtype=kind)
    every = np.arange(len(x))
    for k in range(x.shape[1]):
        far = (c[k] * c[k]).sum(axis=1)[None, :] - 2 * (x[:, k] @ c[k].T)
        codes[:, k] = np.argmin(far, axis=1)
        errors[:, k] = far[every, codes[:, k]] + (x[:, k] * x[:, k]).sum(axis=1)
    return codes, errors


def _numbers(batch: pa.RecordBatch, p: CodeParams, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(p.vector))
    return _integers(column.flatten().to_numpy(zero_copy_only=False), p.scale).reshape(batch.num_rows, p.parts, width)


def first_entries(vectors: DataFrame, p: CodeParams = CodeParams(), key: str = "vec_id") -> np.ndarray:
    """parts x entries x width: the parts of the p.entries vectors of least key; fewer vectors make fewer entries.

    A key that several rows have counts once, with the least of its vectors; rows without one do
    not count. Only these vectors come to the driver.
    """
    keyed = vectors.filter(F.col(key).isNotNull())
    # few rows are enough unless keys repeat among the first; then all distinct keys are asked
    ids = sorted({r[0] for r in keyed.select(key).orderBy(key).limit(p.entries).collect()})
    if len(ids) < p.entries:
        ids = [r[0] for r in keyed.select(key).distinct().orderBy(key).limit(p.entries).collect()]
    least = keyed.filter(F.col(key).isin(ids)).groupBy(key).agg(F.min(p.vector).alias("v")).collect() if ids else []
    rows = [[_integer(x, p.scale) for x in r["v"]] for r in sorted(least, key=lambda r: r[0])]
    every = np.array(rows, dtype=object)
    return every.reshape(len(rows), p.parts, -1).transpose(1, 0, 2) if rows else np.empty((p.parts, 0, 0), dtype=object)


def _limbs(total: int) -> list[int]:
    """The signed digits of a sum, the least first."""
    out, sign, rest = [], -1 if total < 0 else 1, abs(total)
    while rest:
        out.append(sign * (rest & (2**LIMB - 1)))
        rest >>= LIMB
    return out


def entry_sums(vectors: DataFrame, codebooks: np.ndarray, p: CodeParams) -> list:
    """Rows (part, entry, limb, n, s0, s1, ...): for each entry in use the number of its parts and their sums by component.

    A task adds up all its batches before it gives rows, so the shuffle holds a few rows for each
    entry and task, and the driver gets those of the codebooks' size.
    """
    width, shared = codebooks.shape[2], vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        books = shared.value
        counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=object)
        for b in batches:
            x = _numbers(b, p, width)
            codes, _ = nearest(x, books)
            exact = x if _largest(x) * max(1, len(x)) < 2**62 else x.astype(object)
            for k in range(p.parts):
                order = np.argsort(codes[:, k], kind="stable")
                used, at = np.unique(codes[order, k], return_index=True)
                if len(used):
                    sums[k, used] += np.add.reduceat(exact[order, k], at, axis=0).astype(object)
                    counts[k, used] += np.diff(np.append(at, len(order)))
        rows = []
        for k, e in zip(*np.nonzero(counts), strict=True):
            digits = [_limbs(int(s)) for s in sums[k, e]]
            for i in range(max(1, *map(len, digits))):
                rows.append((int(k), int(e), i, 0 if i else int(counts[k, e]), *[d[i] if i < len(d) else 0 for d in digits]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4 + width)], names=names)

    names = ["part", "entry", "limb", "n", *[f"s{i}" for i in range(width)]]
    partial = vectors.select(p.vector).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return partial.groupBy("part", "entry", "limb").agg(*[F.sum(n).alias(n) for n in names[3:]]).collect()


def improved(codebooks: np.ndarray, rows: list) -> np.ndarray:
    """Each entry in use becomes the componentwise floor of its parts' mean; the others stay."""
    counts, sums = {}, {}
    for r in rows:
        at = (r["part"], r["entry"])
        counts[at] = counts.get(at, 0) + r["n"]
        here = sums.setdefault(at, [0] * codebooks.shape[2])
        sums[at] = [s + (x << (LIMB * r["limb"])) for s, x in zip(here, r[4:], strict=True)]
    out = codebooks.copy()
    for (k, e), total in sums.items():
        out[k, e] = [s // counts[k, e] for s in total]
    return out


def fit_codebooks(vectors: DataFrame, p: CodeParams = CodeParams(), key: str = "vec_id") -> np.ndarray:
    """Codebooks (parts x entries x width) of kept_vectors(): the first entries, improved p.rounds times over all rows."""
    books = first_entries(vectors, p, key)
    for _ in range(p.rounds if books.size else 0):
        books = improved(books, entry_sums(vectors, books, p))
    return books


def compress(vectors: DataFrame, codebooks: np.ndarray, p: CodeParams = CodeParams()) -> DataFrame:
    """vectors with code binary (a byte a part) and error long in place of the vector and of columns of these names.

    error is the squared distance to the decoded vector in integers, null if it exceeds 64 bits.
    """
    rest = vectors.drop("code", "error")
    names, width = [n for n in rest.columns if n != p.vector], codebooks.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for b in batches:
            codes, errors = nearest(_numbers(b, p, width), shared.value)
            far = errors.astype(object).sum(axis=1) if len(errors) else []
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(n)) for n in names), pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()), pa.array([int(e) if e < 2**63 else None for e in far], pa.int64())],
                names=[*names, "code", "error"])

    shape = rest.drop(p.vector).withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}).schema
    return rest.mapInArrow(run, shape)


def decompress(coded: DataFrame, codebooks: np.ndarray, p: CodeParams = CodeParams()) -> DataFrame:
    """coded (code and any columns) with decoded array<double>: the entries that the code names, in units of 1.0. A null code gives null."""
    coded = coded.drop("decoded")
    entries = F.broadcast(coded.sparkSession.createDataFrame([([[[int(v) / p.scale for v in e] for e in part] for part in codebooks],)], "books array<array<array<double>>>"))
    at = lambda i: F.conv(F.substring(F.hex("code"), i * 2 + 1, 2), 16, 10).cast("int")
    parts = F.transform("books", lambda book, i: book[at(i)])
    return coded.join(entries).withColumn("decoded", F.when(F.col("code").isNotNull(), F.flatten(parts))).drop("books")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def code_digest(df: DataFrame, p: CodeParams = CodeParams()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row of df (vec_id, embedding, label, any others).

    code is in hexadecimal; label_error sums the errors of rows with one label, null labels
    together, and is null if the sum exceeds 64 bits. See kept_vectors() for the rows that are left out. Repeated rows are
    returned as often as they come; rows without vec_id or label are coded too, but if no row has a
    vec_id there is no entry and all codes are null; an empty table gives an empty result.
    """
    vectors, n = kept_vectors(df.select("vec_id", p.vector, "label"), p)
    books = fit_codebooks(vectors, p) if n else np.empty((p.parts, 0, 0), dtype=object)
    if not books.shape[1]:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
        return vectors.select("vec_id", *nothing, F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
    coded = materialize(compress(vectors, books, p), "codes")
    # a sum of decimals holds what one of longs would not; it is null as soon as one error is
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    labels = materialize(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels")
    labels = F.broadcast(labels) if labels.count() <= p.broadcast_labels else labels
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """The assignment to the codebooks of round k and the codebooks of the next one."""
    return f"""
d{k} AS (SELECT x.n, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON c.p = x.p AND c.i = x.i GROUP BY 1, 2, 3),
a{k} AS (SELECT n, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d{k} GROUP BY 1, 2),
m{k} AS (SELECT x.p, a.e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS k FROM x JOIN a{k} a ON a.n = x.n AND a.p = x.p GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, c.i, CASE WHEN m.k IS NULL THEN c.v ELSE (m.s - ((m.s % m.k) + m.k) % m.k) // m.k END AS v
  FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e AND m.i = c.i)"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, embedding AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT n, (j - 1) // w AS p, (j - 1) % w AS i, CAST(floor(256 * CAST(z AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT n, w, unnest(v) AS z, generate_subscripts(v, 1) AS j FROM v)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, i, v FROM x WHERE n <= 64),{_round_sql(0)},{_round_sql(1)},
d2 AS (SELECT x.n, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c2 c ON c.p = x.p AND c.i = x.i GROUP BY 1, 2, 3),
a2 AS (SELECT n, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d2 GROUP BY 1, 2),
r AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN r USING (n), h"""
