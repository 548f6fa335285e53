"""Operator 3: benchmark decontamination by a broadcast hash set of normalised n-grams."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.text import U, mix, slices, utf8
from wayfold.storage import discard, materialize

#: Bytes of words: digits, letters (A-Z lower-cased) and all bytes of characters from U+0080 on.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class DecontamParams:
    """window: words of an n-gram. A document is contaminated if percent of its words are hit.

    block_bytes bounds the benchmark text that one broadcast holds: a larger benchmark is dealt
    into blocks by a hash of item_id, and the documents are scanned once a block. A block's index
    (see WindowIndex) takes 5 to 10 times its text, 40 times if no word comes twice: 160 MB at most.
    """

    window: int = 13
    percent: int = 5
    block_bytes: int = 4 << 20


def bench_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


def _fold(ids: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of the n numbers from each start on."""
    out = np.full(len(starts), U(seed * 64 + n), dtype=U)
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + ids[starts + i].astype(U))
    return out


class WindowIndex:
    """The windows of a block of items as arrays: by length, the sorted hashes of the distinct windows,
    where each stands in the items' word numbers (for verification), and its items.

    About 30 bytes a word of the items, and 130 a distinct word for the numbers of words.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [k for k, _ in items]
        flat, places = [], {}
        at = 0
        for k, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in bench_words(text)]
            if ids:
                n = min(window, len(ids))
                places.setdefault(n, []).append((at, len(ids) - n + 1, k))
                flat.append(np.array(ids, dtype=np.int32))
                at += len(ids)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        self.seed, self.by_length = 0, {}
        while not all(self._add(n, p) for n, p in places.items()):
            self.seed += 1  # two windows had one hash

    def _add(self, n: int, places: list[tuple[int, int, int]]) -> bool:
        starts = np.concatenate([np.arange(a, a + size) for a, size, _ in places])
        owners = np.concatenate([np.full(size, k, dtype=np.int32) for _, size, k in places])
        h = _fold(self.flat, starts, n, self.seed)
        order = np.lexsort((owners, h))
        h, starts, owners = h[order], starts[order], owners[order]
        new = np.append(True, h[1:] != h[:-1])
        first = starts[new][np.cumsum(new) - 1]
        if not self._same(self.flat, starts, first, n).all():
            return False
        once = new | np.append(True, owners[1:] != owners[:-1])
        bounds = np.append(np.cumsum(once)[new] - 1, once.sum())
        self.by_length[n] = (h[new], starts[new], bounds, owners[once])
        return True

    def _same(self, ids: np.ndarray, starts: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(len(starts), dtype=bool)
        for i in range(n):
            out &= ids[starts + i] == self.flat[first + i]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a verified window, and the items whose windows occur."""
        edges, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), dtype=np.int32, count=len(words))
        total = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (hashes, first, bounds, owners) in self.by_length.items():
            starts = np.flatnonzero(total[n:] - total[:-n] == n)
            if not len(starts):
                continue
            h = _fold(ids, starts, n, self.seed)
            j = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = hashes[j] == h
            starts, j = starts[found], j[found]
            found = self._same(ids, starts, first[j], n)
            starts, j = starts[found], j[found]
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + n, -1)
            for k in np.unique(j).tolist():
                items.update(self.names[o] for o in owners[bounds[k] : bounds[k + 1]].tolist())
        return np.cumsum(edges[:-1]) > 0, items


def _runs(hit: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.tolist()


def _scan_batches(index, with_text: bool):
    def run(batches):
        idx = index.value
        for b in slices(batches, "text"):
            n, spans, items = [], [], []
            for t, runs, known in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                words = bench_words(t)
                hit, owners = idx.scan(words)
                for start, end in zip((runs or [])[::2], (runs or [])[1::2], strict=True):
                    hit[start:end] = True
                n.append(len(words))
                spans.append(_runs(hit))
                items.append(sorted(owners.union(known or ())))
            kept = ["row", "text"] if with_text else ["row"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*kept, "n_words", "spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, p: DecontamParams):
    """Lists of items, each of at most about block_bytes of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // p.block_bytes) + 1

    def block(k):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        return [(r[0], r[1]) for r in part.select("item_id", "text").toLocalIterator()]

    return n, map(block, range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), keep_text: bool = True) -> DataFrame:
    """docs with n_words, spans (start, end, ... in words), n_hit, items and contaminated added.

    docs has text; keep_text says whether it is returned. A null or empty text has no words and no hits; items without words
    have no window; a window that several items hold counts for each; repeated rows are judged one
    by one, and columns of docs with the added names are replaced. An item_id is compared as text;
    a null one counts as the text 'null'.
    """
    added = ["n_words", "spans", "items", "n_hit", "contaminated"]
    docs = docs.drop(*added)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    # a document's own columns stay in one struct, so that no name of theirs meets one of the scan's
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if keep_text or c != "text"]
    out, before = docs.select(F.struct(*own).alias("row"), "text", F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items")), None
    n, blocks = _blocks(items, p)
    for k, block in enumerate(blocks):
        out = _scanned(out, WindowIndex(block, p.window), k < n - 1)
        if k < n - 1:
            # written, so that one block's index is in memory at a time
            out = materialize(out, "scanned")
            if before is not None:
                discard(before)
            before = out
    out = out.select("row.*", "n_words", "spans", "items")
    ends = F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    out = out.withColumn("n_hit", F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x))
    bad = (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(p.percent) * F.col("n_words"))
    return out.withColumn("items", F.array_sort("items")).withColumn("contaminated", bad)


def _scanned(out: DataFrame, index: WindowIndex, with_text: bool) -> DataFrame:
    """out (row, text, spans, items) with n_words, and with one block's hits added to spans and items; text is kept for more blocks only."""
    shared = out.sparkSession.sparkContext.broadcast(index)
    long, text = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    shape = [out.schema["row"], *[T.StructField("text", T.StringType())] * with_text, T.StructField("n_words", T.LongType()), T.StructField("spans", long), T.StructField("items", text)]
    return out.select("row", "text", "spans", "items").mapInArrow(_scan_batches(shared, with_text), T.StructType(shape))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """The contract's columns: the items' ids sorted as strings stand behind items_sha256."""
    found = contamination(docs.select("doc_id", "text"), benchmark, p, keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """docs without the contaminated documents; the columns stay as they are."""
    judged = contamination(docs.select(F.struct("*").alias("doc"), "text"), benchmark, p, keep_text=False)
    return judged.filter(~F.col("contaminated")).select("doc.*")


def mask_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without its hit words (spans as in contamination()); other characters stay."""
    if text is None or not spans:
        return text
    raw = utf8(text)
    marked, at, cut, word = raw.translate(_WORD_BYTES), 0, [], 0
    for w in marked.split():
        at = marked.index(w, at)
        if any(s <= word < e for s, e in zip(spans[::2], spans[1::2], strict=True)):
            cut.append((at, at + len(w)))
        at, word = at + len(w), word + 1
    out, last = [], 0
    for s, e in cut:
        out.append(raw[last:s])
        last = e
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(coalesce({_LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bw)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dwin.n, i, item_id FROM dwin JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN own USING (doc_id)"""
