"""Operator 8: substring dedup of paragraphs by MinHash banding.

Two sorts of paragraphs are compared across documents, both by shingles of five words.
Written paragraphs (lines of min_words or more) are banded by MinHash tuned for high recall, colliding
ones are verified by exact Jaccard. Sliding paragraphs (every min_words consecutive words) find
passages wherever they stand in a line: the least pair of shingles eight words apart is a sliding
paragraph's band key, so equal paragraphs always collide, and the colliding ones are verified by
the hash of the whole paragraph. Neighbouring sliding paragraphs with one key are a segment: equal segments are
counted as one, and only where different segments share a key are their paragraphs compared.
Documents that share a paragraph form components; the least document keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.near_dup import NearDupParams, circulant_signatures, link_classes, texts_of
from wayfold.llm.text import LOWER, U, mix, shingles, slices, space_words, utf8, word_hashes
from wayfold.operators.components import connected_components
from wayfold.storage import discard, materialize


@dataclass(frozen=True)
class PassageParams:
    """min_words: the least length of a paragraph. apart: how many words lie between the starts of a
    pair of shingles; more make keys more selective and segments shorter. near: shingle, similarity and bands for written
    paragraphs; 16 bands of 4 rows miss a pair at similarity 0.8 with probability under 3e-4.
    """

    min_words: int = 50
    apart: int = 8
    near: NearDupParams = NearDupParams(shingle=5, percent=80, bands=16, rows=4)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    size = len(x) - width + 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:size], x[width - step : width - step + size])


def _pairs(p: PassageParams) -> int:
    """How many pairs of shingles a paragraph has."""
    return p.min_words - p.near.shingle + 1 - p.apart


def paragraph_keys(hashes: np.ndarray, p: PassageParams) -> np.ndarray:
    """The band key of each sliding paragraph of a document's word hashes: its least pair of shingles."""
    if len(hashes) < p.min_words:
        return hashes[:0]
    s = shingles(hashes, p.near.shingle)
    return _sliding_min(mix(s[: -p.apart] * U(0x9E3779B97F4A7C15) + s[p.apart :]), _pairs(p))


def span_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive numbers, by doubling; none if there are fewer."""
    size, step, x = len(hashes) - width + 1, 1, hashes
    if size < 1:
        return hashes[:0]
    while step * 2 <= width:
        x = mix(x[:-step] * U(0x9E3779B97F4A7C15) + x[step:])
        step *= 2
    # two spans that overlap cover the width
    return mix(x[:size] * U(0xD6E8FEB86659FD93) + x[width - step : width - step + size] + U(width))


def segments(h: np.ndarray, lengths: np.ndarray, p: PassageParams) -> tuple[np.ndarray, ...]:
    """(text, key, hash, first paragraph, paragraphs, its hash's place) of each segment of several texts, whose word hashes stand one after the other.

    A segment holds fewer paragraphs than a paragraph has words, so its first and last paragraph
    make up its whole text.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < p.min_words:
        return none, h[:0], h[:0], none, none, none
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.flatnonzero(text[: len(h) - p.min_words + 1] == text[p.min_words - 1 :])  # no paragraph crosses texts
    if not len(place):
        return none, h[:0], h[:0], none, none, none
    k, d = paragraph_keys(h, p)[place], text[place]
    run = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    inside = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    starts = np.flatnonzero(inside % _pairs(p) == 0)
    m = np.diff(np.append(starts, len(k)))
    whole = span_hashes(h, p.min_words)[place]
    seg = mix(mix(whole[starts] * U(0x9E3779B97F4A7C15) + whole[starts + m - 1]) * U(0x9E3779B97F4A7C15) + m.astype(U))
    first = np.cumsum(lengths) - lengths
    return d[starts], k[starts], seg, place[starts] - first[d[starts]], m, place[starts]


def _window_batches(p: PassageParams):
    """The paragraphs of the wanted segments of each document."""

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            words = [space_words(t) for t in b.column("text").to_pylist()]
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            h = word_hashes(list(chain.from_iterable(words)))
            text, _, seg, _, m, place = segments(h, lengths, p)
            wanted = b.column("wanted")
            asked = pa.table({"text": np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy())), "seg": wanted.flatten().field("seg"), "hi": wanted.flatten().field("hi")})
            have = pa.table({"text": text, "seg": seg.astype(np.int64), "m": m, "place": place})
            hit = have.join(asked, ["text", "seg"], join_type="inner")
            text, seg, m, place, hi = (hit.column(x).to_numpy() for x in ("text", "seg", "m", "place", "hi"))
            off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            if len(off):
                whole = span_hashes(h, p.min_words)[np.repeat(place, m) + off]
                lo = b.column("doc_id").to_numpy()[np.repeat(text, m)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (whole.astype(np.int64), np.repeat(seg, m), off.astype(np.int32), lo, np.repeat(hi, m))], names=["whole", "seg", "off", "lo", "hi"])

    return run


def _run_batches(p: PassageParams):
    """Merge each document's repeated paragraphs, segment by segment, into maximal runs."""

    def run(batches):
        for b in batches:
            found = b.column("found")
            parts = found.flatten()
            runs = parts.field("runs")
            row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            counts = np.diff(runs.offsets.to_numpy())
            row, at = np.repeat(row, counts), np.repeat(parts.field("at").to_numpy(), counts).astype(np.int64)
            flat = runs.flatten()
            start = at + flat.field("off").to_numpy()
            end, lo = start + flat.field("n").to_numpy(), flat.field("lo").to_numpy()
            order = np.lexsort((start, row))
            row, start, end, lo = row[order], start[order], end[order], lo[order]
            if len(row):
                # the furthest end so far in the row: rows are told apart by an offset beyond all ends
                far = np.maximum.accumulate(row * (end.max() + 1) + end) - row * (end.max() + 1)
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > far[:-1])))
                row, start, end, lo = row[first], start[first], np.maximum.reduceat(end, first), np.minimum.reduceat(lo, first)
            ids = b.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(end - 1 + p.min_words, pa.int64()), pa.array(lo, pa.int64())], names=["doc_id", "start_word", "end_word", "kept_doc_id"])

    return run


def sliding_passages(docs: DataFrame, rows: DataFrame, p: PassageParams) -> DataFrame:
    """(doc_id, start_word, end_word, kept_doc_id): maximal runs of paragraphs that other documents hold.

    rows are the segments of docs. Small sides of joins on keys that many rows may share are written
    first, so that adaptive execution can split these keys.
    """
    classes = materialize(rows.groupBy("seg", "key", "m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "segments")
    keys = materialize(classes.groupBy("key").agg(F.min("lo").alias("klo"), F.max("hi").alias("khi"), F.count("*").alias("n")).filter("klo < khi").select("key", "n"), "keys")
    shared = materialize(classes.join(keys, "key").select("seg", "m", "lo", "hi", "n"), "shared")
    discard(classes, keys)
    # the only segment of its key: all of its paragraphs are repeated, and nowhere else
    one = F.array(F.struct(F.lit(0).alias("off"), F.col("m").alias("n"), "lo"))
    alone = shared.filter("n = 1").select("seg", one.alias("runs"))
    of_doc = materialize(shared.filter("n > 1").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct("seg", "hi")).alias("wanted")), "wanted")
    texts = texts_of(docs, of_doc.select(F.col("doc_id").alias("id")), p.near.broadcast_rows)
    windows = materialize(texts.join(of_doc, "doc_id").mapInArrow(_window_batches(p), "whole long, seg long, off int, lo long, hi long"), "windows")
    again = materialize(windows.groupBy("whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("whole", "lo"), "again")
    hits = windows.select("whole", "seg", "off").join(again, "whole")
    mixed = hits.groupBy("seg").agg(F.collect_set(F.struct("off", F.lit(1).alias("n"), "lo")).alias("runs"))
    runs = materialize(alone.union(mixed), "runs")
    discard(shared, of_doc, windows, again)
    found = rows.select("seg", "doc_id", "at").join(runs, "seg").groupBy("doc_id").agg(F.collect_list(F.struct("at", "runs")).alias("found"))
    return found.mapInArrow(_run_batches(p), "doc_id long, start_word long, end_word long, kept_doc_id long")


def _lines(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Word hashes of the texts, one after the other, their numbers of words, and (text, line number,
    first word, end) of the lines with at least `least` words."""
    words, lengths, out = [], [], []
    for k, t in enumerate(texts):
        first = len(words)
        for i, line in enumerate(utf8(t).translate(LOWER).split(b"\n")):
            at = len(words)
            words += line.split()
            if len(words) - at >= least:
                out.append((k, i, at - first, len(words) - first))
        lengths.append(len(words) - first)
    return word_hashes(words), np.array(lengths, dtype=np.int64), out


def _line_sets(texts: list[str | None], p: PassageParams):
    """_lines() and the set of shingles of each line; lines are longer than a shingle."""
    h, lengths, found = _lines(texts, p.min_words)
    if not found:
        return h, lengths, found, []
    every, first = shingles(h, p.near.shingle), np.cumsum(lengths) - lengths
    return h, lengths, found, [np.unique(every[first[k] + s : first[k] + e - p.near.shingle + 1]) for k, _, s, e in found]


_SCANNED = "doc_id long, at int, m int, key long, seg long, line int, n long, set_key binary, bands array<long>"


def _scan_batches(p: PassageParams):
    """A row for each segment (key, seg, m paragraphs from at on) and each line (m words from at on) of the texts."""
    n = p.near
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("m", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()), ("line", pa.int32()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def batch(size, **given):
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            ids = b.column("doc_id").to_numpy()
            h, lengths, found, sets = _line_sets(b.column("text").to_pylist(), p)
            text, key, seg, at, m, _ = segments(h, lengths, p)
            yield batch(len(text), doc_id=ids[text], at=at.astype(np.int32), m=m.astype(np.int32), key=key.astype(np.int64), seg=seg.astype(np.int64))
            if found:
                text, line, at, end = np.array(found).T
                doc, m = ids[text], end - at
                sig = circulant_signatures(sets, n.bands * n.rows).astype(U).reshape(len(sets), n.bands, n.rows)
                band = np.broadcast_to(np.arange(n.bands, dtype=U), (len(sets), n.bands))
                for r in range(n.rows):
                    band = mix(band * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, n.bands), pa.int32()), pa.array(band.astype(np.int64).ravel()))
                yield batch(len(doc), doc_id=doc, line=line, at=at, m=m, n=[len(x) for x in sets], set_key=[xxhash.xxh3_128_digest(x.tobytes()) for x in sets], bands=bands)

    return run


def _set_batches(p: PassageParams):
    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            _, _, found, sets = _line_sets(b.column("text").to_pylist(), p)
            text, lines = np.array([x[:2] for x in found], dtype=np.int64).reshape(-1, 2).T
            ids = b.column("doc_id").to_numpy()[text]
            named = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], names=["doc", "line"])
            yield pa.RecordBatch.from_arrays([named, pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "items"])

    return run


_ID = "struct<doc:bigint,line:int>"


def written_paragraphs(docs: DataFrame, lines: DataFrame, p: PassageParams) -> DataFrame:
    """(doc_id, start_word, end_word, kept_doc_id): lines with a near copy in another document."""
    sig = lines.select(F.struct(F.col("doc_id").alias("doc"), "line").alias("id"), F.col("at").cast("long").alias("start_word"), (F.col("at") + F.col("m")).cast("long").alias("end_word"), "n", "set_key", "bands")
    classes = materialize(sig.groupBy("set_key").agg(F.min("id").alias("id"), F.max("id").getField("doc").alias("hi"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    def sets_for(ids):
        texts = texts_of(docs, ids.select(F.col("id.doc").alias("id")).distinct(), p.near.broadcast_rows)
        return texts.dropDuplicates(["doc_id", "text"]).mapInArrow(_set_batches(p), f"id {_ID}, items array<long>").join(ids, "id", "left_semi")

    labels = link_classes(classes.select(F.explode("bands").alias("bucket"), "id", "n"), sets_for, p.near)
    of_class = classes.join(labels, "id", "left").select("set_key", "hi", F.coalesce("component", "id").alias("root"))
    # a component spans documents if its least and greatest document differ
    wide = of_class.groupBy("root").agg(F.max("hi").alias("hi")).filter(F.col("root.doc") < F.col("hi")).select("root")
    marked = materialize(of_class.join(wide, "root").select("set_key", F.col("root.doc").alias("kept_doc_id")), "marked")
    return sig.join(marked, "set_key").select(F.col("id.doc").alias("doc_id"), "start_word", "end_word", "kept_doc_id")


def repeated_passages(docs: DataFrame, p: PassageParams = PassageParams()) -> DataFrame:
    """A row for each passage that is repeated across documents: doc_id, kind, start_word, end_word (exclusive, in
    white-space words), kept_doc_id, kept, component_id.

    kind is passage (verbatim, min_words or more, maximal) or paragraph (a line with a near copy).
    The passage stays in kept_doc_id, its least document; component_id is the least document
    reachable over shared passages. Documents without a repeated passage have no row: null, empty
    and short texts never have one. Rows that repeat a doc_id are one document; rows without doc_id
    and other columns are ignored.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    scanned = materialize(docs.mapInArrow(_scan_batches(p), _SCANNED), "scanned")
    sliding = sliding_passages(docs, scanned.filter("line is null"), p).withColumn("kind", F.lit("passage"))
    written = written_paragraphs(docs, scanned.filter("line is not null"), p).withColumn("kind", F.lit("paragraph"))
    found = materialize(sliding.union(written).distinct(), "passages")
    discard(scanned)
    groups = connected_components(found.select("doc_id", "kept_doc_id").distinct(), "doc_id", "kept_doc_id")
    out = found.join(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")), "doc_id")
    return out.select("doc_id", "kind", "start_word", "end_word", "kept_doc_id", (F.col("doc_id") == F.col("kept_doc_id")).alias("kept"), "component_id")


def remove_passages(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (start, end); white space between other words stays."""
    if text is None or not spans:
        return text
    raw, out, at = utf8(text), [], 0
    gone = np.zeros(max(e for _, e in spans), dtype=bool)
    for s, e in spans:
        gone[s:e] = True
    for i, w in enumerate(raw.split()):
        s = raw.index(w, at)
        if i >= len(gone) or not gone[i]:
            out.append(raw[at : s + len(w)])
        at = s + len(w)
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")
