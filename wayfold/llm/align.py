"""Operator 13: minimal groups of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

A token of A and one of B are linked if their byte ranges overlap; the connected components of
this bipartite graph are exactly the groups between byte offsets where tokens of both end. Neither
side has a token across the place before a space that follows something else, so a text is a
sequence of chunks, and each distinct chunk is aligned once: its tokens are encoded and its components
found by union-find, for many chunks at a time. A text then puts its chunks' groups together and adds
up their links.

A slice of documents hands on its different id pairs once, with their numbers, so that the
distributed counting shuffles a row for each pair and slice, not for each link. Each slice then gets the counts of its
own pairs back, which no task needs to hold for the whole corpus, and its documents add them up.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm import speculate
from wayfold.llm.speculate import SpeculateParams, spread, text_list
from wayfold.llm.text import slices
from wayfold.storage import materialize


@dataclass(frozen=True)
class AlignParams:
    """first: the byte-level tokenizer A; second: path of a SentencePiece model, B.

    slice_bytes of text share one table of pairs; of these, piece_chars are worked at once, so that
    a very long text is worked in pieces too. chunks_kept and chars_kept bound a worker's memory of aligned chunks.
    """

    first: SpeculateParams
    second: str
    chunks_kept: int = 120_000
    chars_kept: int = 4 << 20
    slice_bytes: int = 2 << 20
    piece_chars: int = 1 << 18


def default_params() -> AlignParams:
    import public_tokenizers

    # A meets new chunks only, so it need not keep many words
    first = replace(speculate.default_params(special=False), words_kept=40_000, bytes_kept=1 << 20)
    return AlignParams(first, public_tokenizers.path("piece_bpe_32k.model"))


def components(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for n nodes and edges (x, y): union-find over all edges at once.

    A round hooks the larger root of every edge below the smaller one and then halves all paths
    until each node points at its root; edges within a component fall out.
    """
    parent = np.arange(n)
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return parent


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the numbers of all tokens whose ranges overlap, in order. Both sides end at the same byte.

    Between two neighbouring ends of either side lie one token of A and one of B, and a pair of
    tokens overlaps in one such stretch only.
    """
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs, which are merged
    ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
    return tuple(_before(x, ends) for x in (a_ends, b_ends))


def _before(some: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of some, which all are among the ends, are less than each end."""
    marks = np.zeros(len(ends), dtype=np.int64)
    marks[np.searchsorted(ends, some)] = 1
    return np.cumsum(marks) - marks


def _added(of: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (of, pair) once, in order, with its times added up."""
    order = np.lexsort((pair, of))
    of, pair, times = of[order], pair[order], times[order]
    starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1]))[: len(of)])
    return of[starts], pair[starts], np.add.reduceat(times, starts) if len(starts) else times


def _bytes(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, data: np.ndarray) -> bytes:
    """The bytes of all ids, from a table of token bytes."""
    return data[spread(at[ids], sizes[ids])].tobytes()


def _ends_in_space(chunk: str) -> bool:
    return not chunk or chunk[-1].isspace()


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """Both tokenizers of one Python worker."""

    def __init__(self, first: bytes, second: bytes, p: AlignParams):
        import regex
        import sentencepiece

        self.a = speculate.Codec(first, p.first)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=second)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        pieces = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # where no piece goes on with a space after another character, B's merges never cross such a place
        self.chunked = not any("▁" in x.lstrip("▁") for x in names)
        self.chunks = regex.compile(r" (?:[^ ]|(?<=\s) )*").findall
        self.run = regex.compile(r"\s ").search
        self.gap = regex.compile(r"(?<=\S) (?=\S)").search
        self.space = self.model.piece_to_id("▁")
        self._forget()
        self.sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        self.at, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # a token's text in a group: with what follows it
        m = len(self.a.token_sizes)
        self.shown = [f"{i}{c}" for c in ",|" for i in range(m)] + [f"{i}{c}" for c in (",", ";", "") for i in range(n)]
        self.m, self.n, self.p = m, n, p

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.good, self.figures = np.empty(0, dtype=bool), np.empty((len(FIGURES), 0), dtype=np.int64)
        self.pair, self.times, self.n_pairs, self.met = (np.empty(0, dtype=np.int64) for _ in range(4))
        self.kept = 0

    def _forget_rare(self) -> None:
        """Keep the chunks that were met most often, a quarter of chunks_kept and of chars_kept at most."""
        names, limit = list(self.number), self.p.chunks_kept // 4
        stay = np.argsort(-self.met, kind="stable")[:limit]
        sizes = np.cumsum([len(names[i]) for i in stay.tolist()])
        stay = np.sort(stay[(self.met[stay] > 1) & (4 * sizes < self.p.chars_kept)])
        link = spread((np.cumsum(self.n_pairs) - self.n_pairs)[stay], self.n_pairs[stay])
        self.pair, self.times = self.pair[link], self.times[link]
        self.good, self.figures, self.n_pairs, self.met = self.good[stay], self.figures[:, stay], self.n_pairs[stay], self.met[stay] // 2
        self.number = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.groups = [self.groups[i] for i in stay.tolist()]
        self.kept = sum(map(len, self.number))

    def _learn(self, chunks: set[str], chars: int) -> None:
        """Align the chunks that are not known yet, about so many characters at a time."""
        new = [c for c in chunks if c not in self.number]
        if len(self.number) + len(new) > self.p.chunks_kept or self.kept > self.p.chars_kept:
            self._forget_rare()
            new = [c for c in chunks if c not in self.number]
        at, done = 0, []
        new.sort(key=_ends_in_space)
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) < chars):
                size += len(new[end]) + 1
                end += 1
            good, figures, groups, (of, pair, times) = self._align(new[at:end])
            self.groups += groups
            done.append((good, np.array(figures), pair, times, np.bincount(of, minlength=end - at), np.zeros(end - at, dtype=np.int64)))
            self.kept += size
            at = end
        if done:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            add = lambda old, k, axis=0: np.concatenate([old, *(d[k] for d in done)], axis=axis)
            self.good, self.figures = add(self.good, 0), add(self.figures, 1, 1)
            self.pair, self.times, self.n_pairs, self.met = add(self.pair, 2), add(self.times, 3), add(self.n_pairs, 4), add(self.met, 5)

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a text that begins with a space, each without its first space."""
        if not self.chunked:
            return [text[1:]]
        if self.run(text) is None:
            return text[1:].split(" ")
        return [c[1:] for c in self.chunks(text)]

    def cut(self, text: str, chars: int) -> list[str]:
        """The text in pieces of about so many characters, each from the second on with the space that begins it."""
        out, at = [], 0
        while self.chunked and len(text) - at > chars and (gap := self.gap(text, at + chars)):
            out.append(text[at : gap.start()])
            at = gap.start()
        return [*out, text[at:]]

    def align(self, texts: list[str | None], chars: int, digest: bool) -> dict:
        """For the texts together: figures of each, its groups as text or SHA-256, and its links as numbers of all different pairs."""
        n, pieces = len(texts), [(i, x) for i, t in enumerate(texts) if t for x in self.cut(f" {t}", chars)]
        figures, bad = np.zeros((len(FIGURES), n), dtype=np.int64), np.zeros(n, dtype=bool)
        written: list[list[str]] = [[] for _ in texts]
        shas: dict = {}
        held, at = [], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= chars):
                size += len(pieces[end][1])
                end += 1
            chunks = [self._chunks(x) for _, x in pieces[at:end]]
            self._learn(set(chain.from_iterable(chunks)), chars)
            numbers = list(map(self.number.__getitem__, chain.from_iterable(chunks)))
            shown, low = list(map(self.groups.__getitem__, numbers)), 0
            for (i, _), c in zip(pieces[at:end], chunks, strict=True):
                groups = ";".join(shown[low : low + len(c)])
                low += len(c)
                if not digest:
                    written[i].append(groups)
                elif i in shas:
                    shas[i].update(b";" + groups.encode())
                else:
                    shas[i] = hashlib.sha256(groups.encode())
            of = np.repeat([i for i, _ in pieces[at:end]], [len(c) for c in chunks])
            k = len(self.groups)
            met, often = np.unique(of * k + np.array(numbers, dtype=np.int64), return_counts=True)
            of, chunk = met // k, met % k
            self.met += np.bincount(chunk, minlength=k)
            bad[of[~self.good[chunk]]] = True
            for f, x in zip(figures, self.figures, strict=True):
                f += np.bincount(of, weights=x[chunk] * often, minlength=n).astype(np.int64)  # far below 2^53
            many = self.n_pairs[chunk]
            link = spread((np.cumsum(self.n_pairs) - self.n_pairs)[chunk], many)
            held.append(_added(np.repeat(of, many), self.pair[link], self.times[link] * np.repeat(often, many)))
            at = end
        text, pair, times = (np.concatenate([np.empty(0, np.int64), *(h[k] for h in held)]) for k in range(3))
        kept = ~bad[text]
        text, pair, times = _added(text[kept], pair[kept], times[kept])
        pairs, links = np.unique(pair, return_inverse=True)
        figures[:, bad] = 0
        some = lambda i: texts[i] and not bad[i]
        groups = ["" if not some(i) else shas[i].hexdigest() if digest else ";".join(written[i]) for i in range(n)]
        seen = np.bincount(links, weights=times, minlength=len(pairs)).astype(np.int64)
        return dict(zip(FIGURES, figures, strict=True)) | {"groups": groups, "pairs": pairs, "seen": seen, "links": links, "times": times, "per_text": np.bincount(text, minlength=n)}

    def _second(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of B for chunks without the space that the model puts before each; it puts none before an empty one."""
        lists = [x if c else [self.space] for c, x in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=counts.sum()), counts

    def _align(self, chunks: list[str]) -> tuple:
        """(good, figures, groups, (chunk, pair, times)) of chunks without their first space: whether their tokens give them back, and their different pairs.

        Chunks that end in white space stand last. The others are encoded as one text, which is cut by the
        bytes of its tokens; if the bytes do not fit, each chunk is encoded by itself.
        """
        n, k = len(chunks), next((i for i, c in enumerate(chunks) if _ends_in_space(c)), len(chunks))
        texts = [" " + " ".join(chunks[:k])] * (self.chunked and k > 0) + [f" {c}" for c in chunks[k if self.chunked else 0 :]]
        a, _ = self.a.encode(texts)
        b, _ = self._second([t[1:] for t in texts])
        whole = "".join(texts).encode("utf-8", "replace")
        good = np.ones(n, dtype=bool)
        if whole == _bytes(a, self.a.token_sizes, self.a.token_at, self.a.token_bytes) == _bytes(b, self.sizes, self.at, self.data):
            ends = np.cumsum([len(c.encode("utf-8", "replace")) + 1 for c in chunks])
            a_n, b_n = (np.diff(np.append(0, np.searchsorted(np.cumsum(sizes), ends, side="right"))) for sizes in (self.a.token_sizes[a], self.sizes[b]))
        else:
            texts = [f" {c}" for c in chunks]
            a, a_n = self.a.encode(texts)
            b, b_n = self._second(chunks)
            for i, (t, x, y) in enumerate(zip(texts, np.split(a, np.cumsum(a_n)[:-1]), np.split(b, np.cumsum(b_n)[:-1]), strict=True)):
                good[i] = t.encode("utf-8", "replace") == _bytes(x, self.a.token_sizes, self.a.token_at, self.a.token_bytes) == _bytes(y, self.sizes, self.at, self.data)
            a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
            a_n, b_n = np.where(good, a_n, 0), np.where(good, b_n, 0)
        i, j = overlaps(np.cumsum(self.a.token_sizes[a]), np.cumsum(self.sizes[b]))
        root = components(i, len(a) + j, len(a) + len(b))
        first = root[: len(a)] == np.arange(len(a))  # each component's least token is one of A
        a_group = np.cumsum(first) - 1
        b_group = a_group[root[len(a) :]]
        text_of = np.repeat(np.arange(n), a_n)
        of = text_of[i]
        figures = [a_n, b_n, np.bincount(text_of[first], minlength=n), np.bincount(of, minlength=n)]
        groups = self._written(a, b, a_group, b_group, a_n + b_n, np.cumsum(b_n))
        return good, figures, groups, _added(of, a[i] << 32 | b[j], np.ones(len(of), dtype=np.int64))

    def _written(self, a, b, a_group, b_group, sizes, b_ends) -> list[str]:
        """Each text's groups, a1,a2|b1;a3|b2: tokens are put in their places by counting those of the groups before."""
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        b_before = np.append(0, np.cumsum(np.bincount(b_group, minlength=n_groups)))
        a_until = np.cumsum(np.bincount(a_group, minlength=n_groups))
        code = np.empty(len(a) + len(b), dtype=np.int64)
        last_a = np.append(a_group[1:] != a_group[:-1], True)[: len(a)]
        last_b = np.append(b_group[1:] != b_group[:-1], True)[: len(b)].astype(np.int64)
        last_b[b_ends[b_ends > 0] - 1] = 2
        code[np.arange(len(a)) + b_before[a_group]] = last_a * self.m + a
        code[np.arange(len(b)) + a_until[b_group]] = 2 * self.m + last_b * self.n + b
        tokens, ends = list(map(self.shown.__getitem__, code.tolist())), np.append(0, np.cumsum(sizes)).tolist()
        return ["".join(tokens[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


_ALIGNERS: dict[AlignParams, Aligner] = {}


def _aligner(first, second, p: AlignParams) -> Aligner:
    """This worker's aligner of two broadcast files."""
    if p not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[p] = Aligner(first.value, second.value, p)
    return _ALIGNERS[p]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, p: AlignParams, digest: bool = False) -> DataFrame:
    """Written rows of two kinds, which slice ties together.

    A row for each document: docs' columns without text, n_a, n_b, n_groups, n_links, groups (as
    text, or its SHA-256 if digest), links (numbers among the slice's pairs) and times of each. A
    row for each slice: pairs (A id << 32 | B id, in order) and seen, the slice's links of each; links is null there.
    Columns of these names are replaced. Texts that are null or empty, or that the tokens do not give back,
    have no tokens: zeros and an empty text.
    """
    own = [("slice", "long"), *((c, "long") for c in FIGURES), ("groups", "string"), ("links", "array<int>"), ("times", "array<int>"), ("pairs", "array<long>"), ("seen", "array<long>")]
    docs = docs.drop(*[c for c, _ in own])
    context = docs.sparkSession.sparkContext
    with open(p.second, "rb") as f:
        second = context.broadcast(f.read())
    first = speculate.file_lines(docs, p.first)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for s in slices(batches, "text", p.slice_bytes):
            number += 1
            x = _aligner(first, second, p).align(text_list(s.column(s.schema.get_field_index("text"))), p.piece_chars, digest)
            groups = x["groups"]
            kept = [s.column(s.schema.get_field_index(c)) for c in rest]
            none = lambda kind: pa.nulls(len(groups), kind)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(len(groups), number), pa.int64()), *(pa.array(x[c], pa.int64()) for c in FIGURES), pa.array(groups, pa.string()),
                 _lists(x["links"], x["per_text"], pa.int32()), _lists(x["times"], x["per_text"], pa.int32()), none(pa.list_(pa.int64())), none(pa.list_(pa.int64()))],
                names=[*rest, *names])
            one = np.array([len(x["pairs"])])
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, k.type) for k in kept), pa.array([number], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in FIGURES), pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), _lists(x["pairs"], one, pa.int64()), _lists(x["seen"], one, pa.int64())],
                names=[*rest, *names])

    names = [c for c, _ in own]
    shape = docs.drop("text").withColumns({c: F.lit(None).cast(t) for c, t in own}).schema
    for field in shape.fields:
        field.nullable = True
    return materialize(docs.mapInArrow(run, shape), "aligned")


def _slice_pairs(table: DataFrame) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("pairs", "seen"))
    return table.filter("links is null").select("slice", zipped.alias("at", "x")).select("slice", "at", F.col("x.pairs").alias("pair"), F.col("x.seen").alias("seen"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best) of aligned(): how many links corpus-wide hold the two ids, and whether no pair of this B id has more."""
    counts = _slice_pairs(table).groupBy("pair").agg(F.sum("seen").alias("n"))
    # a B id has as many pairs as A has ids at most
    highest = F.max("n").over(W.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def id_pairs(docs: DataFrame, p: AlignParams) -> DataFrame:
    """(a_id, b_id, n, best) over all documents: see pair_counts()."""
    counts = pair_counts(aligned(docs, p, digest=True))
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n", "best")


def with_counts(table: DataFrame) -> DataFrame:
    """The documents of aligned() with n_best, the links whose pair is the best of its B id, and count_sum, the counts of all links' pairs added up.

    The counts go back to the slices that hold the pair; a slice's documents and counts meet in one group, whose size is that of a slice.
    """
    counts = pair_counts(table).select("pair", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    answers = _slice_pairs(table).select(F.col("slice").alias("of"), "at", "pair").join(counts, "pair").select("of", "at", "n")
    documents = table.filter("links is not null").drop("pairs", "seen")
    names = [c for c in documents.columns if c not in ("slice", "links", "times")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, dtype=np.int64)
        n[right.column("at").to_numpy()] = right.column("n").to_numpy()
        links, times = (left.column(c).combine_chunks() for c in ("links", "times"))
        ends = np.append(0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False)))
        held, often = n[links.flatten().to_numpy()], times.flatten().to_numpy()
        added = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        out = {c: left.column(c) for c in names}
        return pa.table(out | {"n_best": pa.array(added(np.where(held > 0, often, 0)), pa.int64()), "count_sum": pa.array(added(np.abs(held) * often), pa.int64())})

    shape = documents.select(*names, F.lit(None).cast("long").alias("n_best"), F.lit(None).cast("long").alias("count_sum")).schema
    return documents.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(run, shape)


def align(docs: DataFrame, p: AlignParams) -> DataFrame:
    """docs (text and any columns), text left out, with n_a, n_b, n_groups, n_links, groups, n_best and count_sum added in place of such columns.

    groups is a1,a2|b1;a3|b2,b3: ids of A and B in order. Every row counts, repeated ones too.
    """
    return with_counts(aligned(docs.drop("n_best", "count_sum"), p))


def alignment_digest(docs: DataFrame, p: AlignParams) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text, any others).

    Texts that are null or empty, or whose tokens do not give the text back, have zeros and ''.
    Repeated rows are counted and returned as often as they come; an empty table gives an empty result.
    """
    got = with_counts(aligned(docs.select("doc_id", "text"), p, digest=True))
    return got.select("doc_id", *FIGURES, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
