"""Operator 6: byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A partition's distinct words become token-position rows. A recursive query joins neighbouring
tokens with the merge table and contracts each word's leftmost pair of least rank, until no pair
is left; an ordered aggregation turns ids back into bytes. Only words that a worker has not met yet
are encoded and decoded, and its memory of words is bounded: a text's ids are those of its words in
order, and its decoded bytes are what the aggregation made of these ids. A long word is encoded in
blocks, whose seams are then mended: see Codec._long().
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.speculate import Splitter, text_list
from wayfold.llm.text import slices


@dataclass(frozen=True)
class BpeParams:
    """ranks: path of a file of base64 tokens and ranks, as in public_tokenizers; pattern splits texts.

    words_kept bounds a worker's memory of encoded words, chunk the words of one recursive query,
    slice_bytes the text that is encoded and decoded at once. Words of more than long_word bytes
    are encoded in blocks of that size.
    """

    ranks: str
    pattern: str
    words_kept: int = 200_000
    chunk: int = 20_000
    slice_bytes: int = 2 << 20
    long_word: int = 64


def default_params() -> BpeParams:
    import public_tokenizers

    return BpeParams(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: A round unnests each word to its pairs by position, joins them with the merge table and contracts
#: the leftmost pair of least rank; k packs rank and position, so its minimum is that pair.
_ENCODE = """
WITH RECURSIVE t(w, ids, live) AS (
  SELECT w, ids, true FROM start
  UNION ALL
  SELECT t.w, CASE WHEN k IS NULL THEN ids ELSE ids[:(k & 4294967295) - 1] || [(k >> 32)::INTEGER] || ids[(k & 4294967295) + 2:] END, k IS NOT NULL
  FROM t LEFT JOIN (
    SELECT w, min((g.m::BIGINT << 32) | u.pos) AS k FROM (
      SELECT w, (unnest(ids)::BIGINT << 32) | unnest(ids[2:]) AS lr, generate_subscripts(ids, 1) AS pos FROM t WHERE live
    ) u JOIN pairs g USING (lr) GROUP BY w) b ON b.w = t.w
  WHERE live)
SELECT w, ids, array_to_string(ids, ' ') AS joined FROM t WHERE NOT live
"""

#: Stands for no token, and is no Latin-1 character.
_MARK_ID, _MARK = -1, "\u0100"
#: Tokens are held as Latin-1 text, a character for each byte.
_DECODE = """
SELECT seq, string_agg(tok, '' ORDER BY pos) FROM (
  SELECT seq, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded
) JOIN vocabulary USING (id) GROUP BY seq
"""


class Codec:
    """The merge table, vocabulary and DuckDB connection of one Python worker."""

    def __init__(self, lines: bytes, p: BpeParams):
        import duckdb

        self.p = p
        ranks = self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.tokens = {i: t for t, i in ranks.items()}
        self.splitter = Splitter(p.pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.sound: dict[tuple[int, int], bool] = {}
        self._forget()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "tok": [t.decode("latin-1") for t in ranks], "n": pa.array([len(t) for t in ranks], pa.int32())})
        self.db.register("given", tokens)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.execute("""
            CREATE TABLE pairs AS
            SELECT (a.id::BIGINT << 32) | b.id AS lr, v.id AS m FROM (
              SELECT id, tok, unnest(range(1, n)) AS at FROM vocabulary) v
            JOIN vocabulary a ON a.tok = left(v.tok, v.at) JOIN vocabulary b ON b.tok = substr(v.tok, v.at + 1)""")
        self.db.execute("INSERT INTO vocabulary VALUES (?, ?, 0)", [_MARK_ID, _MARK])

    def _forget(self) -> None:
        self.joined: dict[str, str] = {}
        #: The bytes behind ids in decimal, joined by a space.
        self.back: dict[str, bytes] = {}

    def _contract(self, words: list[bytes]) -> list[tuple[list[int], str]]:
        """(ids, these in decimal joined by a space) of each word."""
        out: list = [None] * len(words)
        for at in range(0, len(words), self.p.chunk):
            part = words[at : at + self.p.chunk]
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(part), dtype=np.uint8)]))
            self.db.register("start", pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "ids": ids}))
            got = self.db.sql(_ENCODE).to_arrow_table()
            for w, x, text in zip(*(got.column(c).to_pylist() for c in ("w", "ids", "joined")), strict=True):
                out[at + w] = (x, text)
        return out

    def _seams_hold(self, seams: list[tuple[int, int]]) -> list[bool]:
        """For pairs of tokens whether their bytes together encode to these two."""
        new = [s for s in dict.fromkeys(seams) if s not in self.sound]
        if len(self.sound) + len(new) > self.p.words_kept:
            self.sound.clear()
            new = list(dict.fromkeys(seams))
        for s, (ids, _) in zip(new, self._contract([self.tokens[a] + self.tokens[b] for a, b in new]), strict=True):
            self.sound[s] = tuple(ids) == s
        return [self.sound[s] for s in seams]

    def _long(self, word: bytes, reach: int = 8) -> list[int]:
        """The ids of a long word: its blocks are encoded by themselves, then mended where they meet.

        A sequence of tokens is the word's encoding if each two neighbours are the encoding of their
        bytes, for the first merge across a border would also be made with these two alone. Within
        a block they are, so only seams are tested. Where one fails, `reach` tokens on both sides are
        encoded together and make a block of their own; reach doubles from round to round.
        """
        size = self.p.long_word
        blocks = [ids for ids, _ in self._contract([word[i : i + size] for i in range(0, len(word), size)])]
        while True:
            hold = self._seams_hold([(a[-1], b[0]) for a, b in zip(blocks, blocks[1:])])
            if all(hold):
                return list(chain.from_iterable(blocks))
            flat, ends = list(chain.from_iterable(blocks)), np.cumsum([len(b) for b in blocks]).tolist()
            windows: list[list[int]] = []
            for end, ok in zip(ends, hold):
                if not ok:
                    low, high = max(0, end - reach), min(len(flat), end + reach)
                    if windows and low <= windows[-1][1]:
                        windows[-1][1] = high
                    else:
                        windows.append([low, high])
            mended = self._contract([b"".join(map(self.tokens.__getitem__, flat[a:b])) for a, b in windows])
            # between the windows, blocks stay as they are but for what the windows took
            out, at, cuts = [], 0, iter(ends)
            end = next(cuts)
            for (low, high), (ids, _) in zip([*windows, [len(flat), len(flat)]], [*mended, ([], "")], strict=True):
                while at < low:
                    stop = min(end, low)
                    if at < stop:
                        out.append(flat[at:stop])
                    at = stop
                    if at == end:
                        end = next(cuts, len(flat))
                if ids:
                    out.append(ids)
                at = max(at, high)
                while end <= at and end < len(flat):
                    end = next(cuts, len(flat))
            blocks, reach = out, 2 * reach

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, and decode their ids."""
        new = [x for x in words if x not in self.joined]
        if len(self.joined) + len(new) > self.p.words_kept:
            self._forget()
            new = list(words)
        if not new:
            return
        coded = [x.encode("utf-8", "replace") for x in new]
        # a word that is a token is that token, whatever its merges
        out: list = [([r], str(r)) if (r := self.ranks.get(b)) is not None else None for b in coded]
        short = [i for i, b in enumerate(coded) if out[i] is None and len(b) <= self.p.long_word]
        for i, got in zip(short, self._contract([coded[i] for i in short]), strict=True):
            out[i] = got
        for i, b in enumerate(coded):
            if out[i] is None:
                ids = self._long(b)
                out[i] = (ids, " ".join(map(str, ids)))
        self.joined.update(zip(new, (text for _, text in out), strict=True))
        fresh = {text: ids for ids, text in out if text not in self.back}
        self.back.update(zip(fresh, self._decode_words(list(fresh.values())), strict=True))

    def _decode_words(self, words: list[list[int]], together: int = 256) -> list[bytes]:
        """decode() of many short lists: so many are aggregated as one, with a mark after each."""
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        flat = np.full(ends[-1], _MARK_ID, dtype=np.int32)
        flat[np.delete(np.arange(ends[-1]), ends - 1)] = np.fromiter(chain.from_iterable(words), dtype=np.int32, count=ends[-1] - len(words))
        cuts = np.append(np.append(0, ends)[:-1][::together], ends[-1]).astype(np.int32)
        texts = self._texts(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))
        return [x.encode("latin-1") for t in texts for x in t.split(_MARK)[:-1]]

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, each by its ids in decimal joined by a space; all of them are in back."""
        pieces, every = self.splitter.all(texts)
        self.learn(every)
        return [list(map(self.joined.__getitem__, x)) for x in pieces]

    def bytes_of(self, words: list[str]) -> bytes:
        """The bytes behind the ids of a text's words in order."""
        return b"".join(map(self.back.__getitem__, words))

    def _texts(self, ids: pa.ListArray) -> list[str]:
        """The tokens behind each list of ids, joined by an ordered aggregation of the (position, id) rows."""
        self.db.register("coded", pa.table({"seq": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": ids}))
        out = [""] * len(ids)
        got = self.db.sql(_DECODE).to_arrow_table()
        for i, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            out[i] = text
        return out

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes behind each list of ids."""
        return [t.encode("latin-1", "ignore") for t in self._texts(ids)]


def _ids(words: list[list[str]]) -> pa.Array:
    return pa.array([np.array(" ".join(x).split(), dtype=np.int32) for x in words], pa.list_(pa.int32()))


_CODECS: dict[tuple, Codec] = {}


def _codec(lines, p: BpeParams) -> Codec:
    if p not in _CODECS:
        _CODECS.clear()
        _CODECS[p] = Codec(lines.value, p)
    return _CODECS[p]


def _lines(df: DataFrame, p: BpeParams):
    """The rank file, read by the driver and broadcast; its size is that of a vocabulary."""
    with open(p.ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, p: BpeParams) -> DataFrame:
    """docs (text and any columns) with ids array<int> added, in place of a column of that name.

    A null or empty text has no ids. Every row is encoded by itself.
    """
    docs, lines = docs.drop("ids"), _lines(docs, p)

    def run(batches):
        for b in slices(batches, "text", p.slice_bytes):
            ids = _ids(_codec(lines, p).words(text_list(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, docs.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(coded: DataFrame, p: BpeParams) -> DataFrame:
    """coded (ids and any columns) with decoded binary added; null or empty ids give no bytes.

    Ids outside the vocabulary are skipped.
    """
    coded, lines = coded.drop("decoded"), _lines(coded, p)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = _codec(lines, p).decode(part.column("ids").cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, coded.withColumn("decoded", F.lit(None).cast("binary")).schema)


def encode_decode(docs: DataFrame, p: BpeParams) -> DataFrame:
    """docs with ids and round_trip added, text left out: round_trip is true if the decoded ids are the text."""
    docs, lines = docs.drop("ids", "round_trip"), _lines(docs, p)

    def run(batches):
        for b in slices(batches, "text", p.slice_bytes):
            codec, texts = _codec(lines, p), text_list(b.column("text"))
            words = codec.words(texts)
            same = [codec.bytes_of(x) == (t or "").encode("utf-8", "replace") for x, t in zip(words, texts, strict=True)]
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), _ids(words), pa.array(same)], names=[*keep, "ids", "round_trip"])

    schema = docs.drop("text").withColumns({"ids": F.lit(None).cast("array<int>"), "round_trip": F.lit(None).cast("boolean")}).schema
    return docs.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, p: BpeParams) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""
    docs, lines = docs.select("doc_id", "text"), _lines(docs, p)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches, "text", p.slice_bytes):
            codec = _codec(lines, p)
            words = codec.words(text_list(b.column("text")))
            joined, back = [" ".join(x) for x in words], [codec.bytes_of(x) for x in words]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x.count(" ") + 1 if x else 0 for x in joined], pa.int64()), pa.array([sha(x.encode()) for x in joined], pa.string()), pa.array([sha(x) for x in back], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
