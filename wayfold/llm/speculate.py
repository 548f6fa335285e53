"""Operator 11: BPE by speculation: greedy longest matches, verified pair by pair, and exact merging of what fails.

A slice of texts is split into words, and each word that the worker has not met yet is proposed as
the greedy sequence of longest tokens. A sequence is the exact encoding if each token encodes to
itself and no two neighbours would have merged across their border, which is tested for all
distinct neighbours of the slice at once: the merges of both tokens are undone along the border,
the latest first, and a border merge that ranks before the one undone last condemns the pair. Words
with such a pair are merged exactly. Texts are put together from words with numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.text import slices


@dataclass(frozen=True)
class SpeculateParams:
    """tokenizer: path of a byte-level BPE file as in public_tokenizers; pattern splits texts into words.

    special: whether the strings of special tokens in a text become these tokens. words_kept and
    bytes_kept bound a worker's memory of words, slice_bytes the text that is worked at once. Failing words of more than long_word
    bytes are merged by a queue, the others together, a round for each merge.
    """

    tokenizer: str
    pattern: str
    special: bool = True
    words_kept: int = 200_000
    bytes_kept: int = 8 << 20
    slice_bytes: int = 2 << 20
    long_word: int = 256


def default_params(special: bool = True) -> SpeculateParams:
    import public_tokenizers

    return SpeculateParams(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special)


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def unknown_letters() -> set[str]:
    """Letters and digits of the regex module that the tokenizers library does not know, as its Unicode version is older."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    words = ByteLevel(add_prefix_space=False).pre_tokenize_str
    new = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    return {c for kind, like in (("L", "a"), ("N", "1")) for c in regex.findall(rf"\p{{{kind}}}", new) if len(words(like + c + like)) > 1}


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Lookup:
    """Numbers by 64-bit keys: sorted arrays, -1 for a key that is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Merges:
    """A vocabulary with its ranked merges: proposals, their verification and exact merging, over many words at once.

    tokens: bytes by id; merges: (left id, right id, merged id) by rank; base: the id of each byte.
    """

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], base: np.ndarray):
        self.base, n = base.astype(np.int64), max(tokens) + 1
        m = np.array(merges, dtype=np.int64).reshape(-1, 3)
        self.rank = Lookup(m[::-1, 0] << 32 | m[::-1, 1], np.arange(len(m))[::-1])  # of repeated pairs the first
        self.made = m[:, 2]
        self.ranks = {(int(a), int(b)): int(r) for r, (a, b) in zip(range(len(m) - 1, -1, -1), m[::-1, :2], strict=True)}
        # a token may be proposed if it encodes to itself; its last merge gives its two halves
        ids = np.array(sorted(tokens), dtype=np.int64)
        out, counts, last = self._rounds([tokens[i] for i in ids.tolist()])
        own = (counts == 1) & (out[np.cumsum(counts) - counts] == ids)
        self.sound = ids[own]
        self.last, self.left, self.right = np.full(n, -1), np.arange(n), np.arange(n)
        self.last[self.sound] = last[own]
        halved = self.sound[last[own] >= 0]
        self.left[halved], self.right[halved] = m[self.last[halved], 0], m[self.last[halved], 1]
        self._tree([(i, tokens[i]) for i in self.sound.tolist()])

    def _tree(self, tokens: list[tuple[int, bytes]], dense: int = 2) -> None:
        """A tree of the tokens' bytes: step finds a node's child by byte, ends the token that a node completes.

        Nodes are numbered by depth. Those of up to `dense` bytes have a row of children each, which
        most steps use; the others' are looked up.
        """
        nodes: dict[int, int] = {}
        ends, depth = [-1], [0]
        for i, b in tokens:
            at = 0
            for k, x in enumerate(b):
                at = nodes.setdefault(at << 8 | x, len(ends))
                if at == len(ends):
                    ends.append(-1)
                    depth.append(k + 1)
            ends[at] = i
        order = np.argsort(np.array(depth), kind="stable")
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(len(order))
        self.ends = np.array(ends, dtype=np.int64)[order]
        keys = np.fromiter(nodes, dtype=np.int64, count=len(nodes))
        keys, to = new[keys >> 8] << 8 | keys & 255, new[np.fromiter(nodes.values(), dtype=np.int64, count=len(nodes))]
        n = int(np.searchsorted(np.array(depth)[order], dense, side="right"))
        self.dense, self.shallow = dense, np.full(n << 8, -1, dtype=np.int32)
        here = keys < n << 8
        self.shallow[keys[here]] = to[here]
        self.step = Lookup(keys[~here], to[~here])

    def propose(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): of each word (one after the other in data) the greedy longest tokens, and how many."""
        stop = np.repeat(np.cumsum(lengths), lengths)
        at, node = np.arange(len(data)), self.shallow[data].astype(np.int64)
        best, size = self.base[data], np.ones(len(data), dtype=np.int64)
        depth = 1
        while len(at):
            going = at + depth < stop[at]
            at, node = at[going], node[going]
            key = node << 8 | data[at + depth]
            node = self.shallow[key].astype(np.int64) if depth <= self.dense else self.step(key)
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            ended = self.ends[node] >= 0
            best[at[ended]], size[at[ended]] = self.ends[node[ended]], depth
        starts, i, n, jump = [], 0, len(data), size.tolist()
        while i < n:
            starts.append(i)
            i += jump[i]
        starts = np.array(starts, dtype=np.int64)
        return best[starts], np.diff(np.searchsorted(starts, np.append(0, np.cumsum(lengths))))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether their bytes together encode to these two."""
        good = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            rank = self.rank(x << 32 | y)
            bad = (rank >= 0) & (rank < limit)
            good[at[bad]] = False
            p, q = self.last[x], self.last[y]
            going = ~bad & ((p >= 0) | (q >= 0))
            at, x, y, p, q = at[going], x[going], y[going], p[going], q[going]
            # the later merge is undone; at equal ranks the left one would have come first
            undo_left = p > q
            limit = np.where(undo_left, p, q + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, last rank) of words merged exactly: each round contracts each word's leftmost pair of least rank."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word, last = [], [], np.full(len(words), -1, dtype=np.int64)
        none = np.iinfo(np.int64).max
        while len(ids):
            rank = np.full(len(ids), none)
            inside = np.flatnonzero(word[1:] == word[:-1])
            found = self.rank(ids[inside] << 32 | ids[inside + 1])
            rank[inside[found >= 0]] = found[found >= 0]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            live = np.repeat(least < none, sizes)
            done_ids.append(ids[~live])
            done_word.append(word[~live])
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & live)
            hit = hit[np.unique(word[hit], return_index=True)[1]]
            last[word[hit]] = rank[hit]
            ids[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            ids, word = ids[live], word[live]
        every, of = np.concatenate([np.empty(0, np.int64), *done_ids]), np.concatenate([np.empty(0, np.int64), *done_word])
        order = np.argsort(of, kind="stable")
        return every[order], np.bincount(of, minlength=len(words)), last

    def _queue(self, word: bytes) -> list[int]:
        """The ids of one long word, merged exactly with a queue of pairs by rank and place."""
        ids = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, get, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], k = int(made[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def exact(self, words: list[bytes], long_word: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words merged exactly."""
        long = [len(w) > long_word for w in words]
        ids, counts, _ = self._rounds([w for w, k in zip(words, long, strict=True) if not k])
        if not any(long):
            return ids, counts
        short = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        lists = [np.array(self._queue(w), dtype=np.int64) if k else next(short) for w, k in zip(words, long, strict=True)]
        return np.concatenate(lists), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))

    def encode(self, words: list[bytes], long_word: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words: proposed, verified, and merged exactly where the proposal fails."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids, counts = self.propose(np.frombuffer(b"".join(words), dtype=np.uint8), lengths)
        word = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failed = np.unique(word[inside[bad]])
        if not len(failed):
            return ids, counts
        mended, sizes = self.exact([words[i] for i in failed.tolist()], long_word)
        every = np.concatenate([ids, mended])
        starts = np.cumsum(counts) - counts
        starts[failed], counts[failed] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return every[spread(starts, counts)], counts


class Splitter:
    """Splits texts into a pattern's words, special tokens apart, as a library of an older Unicode version than regex's does."""

    def __init__(self, pattern: str, special: Iterable[str] = ()):
        import regex

        self.words = regex.compile(pattern).findall
        names = sorted(special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.late = unknown_letters()
        self.as_other = dict.fromkeys(map(ord, self.late), "\ue000")

    def split(self, text: str, with_late: bool = False) -> list[str]:
        """The words of a text in order; a special token is one word. with_late: the text holds letters that are unknown there."""
        words = self._words_with_late if with_late else self.words
        if self.parts is None:
            return words(text)
        out = self.parts(text)
        if len(out) == 1:
            return words(text)
        return list(chain.from_iterable([x] if i % 2 else words(x) for i, x in enumerate(out)))

    def _words_with_late(self, text: str) -> list[str]:
        out, at = [], 0
        for w in self.words(text.translate(self.as_other)):
            out.append(text[at : at + len(w)])
            at += len(w)
        return out

    def all(self, texts: list[str | None]) -> tuple[list[list[str]], set[str]]:
        """split() of each text, and all different words."""
        out = [self.split(t) if t else [] for t in texts]
        every = set(chain.from_iterable(out))
        late = {w for w in every if not w.isascii() and not self.late.isdisjoint(w)}
        if late:
            out = [ws if late.isdisjoint(ws) else self.split(t, True) for ws, t in zip(out, texts, strict=True)]
            every = set(chain.from_iterable(out))
        return out, every


class WordPool:
    """The words that one Python worker has met, with their ids in one array; both are forgotten when they grow too large.

    encode gives (ids, counts) of new words; fixed holds words of one given id.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], words_kept: int, bytes_kept: int, fixed: dict[str, int] | None = None):
        self.encode, self.words_kept, self.bytes_kept, self.fixed = encode, words_kept, bytes_kept, fixed or {}
        self._forget()

    def _forget(self) -> None:
        self.number = {w: k for k, w in enumerate(self.fixed)}
        self.pool, self.counts = np.array(list(self.fixed.values()), dtype=np.int64), np.ones(len(self.fixed), dtype=np.int64)
        self.kept = 0

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.words_kept or self.kept > self.bytes_kept:
            self._forget()
            new = [w for w in words if w not in self.number]
        if new:
            ids, counts = self.encode(new)
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.pool, self.counts = np.append(self.pool, ids), np.append(self.counts, counts)
            self.kept += sum(map(len, new))

    def ids(self, words: list[list[str]], every: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of lists of words, one list after the other; every holds all different words."""
        self._learn(every)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sizes.sum())
        many = self.counts[numbers]
        ends = np.append(0, np.cumsum(many))[np.cumsum(sizes)]
        return self.pool[spread((np.cumsum(self.counts) - self.counts)[numbers], many)], np.diff(np.append(0, ends))


class Codec:
    """A tokenizer's tables and the words that one Python worker has met."""

    def __init__(self, lines: bytes, p: SpeculateParams):
        self.p, spec = p, json.loads(lines)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain byte-level BPE: {odd or pre}")
        letters = byte_letters()
        vocabulary, token = model["vocab"], {}
        for text, i in vocabulary.items():
            if all(c in letters for c in text):
                token[i] = bytes(letters[c] for c in text)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        base = np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        self.merges = Merges(token, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], base)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError("added tokens with conditions")
        self.splitter = Splitter(p.pattern, self.special if p.special else ())
        # the bytes of all tokens one after the other, for decoding
        token |= {i: s.encode() for s, i in self.special.items()}
        sizes = np.zeros(max(token) + 2, dtype=np.int64)
        for i, b in token.items():
            sizes[i] = len(b)
        self.token_sizes, self.token_at = sizes, np.cumsum(sizes) - sizes
        self.token_bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
        self.pool = WordPool(self._encode, p.words_kept, p.bytes_kept, self.special if p.special else None)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.encode([w.encode("utf-8", "replace") for w in words], self.p.long_word)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after the other, and how many each has."""
        return self.pool.ids(*self.splitter.all(texts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes behind each list of ids; ids outside the vocabulary have none."""
        ids = np.where((ids >= 0) & (ids < len(self.token_sizes)), ids, len(self.token_sizes) - 1)
        sizes = self.token_sizes[ids]
        data = self.token_bytes[spread(self.token_at[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_CODECS: dict[SpeculateParams, Codec] = {}


def codec_of(lines, p: SpeculateParams) -> Codec:
    """This worker's codec of a broadcast tokenizer file."""
    if p not in _CODECS:
        _CODECS.clear()
        _CODECS[p] = Codec(lines.value, p)
    return _CODECS[p]


def file_lines(df: DataFrame, p: SpeculateParams):
    """The tokenizer file, read by the driver and broadcast; its size is that of a vocabulary."""
    with open(p.tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def text_list(column: pa.Array) -> list[str | None]:
    """A column's texts; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, p: SpeculateParams) -> DataFrame:
    """docs (text and any columns) with ids array<int> added, in place of a column of that name.

    A null or empty text has no ids. Every row is encoded by itself.
    """
    docs, lines = docs.drop("ids"), file_lines(docs, p)

    def run(batches):
        for b in slices(batches, "text", p.slice_bytes):
            ids, counts = codec_of(lines, p).encode(text_list(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids, counts)], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, docs.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(coded: DataFrame, p: SpeculateParams) -> DataFrame:
    """coded (ids and any columns) with text added, in place of a column of that name: null or empty ids give an empty text.

    Null ids and ids outside the vocabulary have no bytes; bytes that are no UTF-8 become U+FFFD.
    """
    coded, lines = coded.drop("text").withColumn("ids", F.col("ids").cast("array<int>")), file_lines(coded, p)

    def run(batches):
        for b in batches:
            column = b.column("ids")
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            out = [x.decode("utf-8", "replace") for x in codec_of(lines, p).decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "text"])

    return coded.mapInArrow(run, coded.withColumn("text", F.lit("").cast("string")).schema)


def round_trip_digest(docs: DataFrame, p: SpeculateParams) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids.

    A null or empty text has no tokens and the hashes of nothing; repeated rows are returned as
    often as they come, rows without doc_id too; other columns are ignored.
    """
    docs, lines = docs.select("doc_id", "text"), file_lines(docs, p)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches, "text", p.slice_bytes):
            codec = codec_of(lines, p)
            ids, counts = codec.encode(text_list(b.column("text")))
            data, ends = ids.astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(counts))).tolist()
            back = [sha(x if x.isascii() else x.decode("utf-8", "replace").encode()) for x in codec.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array([sha(data[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
