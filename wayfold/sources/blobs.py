"""Documents, chunked blobs, positional rows, delimited and sectioned text, and decoded byte buffers."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.operators.relational import carry_forward


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a file that does not parse fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_documents(spark: SparkSession, folder: str, name: str = r"^(.*)\.json$") -> tuple[DataFrame, DataFrame]:
    """(documents, failed): (key, doc VARIANT) of the folder's files whose name fits, key its first group, and (key, reason)."""
    raw = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    raw = raw.filter(F.col("file").rlike(name)).select(F.regexp_extract("file", name, 1).alias("key"), F.try_parse_json("value").alias("doc"))
    return raw.filter("doc is not null"), raw.filter("doc is null").select("key", F.lit("invalid JSON").alias("reason"))


@F.pandas_udf(T.StringType())
def _inflate(chunks: pd.Series) -> pd.Series:
    def one(b):
        try:
            return zlib.decompress(b).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return chunks.map(one, na_action="ignore")


def decode_chunks(parts: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(documents, failed) of base64 slices (key, part, parts, chunk): texts (key, text), and keys with a reason.

    Parts must be 1 to parts, each once, and hold base64 of compressed UTF-8. A blob is one value of one row, as the format has it.
    """
    whole = parts.groupBy(key).agg(
        F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.countDistinct("part").alias("d"), F.max("parts").alias("want"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk"))), lambda x: x["chunk"]), "").alias("b64"))
    good = (F.col("lo") == 1) & (F.col("n") == F.col("want")) & (F.col("hi") == F.col("want")) & (F.col("d") == F.col("n"))
    texts = whole.filter(good).select(key, _inflate(F.try_to_binary("b64", F.lit("base64"))).alias("text"))
    failed = whole.filter(~good).select(key, F.lit("parts are not contiguous").alias("reason"))
    return texts.filter("text is not null"), failed.union(texts.filter("text is null").select(key, F.lit("corrupt data").alias("reason")))


def positional_rows(df: DataFrame, row: str, fields: Sequence[str], out: Sequence[str] | None = None) -> DataFrame:
    """A column for each field of an array row; rows of another length are dropped."""
    keep = out or fields
    return df.filter(F.size(row) == len(fields)).select(*[c for c in df.columns if c != row], *[F.col(row)[list(fields).index(f)].alias(f) for f in keep])


def rows_with_index(df: DataFrame, text: str, element: str) -> DataFrame:
    """df with source_index and row for each element of a JSON array text, counted from 0 before any filter."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.from_json(text, f"array<{element}>")).alias("source_index", "row"))


def delimited(lines: DataFrame, value: str, fields: int, number: str = "id") -> DataFrame:
    """(id, parts): lines split at most fields - 1 times; short ones and those without a leading integer are dropped."""
    parts = F.split(value, ",", fields)
    return lines.select(parts.alias("parts")).filter(F.size("parts") == fields).withColumn(number, F.trim(F.col("parts")[0]).try_cast("bigint")).filter(F.col(number).isNotNull())


def sectioned(lines: DataFrame, value: str, doc: str, pos: str, levels: Sequence[str], item: str) -> DataFrame:
    """(doc, pos, section_0 .., item): items with the heading of each level that stands above them.

    levels: a pattern for each heading level, group 1 its title; item likewise. A document's lines
    are a window, so its headings carry forward in line order.
    """
    out = lines
    for i, p in enumerate(levels):
        got = F.regexp_extract(value, p, 1)
        out = out.withColumn(f"section_{i}", F.when(got != "", got))
    for i in range(len(levels)):
        part = [doc, *[f"section_{j}" for j in range(i)]]
        out = carry_forward(out, f"section_{i}", part, pos)
    found = F.regexp_extract(value, item, 1)
    return out.withColumn("item", F.when(found != "", found)).filter("item is not null").select(doc, pos, *[f"section_{i}" for i in range(len(levels))], "item")


#: Size, name and format of the seven argument types, by number.
ARGUMENT_TYPES = {0: (1, "u8", "B"), 1: (2, "u16", "H"), 2: (4, "u32", "I"), 3: (1, "s8", "b"), 4: (2, "s16", "h"), 5: (4, "s32", "i"), 6: (4, "f32", "f")}


def _arguments(raw: bytes, names: Sequence[str], kinds: Sequence[int]) -> tuple[list | None, str | None]:
    at, out = 0, []
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        if kind not in ARGUMENT_TYPES:
            return None, f"unsupported type {kind}"
        size, label, code = ARGUMENT_TYPES[kind]
        at += -at % size
        if at + size > len(raw):
            return None, f"argument {i} exceeds the buffer"
        out.append((i, name, label, float(struct.unpack_from("<" + code, raw, at)[0]), at))
        at += size
    return out, None


def _decoded(raw: pd.Series, names: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    got = [(None, "no definition") if n is None else _arguments(bytes(b or b""), list(n), list(k)) for b, n, k in zip(raw, names, kinds, strict=True)]
    labels = ("index", "name", "type", "value", "raw_offset")
    args = [None if a is None else [dict(zip(labels, x, strict=True)) for x in a] for a, _ in got]
    return pd.DataFrame({"args": pd.Series(args, dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})


def decode_arguments(instructions: DataFrame, definitions: DataFrame, on: Sequence[str] = ("bank", "opcode")) -> DataFrame:
    """instructions (on, args_hex, any others) with decoded (args, error) by definitions (on, names, kinds).

    Little-endian values stand at offsets aligned to their size. Errors are values, not exceptions.
    """
    joined = instructions.join(definitions, list(on), "left").withColumn("_raw", F.unhex(F.coalesce("args_hex", F.lit(""))))
    shape = "args array<struct<index:int,name:string,type:string,value:double,raw_offset:int>>, error string"
    return joined.withColumn("decoded", F.pandas_udf(_decoded, shape)("_raw", "names", "kinds")).drop("_raw", "names", "kinds")


def substitute(instructions: DataFrame, calls: DataFrame, on: str, moves: str = "moves") -> DataFrame:
    """instructions with args_hex overlaid by bytes of each call's args_hex.

    moves: array of (target, source, size) in bytes; native overlay() on the hexadecimal text.
    """
    joined = instructions.join(calls.select(on, F.col("args_hex").alias("_call"), "call_id"), on)
    put = F.aggregate(moves, F.col("args_hex"), lambda a, m: F.overlay(a, F.substring(F.col("_call"), m["source"] * 2 + 1, m["size"] * 2), m["target"] * 2 + 1, m["size"] * 2))
    return joined.withColumn("args_hex", put).drop("_call")


def string_table(raw: bytes) -> list[tuple[int, str]]:
    """(id, text) of a little-endian string table: groups of consecutive ids, 64-bit offsets to UTF-16 or Shift-JIS texts."""
    at = 16 if raw[0] else 0
    wide, utf16 = raw[at + 2] == 2, bool(raw[at + 8])
    groups = struct.unpack_from("<i", raw, at + 12)[0]
    at += 24 if wide else 20
    size, code = (8, "<Q") if wide else (4, "<I")
    table = struct.unpack_from(code, raw, at)[0]
    at += 2 * size
    out = []
    for g in range(groups):
        index, first, last = struct.unpack_from("<3i", raw, at + g * (16 if wide else 12))
        for k in range(last - first + 1):
            start = struct.unpack_from(code, raw, table + (index + k) * size)[0]
            text = b""
            if 0 < start < len(raw):
                step, end = (2, start) if utf16 else (1, start)
                while end + step <= len(raw) and raw[end : end + step] != b"\0" * step:
                    end += step
                text = raw[start:end]
            out.append((first + k, text.decode("utf-16-le" if utf16 else "shift_jis", "replace")))
    return out


def read_string_tables(files: DataFrame) -> DataFrame:
    """(path, id, text, error) of binary files (path, content); a broken file gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    got = pd.DataFrame(string_table(bytes(content)), columns=["id", "text"]).assign(error=None)
                except (struct.error, IndexError) as e:
                    got = pd.DataFrame({"id": [None], "text": [None], "error": [str(e)]})
                got.insert(0, "path", path)
                yield got

    return files.select("path", "content").mapInPandas(run, "path string, id long, text string, error string")


def path_manifest(lines: DataFrame, value: str, pattern: str, fields: Sequence[str]) -> DataFrame:
    """A column for each group of the pattern in lines that name a path; other lines are dropped."""
    found = lines.filter(F.col(value).rlike(pattern))
    return found.select(value, *[F.regexp_extract(value, pattern, i + 1).alias(f) for i, f in enumerate(fields)])


def snapshot_path(snapshots: dict[str, str], key: str) -> str:
    """The file of a snapshot key; an unknown key raises."""
    if key not in snapshots:
        raise KeyError(f"unknown snapshot {key!r}; known are {', '.join(sorted(snapshots))}")
    return snapshots[key]


def lookup_document(spark: SparkSession, folder: str, key: str, schema: str, valid: str = "^[A-Za-z0-9_]+$", default: bool = False) -> DataFrame:
    """The rows of one key in a folder that write_by_key() wrote by the column `key`.

    Only that key's files are read. A key that does not fit the pattern raises; without rows the
    result is empty, or one row of nulls besides the key if default.
    """
    if not re.fullmatch(valid, key):
        raise ValueError(f"invalid key {key!r}")
    rows = spark.read.schema(f"{schema}, key string").json(folder).filter(F.col("key") == key)
    if not default:
        return rows
    empty = spark.createDataFrame([(key,)], "key string")
    return empty.join(rows, "key", "left").select(*rows.columns)
