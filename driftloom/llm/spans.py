"""Byte ranges of documents: keys, grouping by document and removal, shared by the substring operators.

A document is known by its id and a hash of its text; rows that repeat both count as one document, and each gets its
result. Null texts are empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

KEY = "doc_id long, h long"
_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def bodies_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), text; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def by_document(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def joined(bodies: DataFrame, other: DataFrame, how: str) -> DataFrame:
    same = bodies["doc_id"].eqNullSafe(other["doc_id"]) & (bodies["h"] == other["h"])
    return bodies.join(other, same, how).drop(other["doc_id"], other["h"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_spans(bodies: DataFrame, spans: DataFrame, keep_text: bool = True, least: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and, if asked for, spans and kept (bytes).

    spans: KEY, a, b, gone: byte ranges that may touch or overlap. Maximal runs of those with gone set are cut out if they
    have `least` bytes; n_shared counts the bytes in such runs of all ranges.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", spans array<struct<a:int,b:int>>, kept binary" * keep_text
    small_batches(bodies.sparkSession)
    grouped = saved(by_document(spans.distinct(), ["a", "b", "gone"], "spans"), "spans")
    pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans", "kept"][: 8 if keep_text else 6]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pairs, pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                gone = [x for x in merged([(x["a"], x["b"]) for x in own or () if x["gone"]]) if x[1] - x[0] >= least]
                shared = sum(b - a for a, b in merged([(x["a"], x["b"]) for x in own or ()]) if b - a >= least)
                kept = b"".join(data[s:e] for s, e in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)], strict=True))
                rows.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), shared, [{"a": a, "b": b} for a, b in gone], kept)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    return joined(bodies, grouped, "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
