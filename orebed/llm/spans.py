"""Spans of a text: what the secret and personal-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

SPAN = "struct<kind:string,start:long,end:long>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(docs: DataFrame, kinds: tuple[str, ...], find: Callable, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base_spans and spans (arrays of kind, start, end; code points, end exclusive).

    ``find(text)`` returns base spans and all spans as (start, kind number, end)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(found):
        return [{"kind": kinds[k], "start": s, "end": e} for s, k, e in sorted(found)]

    def run(batches):
        for batch in batches:
            found = [find(t or "") for t in batch.column(1).to_pylist()]
            base, every = (pa.array([listed(f[i]) for f in found], SPAN_TYPE) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), base, every], names=["doc_id", "base_spans", "spans"])

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, base_spans array<{SPAN}>, spans array<{SPAN}>")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256 and spans as text."""

    def of(kind: str):
        return lambda span: span["kind"] == kind

    counts = [F.size(F.filter("base_spans", of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, kinds: tuple[str, ...], find: Callable, text_col: str, chars_col: str | None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets.

    Overlapping spans are replaced as one, named by the first.  A null text stays null.  ``chars_col``
    (None, or a column of ``docs``) is set to the code points of the new text."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col else None

    def clean(text):
        if not text:
            return text
        out, done = [], 0
        for s, k, e in sorted(find(text)[1]):
            if s >= done:
                out += [text[done:s], f"[{kinds[k].upper()}]"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            columns, texts = list(batch.columns), [clean(t) for t in batch.column(at).to_pylist()]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in batch.schema]))

    ready(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def has_any(data: bytes, wanted: bytes) -> bool:
    return len(data.translate(None, wanted)) < len(data)


def offsets(pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in the source of each character of a text made of pieces (source start, source
    end, characters).  A piece as long as its source maps one to one, another maps to all of its source."""
    starts, ends = [], []
    for s, e, n in pieces:
        if n == e - s:
            starts.append(np.arange(s, e))
            ends.append(np.arange(s + 1, e + 1))
        else:
            starts.append(np.full(n, s))
            ends.append(np.full(n, e))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]).astype(np.int64), np.concatenate([none, *ends]).astype(np.int64)
