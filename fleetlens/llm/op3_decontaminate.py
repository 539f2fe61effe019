"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by their number n of distinct shingles. An item whose containment in a document reaches the
threshold t misses at most n - ceil(t n) of its shingles there, so of its n - ceil(t n) + 1 smallest hashes (a
bottom-k MinHash whose length each size sets for itself) at least one occurs in the document, however long that is.
That makes the search complete: a sketch over the document, which would drown a short item, is not needed. Documents
probe with all their shingle hashes; the sketches are a small table whose physical join Spark picks by its size.
Candidates are verified on the shingles themselves.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, rolling, staged

SHINGLE = 5
CONTAINMENT = 0.8
_WORD = re.compile(r"[^\W_]+")

# The words differ from those of Python's class at few code points; the texts compared here hold none of them.
ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark
), widths AS (
  SELECT 5 AS width UNION SELECT DISTINCT len(words) FROM w WHERE kind = 'i' AND len(words) BETWEEN 1 AND 4
), s AS (
  SELECT DISTINCT kind, id, shingle FROM (
    SELECT kind, id, unnest([array_to_string(words[k:k+width-1], ' ') FOR k IN range(1, len(words) - width + 2)]) AS shingle
    FROM w JOIN widths ON CASE WHEN kind = 'i' THEN width = least(len(words), 5) ELSE width <= len(words) END)
), n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, round(count(*) / n, 6) AS containment
FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.item_id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], size: int = SHINGLE) -> list[tuple[str, ...]]:
    """Runs of ``size`` words; fewer words make one shingle, none make none."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


def _hashes(words: list[str], size: int) -> np.ndarray:
    """The distinct shingle hashes of one text."""
    known: dict[str, int] = {}
    values = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
    return np.unique(rolling(values, min(size, max(1, len(words)))))


def _short_widths(items: DataFrame, size: int) -> list[int]:
    """The numbers of words below ``size`` that items have."""
    kind = pa.schema([("width", pa.int32())])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {len(words_of(text)) for part in parts for text in part.column(0).to_pylist()}
        yield from batches(kind, (((n,), 4) for n in found if 0 < n < size))

    rows = items.select("text").mapInArrow(counted, "width int").distinct().collect()
    return sorted(r["width"] for r in rows)


def _doc_hashes(docs: DataFrame, size: int, widths: list[int]) -> DataFrame:
    """``doc_id``, ``hash`` for each distinct shingle of ``size`` words, and of each of ``widths``, of each row;
    ``docs`` has doc_id and text."""
    kind = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = words_of(text.as_py())
                    h = np.unique(np.concatenate([_hashes(words, w) for w in (size, *widths)]))
                    yield (i, h.view(np.int64)), 8 * len(h)
        return batches(kind, rows())

    return docs.mapInArrow(hashed, "doc_id long, hashes array<long>").select("doc_id", F.explode("hashes").alias("hash"))


def _sketches(items: DataFrame, size: int, least: float) -> DataFrame:
    """``item_id``, ``item`` (its text), ``hash``: the bottom hashes of each item, as many as its size needs."""
    kind = pa.schema([("item_id", pa.int64()), ("item", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = _hashes(words_of(text), size)
                    if len(h):
                        length = len(h) - math.ceil(round(least * len(h), 9)) + 1
                        yield (i, text, h[:length].view(np.int64)), len(text)
        return batches(kind, rows())

    return items.mapInArrow(sketched, "item_id long, item string, hashes array<long>").select(
        "item_id", "item", F.explode("hashes").alias("hash"))


def _containment(text: str | None, item: str | None, size: int) -> float:
    """Share of the item's distinct shingles that the text has."""
    wanted = set(shingles_of(words_of(item), size))
    if not wanted:
        return 0.0
    width = len(next(iter(wanted)))  # below ``size`` for an item of fewer words
    return len(wanted.intersection(shingles_of(words_of(text), width))) / len(wanted)


def leaks(docs: DataFrame, items: DataFrame, size: int = SHINGLE, least: float = CONTAINMENT,
          short: bool = True) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment`` for each document that holds ``least`` or more of an item's shingles.

    Words are runs of letters and digits in lower case, so case, punctuation and line breaks don't hide an item.
    An item of fewer than ``size`` words is one shingle of all of them and is found inside texts of any length; with
    ``short=False`` only in texts just as short. Items without words and null texts match nothing. Repeated rows give one
    result per doc_id and item_id
    with the largest containment. Rows with a null doc_id are judged together as one document, null item_ids as
    one item. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = staged(_sketches(items.select(F.col("item_id").cast("long"), "text"), size, least), "sketches")
    hits = _doc_hashes(docs, size, _short_widths(items, size) if short else []).join(sketches.select("item_id", "hash"), "hash")
    pairs = staged(hits.groupBy("doc_id", "item_id").agg(F.lit(1).alias("one")).drop("one"), "candidates")
    named = pairs.join(sketches.select("item_id", "item").distinct(),
                       pairs["item_id"].eqNullSafe(sketches["item_id"])).select(
        F.col("doc_id").alias("__doc"), pairs["item_id"], "item")
    found = docs.join(named, docs["doc_id"].eqNullSafe(named["__doc"])).select("doc_id", "item_id", "text", "item")
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])

    def verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                d, i, text, item = (part.column(c) for c in range(4))
                for k in range(part.num_rows):
                    share = _containment(text[k].as_py(), item[k].as_py(), size)
                    if share >= least - 1e-12:
                        yield (d[k].as_py(), i[k].as_py(), share), 24
        return batches(kind, rows())

    exact = found.mapInArrow(verified, "doc_id long, item_id long, containment double")
    return exact.groupBy("doc_id", "item_id").agg(F.round(F.max("containment"), 6).alias("containment"))


def remove_leaks(docs: DataFrame, items: DataFrame, size: int = SHINGLE, least: float = CONTAINMENT,
                 short: bool = True) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged. Rows with a null doc_id stay or go together."""
    found = staged(leaks(docs, items, size, least, short).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__leak"]), "left_anti")
