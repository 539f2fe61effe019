"""Substring dedup by difference-cover anchors.

Every match of 13 words between two places shares an aligned 7-word anchor that starts at a cover position (a place
that is 0, 1 or 3 modulo 7) on both sides: the differences of {0, 1, 3} are all residues modulo 7, so some shift of
at most 6 words brings both places onto the cover. So only 3 of 7 places are hashed and dealt out. Anchors found in
one document alone are dropped; around the others the full 13-word windows are hashed and compared, and each window
that also starts in a document with a smaller id goes.

Anchors and windows travel in packed arrays by ranges of their hashes. Before that, each task settles what it can:
of an anchor or a window that repeats among its own documents it marks the repeats itself and sends one row on. A
passage of a third of all documents so costs one row per task, and no group grows with it.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, rolling, staged, word_blocks

WINDOW = 13
# A difference cover.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_WORDS = 1_500_000  # words that a task holds at a time
BUCKET_CHARS = 16_000_000  # of text for each range of hashes; sets the size of a group, not the result
_NO_ID = (1 << 63) - 1  # documents without an id come last
_PACKED = "bucket int, local boolean, docs binary, places binary, hashes binary"
_PACKED_KIND = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), ("docs", pa.binary()), ("places", pa.binary()),
                          ("hashes", pa.binary())])
_MARKED = "doc long, places binary, hashes binary"
_MARKED_KIND = pa.schema([("doc", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])


def deflated(docs: DataFrame, kinds: dict[str, pa.DataType]) -> DataFrame:
    """The frame with its last column, the text, deflated for the shuffles ahead; a null text is empty."""
    kind = pa.schema([*kinds.items(), ("text", pa.binary())])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [zlib.compress((t.as_py() or "").encode("utf-8", "replace"), 1) for t in part.column(len(kinds))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary())], schema=kind)

    return docs.mapInArrow(packed, ", ".join(f"{name} long" for name in kinds) + ", text binary")


def _data(text: str | bytes | None) -> bytes:
    """The UTF-8 of a text, deflated or not."""
    return zlib.decompress(text) if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")


def word_hashes(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """One hash per word; ``known`` keeps those of frequent words."""
    out = []
    for words in word_blocks(data):
        try:
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def _least(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The smallest document of each row's run."""
    sizes = np.diff(np.append(starts, len(docs)))
    return np.repeat(np.minimum.reduceat(docs, starts), sizes)


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: small numbers so lie beside each other and compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _pack(docs: np.ndarray, places: np.ndarray, hashes: np.ndarray, bits: int, local: np.ndarray) -> Iterator[tuple]:
    """Rows by range of hashes. What is settled goes by document instead, so that it spreads."""
    spread = np.where(local, docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), hashes)
    bucket = ((spread >> np.uint64(32)) >> np.uint64(32 - bits)).astype(np.int64) * 2 + local
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = _runs(bucket)
    for a, b in zip(starts, np.append(starts[1:], len(bucket))):
        rows = order[a:b]
        yield (int(bucket[a]) >> 1, bool(bucket[a] & 1), _planes(docs[rows]), _planes(places[rows].astype("<i4")),
               hashes[rows].tobytes()), 20 * len(rows)


def _chunks(parts: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[list[tuple]]:
    """Lists of (id, word hashes, further columns) with about CHUNK_WORDS words each."""
    held, size = [], 0
    for part in parts:
        for values in zip(part.column(0).to_pylist(), *(part.column(c) for c in range(1, part.num_columns))):
            words = word_hashes(_data(values[1].as_py()), known)
            held.append((values[0], words, *(v.as_py() for v in values[2:])))
            size += len(words)
            if size >= CHUNK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _by_doc(docs: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    starts = _runs(docs)
    for a, b in zip(starts, np.append(starts[1:], len(docs))):
        rows = order[a:b]
        yield (int(docs[a]), _planes(places[rows].astype("<i4")), hashes[rows].astype("<u2").tobytes()), 6 * (b - a)


def _read(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([_from_planes(data, kind) for data in table.column(column).to_pylist()])


def _anchors(bits: int):
    cover = np.isin(np.arange(PERIOD), COVER)

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def rows():
            for chunk in _chunks(parts, known):
                docs, places, hashes = [], [], []
                for doc, words in chunk:
                    all_places = rolling(words, ANCHOR)
                    at = np.flatnonzero(np.resize(cover, len(all_places)))
                    hashes.append(all_places[at])
                    places.append(at)
                    docs.append(np.full(len(at), doc, np.int64))
                docs, places, hashes = map(np.concatenate, (docs, places, hashes))
                order = np.argsort(hashes, kind="stable")
                starts = _runs(hashes[order])
                if not len(starts):
                    continue
                ranked = docs[order]
                sizes = np.diff(np.append(starts, len(ranked)))
                several = np.minimum.reduceat(ranked, starts) != np.maximum.reduceat(ranked, starts)
                # Of an anchor of several documents one row is sent on for other tasks; all its rows are settled.
                settled = np.zeros(len(docs), bool)
                settled[order] = np.repeat(several, sizes)
                sent = ~settled
                sent[order[starts[several]]] = True
                yield from _pack(docs[sent], places[sent], hashes[sent], bits, np.zeros(int(sent.sum()), bool))
                if settled.any():
                    yield from _pack(docs[settled], places[settled], hashes[settled], bits, np.ones(int(settled.sum()), bool))
        return batches(_PACKED_KIND, rows())
    return found


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Places of the anchors that more than one document has."""
    return _settle(table, lambda docs, starts: np.repeat(
        np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts), np.diff(np.append(starts, len(docs)))))


def _later_windows(table: pa.Table) -> pa.Table:
    """Starts of the windows that a document with a smaller id has as well."""
    return _settle(table, lambda docs, starts: docs > _least(docs, starts))


def _settle(table: pa.Table, judge) -> pa.Table:
    docs, places = _read(table, "docs", "<i8"), _read(table, "places", "<i4")
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), "<u8")
    sizes = np.array([len(b) // 8 for b in table.column("docs").to_pylist()])
    local = np.repeat(np.array(table.column("local").to_pylist(), bool), sizes)
    keep, rest = local.copy(), np.flatnonzero(~local)
    if len(rest):
        order = rest[np.argsort(hashes[rest], kind="stable")]
        keep[order] = judge(docs[order], _runs(hashes[order]))
    rows = list(_by_doc(docs[keep], places[keep], hashes[keep]))
    return pa.Table.from_batches(list(batches(_MARKED_KIND, iter(rows))), _MARKED_KIND)


def _windows(bits: int):
    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def rows():
            for chunk in _chunks(parts, known):
                docs, places, hashes = [], [], []
                for doc, words, marks in chunk:
                    last = len(words) - WINDOW
                    if last < 0:
                        continue
                    near = np.concatenate([_from_planes(m, "<i4") for m in marks]).astype(np.int64)
                    wanted = np.zeros(last + PERIOD + 1, bool)
                    for shift in range(PERIOD):
                        at = near - shift
                        wanted[at[(at >= 0) & (at <= last)]] = True
                    at = np.flatnonzero(wanted[:last + 1])
                    hashes.append(rolling(words, WINDOW)[at])
                    places.append(at)
                    docs.append(np.full(len(at), doc, np.int64))
                if not docs:
                    continue
                docs, places, hashes = map(np.concatenate, (docs, places, hashes))
                order = np.argsort(hashes, kind="stable")
                if not len(order):
                    continue
                # A window that a smaller id of this chunk has is settled; those of the smallest id are sent on.
                later = np.empty(len(docs), bool)
                later[order] = docs[order] > _least(docs[order], _runs(hashes[order]))
                yield from _pack(docs[~later], places[~later], hashes[~later], bits, np.zeros(int((~later).sum()), bool))
                if later.any():
                    yield from _pack(docs[later], places[later], hashes[later], bits, np.ones(int(later.sum()), bool))
        return batches(_PACKED_KIND, rows())
    return found


def kept_words(data: bytes, starts: np.ndarray, checks: np.ndarray, known: dict[bytes, int]) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space, for windows marked at ``starts``.

    ``checks`` are 16 bits of the windows' hashes: rows that repeat a doc_id with another text don't take over its
    marks.
    """
    listed = data.split()
    if not len(starts):
        return len(listed), 0, b" ".join(listed)
    words = word_hashes(data, known)
    own = rolling(words, WINDOW).astype("<u2")
    fits = starts < len(own)
    starts, checks = starts[fits], checks[fits]
    starts = starts[own[starts] == checks]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + WINDOW, len(words)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(listed, gone.tolist()) if not g])


def marked_windows(docs: DataFrame) -> DataFrame:
    """``doc``, ``places``, ``hashes``: packed starts of the windows that go. ``docs`` has ``doc`` (no nulls), ``text``."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (chars // BUCKET_CHARS).bit_length())
    shared = docs.mapInArrow(_anchors(bits), _PACKED).groupBy("bucket").applyInArrow(_shared_anchors, _MARKED)
    marks = shared.groupBy("doc").agg(F.collect_list("places").alias("marks"))  # bounded by the document's length
    near = deflated(docs, {"doc": pa.int64()}).join(marks, "doc").select("doc", "text", "marks")
    return near.mapInArrow(_windows(bits), _PACKED).groupBy("bucket").applyInArrow(_later_windows, _MARKED)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the kept words joined by one space) for every row.

    A null or empty text has no words; texts under 13 words keep all. Rows without a doc_id come after all others
    and not before each other. Rows that repeat a doc_id are one document's versions: none removes words of another.
    No rows give no rows. Words are compared by 64-bit hashes of words and windows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text).alias("text"))
    marked = staged(marked_windows(rows.select("doc", "text")), "windows").groupBy("doc").agg(
        F.collect_list(F.struct("places", "hashes")).alias("marks"))  # bounded by the document's length
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def found():
            for part in parts:
                for i, body, marks in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    marks = marks.as_py() or []
                    starts = np.concatenate([np.empty(0, "<i4"), *(_from_planes(m["places"], "<i4") for m in marks)]).astype(np.int64)
                    checks = np.frombuffer(b"".join(m["hashes"] for m in marks), "<u2")
                    n, gone, kept = kept_words(_data(body.as_py()), starts, checks, known)
                    yield (i, n, gone, kept.decode()), len(kept)
        return batches(kind, found())

    packed = deflated(rows, {"doc_id": pa.int64(), "doc": pa.int64()})
    return packed.join(marked, "doc", "left").select("doc_id", "text", "marks").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string")


def removals(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup``."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, ts, array_to_string(words[ts:ts + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS ts FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(ts, ts + 13)) AS place FROM w
  JOIN (SELECT run, min(doc_id) AS least FROM w GROUP BY run) m USING (run) WHERE doc_id > least
), g AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE [words[i] FOR i IN range(1, len(words) + 1)
    IF NOT list_contains(places, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
