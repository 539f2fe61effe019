"""SimHash near-duplicates: segment popcounts as a grid, Manhattan distance as the bound, exact verification.

A fingerprint is mapped to the bit counts of its sixteen 4-bit segments. The Manhattan distance of two such vectors
is a lower bound of the Hamming distance, and two vectors at distance 2 or less share a grid cell (a count vector)
at distance 1 or less from both. So every distinct fingerprint is listed in the cells around its own vector, and
cells with one fingerprint are dropped: nothing else can be in range there. What is left is verified exactly, again
without pairs: two fingerprints differ in at most two bits if and only if some word is at most one bit away from
both, and that word's vector is one of the shared cells. Each such word ties its fingerprints to the smallest of
them, so a group of n near copies costs n links, not n squared.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import batches, discard, staged, word_blocks
from .components import components

SEED = 42
SHINGLE = 3
WORDS = 16  # longs of a set's bit map
SAMPLED, COMMON = 20_000, 10  # a shingle that so many of so many sampled documents have comes last in the prefix order
BLOCK = 2000  # sets of a shingle that are compared with the others in one group
_BLOCK = 1 << 16


def _hash_blocks(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, a block at a time; fewer words make one shingle, none make none."""
    tail, some = [], False
    for block in word_blocks((text or "").encode("utf-8", "replace").lower()):  # bytes: lowers A-Z alone
        words = tail + block
        for at in range(0, len(words) - shingle + 1, _BLOCK):
            part = words[at:at + _BLOCK + shingle - 1]
            shingles = zip(*(part[i:] for i in range(shingle)))
            yield np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
            some = True
        tail = words[max(0, len(words) - shingle + 1):] if len(words) >= shingle else words
    if tail and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], "<u8")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return _printed(text, shingle)[0]


def _printed(text: str | None, shingle: int, distinct: bool = False) -> tuple[int, np.ndarray]:
    """The fingerprint, and the sorted distinct shingle hashes if asked for."""
    counts, total, seen = np.zeros(64, np.int64), 0, [np.empty(0, "<u8")]
    for hashes in _hash_blocks(text, shingle):
        counts += _bits(hashes)
        total += len(hashes)
        if distinct:
            seen.append(np.unique(hashes))
    value = int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0
    return value, np.unique(np.concatenate(seen))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for every row. A null text counts as empty."""
    @pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp"))


def _set_id(distinct: np.ndarray) -> int:
    """Names a set of shingles; texts with equal sets share it."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _sketch(distinct: np.ndarray) -> list[int]:
    """The places of a set's hashes in a map of 64 * WORDS bits. A bit that one map alone has stands for at least one
    shingle that its set alone has, so two maps bound the overlap of their sets from above."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(distinct % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def _wide(distinct: np.ndarray) -> bytes:
    """A map like ``_sketch`` whose bits grow with the set, two to four for each shingle, as a power of two."""
    bits = np.zeros(1 << max(6, (2 * len(distinct) - 1).bit_length()), np.uint8)
    bits[(distinct & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _may_reach(x: bytes, xn: int, y: bytes, yn: int, least: float) -> bool:
    """Whether the wide maps of two sets allow for a similarity of ``least``; the larger map is folded to the smaller's bits."""
    one, other = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(one), len(other))
    one, other = (np.bitwise_or.reduce(m.reshape(-1, size), axis=0).view("<u8") for m in (one, other))
    shared = min(xn - int(np.bitwise_count(one & ~other).sum()), yn - int(np.bitwise_count(other & ~one).sum()))
    return shared * (1 + least) >= least * (xn + yn) - 1e-6


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Hashes of shingles that many documents share, from about SAMPLED documents. They only set the order of the
    prefix search, which is complete under any order, so a sample may decide."""
    kind = pa.schema([("hashes", pa.list_(pa.int64()))])

    def taken(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for body in part.column(0):
                    found = _printed(body.as_py(), shingle, True)[1]
                    yield (found.view(np.int64),), 8 * len(found)
        return batches(kind, rows(), 4 << 20)

    every = max(1, docs.count() // SAMPLED)
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(text)  # exact copies go or stay together
    counts = some.mapInArrow(taken, "hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").count()
    return np.sort(np.array([r["h"] for r in counts.where(F.col("count") >= COMMON).select("h").collect()], np.int64).view(np.uint64))


def sets_of(docs: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """``doc_id``, ``fp``, ``sid`` (names the set of shingles), ``n`` (its size), ``map``, ``wide`` and ``prefix`` per row.

    A set that reaches a similarity of ``least`` with another one has ceil(least n) shingles in common with it, so
    under one order of all shingles their n - ceil(least n) + 1 first ones have one in common. Shingles that many
    documents share come last in the order.
    """
    common = common_shingles(docs, text, shingle)
    kind = pa.schema([("doc_id", docs.select(doc_id).limit(0).toArrow().schema.field(0).type), ("fp", pa.int64()), ("sid", pa.int64()),
                      ("n", pa.int32()), ("map", pa.list_(pa.int64())), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def printed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for i, body in zip(part.column(0).to_pylist(), part.column(1)):
                    fp, found = _printed(body.as_py(), shingle, True)
                    late = np.isin(found, common)
                    length = len(found) - math.ceil(round(least * len(found), 9)) + 1 if len(found) else 0
                    prefix = np.concatenate([found[~late], found[late]])[:length]
                    signed = int(np.array([fp], np.uint64).view(np.int64)[0])
                    yield (i, signed, _set_id(found), len(found), _sketch(found), _wide(found), prefix.view(np.int64)), 200 + len(found) // 2 + 8 * length
        return batches(kind, rows(), 4 << 20)

    ids = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        printed, f"doc_id {ids}, fp long, sid long, n int, map array<long>, wide binary, prefix array<long>")


def _segment_counts(fp) -> F.Column:
    """The bit counts of the sixteen 4-bit segments, each in its own 4 bits of a long."""
    ones = F.lit(0x1111111111111111)
    return reduce(lambda a, b: a + b, [F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in range(4)])


def _bit(i: int) -> F.Column:
    return F.lit((1 << i) if i < 63 else -(1 << 63))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints that differ in at most two bits.

    ``distinct`` has one row per fingerprint ``fp``. A move of one bit changes one segment's count by one, so the
    words one bit away are listed with the cell they fall into.
    """
    counts = _segment_counts(F.col("fp"))
    steps = [F.lit(0).cast("long")]
    for s in range(16):
        count = F.shiftrightunsigned(counts, 4 * s).bitwiseAND(F.lit(15))
        step = _bit(4 * s)
        steps += [F.when(count < 4, step), F.when(count > 0, -step)]
    cells = distinct.select("fp", F.explode(F.array_compact(F.array(
        *[(counts + s).alias("c") for s in steps]))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    near = cells.join(shared, "cell", "left_semi")
    moves = F.array_append(F.transform(F.array(*[_bit(i) for i in range(64)]), lambda b: F.col("fp").bitwiseXOR(b)),
                           F.col("fp"))
    words = near.groupBy("fp").agg(F.collect_set("cell").alias("cells")).select(  # at most 33 cells each
        "fp", F.explode(F.filter(moves, lambda w: F.array_contains("cells", _segment_counts(w)))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    return words.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _possible(least: float) -> Column:
    """Whether the sizes and maps of two sets, named x and y, allow for a similarity of ``least``."""
    alone = lambda p, q: reduce(lambda a, b: a + b, [
        F.bit_count(F.col(f"{p}m{i}").bitwiseAND(F.bitwise_not(F.col(f"{q}m{i}")))) for i in range(WORDS)])
    x, y = F.col("xn"), F.col("yn")
    shared = F.least(x - alone("x", "y"), y - alone("y", "x"))
    return (F.least(x, y) >= least * F.greatest(x, y) - 1e-9) & (shared * (1 + least) >= least * (x + y) - 1e-6)


def _side(rows: DataFrame, p: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("sid").alias(f"{p}s"), F.col("n").alias(f"{p}n"), *[
        F.col(f"m{i}").alias(f"{p}m{i}") for i in range(WORDS)])


def star_pairs(entries: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) of sets that share a prefix shingle with the smallest and the largest set there: a first pass,
    which connects most near copies with few comparisons."""
    ends = entries.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    tied = entries.join(ends, "token").select(F.col("sid").alias("x"), F.explode(F.array("low", "high")).alias("y"))
    tied = tied.where("x <> y").select(F.least("x", "y").alias("xs"), F.greatest("x", "y").alias("ys")).distinct()
    return tied.join(_side(known, "x"), "xs").join(_side(known, "y"), "ys").where(_possible(least)).select(
        F.col("xs").alias("x"), F.col("ys").alias("y"))


def block_pairs(entries: DataFrame, least: float) -> DataFrame:
    """All other pairs (x, y) that share a prefix shingle, may be similar and aren't connected yet.

    ``entries`` has ``token``, ``sid``, ``root`` (of what is connected), ``n`` and the map. The sets of a shingle are
    dealt into blocks of about BLOCK; every block is compared with all sets of the shingle, and only pairs that
    their sizes and maps allow leave the join.
    """
    open_ = entries.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1")).where(
        "r0 <> r1").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    left = entries.join(open_, "token").withColumn("block", F.pmod(F.hash("sid"), F.col("blocks")))
    right = entries.join(open_, "token").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = _side(left, "x", "token", "block", F.col("root").alias("xr"))
    y = _side(right, "y", F.col("token").alias("token_y"), F.col("block").alias("block_y"), F.col("root").alias("yr"))
    met = (F.col("token") == F.col("token_y")) & (F.col("block") == F.col("block_y")) & (F.col("xs") < F.col("ys"))
    return x.join(y, met & (F.col("xr") != F.col("yr")) & _possible(least)).select(
        F.col("xs").alias("x"), F.col("ys").alias("y")).distinct()


def _likely(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) that the wide maps allow: a map has a sixteenth to a thirty-second of the bits of its set, so candidates
    carry maps, and what is left carries sets."""
    kind = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def allowed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, xn, y, yn = (part.column(c).to_pylist() for c in ("x", "xn", "y", "yn"))
            maps = zip(part.column("xw"), part.column("yw"))
            met = [i for i, (xw, yw) in enumerate(maps) if _may_reach(xw.as_py(), xn[i], yw.as_py(), yn[i], least)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in met], pa.int64()) for c in (x, y)], schema=kind)

    side = lambda p: known.select(F.col("sid").alias(p), F.col("n").alias(f"{p}n"), F.col("wide").alias(f"{p}w"))
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(allowed, "x long, y long")


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """The pairs whose exact sets of shingle hashes have a Jaccard similarity of ``least``, as staged edges (a, b) of
    fingerprints. Only the sets of pairs that the wide maps allow are made."""
    likely = staged(_likely(pairs, known, least), "likely")
    named = staged(known.select("sid", "fp", "first").join(
        likely.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "sid"), "named")
    sets = staged(_shingle_sets(docs, named, doc_id, text, shingle), "shingles")
    both = likely.join(sets.select(F.col("sid").alias("x"), F.col("fp").alias("a"), F.col("shingles").alias("one")), "x").join(
        sets.select(F.col("sid").alias("y"), F.col("fp").alias("b"), F.col("shingles").alias("other")), "y")
    common, n = F.size(F.array_intersect("one", "other")), F.size("one") + F.size("other")
    edges = staged(both.where(common >= least * (n - common) - 1e-9).select("a", "b").distinct(), "similar")
    discard(likely, named, sets)
    return edges


def _shingle_sets(docs: DataFrame, named: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``sid``, ``fp``, ``shingles`` of the sets that ``named`` (sid, fp, first: a document that has it) lists."""
    kind = pa.schema([("sid", pa.int64()), ("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def taken_apart(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for sid, fp, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    found = _printed(body.as_py(), shingle, True)[1]
                    if _set_id(found) == sid:  # a row that repeats the doc_id may have another text
                        yield (sid, fp, found.view(np.int64)), 8 * len(found)
        return batches(kind, rows(), 4 << 20)

    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(
        named, F.col("__id").eqNullSafe(F.col("first"))).select("sid", "fp", "text")
    return texts.mapInArrow(taken_apart, "sid long, fp long, shingles array<long>").dropDuplicates(["sid"])


def similar_links(prints: DataFrame, docs: DataFrame, near: DataFrame, doc_id: str, text: str, shingle: int,
                  least: float) -> DataFrame:
    """Edges of fingerprints that, with ``near``, have the components of all pairs of texts with a similarity of ``least``.

    An exact prefix-filter join of the distinct sets of shingles. What a first pass has connected isn't compared
    again, so a large group of near copies costs few comparisons; all other candidates are verified. ``prints`` is a
    staged table of ``sets_of``, which goes once its prefixes are drawn.
    """
    rows = prints.where("n > 0")
    known = staged(rows.groupBy("sid").agg(
        F.min("fp").alias("fp"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("map").alias("map")).select(
        "sid", "fp", "first", "n", "wide", *[F.col("map")[i].alias(f"m{i}") for i in range(WORDS)]), "sets")
    same = rows.select("sid", F.col("fp").alias("a")).join(known.select("sid", F.col("fp").alias("b")), "sid").where("a <> b")
    near = staged(near.unionByName(same.select("a", "b").distinct()), "near")
    drawn = rows.select("sid", "prefix").dropDuplicates(["sid"]).select("sid", F.explode("prefix").alias("token"))
    shared = drawn.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    entries = staged(drawn.join(shared, "token"), "entries")
    discard(prints)
    verified = lambda pairs: _verified(pairs, known, docs, doc_id, text, shingle, least)
    star = verified(star_pairs(entries, known, least))
    edges = staged(near.unionByName(star).distinct(), "links")
    discard(near, star)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = known.drop("wide").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = staged(block_pairs(entries.join(rooted, "sid"), least), "candidates")
    discard(entries)
    more = verified(rest)
    every = staged(edges.unionByName(more), "links")
    discard(known, edges, rest, more)
    return every


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
            similarity: float | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest doc_id reachable) for every row.

    Fingerprints link at two or fewer differing bits. With ``similarity``, a Jaccard similarity of shingles, texts
    that are at least so similar link as well. They differ in some ten bits, farther apart than the grid can be
    searched for, so an exact prefix-filter join of their sets of shingles finds them, all of them.

    Exact copies meet in one distinct fingerprint before anything is compared. Texts without words (null, empty,
    blanks) have fingerprint 0 and are linked like any other. Rows repeat as in the input; a null doc_id keeps its
    row and never becomes a component_id unless its whole component has none. No rows give no rows.
    """
    if similarity:
        full = staged(sets_of(docs, doc_id, text, shingle, similarity), "prefixes")
        prints = staged(full.select("doc_id", "fp"), "simhash")
        edges = similar_links(full, docs, links(prints.select("fp").distinct()), doc_id, text, shingle, similarity)
    else:
        prints = staged(fingerprints(docs, doc_id, text, shingle), "simhash")
        edges = links(prints.select("fp").distinct())
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(edges).withColumnRenamed("node", "fp")
    grown = first.join(linked, "fp").select("fp", "root", "first")
    roots = grown.groupBy("root").agg(F.min("first").alias("component_id"))
    reached = grown.join(roots, "root").select("fp", "component_id")
    known = staged(first.join(reached, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")), "classes")  # so the last join can split a hot fp
    return prints.select("doc_id", "fp").join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id, all columns unchanged.

    Rows that repeat a doc_id are one document: the one with the smallest text stays. Rows without a doc_id are
    kept as they are, since no row can be named in their place. Only the ids that go are joined with the texts.
    """
    key = F.col(doc_id) == F.col("__id")
    found = staged(classes(docs, doc_id, text, shingle, similarity).groupBy(F.col("doc_id").alias("__id")).agg(
        F.count("*").alias("__rows"), F.min("component_id").alias("__kept")).where(
        "__id IS NOT NULL AND (__rows > 1 OR __id <> __kept)"), "dropped")
    repeated = docs.join(found.where("__id = __kept").select("__id"), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first()))
    return docs.join(found.select("__id"), key, "left_anti").unionByName(
        repeated.withColumn("__rank", rank).where("__rank = 1").drop("__rank"))
