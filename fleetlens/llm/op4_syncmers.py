"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers (by hash) is its first or its last one.
That depends on the k-mer alone, so an edit moves no anchor outside of it, and every stretch of a text holds some. A
fingerprint keeps the anchors with the smallest hashes, each with its place. Two fingerprints are compared by the
share of anchors they have in common among the smallest of both, counting those that agree on how far they moved.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, mixed, rolling, staged

K, S = 16, 6
SHORT_TEXT, SHORT_K, SHORT_S = 256, 5, 2  # texts under 256 code points have too few long k-mers
ANCHORS = 28
DRIFT = 64  # code points that a common anchor may be away from where most have moved
_HASH_BITS, _PLACE_BITS = 28, 20  # seven and five hex digits


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of a sequence of code points."""
    inner = rolling(points.astype(np.uint64), s)
    width = k - s + 1
    if len(inner) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least, done = inner, 1
    while done < width:  # minima over ever longer windows
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    places = np.flatnonzero((inner[:len(least)] == least) | (inner[width - 1:] == least))
    # A k-mer's hash from the s-mers at its start, its middle and its end, which cover it (k <= 3 s).
    with np.errstate(over="ignore"):
        hashes = mixed(inner[places] * np.uint64(3) + mixed(inner[places + (width - 1) // 2] * np.uint64(5)
                                                            + mixed(inner[places + width - 1])))
    return hashes, places


def fingerprint(text: str, size: int = ANCHORS) -> str:
    """The ``size`` smallest anchors, each as hash and first place in hex; a text too short for any is one anchor,
    an empty text the empty string."""
    if not text:
        return ""
    sizes = (SHORT_K, SHORT_S) if len(text) < SHORT_TEXT else (K, S)
    hashes, places = anchors(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), *sizes)
    if not len(hashes):
        hashes = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "<u8")
        places = np.zeros(1, np.int64)
    short, first = np.unique(hashes >> np.uint64(64 - _HASH_BITS), return_index=True)
    return "".join(f"{h:07x}{p % (1 << _PLACE_BITS):05x}" for h, p in zip(short[:size].tolist(), places[first[:size]].tolist()))


def likeness(one: str, other: str, size: int = ANCHORS) -> float:
    """0 to 1; equal fingerprints (two empty ones as well) are 1, an empty one is 0 to any other."""
    if one == other:
        return 1.0
    a, b = ({f[i:i + 7]: int(f[i + 7:i + 12], 16) for i in range(0, len(f), 12)} for f in (one, other))
    # A fingerprint below its size holds all anchors of its text; the smallest of both are the smallest of the union.
    union = sorted(a.keys() | b.keys())[:size]
    moved = sorted(b[h] - a[h] for h in union if h in a and h in b)
    if not moved:
        return 0.0
    usual = moved[len(moved) // 2]
    return sum(abs(m - usual) <= DRIFT for m in moved) / len(union)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` (rounded down) replaced by as many code points from the start of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


_COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _row(doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other,
            likeness(own, other), likeness(own, next_own))


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, for which the start of the next document takes the place of
    its last quarter, and their likenesses.

    Next is by ascending doc_id, nulls first, equal ids by text; after the last comes the first. The texts are
    dealt in ranges of doc_id and stream through each range in order. Only a range's first and last document (two
    rows per partition) are handed over to the neighbours. A null text is empty; a single document follows itself;
    no rows give no rows.
    """
    kind = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_COLUMNS])

    def streamed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def rows():
            held = None
            for part in parts:
                for i, body in zip(part.column(0).to_pylist(), part.column(1)):
                    body = body.as_py()
                    own = fingerprint(body)
                    if held is None:
                        yield (_HEAD, number, body, i, len(body), None, own, None, None, None), 4 * len(body)
                    else:
                        yield (_WHOLE, number, None, *_row(*held, body, own)), 1000
                    held = i, body, own
            if held is not None:
                i, body, own = held
                yield (_TAIL, number, body, i, len(body), None, own, None, None, None), 4 * len(body)
        return batches(kind, rows())

    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = staged(ranged.mapInArrow(streamed, "kind int, part int, text string, " + _RESULT), "syncmers")
    heads, tails = found.where(F.col("kind") == _HEAD), found.where(F.col("kind") == _TAIL)
    order = Window.orderBy("part")  # one row per partition
    before = heads.select("part").select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    nexts = heads.select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_own")).join(before, "part")
    last = tails.join(nexts.drop("part"), tails["part"] == nexts["before"]).select(
        "doc_id", "text", "fingerprint", "following", "next_own")
    result = pa.schema(_COLUMNS)

    def finished(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(result, ((_row(*values), 1000) for part in parts for values in zip(*(c.to_pylist() for c in part.columns))))

    return found.where(F.col("kind") == _WHOLE).select([n for n, _ in _COLUMNS]).unionByName(last.mapInArrow(finished, _RESULT))
