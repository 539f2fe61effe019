"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors, and the form each word most likely means.

A word is a vector of letter counts. One edit takes at most one letter away (down) and adds at most one (up), so what is near
a word lies within one down and one up of it: words of its own length within both, words one letter shorter within the down,
words one letter longer within the up. For each length a k-d tree, fitted on a bounded sample of words, cuts the vectors into
leaves. Every word lives in one leaf and visits all leaves whose box it can reach. Each leaf is one group: a k-d tree of the
words that live there is built and searched in place for all visitors at once, box by box, and the order of the letters of
what is reached is compared exactly. Only counts and the best form of each visitor leave the group, never pairs. A leaf with
more words or visitors than fit is cut into a grid of groups, so nothing is capped.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mixed, staged, word_blocks

SAMPLE = 100_000  # words the trees are fitted on, about so many, by hash
LETTERS = 1 << 18  # of the words of a leaf, and of those that visit a group
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
EDITED = 31  # of so many pairs of document and run, one loses a letter
_HELD = 400_000  # words a task counts before it hands them on
_DIMS = 96  # letters are folded onto so many counts, which keeps the bounds
_SMALL = 24  # words of a box that is searched no deeper
_PAIRS = 1 << 22

# The letters of a run are A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased, all else parts runs.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _runs(text: str) -> Counter:
    """How often each lower-cased run of LEAST_LENGTH letters or more occurs, as Latin-1 bytes."""
    found: Counter = Counter()
    for block in word_blocks(text.encode("latin-1", "replace").translate(_TABLE)):
        found.update(w for w in block if len(w) >= LEAST_LENGTH)
    return found


def _edited(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in _runs(text).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
        if h % EDITED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < LEAST_LENGTH:
                continue
        yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: the words of all texts, every EDITED-th with a letter left out, that occur LEAST_COUNT times or more.

    Counted inside the tasks, then summed, so a frequent word moves once a task. Null texts have no words; a null id
    hashes like an empty one; equal rows all count.
    """
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        rows = lambda: (((w.decode("latin-1"), n), len(w) + 8) for w, n in held.items())
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                for word, n in _edited(doc_id, text.as_py() or ""):
                    held[word] = held.get(word, 0) + n
                if len(held) >= _HELD:
                    yield from batches(kind, rows())
                    held.clear()
        yield from batches(kind, rows())

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class _Words(NamedTuple):
    codes: np.ndarray  # code points, zeros behind the end
    size: np.ndarray
    counts: np.ndarray  # letter counts
    odd: np.ndarray  # a bit for each letter that occurs an odd number of times


def _vectors(words: np.ndarray) -> _Words:
    n, width = len(words), max(1, words.dtype.itemsize // 4)
    codes = np.ascontiguousarray(words).view(np.uint32).reshape(n, width)
    counts, odd, row = np.zeros((n, _DIMS), np.uint16), np.zeros(n, np.uint64), np.arange(n)
    for j in range(width):
        letter = codes[:, j]
        there = letter > 0
        dim = letter % _DIMS
        counts[row, dim] = np.minimum(counts[row, dim].astype(np.int32) + there, 65535)
        odd ^= np.where(there, np.uint64(1) << (letter % 64).astype(np.uint64), np.uint64(0))
    return _Words(codes, (codes > 0).sum(axis=1), counts, odd)


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count up to which rows go left that halve the rows best; None if all rows are equal."""
    some = counts[:: max(1, len(counts) // 2048)] if len(counts) > 4096 else counts
    for rows in (some, counts):
        shares = np.array([(rows <= t).mean(axis=0) for t in range(4)])
        gap = np.where((shares > 0) & (shares < 1), np.abs(shares - 0.5), 1.0)
        t, dim = np.unravel_index(int(gap.argmin()), gap.shape)
        if gap[t, dim] < 1:
            return int(dim), int(t)
    low, high = counts.min(axis=0), counts.max(axis=0)
    dim = int((high - low).argmax())
    return (dim, int(low[dim])) if high[dim] > low[dim] else None


def _fit(counts: np.ndarray, leaves: int, number: Iterator[int]) -> tuple:
    """A tree of (letter, count, left, right) with some ``leaves`` leaves of equal weight; a leaf is (number,)."""
    cut = _cut(counts) if leaves > 1 and len(counts) > 1 else None
    if cut is None:
        return (next(number),)
    left = counts[:, cut[0]] <= cut[1]
    share = min(leaves - 1, max(1, round(leaves * float(left.mean()))))
    return (*cut, _fit(counts[left], share, number), _fit(counts[~left], leaves - share, number))


def _sides(counts, rows, down, up, cut, low, high):
    """What of ``rows`` can reach the two halves of a box, with what is left of down and up."""
    dim, t = cut
    v = counts[rows, dim].astype(np.int64)
    less = down - (np.maximum(v - t, 0) - np.maximum(v - high[dim], 0))
    more = up - (np.maximum(t + 1 - v, 0) - np.maximum(low[dim] - v, 0))
    left, right = less >= 0, more >= 0
    new_high, new_low = high.copy(), low.copy()
    new_high[dim], new_low[dim] = min(t, high[dim]), max(t + 1, low[dim])
    return ((rows[left], less[left], up[left], low, new_high), (rows[right], down[right], more[right], new_low, high))


def _reached(tree: tuple, counts, rows, down, up, low=None, high=None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) for every leaf that rows can reach."""
    if low is None:
        low, high = np.zeros(_DIMS, np.int64), np.full(_DIMS, 1 << 40)
    if not len(rows):
        return
    if len(tree) == 1:
        yield tree[0], rows
        return
    for side, reach in zip(tree[2:], _sides(counts, rows, down, up, tree[:2], low, high)):
        yield from _reached(side, counts, *reach)


def length_class(size: np.ndarray) -> np.ndarray:
    """One class per length below 64; above, lengths that differ by a fifth at most share one."""
    size = np.asarray(size, np.int64)
    return np.where(size < 64, size, 64 + np.floor(np.log2(np.maximum(size, 64) / 64) * 4).astype(np.int64))


def _near(w: _Words, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one letter inserted, deleted or replaced."""
    out, width = np.zeros(len(q), bool), w.codes.shape[1]
    step = max(1, (1 << 23) // width)
    for i in range(0, len(q), step):
        a, b = q[i:i + step], p[i:i + step]
        gap = w.size[a] - w.size[b]
        a, b = np.where(gap > 0, b, a), np.where(gap > 0, a, b)  # a is the shorter
        x, y = w.codes[a], w.codes[b]
        differs = x != y
        replaced = (gap == 0) & (differs.sum(axis=1) == 1)
        inside = np.arange(width) < w.size[a][:, None]
        first = np.where((differs & inside).any(axis=1), (differs & inside).argmax(axis=1), w.size[a])
        moved = np.zeros_like(differs)
        moved[:, :-1] = x[:, :-1] != y[:, 1:]
        late = (moved & inside & (np.arange(width) >= first[:, None])).any(axis=1)
        out[i:i + step] = replaced | ((np.abs(gap) == 1) & ~late)
    return out


def _halves(w: _Words, q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that agree in their first or their last half: any one edit leaves one of the two as it is."""
    for size in np.unique(w.size[p]):
        points = p[w.size[p] == size]
        for other in (size - 1, size, size + 1):
            rows = q[w.size[q] == other]
            half = min(size, other) // 2
            rest = min(size, other) - half
            if not len(rows) or not rest:
                continue
            for first in (True, False):
                key = lambda r, n: w.codes[r, :half] if first else w.codes[r, n - rest:n]  # noqa: E731,B023
                _, name = np.unique(np.concatenate([key(points, size), key(rows, other)]), axis=0, return_inverse=True)
                name = name.ravel()
                order = np.argsort(name[:len(points)], kind="stable")
                begin = np.searchsorted(name[:len(points)][order], name[len(points):], "left")
                count = np.searchsorted(name[:len(points)][order], name[len(points):], "right") - begin
                done = 0
                while done < len(rows):
                    stop = done + max(1, int(np.searchsorted(np.cumsum(count[done:]), _PAIRS, "right")))
                    n = count[done:stop]
                    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    a, b = np.repeat(rows[done:stop], n), points[order[np.repeat(begin[done:stop], n) + offset]]
                    if not first and half:  # pairs that agree in the first half as well were given before
                        new = (w.codes[a, :half] != w.codes[b, :half]).any(axis=1)
                        a, b = a[new], b[new]
                    yield a, b
                    done = stop


def _search(w: _Words, points, rows, down, up, low, high) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, points) that may be one edit apart: a k-d tree of the points, built as far as rows come."""
    if not len(rows) or not len(points):
        return
    cut = _cut(w.counts[points]) if len(points) > _SMALL else None
    if cut is None:
        if len(points) * len(rows) > _PAIRS:
            yield from _halves(w, rows, points)
            return
        close = np.bitwise_count(w.odd[rows][:, None] ^ w.odd[points][None, :]) <= 2
        i, j = np.nonzero(close)
        yield rows[i], points[j]
        return
    left = w.counts[points, cut[0]] <= cut[1]
    for part, reach in zip((points[left], points[~left]), _sides(w.counts, rows, down, up, cut, low, high)):
        yield from _search(w, part, *reach)


def near_words(words: np.ndarray, n: np.ndarray, points: np.ndarray, rows: np.ndarray, down: np.ndarray,
               up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ``rows`` with near words among ``points``: the rows, how many, and the near word of largest ``n`` (of
    equals the smallest)."""
    w = _vectors(words)
    hits, held, size = [], [], 0

    def settle() -> None:
        q, p = (np.concatenate(x) for x in zip(*held))
        good = _near(w, q, p)
        hits.append((q[good], p[good]))
        held.clear()

    box = np.zeros(_DIMS, np.int64), np.full(_DIMS, 1 << 40)
    for q, p in _search(w, points, rows, down.astype(np.int64), up.astype(np.int64), *box):
        held.append((q, p))
        size += len(q)
        if size >= _PAIRS:
            settle()
            size = 0
    if held:
        settle()
    q, p = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, np.int64),) * 2
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[p], -n[p], q))
    q, p = q[order], p[order]
    found, first, many = np.unique(q, return_index=True, return_counts=True)
    return found, many, p[first]


def _visits(size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, rows, down, up): the classes of lengths where words one edit away can be."""
    home = length_class(size)
    shorter, longer = length_class(size - 1), length_class(size + 1)
    for c in np.unique(np.concatenate([home, shorter, longer])):
        rows = np.flatnonzero((home == c) | (shorter == c) | (longer == c))
        down = ((shorter == c) | (home == c))[rows]
        up = ((longer == c) | (home == c))[rows]
        yield int(c), rows, down.astype(np.int64), up.astype(np.int64)


def _route(trees: dict[int, tuple], words: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf, lives there, rows, down, up) for all leaves that the words live in or visit."""
    w = _vectors(words)
    home, none = length_class(w.size), np.zeros(len(words), np.int64)
    for c in np.unique(home):
        for leaf, rows in _reached(trees[int(c)], w.counts, np.flatnonzero(home == c), none[home == c], none[home == c]):
            yield leaf, True, rows, none[rows], none[rows]
    for c, rows, down, up in _visits(w.size):
        if c in trees:
            budget = np.zeros((2, len(words)), np.int64)
            budget[:, rows] = down, up
            for leaf, there in _reached(trees[c], w.counts, rows, down, up):
                yield leaf, False, there, budget[0, there], budget[1, there]


def _trees(words: DataFrame) -> dict[int, tuple]:
    """A tree for each class of lengths, fitted on SAMPLE words; how many leaves follows from all words."""
    size = F.length("word")
    coarse = words.groupBy(size.alias("size")).agg(F.sum(size).alias("letters"), F.count("*").alias("n"))
    total, n = {}, 0
    for row in coarse.collect():  # one row per length of words
        c = int(length_class(np.array([row["size"]]))[0])
        total[c] = total.get(c, 0) + row["letters"]
        n += row["n"]
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 40))  # by hash, so that no task sends more than its share
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < share).select("word").collect()
    sample = np.array([r[0] for r in drawn])
    kinds = length_class(np.char.str_len(sample)) if len(sample) else np.empty(0, np.int64)
    number = iter(range(1 << 62))
    return {c: _fit(_vectors(sample[kinds == c]).counts if (kinds == c).any() else np.zeros((0, _DIMS), np.uint16),
                    -(-letters // LETTERS), number) for c, letters in sorted(total.items())}


def _texts(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str) if len(column) else np.empty(0, "U1")


def _slot(words: np.ndarray, of: int) -> np.ndarray:
    """Which of ``of`` groups a word falls into."""
    if of == 1:
        return np.zeros(len(words), np.int64)
    sums = np.array([zlib.crc32(str(x).encode()) for x in words], np.uint64)
    return (mixed(sums) % np.uint64(of)).astype(np.int64)


def near_forms(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` of every row of ``words`` (distinct ``word``, ``n``).

    ``form`` is the near word of largest n if that is RATIO times the word's own or more.
    """
    trees = _trees(words)
    routed = pa.schema([("leaf", pa.int64()), ("lives", pa.bool_()), ("letters", pa.int64())])

    def weighed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for part in parts:
            texts = _texts(part.column(0))
            size = np.char.str_len(texts)
            for leaf, lives, rows, _, _ in _route(trees, texts) if len(texts) else ():
                sums[leaf, lives] += int(size[rows].sum())
        yield from batches(routed, (((*k, v), 24) for k, v in sums.items()))

    weights = words.select("word").mapInArrow(weighed, "leaf long, lives boolean, letters long")
    grid: dict[int, list[int]] = {}
    for r in weights.groupBy("leaf", "lives").agg(F.sum("letters").alias("letters")).collect():  # two rows per leaf
        grid.setdefault(r["leaf"], [1, 1])[0 if r["lives"] else 1] = max(1, -(-r["letters"] // (LETTERS if r["lives"] else 8 * LETTERS)))
    fields = [("leaf", pa.int64()), ("chunk", pa.int64()), ("slice", pa.int64()), ("lives", pa.bool_()), ("down", pa.int8()),
              ("up", pa.int8()), ("word", pa.string()), ("n", pa.int64())]
    dealt_schema = pa.schema(fields)

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = _texts(part.column(0))
            for leaf, lives, rows, down, up in _route(trees, texts) if len(texts) else ():
                chunks, slices = grid[leaf]
                own = _slot(texts[rows], chunks if lives else slices)
                for other in range(slices if lives else chunks):
                    fixed = np.full(len(rows), other)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), leaf)), pa.array(own if lives else fixed), pa.array(fixed if lives else own),
                         pa.array(np.full(len(rows), lives)), pa.array(down.astype(np.int8)), pa.array(up.astype(np.int8)),
                         part.column(0).take(at), part.column(1).take(at)], schema=dealt_schema)

    found_schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def searched(group: pa.Table) -> pa.Table:
        texts, n = _texts(group["word"].combine_chunks()), group["n"].to_numpy()
        lives = group["lives"].to_numpy(zero_copy_only=False)
        points, rows = np.flatnonzero(lives), np.flatnonzero(~lives)
        found, many, best = near_words(texts, n, points, rows, group["down"].to_numpy()[rows], group["up"].to_numpy()[rows])
        word = group["word"].combine_chunks()
        return pa.Table.from_arrays([word.take(pa.array(found)), pa.array(many.astype(np.int64)), pa.array(n[best]),
                                     word.take(pa.array(best))], schema=found_schema)

    groups = words.select("word", "n").mapInArrow(
        dealt, "leaf long, chunk long, slice long, lives boolean, down byte, up byte, word string, n long")
    found = groups.groupBy("leaf", "chunk", "slice").applyInArrow(searched, "word string, near long, best_n long, best string")
    none = F.lit(None)
    both = found.select("word", none.cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("m"), "best").alias("b"))
    both = both.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("struct<m: long, best: string>").alias("b")))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    likely = -F.col("b.m") >= RATIO * F.col("n")
    return out.select("word", "n", "n_near", F.when(likely, F.col("b.best")).alias("form"), F.when(likely, -F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of the words that have a form: forms followed to the last. Each form occurs RATIO times as often
    as its word, so there is no circle, and the steps double with each join: five joins follow any chain."""
    up = staged(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(up.join(above, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return up


def forms(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``docs``; no words, no rows."""
    words = staged(vocabulary(docs), "words")
    near = staged(near_forms(words), "forms")
    ends = roots(near).withColumnRenamed("word", "w")
    return near.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
