"""Periodic run detection: stretches of words that repeat with a period at least four times, by synchronising sets.

At each dyadic scale t a hash chooses positions from what stands in the 2t words after them: a position is in the set if
the least hash among the t + 1 windows of t words that begin there and further on is that of the first or the last window.
Windows with a period of t / 4 or less, a highly periodic region, have no hash. So the set has few positions, and equal
contexts of 2t words make equal choices. Of a run of period q, t <= q < 2t, the set holds a position and its copy q words on,
unless the run is such a region itself, and no equal context lies between the two: neighbours of equal context at a distance
of t to 2t - 1 propose (position, period). A proposal is extended word by word to both sides, which also proves it. The highly
periodic regions of a scale are the runs found at smaller scales. A text none of whose contexts recurs at a scale has no
longer periods and is done, so most texts leave after a few scales. Texts are worked on inside the tasks, many at once.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, word_blocks

LEAST, TIMES = 6, 4  # a run has at least LEAST words and TIMES periods
_CHUNK = 1 << 19  # words that are worked on at once
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Collision(Exception):
    """Two different contexts had one hash."""


def _paired(hashes: np.ndarray, step: int) -> np.ndarray:
    """The hash of each window twice as long as those of ``hashes``; the last ones are of no use."""
    with np.errstate(over="ignore"):
        return mixed(hashes * _FACTOR + np.append(hashes[step:], hashes[:step]))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: running minima of blocks from both sides."""
    n = len(values)
    blocks = np.append(values, np.full(-n % width, _NEVER)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _matching(words: np.ndarray, period: int, at: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the word ``period`` further on."""
    far, size = 0, 64
    while True:
        if step > 0:
            a, b = words[at + far:at + far + size], words[at + far + period:at + far + period + size]
            same = a[:len(b)] == b
        else:
            low = max(0, at + 1 - far - size)
            same = (words[low:at + 1 - far] == words[low + period:at + 1 - far + period])[::-1]
        if not len(same):
            return far
        if not same.all():
            return far + int(same.argmin())
        far, size = far + len(same), min(size * 2, 1 << 16)


def _check(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> None:
    step = max(1, (1 << 21) // width)
    for i in range(0, len(a), step):
        span = np.arange(width)
        if (words[a[i:i + step, None] + span] != words[b[i:i + step, None] + span]).any():
            raise _Collision


def _found(texts: list[np.ndarray], seed: int) -> list[list[tuple[int, int, int]]]:
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    alive = np.array([k for k, w in enumerate(texts) if len(w) >= TIMES], np.int64)
    if not len(alive):
        return runs
    sizes = np.array([len(texts[k]) for k in alive])
    words = np.concatenate([texts[k] for k in alive])
    with np.errstate(over="ignore"):
        hashes = mixed(words.astype(np.uint64) + mixed(np.array([seed], np.uint64)))
    t = 1
    while True:
        base = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(alive)), sizes)
        room = np.repeat(base + sizes, sizes) - np.arange(len(words))  # words up to the end of the text
        own = hashes
        if t >= TIMES:  # highly periodic windows have no hash
            change = np.zeros(len(words) + 1, np.int32)
            for i, k in enumerate(alive):
                for start, length, period in runs[k]:
                    if period * TIMES <= t <= length:
                        change[base[i] + start] += 1
                        change[base[i] + start + length - t + 1] -= 1
            own = np.where(np.cumsum(change[:-1]) > 0, _NEVER, hashes)
        least = _lowest(own, t + 1)
        n = len(least)
        at = np.flatnonzero((least == np.minimum(own[:n], own[t:])) & (least != _NEVER) & (room[:n] >= 2 * t))
        doubled = _paired(hashes, t)
        with np.errstate(over="ignore"):
            context = doubled[at] + mixed(text[at].astype(np.uint64))
        order = np.argsort(context, kind="stable")
        here, context = at[order], context[order]
        same = context[1:] == context[:-1]
        left, right = here[:-1][same], here[1:][same]
        near = right - left < 2 * t
        _check(words, left[near], right[near], 2 * t)
        chosen = near & (right - left >= t)
        _extend(texts, runs, alive, base, text, left[chosen], (right - left)[chosen], t)
        again = np.zeros(len(alive), bool)
        again[text[left]] = True
        again &= sizes >= TIMES * 2 * t
        if not again.any():
            return runs
        stay = again[text]
        alive, sizes, words, hashes, t = alive[again], sizes[again], words[stay], doubled[stay], 2 * t


def _extend(texts: list[np.ndarray], runs: list, alive: np.ndarray, base: np.ndarray, text: np.ndarray,
            at: np.ndarray, period: np.ndarray, t: int) -> None:
    """Adds the run around each proposal; one that lies in a run just found is skipped."""
    last, end = None, 0
    for i in np.lexsort((at, period, text[at])):
        k, q = int(text[at[i]]), int(period[i])
        p = int(at[i] - base[k])
        if last == (k, q) and p < end:
            continue
        words = texts[alive[k]]
        begin = p - _matching(words, q, p - 1, -1)
        stop = p + 2 * t + _matching(words, q, p + 2 * t, 1) + q
        last, end = (k, q), stop - q
        if stop - begin >= TIMES * q:
            runs[alive[k]].append((begin, stop - begin, q))


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, given as numbers of words, by start, then period.

    A run is a longest stretch of LEAST words and TIMES of its smallest period or more. Contexts are compared by hashes,
    but whatever is near enough to matter is compared word by word, and a collision starts again with another hash.
    """
    for seed in range(64):
        try:
            return [sorted(r for r in runs if r[1] >= LEAST) for runs in _found(texts, seed)]
        except _Collision:
            continue
    raise RuntimeError("hash collisions under 64 seeds")


def _numbered(text: str, numbers: defaultdict) -> np.ndarray:
    parts = [np.array([numbers[w] for w in block], np.int64) for block in word_blocks(text.encode())]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _collapsed(text: str, n: int, runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep, at, kept = np.cumsum(change[:-1]) == 0, 0, []
    for block in word_blocks(text.encode()):
        kept += [b" ".join(w for w, k in zip(block, keep[at:at + len(block)]) if k)]
        at += len(block)
    return b" ".join(k for k in kept if k).decode()


_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_OUT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _worked(texts: list[str]) -> Iterator[tuple[int, list, str]]:
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    words = [_numbered(t, numbers) for t in texts]
    for text, w, runs in zip(texts, words, find_runs(words)):
        yield len(w), [dict(zip(("start", "length", "period"), r)) for r in runs], _collapsed(text, len(w), runs)


def periodic(text: Column) -> Column:
    """``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of each text.

    Words are what blanks part; null is an empty text, which has no runs and an empty ``collapsed``. A text is worked on
    whole, whatever its length (about 60 bytes a word), and alone, so copies and skewed ids don't matter.
    """
    @F.arrow_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(texts: pa.Array) -> pa.Array:
        rows, held, size = [], [], 0
        for value in texts:
            held.append(value.as_py() or "")
            size += len(held[-1])
            if size >= 4 * _CHUNK:
                rows += _worked(held)
                held, size = [], 0
        rows += _worked(held)
        n, runs, collapsed = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(runs, _OUT[1].type), pa.array(collapsed, pa.string())], fields=list(_OUT))

    return found(text)


def with_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` of ``periodic``, which replaces a column of that name."""
    return docs.withColumn(into, periodic(F.col(text)))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared as fractions; the first of equals, null if there is none."""
    more = lambda a, b: a.length * b.period > b.length * a.period
    return F.reduce(runs, F.get(runs, 0), lambda best, r: F.when(more(r, best), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The query's text: every tenth document, by a hash of its id, repeats its first words from some place on.

    A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def moved(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Bound to a variable, the words are split once a text and not once a word.
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, moved(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_runs``, the strongest run and digests of all runs and of the collapsed text, of every row."""
    rows = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    runs, best = F.col("periodic.runs"), F.col("best")
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","),
                              r.period.cast("string"), F.lit("\n"))
    return rows.withColumn("best", strongest(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
