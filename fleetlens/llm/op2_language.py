"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

A word's script comes from its code points; only languages that were seen to use it are candidates. Its score under a
language is the sum of smoothed log frequencies of its letter trigrams there. Viterbi over the words of a text, with
a penalty for every change of language, gives the best labelling; neighbouring words of one language form a span.
Texts are labelled many at a time, one word position after another, so the recursion runs on arrays.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, staged

PER_LANGUAGE = 500  # labelled documents that each language is learned from, at most
BUCKETS = 1 << 15  # trigrams are counted by hash
PENALTY = 12.0  # of a change of language, in nats
SMOOTHING = 0.1
LEAST_SHARE = 0.002  # of a language's letters, for a script to be one of its own
UNDETERMINED = "und"
_CELLS = 4_000_000  # words x languages labelled at a time
_CACHED = 400_000
_WORD = re.compile(r"[^\W\d_]+")

# First code points of Unicode script ranges; code points between two belong to the lower one.
_RANGES = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
           (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
           (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
           (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
           (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
           (0xFB00, "other"), (0x20000, "han")]
_STARTS = np.array([s for s, _ in _RANGES])
_NAMES = sorted({n for _, n in _RANGES})
_SCRIPT = np.array([_NAMES.index(n) for _, n in _RANGES])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning. A null id counts as not held out, and is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words in lower case, with a blank at both ends; the first index of each word; the
    script of its first letter; its number of letters."""
    lowered = [w.lower() for w in words]
    text = " " + "  ".join(lowered) + " "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in lowered])
    firsts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1])).astype(np.int64)
    with np.errstate(over="ignore"):
        mix = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
               ^ points[2:] * np.uint64(0x165667B19E3779F9))
        buckets = ((mix * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    scripts = _SCRIPT[np.searchsorted(_STARTS, points[firsts + 1], side="right") - 1]
    letters = np.array([sum(map(str.isalpha, w)) for w in words])
    # A word of n letters has n trigrams; the two that reach into the next word's blank are left out below.
    return buckets, firsts, scripts, letters


def _per_word(values: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` (by trigram) over each word, without the two trigrams between words."""
    keep = np.ones(size, bool)
    keep[firsts[1:] - 1] = False
    keep[firsts[1:] - 2] = False
    return np.add.reduceat(np.where(keep[:, None], values, 0), firsts, axis=0)


class Model:
    """Log frequencies by language and trigram bucket, scripts by language, and the share of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language
        self.allowed = (scripts > 0) & (scripts >= LEAST_SHARE * scripts.sum(axis=1, keepdims=True))
        self.start = np.log(documents / documents.sum()).astype(np.float32)
        self._rows: dict[str, int] = {}
        self._scores, self._letters = np.empty((0, len(languages)), np.float32), np.empty(0, np.int64)

    def __reduce__(self):
        return _restored, (self.languages, self.table, self.allowed, self.start)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores by language, and the number of letters, for each word."""
        new = set(words).difference(self._rows)
        if len(new) + len(self._rows) > _CACHED:
            new = set(words)
            self._rows, self._scores, self._letters = {}, self._scores[:0], self._letters[:0]
        if new:
            listed = list(new)
            found, letters = self._score(listed)
            self._rows.update(zip(listed, range(len(self._scores), len(self._scores) + len(listed))))
            self._scores, self._letters = np.concatenate((self._scores, found)), np.concatenate((self._letters, letters))
        rows = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
        return self._scores[rows], self._letters[rows]

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, firsts, scripts, letters = _trigrams(words)
        total = _per_word(self.table[buckets], firsts, len(buckets))
        allowed = self.allowed[:, scripts].T
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) - 4 * PENALTY)
        total[~allowed.any(axis=1) | (letters == 0)] = 0  # no candidate, or no letters: says nothing
        return total.astype(np.float32), letters


def _restored(languages, table, allowed, start) -> Model:
    model = Model.__new__(Model)
    model.languages, model.table, model.allowed, model.start = languages, table, allowed, start
    model._rows, model._scores, model._letters = {}, np.empty((0, len(languages)), np.float32), np.empty(0, np.int64)
    return model


def viterbi(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language index of every word. ``scores`` has the words of all texts in a row, ``sizes`` their counts.

    Ties stay with the language before, then with the first. Texts are ordered by length, so those still running at
    a position are the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    running = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.empty(scores.shape, np.int16)
    value = np.tile(start, (len(sizes), 1)).astype(np.float32)
    for t, n in enumerate(running):
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            top = now[np.arange(n), best][:, None] - penalty
            back[begin[:n] + t] = np.where(now >= top, own, best[:, None])
            np.maximum(now, top, out=now)
        now += scores[begin[:n] + t]
    labels = np.empty(len(scores), np.int16)
    state = value.argmax(axis=1) if len(sizes) else np.empty(0, np.int64)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        rows = begin[:n] + t
        labels[rows] = state[:n]
        if t:
            state[:n] = back[rows, state[:n]]
    return labels


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from ``text`` and ``lang`` of documents that are not held out; None if there are none.

    Each language is learned from whole texts of at most ``per_language`` documents, those first by a hash of the
    doc_id. What reaches the driver is one row of counts per language and partition sum: languages x BUCKETS numbers.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                        & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # Counted first: of a language with many documents only hashes in a share that holds some four times as many as
    # wanted are ranked, so a ranking stays small however large its language is.
    ids = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("draw"))
    share = F.lit(4.0 * per_language) / F.count("*") * (1 << 40)
    # One row per language, as in the model itself: broadcast, so that ids are cut in the scan and not dealt by language.
    drawn = ids.join(F.broadcast(ids.groupBy("lang").agg(share.alias("share"))), "lang").where("draw <= share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    picked = drawn.select("doc_id", "lang", "draw").withColumn("rank", rank).where(F.col("rank") <= per_language)
    picked = staged(picked.select("doc_id", "lang").distinct(), "sample")
    sample = usable.join(picked, ["doc_id", "lang"], "left_semi").select("lang", "text")
    kind = pa.schema([("lang", pa.string()), ("what", pa.string()), ("at", pa.int64()), ("n", pa.int64())])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}  # by language and table

        def add(lang, what, values):
            held = sums.get((lang, what))
            sums[lang, what] = values if held is None else held + values

        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                add(lang, "documents", np.ones(1))
                words = _WORD.findall(text.as_py())
                if words:
                    buckets, firsts, scripts, letters = _trigrams(words)
                    inside = np.ones(len(buckets), bool)
                    inside[firsts[1:] - 1] = inside[firsts[1:] - 2] = False
                    add(lang, "trigram", np.bincount(buckets[inside], minlength=BUCKETS))
                    add(lang, "script", np.bincount(scripts, weights=letters, minlength=len(_NAMES)))
        return batches(kind, (((lang, what, at, int(v[at])), 32) for (lang, what), v in sums.items()
                              for at in np.flatnonzero(v).tolist()))

    sums = sample.mapInArrow(counted, "lang string, what string, at long, n long").groupBy("lang", "what", "at").agg(
        F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    if not languages:
        return None
    index = {name: i for i, name in enumerate(languages)}
    tables = {what: np.zeros((len(languages), size)) for what, size in
              (("trigram", BUCKETS), ("script", len(_NAMES)), ("documents", 1))}
    for what, group in sums.groupby("what"):
        tables[what][group["lang"].map(index).to_numpy(), group["at"].to_numpy()] = group["n"].to_numpy()
    return Model(languages, tables["trigram"], tables["script"], tables["documents"][:, 0])


def label(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, that language's share of the letters, and the spans (start, end, language)."""
    limit, at = max(1, _CELLS // len(model.languages)), 0
    while at < len(texts):
        words, sizes = [], []
        while at < len(texts) and (not sizes or len(words) < limit):
            found = _WORD.findall(texts[at] or "")
            words += found
            sizes.append(len(found))
            at += 1
        scores, letters = model.scores(words)
        labels = viterbi(scores, np.array(sizes), model.start)
        del scores, words
        stop = 0
        for text, size in zip(texts[at - len(sizes):at], sizes):
            own, weight = labels[stop:stop + size], letters[stop:stop + size]
            stop += size
            share = np.bincount(own, weights=weight, minlength=len(model.languages))
            if not share.any():
                yield UNDETERMINED, 0.0, []
                continue
            best = int(share.argmax())
            yield model.languages[best], float(share[best] / share.sum()), _spans(model, text, own, weight)


def _spans(model: Model, text: str, labels: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, str]]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    if not len(cuts):
        first, last = _WORD.search(text).start(), len(text)
        while not text[last - 1].isalpha():
            last -= 1
        return [(first, last, model.languages[labels[0]])]
    places = [m.span() for m in _WORD.finditer(text)]
    bounds = [0, *cuts.tolist(), len(labels)]
    return [(places[a][0], places[b - 1][1], model.languages[labels[a]]) for a, b in zip(bounds, bounds[1:])]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` (start, end, lang in code points) for every row.

    A null text, and one without letters, is ``und`` with score 0 and no spans; so is everything without a model.
    Letters of a script that no language uses say nothing: the commonest language is predicted. Equal shares go to
    the first language by name. No rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    kind = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                      ("spans", pa.list_(span))])

    def labelled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value

        def rows():
            for part in parts:
                for at in range(0, part.num_rows, 500):
                    some = part.slice(at, 500)
                    texts = some.column(1).to_pylist()
                    found = label(known, texts) if known else ((UNDETERMINED, 0.0, []) for _ in texts)
                    for i, (lang, score, spans) in zip(some.column(0).to_pylist(), found):
                        spans = [{"start": s, "end": e, "lang": n} for s, e, n in spans]
                        yield (i, lang, score, spans), 64 + 48 * len(spans)
        return batches(kind, rows())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        labelled, "doc_id long, lang_pred string, score double, spans array<struct<start long, end long, lang string>>")


def predictions(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))
