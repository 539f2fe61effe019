"""Packing by concatenate and cut: prefix sums over partition totals give every document its global offset.

Pass one turns texts into ids and sums their counts inside each partition; pass two sums the partitions' totals (one
row per partition) and adds them. From its global offset a document knows which fixed windows it reaches into. A
window inside one document is complete at once; pieces at a document's ends are boundary records, which share their
window with the neighbours and meet by its number.
"""

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, staged

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEPARATOR = 1
LENGTH = 2048
_CACHED_CHARS, _CACHED_WORDS = 32, 400_000
_MARKS = ".,;:!?"
_PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+[.,;:!?]*")  # normal forms and lower case keep these runs
_AT_ONCE = 4 << 20  # bytes of text that are encoded together


class WordIds(dict):
    """Ids of blank-separated words as little-endian unsigned 32-bit bytes; the first short words are kept.

    For vocabularies that drop white space and never let a token reach across it, as VOCABULARY's does: the ids of
    a text are those of its words, one after the other. Unknown words of many texts are encoded together. Where each one
    ends is shown by the vocabulary's own ending tokens if a word is Latin letters, perhaps with sentence marks behind them,
    for which the number of endings is known; between all others stands a special token, which costs the tokenizer more time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
        from tokenizers import Tokenizer
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        special = {str(t): i for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self._special = list(special)
        self._cut = next(iter(special.items()), None)
        self._ends = self._ending()

    def _ending(self) -> np.ndarray | None:
        """Which ids end a run of letters or of sentence marks; None if the vocabulary doesn't tell for every such character."""
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        ids = [i for t, i in self._tokenizer.get_vocab().items() if t.endswith(suffix)]
        ends = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        ends[ids] = True
        letters = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
        alone = [np.frombuffer(self._alone(w), "<u4") for w in [*letters, *_MARKS]]
        return ends if all(len(a) and a.max() < len(ends) and ends[a].sum() == 1 and ends[a[-1]] for a in alone) else None

    def _alone(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _told(self, words: list[str]) -> dict[str, bytes]:
        """The ids of plain words, cut at their endings; nothing if there are not as many as there should be."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        runs = np.cumsum([1 + (w[-1] in _MARKS) for w in words])
        if len(ends) != runs[-1] or ends[-1] != len(ids):
            return {}
        data, cuts = ids.tobytes(), (4 * ends[runs - 1]).tolist()
        return dict(zip(words, (data[a:b] for a, b in zip([0] + cuts, cuts))))

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if _PLAIN.fullmatch(w)] if self._ends is not None else []
        found = self._told(plain) if plain else {}
        words = [w for w in words if w not in found] if found else words
        text = " ".join(words)
        if not self._cut or any(t in text for t in self._special):
            alone = {w: self._alone(w) for w in words if not self._cut or any(t in w for t in self._special)}
            rest = [w for w in words if w not in alone]
            found.update(alone)
        else:
            rest = words
        if rest:
            ids = self._tokenizer.encode_batch_fast([self._cut[0].join(rest)], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self._cut[1])).tolist()
            found.update(zip(rest, (data[a:b] for a, b in zip([0] + [c + 4 for c in cuts], cuts + [len(data)]))))
        return found

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text. Words are cut and numbered by Arrow; each distinct one is looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        held = list(map(self.get, distinct))
        missing = [w for w, ids in zip(distinct, held) if ids is None]
        new = self._encoded(missing) if missing else {}
        parts = [new[w] if ids is None else ids for w, ids in zip(distinct, held)] if missing else held
        kept = (w for w in missing if len(w) <= _CACHED_CHARS)
        self.update((w, new[w]) for w in islice(kept, max(0, _CACHED_WORDS - len(self))))
        known, size = np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        n = size[word]
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = known[np.repeat((np.cumsum(size) - size)[word] - first[:-1], n) + np.arange(first[-1])]
        ends = first[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for a, b in zip(ends, ends[1:]):
            yield ids[a:b].tobytes()


def _slices(texts: pa.Array, size: int = _AT_ONCE) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized(docs: DataFrame, doc_id: str, text: str, vocabulary: str, separator: int) -> DataFrame:
    """``doc_id``, ``part``, ``before`` (ids before it in its partition), ``tokens``, ``ids`` with the separator."""
    kind = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()),
                      ("ids", pa.binary())])
    end = np.array([separator], "<u4").tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words = TaskContext.get().partitionId(), _word_ids(vocabulary)

        def rows():
            before = 0
            for part in parts:
                encoded = (ids for some in _slices(part.column(1).fill_null("")) for ids in words.of(some))
                for i, ids in zip(part.column(0).to_pylist(), encoded):
                    ids += end
                    yield (i, number, before, len(ids) // 4, ids), len(ids)
                    before += len(ids) // 4
        return batches(kind, rows())

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(
        encode, "doc_id long, part int, before long, tokens long, ids binary")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
           separator: int = SEPARATOR, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` and ``length`` in its document, ``doc_tokens``, ``sequence_id``,
    ``offset`` there, ``boundary`` (the window is shared) and ``ids`` (little-endian unsigned 32-bit).

    Every sequence but the last is full, so padding is below one sequence over the whole corpus. A null or empty
    text is its separator alone. Repeated rows are packed each on its own. No rows give no rows. Ids and offsets
    come from one written table, so a repeated task can't number anything anew.
    """
    rows = staged(tokenized(docs, doc_id, text, vocabulary, separator), "tokens")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))  # one row per input partition
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    first = F.col("base") + F.col("before")
    placed = rows.join(F.broadcast(bases), "part").withColumn("first", first)
    windows = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("tokens") - 1) / length))

    def piece(w):
        start = F.greatest(w * length - F.col("first"), F.lit(0))
        stop = F.least((w + 1) * length - F.col("first"), F.col("tokens"))
        return F.struct(start.alias("start"), (stop - start).alias("length"), w.alias("sequence_id"),
                        (F.col("first") + start - w * length).alias("offset"),
                        F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * (stop - start)).cast("int")).alias("ids"))

    cut = placed.select("doc_id", F.col("tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset",
                      (F.col("p.length") < length).alias("boundary"), "p.ids")


def sequences(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``sequence_id``, ``ids`` of each sequence, from pieces: whole windows pass, boundary records meet by number."""
    whole = packed.where(~F.col("boundary")).select("sequence_id", "ids")
    shared = packed.where("boundary").groupBy("sequence_id").agg(  # at most ``length`` ids, so as many records
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: F.hex(p["ids"])), F.lit(""), lambda a, b: F.concat(a, b))
    return whole.unionByName(shared.select("sequence_id", F.unhex(joined).alias("ids")))


def piece_digests(docs: DataFrame, **options) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                          "sequence_id", "offset")
