"""Secret scans: rules for known kinds of secrets, and a token-efficiency test for random strings.

Random strings cost many tokens: a vocabulary trained on prose cuts them into short pieces. A run of key characters
whose characters per token stay below a limit is a secret, unless it is a digest of a known length, a UUID, a number or
a date. Of what is shaped like an identifier only the letters count, so one made of words is none.
"""

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHARS_PER_TOKEN = 2.2
BLOCK = 512  # a longer run is scored in blocks of so many characters, and is random if one of them is

# The kinds of the result and the patterns they are found by.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_NUMBER = re.compile(
    r"[0-9]+(?:[-_/][0-9]+)*"  # numbers, dates, phone and card numbers
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")  # UUID
_IDENTIFIER = re.compile(  # words, with numbers at their ends
    r"[A-Za-z]*[0-9]{0,4}(?:[-_/]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[-_/]*")
_LETTERS = re.compile(r"[A-Za-z]+")
LEAST_LETTERS = 8  # of an identifier: rules and numbered marks are none


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, vocabulary: str = VOCABULARY, ratio: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run of key characters reads as random under the vocabulary."""
    body = run.rstrip("=")
    if not _LETTERS.search(body) or _NUMBER.fullmatch(body) or _DIGEST.fullmatch(body) and len(body) in _DIGEST_LENGTHS:
        return False
    tokens = lambda part: len(_encoding(vocabulary).encode_ordinary(part))
    for at in range(0, max(1, len(run) - BLOCK // 2), BLOCK):  # a short rest belongs to the block before it
        end = at + BLOCK if len(run) - at > BLOCK + BLOCK // 2 else len(run)
        block = run[at:end]
        if _IDENTIFIER.fullmatch(block.rstrip("=")):
            words = _LETTERS.findall(block)
            if (n := sum(map(len, words))) >= LEAST_LETTERS and n <= ratio * sum(map(tokens, words)):
                return True
        elif len(block) <= ratio * tokens(block):
            return True
    return False


def spans(text: str | None, vocabulary: str = VOCABULARY, ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end) in code points, by start and kind. A null text has none.

    A match that is too short is dropped after it was consumed, as its rule says. For access and hex a too short
    match is never followed by one inside it, so the least length stands in the pattern. Random strings are added
    where no other span covers them.
    """
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    starts, reach = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]  # how far the first spans reach
    for m in _RUN.finditer(text):
        if reach[bisect_left(starts, m.end())] <= m.start() and is_random(m[0], vocabulary, ratio):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
         ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """``doc_id`` and ``found``, an array of (kind, start, end), for every row, rows without secrets included.

    Null and empty texts have none; repeated rows are scanned alike; no rows give no rows.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for i, body in zip(part.column(0).to_pylist(), part.column(1)):
                    found = [{"kind": KINDS[k], "start": s, "end": e}
                             for s, k, e in spans(body.as_py(), vocabulary, ratio)]
                    yield (i, found), 24 + 40 * len(found)
        return batches(kind, rows())

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(
        scanned, "doc_id long, found array<struct<kind string, start long, end long>>")


def redacted(text: str, vocabulary: str = VOCABULARY, ratio: float = CHARS_PER_TOKEN, mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans(text, vocabulary, ratio):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows with the secrets of ``text`` masked; ``n_chars`` follows, other columns and clean rows are unchanged."""
    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redacted(t) if t else t)

    out = docs.withColumn("__masked", masked(F.col(text)))
    changed = ~F.col("__masked").eqNullSafe(F.col(text))
    replaced = {text: F.col("__masked")}
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        replaced[n_chars] = F.when(changed, F.length("__masked").cast(kind)).otherwise(F.col(n_chars))
    return out.select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])


def span_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, ``base_sha256``, ``spans``."""
    found, text = F.col("found"), lambda a: F.array_join(F.transform(
        a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(F.filter(found, lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        text(found).alias("spans"))
