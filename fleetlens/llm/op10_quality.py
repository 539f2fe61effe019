"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A document's evidence is the log likelihood ratio of its surface features under the labelled good and bad documents
(all labelled rows count; the model is a table of FEATURES x BINS numbers). Every host gets a beta posterior of its
share of good documents, shrunk toward the global share, and every path of a host one shrunk toward its host; how
strongly is estimated from how far hosts, and paths in hosts, differ (method of moments). The path posterior is the
prior of the document's own decision. Site counts are grouped sums, so a host with a third of all rows is summed
inside the tasks first, and only the table of sites is joined back.

Toxic texts look like others on the surface, so the stage that drops documents also asks their words: each hashed word
has the log ratio of its share of toxic and of clean labelled documents (all of them count), less its standard error,
and a document is as toxic as its most toxic word. ``scores`` and its SQL have the quality part alone.
"""

import re
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, staged

BINS = 16
FEATURES = ("upper", "marks", "distinct", "length", "digits")
SMOOTHING = 1.0
STRENGTH = (1.0, 1000.0)  # least and most pseudo-documents of a prior
THRESHOLD = 0.5
BUCKETS = 1 << 20  # of hashed words
ERRORS = 1.64  # standard errors by which a word's log ratio is lowered
_WORD = re.compile(r"[^\W_]+")


def _bins(text: Column) -> list[Column]:
    """The bin, 0 to BINS - 1, of each feature; a text without words falls into the lowest bins."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chars, n = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    solid = F.length(F.translate(text, " \t\n\r\x0b\f", ""))
    shares = [
        F.regexp_count(text, F.lit(r"\p{Lu}")) / chars * 32,
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / chars * 64,
        F.size(F.array_distinct(words)) / n * 16,
        solid / n * 2,
        F.regexp_count(text, F.lit(r"[0-9]")) / chars * 32,
    ]
    return [F.least(F.floor(s), F.lit(BINS - 1)).cast("int") for s in shares]


def _features(docs: DataFrame, doc_id: str, text: str, host: Column, path: Column) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"),
                       F.coalesce(path, F.lit("")).alias("path"), F.array(*_bins(body)).alias("bins"))


def _ratios(labelled: DataFrame) -> list[list[float]]:
    """ln P(bin | good) - ln P(bin | bad) for each feature; zeros unless both classes have labelled documents."""
    counted = labelled.select("good", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
        F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no"))
    table = {(r["feature"], r["bin"]): (r["yes"], r["no"]) for r in counted.collect()}  # FEATURES x BINS rows at most
    total = [sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1)]
    if not all(total):
        return [[0.0] * BINS for _ in FEATURES]
    share = lambda n, of: log((n + SMOOTHING) / (of + SMOOTHING * BINS))
    return [[share(table.get((f, b), (0, 0))[0], total[0]) - share(table.get((f, b), (0, 0))[1], total[1])
             for b in range(BINS)] for f in range(len(FEATURES))]


def _evidence(bins: Column, ratios: list[list[float]]) -> Column:
    parts = [F.element_at(F.array(*map(F.lit, ratios[f])), bins[f] + 1) for f in range(len(FEATURES))]
    return reduce(lambda a, b: a + b, parts)


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Pseudo-count of a beta prior whose groups (n, good) vary around ``mean``, by the method of moments."""
    rate, weight = F.col("good") / F.col("n"), F.col("n")
    spread = F.sum(weight * (rate - mean) * (rate - mean)) / F.sum(weight)
    within = F.sum(mean * (1 - mean)) / F.sum(weight)  # what sampling alone would give
    level = F.sum(weight * mean * (1 - mean)) / F.sum(weight)
    raw = level / F.greatest(spread - within, F.lit(1e-9)) - 1
    return F.least(F.greatest(F.coalesce(raw, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def _sites(scored: DataFrame) -> DataFrame:
    """``host``, ``path``, ``prior``: the posterior share of good documents of every site."""
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "sites")
    mean = paths.agg((F.sum("good") / F.sum("n")).alias("m")).first()["m"]
    mean = 0.5 if mean is None else min(max(mean, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    pull = hosts.agg(_strength(hosts, F.lit(mean)).alias("s")).first()["s"]
    hosts = hosts.select("host", ((F.col("good") + pull * mean) / (F.col("n") + pull)).alias("host_rate"))
    both = paths.join(hosts, "host")
    inner = both.agg(_strength(both, F.col("host_rate")).alias("s")).first()["s"]
    return both.select("host", "path", "host_rate", (
        (F.col("good") + inner * F.col("host_rate")) / (F.col("n") + inner)).alias("prior"))


def model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          path: str = "lang") -> tuple[list[list[float]], DataFrame]:
    """Evidence table and site table. A site counts a labelled document by its label, any other by its evidence."""
    rows = staged(_features(docs, doc_id, text, F.col(host), F.col(path)), "features")
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).alias("good"))
    known = rows.join(truth, "doc_id", "left")
    ratios = _ratios(known.where("good IS NOT NULL"))
    base = truth.agg(F.avg(F.col("good").cast("int")).alias("m")).first()["m"]
    base = 0.5 if base is None else min(max(base, 1e-6), 1 - 1e-6)
    odds = F.exp(-_evidence(F.col("bins"), ratios)) * ((1 - base) / base)
    return ratios, _sites(known.withColumn("p", F.coalesce(F.col("good").cast("double"), 1 / (1 + odds))))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          path: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with ``evidence``, ``host_rate``, ``prior`` and ``p_good``, each prefixed
    with two underscores.

    The texts are read twice and never shuffled as long as the table of sites is small enough to broadcast (Spark
    measures it); beyond that the texts move once. Null text counts as empty, a null host or path as an empty one,
    labels without id or quality are ignored, several labels of a document are averaged (a tie is good). Without
    labels of both kinds the evidence is 0. Empty documents give no rows.
    """
    ratios, sites = model(docs, labels, doc_id, text, host, path)
    sites = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"),
                         F.col("host_rate").alias("__host_rate"), F.col("prior").alias("__prior"))
    bins = F.array(*_bins(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.withColumn("__evidence", _evidence(bins, ratios)).withColumns({
        "__h": F.coalesce(F.col(host), F.lit("")), "__p": F.coalesce(F.col(path), F.lit(""))})
    joined = rows.join(sites, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__path")), "left")
    odds = F.exp(-F.col("__evidence")) * (1 - F.col("__prior")) / F.col("__prior")
    return joined.withColumn("__p_good", 1 / (1 + odds)).drop("__h", "__p", "__host", "__path")


def _buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words, runs of letters and digits in lower case."""
    return np.unique(np.array([xxhash.xxh64_intdigest(w) % BUCKETS for w in set(_WORD.findall((text or "").lower()))], np.int64))


def toxic_words(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The log odds of being toxic that each bucket gives a document. Several labels of a document are averaged (a
    tie is toxic); without labels of both kinds no document is toxic."""
    truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(
        (F.avg("toxic") >= 0.5).alias("toxic"))
    kind = pa.schema([(c, pa.int64()) for c in ("bucket", "yes", "no")])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)  # the last one counts documents
        for part in parts:
            for toxic, body in zip(part.column(0).to_pylist(), part.column(1)):
                counts[0 if toxic else 1, np.append(_buckets(body.as_py()), BUCKETS)] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield from batches(kind, (((int(i), int(counts[0, i]), int(counts[1, i])), 24) for i in used))

    known = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(truth, "__id").select("toxic", "text")
    summed = known.mapInArrow(counted, "bucket long, yes long, no long").groupBy("bucket").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    rows = np.array([tuple(r) for r in summed.where(f"yes > 0 OR bucket = {BUCKETS}").collect()], np.int64).reshape(-1, 3)
    total = rows[rows[:, 0] == BUCKETS]
    odds = np.full(BUCKETS, -np.inf)
    if not len(total) or not total[0, 1:].all():
        return odds
    toxic, clean = (int(n) for n in total[0, 1:])
    odds[:] = log(toxic / clean)
    bucket, yes, no = rows[rows[:, 0] < BUCKETS].T
    ratio = np.log((yes + 0.5) / (toxic + 1)) - np.log((no + 0.5) / (clean + 1))
    odds[bucket] += np.maximum(ratio - ERRORS * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)), 0)
    return odds


def is_toxic(text: Column, odds: np.ndarray) -> Column:
    """Whether a text's most toxic word makes it more likely toxic than not."""
    found = np.sort(np.flatnonzero(odds > 0))

    @F.pandas_udf("boolean")
    def judged(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(np.isin(_buckets(t), found).any()) for t in texts], dtype=bool)

    return judged(text)


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose probability of being good reaches THRESHOLD and that aren't toxic, columns unchanged."""
    words = toxic_words(docs, labels, **{k: v for k, v in columns.items() if k in ("doc_id", "text")})
    kept = judge(docs, labels, **columns).where(F.col("__p_good") >= THRESHOLD).select(*docs.columns)
    return kept.where(~is_toxic(F.col(columns.get("text", "text")), words)) if (words > 0).any() else kept


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``p_good`` and the parts it is made of, and ``keep``, for every row."""
    judged = judge(docs, labels)
    return judged.select("doc_id", *[F.round("__" + c, 6).alias(c) for c in ("evidence", "host_rate", "prior", "p_good")],
                         (F.col("__p_good") >= THRESHOLD).alias("keep"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(lang, '') AS path, coalesce(text, '') AS body,
    [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents
), f AS (
  SELECT doc_id, host, path, [least(15, floor(s))::INT FOR s IN [
    len(regexp_extract_all(body, '\p{Lu}')) / greatest(length(body), 1) * 32,
    len(regexp_extract_all(body, '[^\p{L}\p{N}\s]')) / greatest(length(body), 1) * 64,
    len(list_distinct(words)) / greatest(len(words), 1) * 16,
    length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) / greatest(len(words), 1) * 2,
    len(regexp_extract_all(body, '[0-9]')) / greatest(length(body), 1) * 32]] AS bins FROM t
), truth AS (
  SELECT doc_id, avg(quality) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), known AS (SELECT f.*, good FROM f LEFT JOIN truth USING (doc_id)),
total AS (SELECT count(*) FILTER (WHERE good) AS yes, count(*) FILTER (WHERE NOT good) AS no FROM known),
counted AS (
  SELECT feature, bin, count(*) FILTER (WHERE good) AS yes, count(*) FILTER (WHERE NOT good) AS no
  FROM (SELECT good, unnest(range(1, 6)) AS feature, unnest(bins) AS bin FROM known WHERE good IS NOT NULL) GROUP BY ALL
), ratio AS (
  SELECT x.feature, y.bin, CASE WHEN t.yes > 0 AND t.no > 0 THEN ln((coalesce(c.yes, 0) + 1e0) / (t.yes + 16e0))
    - ln((coalesce(c.no, 0) + 1e0) / (t.no + 16e0)) ELSE 0e0 END AS r
  FROM range(1, 6) x(feature), range(16) y(bin), total t LEFT JOIN counted c ON c.feature = x.feature AND c.bin = y.bin
), pieces AS (SELECT doc_id, host, path, good, unnest(range(1, 6)) AS feature, unnest(bins) AS bin FROM known),
scored AS (
  SELECT doc_id, host, path, good, sum(r) AS evidence FROM pieces JOIN ratio USING (feature, bin) GROUP BY doc_id, host, path, good
), base AS (SELECT least(greatest(coalesce(avg(good::INT), 0.5e0), 1e-6), 1 - 1e-6) AS b FROM truth),
paths AS (
  SELECT host, path, count(*) AS n, sum(coalesce(good::INT::DOUBLE, 1 / (1 + exp(-evidence) * ((1 - b) / b)))) AS good
  FROM scored, base GROUP BY host, path
), m AS (SELECT least(greatest(coalesce(sum(good) / sum(n), 0.5e0), 1e-6), 1 - 1e-6) AS m FROM paths),
hosts AS (SELECT host, sum(n) AS n, sum(good) AS good FROM paths GROUP BY host),
pull AS (
  SELECT least(greatest(m * (1 - m) / greatest(sum(n * (good / n - m) * (good / n - m)) / sum(n)
    - count(*) * m * (1 - m) / sum(n), 1e-9) - 1, 1e0), 1000e0) AS s FROM hosts, m GROUP BY m
), rates AS (SELECT host, (good + s * m) / (n + s) AS host_rate FROM hosts, pull, m),
both_rates AS (SELECT paths.*, host_rate FROM paths JOIN rates USING (host)),
inside AS (
  SELECT least(greatest(sum(n * host_rate * (1 - host_rate)) / sum(n) / greatest(
    sum(n * (good / n - host_rate) * (good / n - host_rate)) / sum(n) - sum(host_rate * (1 - host_rate)) / sum(n), 1e-9) - 1,
    1e0), 1000e0) AS s FROM both_rates
), sites AS (SELECT host, path, host_rate, (good + s * host_rate) / (n + s) AS prior FROM both_rates, inside),
judged AS (SELECT doc_id, evidence, host_rate, prior, 1 / (1 + exp(-evidence) * (1 - prior) / prior) AS p FROM scored JOIN sites USING (host, path))
SELECT doc_id, round(evidence, 6) AS evidence, round(host_rate, 6) AS host_rate, round(prior, 6) AS prior,
  round(p, 6) AS p_good, p >= 0.5 AS keep FROM judged
"""
