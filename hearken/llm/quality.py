"""Quality classifier with hierarchical empirical Bayes.

Evidence: one pass over each whole text gives surface measures and hashed features, its distinct words and its distinct
trigrams of character kinds. Grouped counts over all labelled documents give each hashed feature a log ratio of its
frequencies among good and bad ones; their means join the surface measures in a logistic model. Ratios that the model is
fitted on come from the other half of the labels.

Sites have levels: all documents, host, path within the host. Each level's rate of good documents is a Beta posterior whose
prior is the level above; the strength of the prior comes from the spread between sites (method of moments), so sparse
sites shrink towards their parent. A document counts with its label, or with its own probability if it has none; all level
sums are grouped aggregates over all documents. What a document says about itself is taken out of its site's rate again,
and Bayes' rule joins the two: posterior odds are its own odds times those of its site over those of the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, stored, text_or_empty, without
from .superkmers import Hashes

#: The logistic model is fitted on at most about this many labelled rows; all labels count in the ratios, all documents are scored.
MAX_LABELS = 200_000
#: Labels that are broadcast; more meet the documents' features by a shuffle.
BROADCAST_LABELS = 1 << 20
#: Least posterior of an accepted document.
ACCEPT = 0.5
#: Buckets of words and of trigrams of character kinds.
WORDS, SHAPES = 1 << 16, 1 << 12
#: Added to each count of a hashed feature.
PRIOR = 1.0
LETTER, UPPER, DIGIT, NUMBER, SPACE, LINE, PLAIN, SYMBOL = range(8)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point, with all beyond the first plane as one: kind, and kind with each ASCII mark for itself."""
    kind = np.full((1 << 16) + 1, SYMBOL, np.uint8)
    for c in range(1 << 16):
        x = unicodedata.category(chr(c))
        if x[0] in "LM":
            kind[c] = UPPER if x == "Lu" else LETTER
        elif x[0] == "N":
            kind[c] = DIGIT if 48 <= c < 58 else NUMBER
        elif x[0] == "Z" or 9 <= c <= 13:
            kind[c] = LINE if c == 10 else SPACE
        elif chr(c) in ".,;:'\"?!-()":
            kind[c] = PLAIN
    shape = kind.astype(np.int64)
    marks = np.array([c for c in range(33, 127) if kind[c] in (PLAIN, SYMBOL)])
    shape[marks] = np.arange(8, 8 + len(marks))
    return kind, shape


def _words(a: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what stands between the places ``apart``."""
    edge = np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def evidence(text: str) -> tuple[list[float], np.ndarray]:
    """Surface measures of a text, and its hashed features: words first, then trigrams of kinds."""
    kind, shape = _kinds()
    code = lambda s: np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
    a = code(text)
    k = kind[a]
    n_of = np.bincount(k, minlength=8)
    low = code(text.lower())
    kl = kind[low]
    start, end = _words(low, (kl == SPACE) | (kl == LINE))
    h = Hashes(low)
    words = np.unique(h.of(start, end))
    s, e = _words(low, kl == LINE)
    lines = len(np.unique(h.of(s, e)))
    x = shape[a]
    tri = ((x[:-2] << 14 | x[1:-1] << 7 | x[2:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52) if len(x) > 2 else np.zeros(0, np.uint64)
    shapes = np.flatnonzero(np.bincount(tri.astype(np.int64), minlength=SHAPES))
    n, chars, letters = len(start), max(len(a), 1), int(n_of[LETTER] + n_of[UPPER])
    share = lambda x, of: float(x / of) if of else 0.0
    measures = [
        1 / (n + 1.0), float(np.log1p(n)),
        # distinct words, against what a text of this length has at least (Heaps' law, exponent 0.6)
        share(len(words), n**0.6), share(len(words), n), share(n_of[SYMBOL], chars), share(n_of[UPPER], letters + 1.0), share(letters, n) / 10,
        share(n_of[DIGIT], chars), share(lines, len(s)), share(letters, chars),
    ]
    return measures, np.concatenate([np.unique(words & np.uint64(WORDS - 1)).astype(np.int32), (shapes + WORDS).astype(np.int32)])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, host, path, m`` (measures) and ``ids`` (hashed features) of each row's whole text (doc_id, host, path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [evidence(t.as_py()) for t in b.column(3)]
            cols = [pa.array([m for m, _ in got], pa.list_(pa.float64())), pa.array([i for _, i in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["doc_id", "host", "path", "m", "ids"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, m array<double>, ids array<int>")


def ratios(known: DataFrame) -> np.ndarray:
    """Log ratios of the hashed features' frequencies, by half: those of half 1, of half 0, of both. ``known``: ids, label, half."""
    n = np.zeros((2, 2))
    for half, label, k in known.groupBy("half", "label").count().collect():
        n[half, int(label)] = k
    seen = np.zeros((2, 2, WORDS + SHAPES))
    counts = known.select("half", F.col("label").cast("int").alias("label"), F.explode("ids").alias("id")).groupBy("id")
    sums = [F.count_if((F.col("half") == h) & (F.col("label") == y)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)]
    for i, *c in counts.agg(*sums).collect():  # at most WORDS + SHAPES rows
        seen[:, :, i] = np.reshape(c, (2, 2))
    both = lambda x: np.array([x[1], x[0], x.sum(axis=0)])
    rate = (both(seen) + PRIOR) / (both(n) + 2 * PRIOR)[:, :, None]
    return np.log(rate[:, 1]) - np.log(rate[:, 0])


def inputs(m: np.ndarray, ids: list[np.ndarray], ratio: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Inputs of the logistic model: measures, their squares and roots, and mean and least ratios of words and of kinds."""
    more = np.zeros((len(ids), 4))
    for k, i in enumerate(ids):
        cut_at = np.searchsorted(i, WORDS)
        for j, part in enumerate((i[:cut_at], i[cut_at:])):
            if len(part):
                r = ratio[which[k], part]
                more[k, 2 * j : 2 * j + 2] = r.mean(), r.min()
    return np.hstack([m, m * m, np.sqrt(m), more])


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def site_rates(scored: DataFrame, levels: list[str]) -> DataFrame:
    """``levels``, ``n``, ``k``, ``m``, ``strength`` of each deepest site, and ``base``, the rate of all, from rows (levels, k).

    Per level: sites with ``n`` documents and ``k`` good ones (labels, or probabilities) under the parent's rate ``m`` have
    the rate ``(k + strength * m) / (n + strength)``. The strength is one number a level, from the variance between its sites.
    """
    counts = scored.groupBy(*levels).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("k").alias("k"))
    total = counts.agg(F.sum("k"), F.sum("n")).first()
    base = (total[0] or 0.0) / total[1] if total[1] else 0.5
    rates = None
    for depth in range(1, len(levels) + 1):
        on = levels[:depth]
        here = counts.groupBy(*on).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if rates is None:
            here = here.withColumn("m", F.lit(base))
        else:
            up = rates.select(*[F.col(c).alias(f"_{c}") for c in on[:-1]], F.expr("(k + strength * m) / (n + strength)").alias("m"))
            cond = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on[:-1]]
            here = here.join(up, cond).select(*on, "n", "k", "m")
        # between-site variance: the squared deviations less what the sites' own sampling explains
        dev = F.pow(F.col("k") / F.col("n") - F.col("m"), 2)
        noise = F.col("m") * (1 - F.col("m")) / F.col("n")
        w, between, spread = here.agg(F.sum("n"), F.sum(F.col("n") * (dev - noise)), F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))).first()
        tau = max((between or 0.0) / w, 1e-6) if w else 1e-6
        rates = here.withColumn("strength", F.lit(max(1.0, (spread or 0.0) / w / tau - 1.0) if w else 1.0))
    return rates.withColumn("base", F.lit(base))


def posterior(scored: DataFrame) -> DataFrame:
    """``doc_id, p_text, p_site, p_good, accepted`` from rows ``doc_id, host, path, p, k`` (own probability; label or again ``p``)."""
    sites = site_rates(scored, ["host", "path"])
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", F.col("k").alias("sum"), "m", "strength", "base")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    rate = (F.col("sum") - F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") - 1 + F.col("strength"))
    odds = _logit(F.col("p")) + _logit(rate) - _logit(F.col("base"))
    post = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", F.col("p").alias("p_text"), rate.alias("p_site"), post.alias("p_good"), (post >= ACCEPT).alias("accepted"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, p_text, p_site, p_good, accepted`` for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality``; null or repeated labels: nulls are left out, of several the lower
    counts. Without labelled documents of both classes every document is accepted with probability 1. Null host or path is a site of
    its own. Empty and null texts are scored by their features (no words); texts may be of any length; repeated rows get equal
    scores; null ids are carried and have no label. Columns with clashing names are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text_or_empty("text").alias("text"))
    feats = stored(features(base), "features")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = cut(marks.agg(F.min("quality").cast("double").alias("label")))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    known = stored(feats.join(marks, "doc_id").select("doc_id", "m", "ids", "label", half), "known")
    n, good = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < good < n:
        return feats.select("doc_id", *[F.lit(1.0).alias(c) for c in ("p_text", "p_site", "p_good")], F.lit(True).alias("accepted"))
    ratio = ratios(known)

    def rows_of(b: pa.RecordBatch, which) -> np.ndarray:
        m = np.array(b.column("m").to_pylist()).reshape(b.num_rows, -1)
        ids = [x.values.to_numpy() for x in b.column("ids")]
        return inputs(m, ids, ratio, which)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b, b.column("half").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([*x], pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    if n > MAX_LABELS:  # by hash, so that reruns agree
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELS / n))
    table = stored(known.mapInArrow(train, "x array<double>, label double"), "train").select(array_to_vector("x").alias("x"), "label")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-4, maxIter=60).fit(table)
    weights, intercept = model.coefficients.toArray(), float(model.intercept)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = rows_of(b, np.full(b.num_rows, 2)) @ weights + intercept
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "host", "path", "p"])

    scored = feats.mapInArrow(rate, "doc_id long, host string, path string, p double").join(marks, "doc_id", "left")
    return posterior(stored(scored.select("doc_id", "host", "path", "p", F.coalesce("label", "p").alias("k")), "scored"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`score` accepts; all columns kept. A repeated id stays if any row of it does."""
    with scratch(docs.sparkSession):
        bad = score(docs, labels).groupBy("doc_id").agg(F.max("accepted").alias("good")).filter("not good")
        return without(docs, bad.select(F.col("doc_id").alias("_id")), {"_id": F.col("doc_id").cast("long")})
