"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced character.

A word with a terminator behind it, ``w$``, is turned to begin at each of its places. Turned to begin just behind a character, it
ends in that character; without it, it is the place's prefix. Two words that differ in one character have the same prefix at its
place, and a word that lacks the character is, turned whole, that prefix itself. So sorted rotations bring all of them together:
the words that begin with a prefix and go on by one character, and the one that ends there. Such a group has at most one word for
each character of the alphabet, and one that is whole. A scan gives each word the number of its neighbours in the group and
the best of them (most frequent, then smallest), never the pairs.

A character that repeats its left neighbour can be left out at either place with the same result; only the first counts, so
each pair of words is met once in all groups.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, dealt, lasting, n_tasks, scratch, stored

#: Code points of a word and occurrences over all documents, at least; how many times a form is more frequent than its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words held per task before their counts go on; words longer than this are turned as digests, so that their rotations take
#: memory in proportion to the word.
HELD, LONG = 1 << 17, 64
#: Letters of a text whose runs are held at once.
PIECE = 1 << 22
#: One of so many runs, by its digest, loses a character.
SLIPS = 199

RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_END = "$"


def slipped(word: str, h: int) -> str:
    """``word``, without the code point that ``h`` names if ``SLIPS`` divides it."""
    if h % SLIPS:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counted_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words, counted over all documents. Runs that are too short stay so and aren't counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for k in range(0, len(rows), 1 << 14):
                part = rows[k : k + (1 << 14)]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64())})
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begun, text = zlib.crc32(f"{doc}:".encode()), text.lower().decode(errors="replace")
                runs = RUN.findall(text) if len(text) < PIECE else (m[0] for m in RUN.finditer(text))  # not all runs of a very long text at once
                for run, n in Counter(runs).items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % SLIPS == 0:
                        run = slipped(run, h)
                        if len(run) < LEAST_LENGTH:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield from flush()
        yield from flush()

    bounded_batches(docs.sparkSession)
    # bytes: lower() of bytes changes A-Z only
    rows = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _short_rotations(words: DataFrame) -> DataFrame:
    """``key, wid, n, whole, first`` of each rotation: whole, or without the character in front of which it begins."""
    size = F.char_length("word")
    tail = lambda i: F.concat(F.col("word").substr(i + 1, size), F.lit(_END))
    head = lambda i: F.col("word").substr(F.lit(1), i)
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(tail(i), head(i)).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first")))

    def skip(i: Column) -> Column:
        first = (i == 0) | (F.col("word").substr(i, F.lit(1)) != F.col("word").substr(i + 1, F.lit(1)))
        return F.struct(F.concat(tail(i + 1), head(i)).alias("key"), F.lit(False).alias("whole"), first.alias("first"))

    skipped = F.transform(F.sequence(F.lit(0), size - 1), skip)
    return words.select("wid", "n", F.explode(F.concat(whole, skipped)).alias("r")).select("r.key", "wid", "n", "r.whole", "r.first")


_P = (1 << 61) - 1
_BASES = (911_382_323_987_654_321, 572_904_318_111_222_333)


def _long_rotations(words: DataFrame) -> DataFrame:
    """The same of long words; a key is the place, the length and two digests of 61 bits each of what stands left and right."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wid, n, word in zip(*(batch.column(c).to_pylist() for c in ("wid", "n", "word")), strict=True):
                size, left, right = len(word), [], []
                for base in _BASES:
                    h, hs = 0, [0]
                    for c in word:
                        h = (h * base + ord(c) + 1) % _P
                        hs.append(h)
                    g, gs, power = 0, [0], 1
                    for c in reversed(word):  # of the last letters, as if they were hashed from their own first one
                        g = (g + (ord(c) + 1) * power) % _P
                        power = power * base % _P
                        gs.append(g)
                    left.append(hs)
                    right.append(gs[::-1])
                key = lambda i, j: f"{_END}{i}:{size - (j - i)}:{left[0][i]:x}{_END}{left[1][i]:x}{_END}{right[0][j]:x}{_END}{right[1][j]:x}"  # noqa: B023, E731
                for k in range(0, size + 1, 4096):
                    at = range(k, min(k + 4096, size + 1))
                    cuts = range(k, min(k + 4096, size if size > LONG else 0))  # words of LONG are here for longer ones only
                    m = len(at) + len(cuts)
                    yield pa.RecordBatch.from_pydict({
                        "key": [key(i, i) for i in at] + [key(i, i + 1) for i in cuts], "wid": [wid] * m, "n": [n] * m,
                        "whole": [True] * len(at) + [False] * len(cuts), "first": [False] * len(at) + [i == 0 or word[i - 1] != word[i] for i in cuts],
                    })

    return words.select("wid", "n", "word").mapInArrow(turn, "key string, wid long, n long, whole boolean, first boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """``wid, n_near, best`` of the words with neighbours; ``best`` is a struct of the negative count and the ``wid`` of the neighbour
    with the largest count, the smallest ``wid`` among several. ``words``: ``wid, word, n``."""
    turned = _short_rotations(words.filter(F.char_length("word") <= LONG))
    long_words = words.filter(F.char_length("word") > LONG - 1)  # a word of LONG may lack a character of a longer one
    turned = turned.unionByName(_long_rotations(long_words))
    one = F.struct((-F.col("n")).alias("neg"), F.col("wid").alias("wid"))
    size = F.char_length("word")
    total = words.agg(F.coalesce(F.sum((2 * size + 1) * (F.least(size, F.lit(2 * LONG)) + 24)), F.lit(0))).first()[0]
    turned = dealt(turned, total, "key")
    skip, group = ~F.col("whole"), Window.partitionBy("key").orderBy("whole", F.desc("n"), "wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = turned.withColumns({
        "n_skip": F.sum(skip.cast("long")).over(group),
        "n_first": F.sum(F.col("first").cast("long")).over(group),
        "top": F.first_value(F.when(skip, one)).over(group),
        "second": F.nth_value(F.when(skip, one), 2).over(group),
        "top_first": F.min(F.when(F.col("first"), one)).over(group),
        "shorter": F.max(F.when(F.col("whole"), one)).over(group),
    })
    other = F.when(F.col("top.wid") != F.col("wid"), F.col("top")).otherwise(F.col("second"))
    has_shorter = F.col("first") & F.col("shorter").isNotNull()
    near = F.when(F.col("whole"), F.col("n_first")).otherwise(F.col("n_skip") - 1 + has_shorter.cast("long"))
    best = F.when(F.col("whole"), F.col("top_first")).otherwise(F.least(other, F.when(has_shorter, F.col("shorter"))))
    met = scanned.select("wid", near.alias("near"), best.alias("best")).filter("near > 0")
    return met.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``wid, form, root`` from ``wid, form``: forms followed to the last. Each form is ``TIMES`` times more frequent than what it is the
    form of, so there are no rings, and doubling the steps ends after a few rounds."""
    now = cut(forms.withColumn("root", F.col("form")))
    while True:
        up = now.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(up, "root", "left").select("wid", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased, after the slips that
    :func:`slipped` makes by document and run; of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences ``n`` overall.
    ``n_near`` counts the words that differ by one inserted, deleted or replaced code point; ``form`` is the most frequent of these
    (then the smallest by code points) if it occurs at least ``TIMES`` times as often, ``form_n`` its count, ``root`` the last of the
    forms of forms, the word itself if it has none. Null texts have no words, a null id counts as the empty string; repeated rows
    count again. Words of any length are compared; beyond ``LONG`` code points what stands left and right of a place is compared by
    digests of 122 bits. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    with scratch(docs.sparkSession):
        counted = stored(counted_words(docs), "counts")
        rows = counted.count()
        # numbers that follow the order of code points, which is that of UTF-8
        parts = n_tasks(docs.sparkSession, rows * 64, 32 << 20)
        words = stored(counted.repartitionByRange(parts, "word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id()), "words")
        near = cut(neighbours(words))
        formed = words.select("wid", "n").join(near, "wid").filter(-F.col("best.neg") >= TIMES * F.col("n"))
        forms = roots(formed.select("wid", F.col("best.wid").alias("form")))
        name = lambda c: words.select(F.col("wid").alias(c), F.col("word").alias(f"{c}_word"))
        named = forms.join(name("form"), "form").join(name("root"), "root").select("wid", "form_word", "root_word")
        out = words.join(near, "wid", "left").join(named, "wid", "left")
        out = out.select(
            "word",
            F.col("form_word").alias("form"),
            F.coalesce("root_word", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("form_word").isNotNull(), -F.col("best.neg")).alias("form_n"),
        )
        return lasting(out, "variants")
