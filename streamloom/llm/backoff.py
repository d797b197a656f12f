"""Stupid-backoff scores of every document, by relations of n-grams and their counts.

For each order up to ORDER the corpus' n-grams are exploded and counted in partitions of the
n-gram's hash. The documents' n-grams meet their counts there, and the logarithms are summed by
document.

A word scores count(n-gram) / count(its first n-1 words) for the longest n-gram, of at most
ORDER words and within its document, that the corpus holds, else BACKOFF times as much for
each word less; a single word scores count / all words, and one that the corpus doesn't hold
1 / all words. Logarithms (base 10) of counts are taken as whole millionths, so that the
order of adding doesn't matter.

Documents scored against themselves hold no n-gram that the corpus lacks, so nothing backs
off, and most counts cancel between a word and the next: what is left of each n-gram is one
term, which needs no other word's. So an order is shuffled once: each n-gram's rows lie together,
are counted, and their terms are summed by document at once. Of the orders that only documents as
short as themselves need, count tables are made and joined. Documents scored against another corpus
meet its count tables word by word.

N-grams that make up about a HOT-th of a sample of the rows or more, at most HOT of an order, are
counted apart and broadcast, so no task is one n-gram's. That is a choice of way, not of result: all
counts are of the whole corpus. N-grams are known by 64-bit hashes: in 10^10 different ones about
three share theirs with another.

Words: A-Z lower-cased, runs of digits, letters and characters above 7F. Null and wordless
texts have no words, score 0 and mean null. Repeated rows count as often as they occur, and
are scored each. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, release, saved

ORDER, BACKOFF, HOT, PART = 3, 0.4, 100_000, 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The array of the text's words; empty for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def micro(count) -> Column:
    """The logarithm of a count in millionths."""
    return F.rint(F.log10(count) * 1e6).cast("long")


def grams(told: DataFrame, n: int, *more: str) -> DataFrame:
    """gram (a hash) and last (the place of its last word, from 1) of all n-grams of the rows' words, with the columns named."""
    ends = [F.slice("words", i + 1, F.greatest(F.size("words") - (n - 1), F.lit(0))) for i in range(n)]
    if n == 1:
        each, parts = told.select(*more, F.posexplode("words").alias("at", "w")), ["w"]
    else:
        each, parts = told.select(*more, F.posexplode(F.arrays_zip(*ends)).alias("at", "w")), [F.col("w")[str(i)] for i in range(n)]
    return each.select(*more, F.xxhash64(*parts).alias("gram"), (F.col("at") + n).alias("last"))


def counts(told: DataFrame, n: int, least: int = 1) -> DataFrame:
    """The count table of an order: gram and its count, of those counted `least` times."""
    found = saved(grams(told, n).groupBy("gram").agg(F.count("*").alias("count")).where(F.col("count") >= least), f"grams{n}")
    release(told.sparkSession)
    return found


def met(rows: DataFrame, known: DataFrame, total: int, unknown: bool) -> list[DataFrame]:
    """rows with the counts of their grams, in parts; those without any (count null) only if unknown."""
    hot = F.broadcast(known.where(F.col("count") * HOT >= total))
    cold = known.where(F.col("count") * HOT < total)
    parts = [rows.join(hot, "gram")]
    if unknown or not cold.isEmpty():
        parts.append(rows.join(hot, "gram", "left_anti").join(cold, "gram", "left" if unknown else "inner"))
    return parts


def _frequent(told: DataFrame, n: int) -> DataFrame:
    """gram and count of the order's n-grams that are frequent in one row of PART: no more than HOT."""
    some = told.where(F.pmod(F.xxhash64("row"), F.lit(PART)) == 0)
    words_ = some.agg(F.sum("n_words")).first()[0] or 0
    often = grams(some, n).groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") >= max(4, words_ // HOT)).select("gram")
    found = saved(grams(told, n).join(F.broadcast(saved(often, "often")), "gram").groupBy("gram").agg(F.count("*").alias("count")), "frequent")
    release(told.sparkSession)
    return found


def _own_terms(told: DataFrame, order: int, total: int) -> list[DataFrame]:
    """row and micro, to be summed: each order's n-grams as often as they are added less as often as they are taken away.

    An n-gram is added where it is the longest that ends at its last word, and taken away where the word after it has it as its first words.
    """
    out = []
    for n in range(1, order + 1):
        first = F.col("last") == n
        longest = F.lit(True) if n == order else first
        begins = F.lit(False) if n == order else (F.lit(True) if n == order - 1 else first) & (F.col("last") < F.col("n_words"))
        rows = grams(told, n, "row", "n_words").select("row", "gram", (longest.cast("int") - begins.cast("int")).alias("times"))
        if n < order - 1:  # only rows of n words have a term
            parts = met(rows.where("times != 0"), counts(told, n, 2), total, False)
        else:
            frequent = F.broadcast(_frequent(told, n))
            counted = rows.join(frequent, "gram", "left_anti").withColumn("count", F.count("*").over(Window.partitionBy("gram")))
            parts = [rows.where("times != 0").join(frequent, "gram"), counted.where("count > 1 and times != 0")]
        out += [saved(p.groupBy("row").agg(F.sum(F.col("times") * micro("count")).alias("micro")), "terms") for p in parts]
        if n >= order - 1:
            del counted
        del parts, rows
        release(told.sparkSession)
    return out


def _terms(told: DataFrame, corpus: DataFrame, order: int, total: int, backoff: float) -> list[DataFrame]:
    """row and micro: the scores of its words against another corpus, summed."""
    parts = []
    for n in range(1, order + 1):
        for found in met(grams(told, n, "row"), counts(corpus, n), total, False):
            found = found.select("row", "last", F.lit(n).alias("n"), micro("count").alias("log"))
            parts += [found.withColumn("first", F.lit(False)), found.select("row", (F.col("last") + 1).alias("last"), (F.col("n") + 1).alias("n"), "log", F.lit(True).alias("first"))]
    places = told.where("n_words > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n_words").cast("int"))).alias("last"))
    logs = [F.max(F.when((F.col("n") == n) & (F.col("first") == first), F.col("log"))).alias(f"{'first' if first else 'whole'}{n}") for n in range(1, order + 1) for first in (False, True)]
    known = reduce(DataFrame.unionByName, parts).groupBy("row", "last").agg(*logs)
    less, every = micro(F.lit(backoff)), micro(F.lit(max(total, 1)))
    longest = F.least(F.col("last"), F.lit(order))
    value = F.coalesce(*[F.col(f"whole{n}") - (F.col(f"first{n}") if n > 1 else every) + (longest - n) * less for n in range(order, 0, -1)], (longest - 1) * less - every)
    scored = places.join(known, ["row", "last"], "left").groupBy("row").agg(F.sum(value).alias("micro"))
    return [scored]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", corpus: DataFrame | None = None, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """key, n_words, score (the summed log10) and mean (by word) of every row of docs, by the counts of corpus (null: docs themselves; else a table with the same text column)."""
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), words(F.col(text).cast("string")).alias("words"))
    told = saved(told.withColumn("n_words", F.size("words").cast("long")), "words")
    if corpus is None:
        total = told.agg(F.sum("n_words")).first()[0] or 0
        terms = _own_terms(told, order, total)
        once = -micro(F.lit(max(total, 1))) * (F.col("n_words") if order == 1 else 1)  # each single word is taken of all words
    else:
        held = saved(corpus.select(words(F.col(text).cast("string")).alias("words")), "corpus")
        total = held.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
        terms = _terms(told, held, order, total, backoff)
        once = F.lit(0).cast("long")
    summed = reduce(DataFrame.union, terms).groupBy("row").agg(F.sum("micro").alias("micro"))
    out = told.select("row", "k", "n_words").join(bounded(summed, F.lit(16)), "row", "left")
    value = F.when(F.col("n_words") > 0, F.coalesce("micro", F.lit(0)) + once).otherwise(0) / 1e6
    return out.select(F.col("k").alias(key), "n_words", value.alias("score"), F.when(F.col("n_words") > 0, value / F.col("n_words")).alias("mean"))


#: The same in DuckDB, of the table documents.
SQL = """
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents)
), g AS (
  SELECT *, lag(word, 1) OVER d AS w1, lag(word, 2) OVER d AS w2 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT word, count(*) AS n FROM g GROUP BY ALL),
c2 AS (SELECT w1, word, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w2, w1, word, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
t AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id, CASE
      WHEN c3.n IS NOT NULL THEN round(log10(c3.n) * 1e6) - round(log10(x2.n) * 1e6)
      WHEN c2.n IS NOT NULL THEN round(log10(c2.n) * 1e6) - round(log10(x1.n) * 1e6) + (least(i, 3) - 2) * round(log10(0.4::DOUBLE) * 1e6)
      ELSE round(log10(c1.n) * 1e6) - round(log10(t.n) * 1e6) + (least(i, 3) - 1) * round(log10(0.4::DOUBLE) * 1e6) END::BIGINT AS micro
  FROM g CROSS JOIN t JOIN c1 ON c1.word = g.word
  LEFT JOIN c2 ON c2.w1 = g.w1 AND c2.word = g.word
  LEFT JOIN c3 ON c3.w2 = g.w2 AND c3.w1 = g.w1 AND c3.word = g.word
  LEFT JOIN c2 x2 ON x2.w1 = g.w2 AND x2.word = g.w1
  LEFT JOIN c1 x1 ON x1.word = g.w1
)
SELECT documents.doc_id, count(micro) AS n_words, coalesce(sum(micro), 0)::DOUBLE / 1e6 AS score,
  CASE WHEN count(micro) > 0 THEN sum(micro)::DOUBLE / 1e6 / count(micro) END AS mean
FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
