"""URL filters: fixed rules first, else logistic regression on hashed character n-grams of host and path.

Nulls and texts without "://" have an empty host and path, fit no rule and get the
model's verdict for an empty URL (its intercept). Each row is judged alone, so ties,
repeated rows and empty tables need nothing special; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): each rule holds for its host and all subdomains where the path starts so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The small labelled table is made of these: a host is a TOPICS word (1: block) joined to a COMMON one, either first, or a topic alone.
TOPICS = {
    1: "casino poker slots betting jackpot roulette pills viagra pharmacy-rx steroids porn xxx adult escort camgirls warez torrents keygen cracked phishing spam adserver adclick tracking popunder lottery payday replica botnet malware".split(),
    0: "library museum history science physics biology cooking recipes gardening travel weather news journal university college school hospital music painting poetry football cycling astronomy geology railway archive dictionary atlas theatre kitchen".split(),
}
COMMON = "online daily best city my free world house".split()
#: Made-up names (no word of any topic), which are allowed: joined of these syllables.
SYLLABLES = "ka ro mi ten sul vor lin dra pe zo nar bel".split()
PREFIXES = ("", "www.", "m.", "blog.")
TAILS = ((".example.com", "/en/123"), (".example.net", "/de/45.html"), (".example.org", "/es/678/"))
SIZE, GRAMS = 1 << 16, (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to /, ? or #, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(rule: Sequence[str]) -> str:
    return rule[1] + rule[2]


def _longest(host: Column, path: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: len(rule_name(r)), reverse=True)
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    return F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path, each field marked."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{mark}{n}{text[i : i + n]}".encode()) % SIZE for i in range(max(1, len(text) - n + 1)))
    return np.fromiter(sorted(found), np.int64, len(found))


def labelled_urls(topics=TOPICS, common: Sequence[str] = COMMON) -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 to block)."""
    hosts = [(h, y) for y, words in topics.items() for t in words for h in (t, *(f"{t}-{c}" for c in common[::2]), *(f"{c}-{t}" for c in common[1::2]))]
    hosts += [(a + b + c, 0) for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) for c in SYLLABLES[(i + j) % 4 :: 4]]
    return [(p + h + end, path, y) for i, (h, y) in enumerate(hosts) for j, p in enumerate(PREFIXES) for end, path in (TAILS[(i + j) % len(TAILS)],)]


def train(rows=None, epochs: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, by full-batch gradient descent (Adagrad)."""
    rows = labelled_urls() if rows is None else rows
    each = [features(h, p) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    at, of = np.concatenate(each), np.repeat(np.arange(len(rows)), [len(x) for x in each])
    scale = 1 / np.sqrt([max(1, len(x)) for x in each])
    w, b, gw, gb = np.zeros(SIZE), 0.0, np.full(SIZE, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(of, w[at], len(rows)) * scale + b
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.bincount(at, (error * scale)[of], SIZE) + l2 * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        gb += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(gb)
    return w, b


def score(host: str, path: str, w: np.ndarray, b: float) -> float:
    x = features(host, path)
    return float(1 / (1 + np.exp(-(w[x].sum() / np.sqrt(len(x)) + b))))


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, model=None) -> DataFrame:
    """key, host, path, rule (or null), verdict and the model's block_score for each row of pages.

    One scan, no shuffle: rules are column expressions, and only the weights (SIZE doubles) go to the executors.
    """
    w, b = train() if model is None else model
    host, path = host_and_path(F.col(url))
    kind = pages.schema[key].dataType
    seen = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [score(h, p, w, b) for h, p in zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "block_score"])

    out = small_batches(seen).mapInArrow(scored, T.StructType([*seen.schema.fields, T.StructField("block_score", T.DoubleType())]))
    ruled = _longest(F.col("host"), F.col("path"), rules, rule_name)
    verdict = F.coalesce(_longest(F.col("host"), F.col("path"), rules, lambda r: r[0]), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select(F.col("k").cast(kind).alias(key), "host", "path", ruled.alias("rule"), verdict.alias("verdict"), "block_score")
