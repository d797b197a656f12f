"""Personal data: fixed grammars first, then bootstrapped contextual extraction.

The spans that the grammars of email, ip, card and phone find are the seeds. Every mention,
seed or not, of something shaped like an identifier stands in lexical patterns: the word
before it, the two words before it, the word after it, and the words on both sides. Patterns and instances form a
graph that Spark scores in rounds: a pattern of a kind is as good as the share of its
mentions that are good instances of the kind (with enough distinct ones), an instance as
good as the noisy-or of its patterns. Instances of a kind's wider shape that no seed
grammar takes (an address without a dot, a spelt-out one, a six-part or colon address, a
number without +, a short card) are added where they score at least ACCEPT.

Seeds stay whatever the scores. Added spans never overlap seeds or each other. Null and empty texts
have no spans. Repeated rows are searched alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, column, numbered, saved, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Distinct good instances that a pattern needs, its least confidence, an instance's least score, rounds.
SUPPORT, CONFIDENCE, ACCEPT, ROUNDS = 3, 0.8, 0.9, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: The wider shapes, by kind.
WIDER = {
    "email": re.compile(r"(?i)(?<![\w.@+-])[a-z0-9][\w.+-]{0,63}(?:@[a-z0-9-]{2,63}|\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{2,63}|\.[a-z0-9-]{2,63}){1,4})(?![\w@.-])"),
    "ip": re.compile(r"(?i)(?<![\w:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,3}(?![\w-])|(?<![\w.+-])3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ once: the run of local characters before it, back to the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Number chains, four parts at a time."""
    for chain in _CHAIN.finditer(text):
        if "." not in chain[0]:
            continue
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap, without those that fail."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, a, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _joined(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that the spans cover, rising."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def wider_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the wider shapes that touch no base span."""
    out: list[tuple[int, int, int]] = []
    for kind, name in enumerate(KINDS):
        if name == "email" and "@" not in text and "at]" not in text.lower() and "at)" not in text.lower():
            continue
        found = [m.span() for m in WIDER[name].finditer(text)]
        if found:
            starts, ends = _joined((a, b) for _, a, b in (*base, *out))
            for a, b in found:
                i = bisect_right(ends, a)
                if i == len(ends) or starts[i] >= b:
                    out.append((kind, a, b))
    return out


_BEFORE = re.compile(r"\S+")


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention."""
    before = [w.strip(".,;:!?()[]\"'").lower() for w in _BEFORE.findall(text[max(0, start - 80) : start])][-2:]
    after = [w.strip(".,;:!?()[]\"'").lower() for w in _BEFORE.findall(text[end : end + 40].lstrip(",.;:!?)]\"'"))][:1]
    out = []
    if before:
        out.append(f"{before[-1]} _")
    if len(before) > 1:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"_ {after[0]}")
        if before:
            out.append(f"{before[-1]} _ {after[0]}")
    return out


_SPAN = "struct<kind:int,start:bigint,end:bigint>"
_MENTION = "struct<kind:int,start:bigint,end:bigint,seed:boolean,instance:string,patterns:array<string>>"


def searched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, hash (of the text), base (spans) and mentions of every row; one scan of the texts."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).withColumn("hash", F.sha2("text", 256))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    mention = pa.struct([*span, ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, mentions = [], []
            for value in column(batch, "text"):
                t = value.as_py() or ""
                base = base_spans(t)
                wide = wider_spans(t, base)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                mentions.append([{"kind": k, "start": a, "end": b, "seed": seed, "instance": t[a:b].lower()[:200], "patterns": patterns(t, a, b)} for seed, spans in ((True, base), (False, wide)) for k, a, b in spans])
            yield batch_of({"k": (column(batch, "k"), None), "hash": (column(batch, "hash"), None), "base": (bases, pa.list_(span)), "mentions": (mentions, pa.list_(mention))})

    return small_batches(rows).mapInArrow(mapped, f"k {rows.schema['k'].dataType.simpleString()}, hash string, base array<{_SPAN}>, mentions array<{_MENTION}>")


def bootstrap(mentions: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, confidence, support) and (kind, instance, score) after some rounds.

    mentions: kind, instance, seed, pattern, a row for each mention and pattern. Edges are counted
    before anything is joined, and a pattern's mentions are summed, never gathered.
    """
    edges = saved(mentions.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    all_kinds = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    scores = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("score"))
    good = None
    for _ in range(rounds):
        weighed = edges.join(scores, ["kind", "instance"])
        good = weighed.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.sum((F.col("score") >= ACCEPT).cast("long")).alias("support"))
        good = good.join(all_kinds, "pattern").select("kind", "pattern", (F.col("mass") / F.col("total")).alias("confidence"), "support")
        good = saved(good.where((F.col("support") >= support) & (F.col("confidence") >= confidence)), "patterns")
        miss = F.sum(F.when(F.col("confidence").isNotNull(), F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))
        scores = edges.join(bounded(good, F.octet_length("pattern") + 40), ["kind", "pattern"], "left").groupBy("kind", "instance").agg(F.max("seed").alias("seed"), F.coalesce(miss, F.lit(0.0)).alias("miss"))
        scores = saved(scores.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("score")), "instances")
    return good, scores


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT, **more) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans (all, as kind:start:end by kind, then start), n_added, text_hash."""
    rows = saved(searched(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "mentions")
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    _, scores = bootstrap(each.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")), **more)
    good = bounded(scores.where(F.col("score") >= accept).select("kind", "instance"), F.octet_length("instance") + 24)
    added = each.where(~F.col("seed")).join(good, ["kind", "instance"])
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = rows.select("row", "k", "hash", "base").join(added, "row", "left")
    kinds = F.array(*map(F.lit, KINDS))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    extra = F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))
    return out.select(F.col("k").alias(key), *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_added"), F.col("hash").alias("text_hash"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[{}]", accept: float = ACCEPT, **more) -> DataFrame:
    """docs with every span replaced by its kind's mark; other columns and rows stay as they are.

    Rows meet their spans by the SHA-256 of their text, on which alone spans depend; the spans are
    broadcast if they are few, else joined.
    """
    found = find(docs, key, text, accept, **more)
    spans = saved(found.where(F.col("spans") != "").groupBy(F.col("text_hash").alias("_pii_hash")).agg(F.first("spans").alias("_pii_spans")), "spans")
    spans = bounded(spans, F.octet_length("_pii_spans") + 80)
    place = docs.columns.index(text)
    joined = numbered(docs).join(spans, F.sha2(F.col(f"c{place}").cast("string"), 256) == spans["_pii_hash"], "left")

    @F.pandas_udf("string")
    def replace(texts, spans):
        import pandas as pd

        out = []
        for t, s in zip(texts, spans, strict=True):
            if s and t:
                cuts = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(",")))
                done, parts = 0, []
                for a, b, k in cuts:
                    if b > done:
                        parts += [t[done : max(a, done)], mark.format(k)]
                        done = b
                t = "".join(parts) + t[done:]
            out.append(t)
        return pd.Series(out, dtype=object)

    own = F.col(f"c{place}")
    cut = F.when(F.col("_pii_spans").isNull(), own).otherwise(replace(own.cast("string"), "_pii_spans"))
    return joined.select(*[(cut if i == place else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
