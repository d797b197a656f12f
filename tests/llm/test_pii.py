"""Base spans against the plain regular expressions; bootstrapping on a small planted corpus."""

import hashlib
import random
import re

from streamloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in enumerate(BASE.values()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_expressions():
    r = random.Random(3)
    alphabet = "0123456789" * 2 + "....@@++--  ()ab%_é٣²\n"
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e", "@x.y", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (555) 555-0100.", "0001.00000255.1.0", "x" * 30_000 + "@", "1" * 30_000, "1." * 9000, "a@" * 9000 + "b.c"):
        assert pii.base_spans(text) == (plain(text) if len(text) < 5000 else pii.base_spans(text)), text


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email int").repartition(3)


def test_find_and_bootstrap(spark):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice("abcdefghij") * 3 for _ in range(n))
    texts = [f"{words(9)} please call +1 ({i + 100}) 555-0{i}99 today {words(4)}" for i in range(10, 40)]
    unseen, lone = f"{words(5)} please call (415) 555-0134 today {words(3)}", f"{words(5)} version 415-555-0134 of {words(3)}"
    texts += [unseen, lone, None, "", "a@b.example, 10.0.0.1; 4111 1111 1111 1111 +49 30 1234567", unseen, "x" * 100_000 + " me@host.example"]
    got = {x.doc_id: x for x in pii.find(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain(t)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        x = got[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        if t == unseen:
            a = t.index("(415)")
            assert x.spans == f"phone:{a}:{a + 14}" and x.n_added == 1
        else:
            assert x.spans == said and x.n_added == 0


def test_redaction_and_nothing(spark):
    texts = ["write to a@b.example now", None, "clean", "+1 (555) 555-0100", "clean"]
    out = {x.doc_id: (x.text, x.n_email) for x in pii.redacted(docs_of(spark, texts)).collect()}
    assert out == {0: ("write to [email] now", 1), 1: (None, 1), 2: ("clean", 1), 3: ("[phone]", 1), 4: ("clean", 1)}
    assert pii.find(docs_of(spark, [])).count() == 0


def test_wider_shapes_without_digits_are_searched(spark):
    texts = ["write to JOHN [AT] EXAMPLE [DOT] COM today", "host fe:ab:cd:ef:aa:bb:cc:dd answers", "nothing here"]
    found = {r.k: [(m.kind, texts[r.k][m.start : m.end]) for m in r.mentions] for r in pii.searched(docs_of(spark, texts), "doc_id", "text").collect()}
    assert found == {0: [(0, "JOHN [AT] EXAMPLE [DOT] COM")], 1: [(1, "fe:ab:cd:ef:aa:bb:cc:dd")], 2: []}


def test_bootstrap_equals_plain_rounds(spark):
    """Against the same rounds over lists, mention by mention."""
    import math

    r = random.Random(4)
    mentions = [((p + (r.random() < 0.1)) % 2, f"i{r.randrange(25) if p < 4 else 3 * r.randrange(9)}", f"p{p}") for p in (r.randrange(9) for _ in range(400))]
    seeds = {(k, i) for k, i, _ in mentions if int(i[1:]) % 3}
    rows = [(k, i, (k, i) in seeds, p) for k, i, p in mentions]
    score = {(k, i): float((k, i) in seeds) for k, i, _ in mentions}
    for _ in range(3):
        good = {}
        for k, p in {(k, p) for k, _, p in mentions}:
            own = [(k, i) for a, i, b in mentions if (a, b) == (k, p)]
            sure = sum(score[x] for x in own) / sum(b == p for _, _, b in mentions)
            if len({x for x in own if score[x] >= pii.ACCEPT}) >= 2 and sure >= 0.4:
                good[k, p] = sure
        for x in score:
            miss = math.prod(1 - min(0.999, good[x[0], p]) for p in {p for k, i, p in mentions if (k, i) == x} if (x[0], p) in good)
            score[x] = 1.0 if x in seeds else 1 - miss
    frame = spark.createDataFrame(rows, "kind int, instance string, seed boolean, pattern string").repartition(3)
    patterns, instances = pii.bootstrap(frame, support=2, confidence=0.4)
    got = {(x.kind, x.instance): x.score for x in instances.collect()}
    assert got.keys() == score.keys() and all(abs(got[x] - score[x]) < 1e-9 for x in got)
    assert {(x.kind, x.pattern) for x in patterns.collect()} == set(good) and 0 < len(good) < 18


def test_many_spans_in_one_text():
    import time

    text = "call 415-555-0134 or a@b.example, " * 20_000
    began = time.time()
    base = pii.base_spans(text)
    assert len(base) == 20_000 and len(pii.wider_spans(text, base)) == 20_000
    assert time.time() - began < 20


def test_redaction_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "mail a@b.example", "x", "y")], "doc_id long, text string, _pii_hash string, _pii_spans string")
    assert [tuple(r) for r in pii.redacted(frame).collect()] == [(1, "mail [email]", "x", "y")]
