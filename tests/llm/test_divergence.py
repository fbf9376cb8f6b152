import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from scribelake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, digest long, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, at_least, top):
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= at_least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        every = sum(total.values())
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (every + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())))]
    return sorted(out)


def rows():
    rng = random.Random(3)
    words = ["Ana", "été", "straße", "x", "日本", "B", "zeta", "é", "Ω", "alpha9beta", "don't", "ÀB"] + [a + b for a, b in itertools.product("bcdfg", ["a", "en", "ort"])]
    out = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "s3", "é", None])
        some = rng.sample(words, 14)
        out.append((" ".join(rng.choice(some) for _ in range(rng.randint(1, 40))), lang, source))
    out += [(None, "en", "mute"), ("", "en", "s1"), (" 12 .. ", "de", "only"), ("Ana " * 300_000, "en", "s2"), ("solo", "it", "a"), ("solo", "it", "b")]
    return out + [("bort bort", "en", "s3")] * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 7, 7) for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_equals_brute_force(spark, monkeypatch, bits):
    """With 3 bits nearly all digests collide and are split."""
    monkeypatch.setattr(divergence, "TERMS", 5)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "HELD", 60)
    monkeypatch.setattr(divergence, "SEGMENT", 1000)
    got = divergence.audit(frame(spark, rows()), at_least=20, top=6, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), 20, 6)


def test_audit_without_terms(spark):
    some = [("a b", "en", "x"), (None, "en", "y"), (None, None, None)]
    assert sorted(map(tuple, divergence.audit(frame(spark, some)).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(frame(spark, [])).count() == 0
