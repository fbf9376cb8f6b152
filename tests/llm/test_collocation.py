import random
import re
from collections import Counter, defaultdict

import pytest

from scribelake.llm import collocation

SCHEMA = "doc_id long, text string, lang string, code long, n long, k int"


def brute(rows, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        some = {p for p, n in f.items() if len(p) > 1 and n >= least}
        gone = {q for p in some if len(p) == 3 for q in (p[:2], p[1:]) if 100 * f[p] >= share * f[q]}
        found = []
        for p in some - gone:
            cuts = [(1000000 * f[p] * f[p] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s, k) for i, (s, a, p, l, r, k) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows():
    rng = random.Random(4)
    words = [a + b for a in ("Ka", "lo", "mÉ", "ne") for b in ("bel", "dor", "fin", "ß", "x\x00y")]
    out = []
    license_line = "granted free of charge to any person who holds a copy"
    for i in range(200):
        text = ""
        for _ in range(rng.randint(1, 30)):
            text += rng.choice(words[: rng.choice([4, 20])]) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n"])
        if i % 4 == 0:
            text += "; " + license_line + ("." if i % 8 else " ne dor")
        out.append((text, rng.choice(["en", "en", "fr", None])))
    out += [(None, "en"), ("", "fr"), (" .. \n", "en"), ("hot pair " * 4000, "en"), ("hot pair cold", "en"), ("echo", "de"), ("w" * 5000, "en")]
    return out + [("once more with feeling", "fr")] * 12


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 5, 5, 5) for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("mode", ["ranks", "digests"])
def test_collocations_equal_brute_force(spark, monkeypatch, mode):
    """Small flushes, long texts in segments, hot words; digests start with a seed under which all words collide."""
    for name, value in (("HELD", 300), ("HELD_WORDS", 30), ("SEGMENT", 50), ("KEYS", 7)):
        monkeypatch.setattr(collocation, name, value)
    if mode == "digests":
        monkeypatch.setattr(collocation, "DICTIONARY_WORDS", 0)
        true = collocation.digest
        monkeypatch.setattr(collocation, "digest", lambda lang, word, seed: 9 if seed == 0 else true(lang, word, seed))
    got = collocation.collocations(frame(spark, rows()), least=6, share=50, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "k"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), 6, 50, 40)


def test_paths_are_maximal_and_carry_their_counts(spark):
    """The license line is one path; what branches off ends it."""
    table, codes_of, ranks = collocation._coded(spark, collocation.vocabulary(frame(spark, rows())), 6)
    found, pairs, _ = collocation.flows(collocation.edges(frame(spark, rows()), codes_of, ranks, collocation.np.array([1, 2])), 6)
    text = {r.code: (r.lang, r.word) for r in table.collect()}
    got = {(text[r.codes[0]][0], " ".join(text[c][1] for c in r.codes)): r.n for r in collocation.paths(found, collocation.unary(found, pairs)).collect()}
    line = "granted free of charge to any person who holds a copy"
    en = sum(line in (t or "") for t, lang in rows() if lang == "en")
    assert got["en", line] == en
    assert got["en", "hot pair hot pair"] == 3999 and got["fr", "once more with feeling"] == 12


def test_no_documents(spark):
    assert collocation.collocations(frame(spark, [])).count() == 0
