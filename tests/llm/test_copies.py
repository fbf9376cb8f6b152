"""Substring de-duplication and the n-gram join: pasted passages, brute force, repeated and large ids."""

import random

import pytest

from scribelake.llm import ngramjoin, substring
from scribelake.llm.words import SEGMENT, folded, hash_texts

from .helpers import empty, frame

VOCABULARY = [a + b + c for a in "bcdfghjk" for b in ("ama", "elo", "iru", "uno") for c in ("ten", "sor", "pik", "lad")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def pasted(low, high, edited=False, n=30):
    """Pairs of documents with a common passage of ``low`` to ``high`` words inside a line, or over line ends."""
    rng, rows, passages = random.Random(low), [], {}
    for i in range(n):
        passages[i] = words(rng, rng.randint(low, high))
        for k in range(2):
            mine = list(passages[i])
            if edited and k:
                mine[len(mine) // 2] = "changed"
            if i % 4 == 3 and k:
                mine[20] += "\n" + mine.pop(21)
            rows.append((2 * i + k, " ".join(words(rng, 60) + mine + words(rng, 60)), None, None, 0, None, None))
    return rows, passages


def test_pasted_passages_are_found_in_full_and_shorter_ones_are_not(spark):
    rows, passages = pasted(51, 60)
    more, longer = pasted(61, 120)
    short, _ = pasted(25, 46)
    rows += [(1000 + r[0], *r[1:]) for r in more] + [(2000 + r[0], *r[1:]) for r in short]
    docs = frame(spark, rows).repartition(5)
    found = substring.substring_dedup(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == set(range(60)) | set(range(1000, 1060)) and found.count() == 120
    for shift, some in ((0, passages), (1000, longer)):
        for i, passage in some.items():
            a, b = got[shift + 2 * i], got[shift + 2 * i + 1]
            # chance can lengthen a common stretch by a word
            assert all(r.start <= 60 and r.start + r.n_words >= 60 + len(passage) and r.n_words <= len(passage) + 4 and r.kept_in == shift + 2 * i for r in (a, b))
            assert a.cluster_id == b.cluster_id and b.removed and not a.removed
    assert len({r.cluster_id for r in got.values()}) == 60
    left = {r.doc_id: r.text for r in substring.cut(docs, found).collect()}
    for i, passage in passages.items():
        assert " ".join(passage) in " ".join(left[2 * i].split()) and 112 <= len(left[2 * i + 1].split()) <= 120
    assert left[2001] == short[1][1]


def test_edited_passages_and_awkward_rows(spark):
    rows, _ = pasted(60, 90, edited=True, n=12)
    rows = [(r[0] + (1 << 62), *r[1:]) for r in rows]  # ids as hashes give
    shared = " ".join(words(random.Random(5), 70))
    rows += [(7, "alpha " + shared, None, None, 0, None, None), (7, "beta " + shared, None, None, 0, None, None)]  # one doc_id, so no other document
    rows += [(8, None, None, None, 0, None, None), (9, "", None, None, 0, None, None), (None, shared, None, None, 0, None, None)]
    rows += [(10, "x" * 200_000, None, None, 0, None, None), (11, "y " * 20, None, None, 0, None, None)]
    got = substring.substring_dedup(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {(1 << 62) + i for i in range(24)} and len(got) == 24
    assert substring.substring_dedup(empty(spark)).count() == 0
    named = spark.createDataFrame([("a", shared), ("b", "new " + shared), ("b", "other"), ("b", "other")], "doc_id string, text string")
    assert sorted((r.doc_id, r.removed, r.kept_in) for r in substring.substring_dedup(named).collect()) == [("a", False, "a"), ("b", True, "a")]


def test_repeating_text_is_found(spark):
    rows = [(1, "one " + "same " * 300), (2, "Same\n" * 200), (3, "a b " * 200), (4, "start b " + "a b " * 100), (5, "same " * 30)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    covered = {d: set() for d in (2, 4)}
    for r in got:
        if r.doc_id in covered:
            covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert len(covered[2]) >= 140 and len(covered[4]) >= 140


def test_found_passages_equal_brute_force(spark):
    rng, least = random.Random(3), 51
    stock = [words(rng, n) for n in (30, 45, 52, 60, 150)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(3):
            part = rng.choice(stock)
            text += words(rng, rng.randint(3, 25)) + part[rng.randrange(len(part)) :]
        rows.append((i, " ".join(text)))
    every = {d: t.split() for d, t in rows}
    holders = {}
    for d, w in every.items():
        for i in range(len(w) - least + 1):
            holders.setdefault(tuple(w[i : i + least]), set()).add(d)
    want = {(d, i + k) for d, w in every.items() for i in range(len(w) - least + 1) if len(holders[tuple(w[i : i + least])]) > 1 for k in range(least)}
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    here = {(r.doc_id, r.start + k) for r in got for k in range(r.n_words)}
    assert {d for d, _ in want} == {d for d, _ in here}
    # chance can lengthen the stretch that another than the least document shares by a word
    assert len(want - here) <= 0.01 * len(want)
    # beyond them only words between aligned parts, and parts that are long enough together
    assert len(here - want) <= 0.1 * len(want)


def test_passages_are_found_behind_pieces_in_earlier_documents(spark):
    """Two documents hold a passage of which earlier ones hold pieces of 45 words, or of 15 to 50 words all over it."""
    rng, rows, wanted = random.Random(9), [], []

    def add(part):
        rows.append((len(rows), " ".join(words(rng, 20) + part + words(rng, 20))))

    for k in range(25):
        passage = words(rng, rng.randint(51, 200) if k else 200)
        for i in range(10):
            n = 45 if k == 0 else rng.randint(15, 50)
            at = i * (len(passage) - n) // 9 if k == 0 else rng.randint(0, len(passage) - n)
            add(passage[at : at + n])
        wanted.append((len(rows), len(passage)))
        add(passage)
        add(passage)
    got = {}
    for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_words for r in got[wanted[0][0] + 1]) >= 200 and got[wanted[0][0] + 1][0].kept_in == wanted[0][0]
    found = sum(any(r.removed and r.n_words >= 51 for r in got.get(d + 1, [])) for d, _ in wanted)
    assert found >= 0.95 * len(wanted)


def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randint(0, 50))) + rng.choice(["", "\n", " \t"]) for _ in range(200)] + ["", "é " * 10, "z" * 5000]
    h, counts = hash_texts([folded(t) for t in texts])
    flat = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))
    from scribelake.llm import words as module

    monkeypatch.setattr(module, "SEGMENT", 300)
    again, same = hash_texts([folded(t) for t in texts])
    assert again.tolist() == h.tolist() and same.tolist() == counts.tolist() and SEGMENT > 300


@pytest.mark.parametrize("threshold", [0.8])
def test_rows_that_share_an_id_are_decided_apart(spark, threshold):
    rng = random.Random(4)
    a, unique = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    near = a.split()
    near[5] = "changed"
    table = spark.createDataFrame([(1, a), (5, a), (5, unique), (6, " ".join(near)), (6, " ".join(near)), (None, a)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in ngramjoin.keep_one(table, threshold).collect())
    assert kept == [(0, a), (1, a), (5, unique)]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.keep) for r in ngramjoin.jaccard_join(table, threshold).collect())
    assert got == [(1, 1, 2, True), (5, 1, 2, False), (5, 5, 0, True), (6, 1, 2, False)]
    twice = spark.createDataFrame([(3, a), (3, a), (4, unique)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngramjoin.keep_one(twice).collect()) == [3, 4]
