import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scribelake.llm import cotrain, decontam, langid, linededup, mixing, ngramjoin, rules, tokencount, toxicity
from scribelake.llm.components import connected_components
from scribelake.llm.neardup import choose_bands

from .helpers import corpus, empty, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


def unique_rows():
    return {r[0]: r[1] for r in ROWS}


# --- 1 toxicity


def _toxic(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(240):
        text = sentence(rng, 30)
        toxic = i % 4 == 0
        if toxic:
            text = text.replace(" ", " zorgul" + rng.choice(["a", "en", "ist", "os"]) + " ", 1) + " You are a zorgulat, zorgulix!"
        else:
            text += " You are a friend, an old one!"
        rows.append((i, text, "en", "a", 1, None, None))
        labels.append((i, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_learns_stems(spark):
    docs, labels, truth = _toxic(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_awkward_rows(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(empty(spark), model, ["doc_id"]).count() == 0


def test_grammar_readings():
    g = toxicity.Grammar()

    def read(s):
        got = g.read(s.split(), [2.0 if x in "IH" else 0.0 for x in s.split()])
        return got and got[0]

    cases = {"o I": "embedded", "I o": "embedded", "T o I": "aimed", "I o T": "aimed", "N I": "negated", "N o o o o I": "embedded", "N o T I": "negated", "R o I": "reported"}
    cases |= {"Q I Q": "reported", "Q o Q I": "embedded", "F H T": "threat", "F N H": "negated", "H o": None, "R o F H": "reported", "I": None, "I I": None, "o T": None, "T I R": "aimed"}
    assert {k: read(k) for k in cases} == cases


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(2)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.insult(), toxicity.threat()]
    machine = toxicity.Grammar()
    for _ in range(300):
        tape = [rng.choice(toxicity.WORD_SYMBOLS) for _ in range(rng.randint(0, 12))]
        states, want, state, got = [0] * 5, [], machine.start, []
        for s in tape:
            total = 0.0
            for k, t in enumerate(parts):
                states[k], s, w = t.step(states[k], s)
                total += w
            want.append((s, total))
        for s in tape:
            state, out, w = machine.machine.step(state, s)
            got.append((out, w))
        assert got == want


def test_words_alone_negated_or_reported_are_not_toxic(spark):
    docs, labels, _ = _toxic(spark)
    for model in (toxicity.ToxicityModel(dict(toxicity.SEEDS), {}), toxicity.train(docs, labels)):
        scorer = toxicity.Scorer(model)
        score = lambda t: 1 / (1 + np.exp(-(scorer.features(t) @ model.coefficients + model.intercept)))
        clean = ["idiot", "Idiot!", "he is not an idiot", "he said you are an idiot", '"you moron" was on the wall', "kill", "they did not kill him", "a fine day", ""]
        assert all(score(t) < 0.5 for t in clean), [(t, score(t)) for t in clean]
        assert score("you are an idiot. he is a moron") >= 0.5 and score("I will kill you") > score("kill you")
        assert score("you are an idiot") > score("you are not an idiot")


def test_every_feature_that_passes_is_learned(spark):
    rng, rows, labels = random.Random(6), [], []
    rare = [f"zorg{a}{b}" for a in "abcdefgh" for b in ("lim", "tak", "pun")]
    for i in range(600):
        text = sentence(rng, 20)
        if i % 4 == 0:
            text = " ".join(f"{w} {x}" for w, x in zip(text.split(), rng.sample(rare, 12))) + " you are"
        rows.append((i, text, "en", "a", 1, None, None))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(model.insult(w) > 0 for w in rare)


# --- 2 mixing


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(ROWS)
    sizes, by = defaultdict(int), defaultdict(list)
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [1, 2, 3, 1][: len(order)])))
    source = {r[0]: r[3] for r in ROWS}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        by[s].append(r.taken)
    assert max(targets[s] / sizes[s] for s in order if sizes[s]) <= 3 + 1e-9
    assert mixing.mix(empty(spark)).count() == 0


def test_fit_budget_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 2))
        take = mixing.fit_budget(sizes, counts, budget)
        sums = ((np.array(c) * sizes).sum() for c in itertools.product(*[range(n + 1) for n in counts]))
        assert (take >= 0).all() and (take <= counts).all() and (sizes * take).sum() == max(s for s in sums if s <= budget)


def test_fit_budget_of_long_documents_and_large_budgets():
    fit = lambda sizes, counts, budget: (mixing.fit_budget(np.array(sizes), np.array(counts), budget) * np.array(sizes)).sum()
    assert fit([70_000, 100_000], [1, 1], 70_000) == 70_000
    assert fit([70_000, 90_000, 100_000], [3, 3, 3], 160_000) == 160_000
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 25_000, 3000))
    counts = rng.integers(1, 50, len(sizes))
    assert fit(sizes, counts, int((sizes * counts).sum() * 0.77)) == int((sizes * counts).sum() * 0.77)


@pytest.mark.parametrize("small", [True, False])
def test_mix_without_broadcast(spark, docs, monkeypatch, small):
    monkeypatch.setattr(mixing, "_small", lambda df, rows=0: small)
    monkeypatch.setattr(mixing, "HOT", 2)
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_targets_equal_water_fill(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = {f"s{k:02}": rng.choice([0, 1, 10, 1000, 5000]) for k in range(17)} | {None: 40}
        table = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, size long, docs long")
        order = sorted(sizes, key=lambda x: (x is None, x or ""))
        want = mixing.water_fill([sizes[k] for k in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
        got = {r.source: r.target for r in mixing.targets(table, (1, 2, 3), 3.0).collect()}
        assert [got[k] for k in order] == pytest.approx(want)


def test_water_fill():
    assert mixing.water_fill([100, 0, 100], [1, 2, 3]) == pytest.approx([50, 0, 150])
    assert mixing.water_fill([10, 1000], [3, 1]) == pytest.approx([30, 980])


# --- 3 quality


def test_cotraining(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(300):
        good = i % 3 > 0
        text = sentence(rng, 60) if good else "###$$$ ".join(sentence(rng, 30).upper().split())
        rows.append((i, text, "en", "a" if good else "b", len(text), None, None))
        if i % 2:
            labels.append((i, int(good)))
    docs = frame(spark, rows)
    pages = spark.createDataFrame([(1, "https://x.example/en/3?ref=a", "<p>"), (2, "nope", None)], "page_id long, url string, html string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in cotrain.score_quality(docs, pages, cotrain.train(docs, pages, marks)).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(300)]) >= 0.97


def test_cotraining_without_labels(spark, docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = cotrain.train(docs, pages, spark.createDataFrame([], "doc_id long, quality int"))
    got = cotrain.score_quality(docs, pages, model).collect()
    assert len(got) == len(ROWS) and all(r.kept is None and r.score == 0.5 for r in got)
    assert cotrain.train(empty(spark), pages, spark.createDataFrame([], "doc_id long, quality int")).text.sum() == 0


# --- 4 tokens


def test_length_histogram(spark, docs):
    with open(tokencount.VOCABULARY, "rb") as f:
        encode = tokencount._encoder(f.read(), tokencount.PATTERN).encode_ordinary
    lengths = [len(encode(r[1] or "")) for r in ROWS]
    rows = tokencount.length_histogram(docs).orderBy("n_tokens").collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    at = {r.context_limit: r.tokens_kept for r in tokencount.at_limits(tokencount.length_histogram(docs), [0, 17, 10**6]).collect()}
    assert at == {k: sum(min(x, k) for x in lengths) for k in (0, 17, 10**6)}
    assert tokencount.length_histogram(empty(spark)).count() == 0


# --- 5 language


def _languages(spark):
    rng, rows = random.Random(4), []
    sets = {"aa": ["kabo", "lomi", "taru", "seno"], "bb": ["schtz", "pfrung", "zwkelt", "bricht"], "cc": ["ñuela", "cióndo", "llaje", "rrosa"]}
    for i in range(300):
        lang = sorted(sets)[i % 3]
        rows.append((i, sentence(rng, 20, sets[lang]), lang, "a", 1, None, None))
    return rows


def test_language(spark):
    rows = _languages(spark)
    docs = frame(spark, rows)
    model = langid.train(docs, slots=1 << 14)
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].score > 0.5 for r in rows)
    odd = frame(spark, [(1, None, None, None, 0, None, None), (2, " 123 !", None, None, 0, None, None), (3, "", None, None, 0, None, None), (4, "я" * 50, None, None, 0, None, None), (5, "Kabo lomi", None, None, 0, 0.1, None)])
    found = {r.doc_id: r.lang_pred for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert [found[i] for i in (1, 2, 3)] == ["und"] * 3 and found[4] in model.languages and found[5] == "aa"
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [5]
    none = langid.train(empty(spark), slots=1 << 14)
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}


def test_bloom_masks_have_no_false_negative(spark):
    docs = frame(spark, _languages(spark))
    model = langid.train(docs, slots=1 << 14, fold=None)
    grams = np.concatenate([h for _, h in langid.gram_hashes(["kabo lomi taru"])])
    assert (model.masks(grams)[0] >> model.languages.index("aa") & 1).all()


def test_a_rare_language_is_learned_in_a_large_corpus(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 8), "en", "a", 1, None, None) for i in range(6000)]
    rows += [(10_000 + i, sentence(rng, 20, ["przy", "szczy", "jest", "wiele"]), "pl", "a", 1, None, None) for i in range(20)]
    docs = frame(spark, rows).repartition(4)
    model = langid.train(docs, sample_rows=200, floor=100, slots=1 << 16, fold=None)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[10_000 + i] == "pl" for i in range(20)) and np.mean([got[i] == "en" for i in range(6000)]) > 0.99


def test_masks_equal_brute_force(spark):
    """Filters hold just the n-grams that a plain count of documents chooses, but for collisions of slots."""
    rows = _languages(spark)[:90]
    model = langid.train(frame(spark, rows), slots=1 << 18, fold=None)
    n, per = defaultdict(Counter), Counter(r[2] for r in rows)
    for r in rows:
        for h in {int(x) for _, g in langid.gram_hashes([r[1]]) for x in g}:
            n[h][r[2]] += 1
    every = np.array(sorted(n), dtype=np.uint64)
    masks, wrong = model.masks(every), 0
    for k, h in enumerate(every.tolist()):
        rate = {x: c / per[x] for x, c in n[h].items()}
        want = {x for x in rate if rate[x] >= 0.2 * max(rate.values())}
        got = {x for i, x in enumerate(model.languages) if masks[i // 8][k] >> (i % 8) & 1}
        assert want <= got
        wrong += got != want
    assert wrong <= 0.01 * len(every)


# --- 6 rules


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules(spark, docs):
    extra = ["a b c a b c a b c d e f " * 3, "x y z\nx y z\n\n\nq", "# # * <b> | &", "a a a a", "é\xa0è b"]
    more = frame(spark, [(2000 + i, t, None, None, 0, None, None) for i, t in enumerate(extra)])
    entries = rules.apply_policy(rules.ledger(docs.union(more)))
    want = unique_rows() | {2000 + i: t for i, t in enumerate(extra)}
    got = entries.collect()
    assert len(got) == len(ROWS) + len(extra)
    for r in got:
        n, chars, symbols, dup, repeat = brute_rules(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    kept = sum(r.kept for r in got)
    assert {r.kept for r in rules.ablations(entries).collect()} == {kept}
    assert rules.ledger(empty(spark)).count() == 0


# --- 7 decontamination


def test_contaminated(spark, docs):
    rng = random.Random(9)
    vocabulary = [a + b + c for a in "bcdfg" for b in ("ama", "elo", "iru") for c in ("ten", "sor", "pik", "lad")]
    items = [" ".join(rng.sample(vocabulary, rng.randint(12, 30))) for _ in range(70)]
    rows, truth = [], set()
    for i in range(60):
        text = sentence(rng, 200)
        if i % 3 == 0:
            k = rng.randrange(70)
            text = f"{text}\n{items[k].upper()}! {sentence(rng, 300)}"
            truth.add((i, k))
        rows.append((i, text, None, None, 0, None, None))
    marked = frame(spark, rows)
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, ""), (102, "to be")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(marked, bench).collect()}
    assert got == truth
    assert {r.doc_id for r in decontam.drop_contaminated(marked, bench).collect()} == set(range(60)) - {d for d, _ in truth}
    assert decontam.contaminated(docs, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def _bm25(texts):
    """Plain BM25 of a query (words) against each text, and each text's own score."""
    words = [decontam.tokens(t) for t in texts]
    n, mean = len(words), max(1.0, sum(map(len, words)) / len(words))
    df = Counter(w for t in words for w in set(t))
    part = lambda w, t: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return lambda q: [sum(part(w, t) for w in q if w in t) for t in words], [sum(part(w, t) for w in set(t)) for t in words]


def test_block_max_search_equals_full_scoring_and_skips_blocks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(400)] + ["", "two words"]
    index = decontam.Index([decontam.tokens(t) for t in texts], 0.4)
    score, own = _bm25(texts)
    hits = 0
    for n in range(60):
        q = set(rng.sample(words, 15)) | (set(decontam.tokens(texts[n])) if n % 2 else set())
        hashes, _ = decontam.hash_tokens([decontam._plain(" ".join(q))])
        terms = np.unique(index.terms(hashes))
        want = [i for i, s in enumerate(score(q)) if own[i] and s >= 0.4 * own[i] - 1e-9]
        assert index.search(terms[terms >= 0]).tolist() == want
        hits += len(want)
    assert hits >= 30 and index.seen == 60 * index.blocks and 0 < index.scored < 0.5 * index.seen


def test_tokens_are_hashed_as_they_are_read():
    texts = ["a-b c_d!", "É—ß! x", "tab\tnew\nline  ---  x", "", "“quote” d'été\u00a0y", "x" * 5000]
    hashes, counts = decontam.hash_tokens([decontam._plain(t) for t in texts])
    flat = [w for t in texts for w in decontam.tokens(t)]
    assert counts.tolist() == [len(decontam.tokens(t)) for t in texts] and len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist())))


def test_contaminated_equals_brute_force_in_one_pass_or_several(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(150)]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in [rng.randint(6, 24) for _ in range(22)] + [5, 64, 65, 90, 129, 300, 600, 1000]]
    rows = []
    for i in range(80):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 120) if i % 5 else 900)).split()
        if i % 2:
            part = items[i % 30].split()
            a = rng.randrange(len(part))
            at = rng.randint(0, len(text))
            text[at:at] = part if i % 4 == 1 else part[a : a + rng.randint(3, len(part))]
        rows.append((i, " ".join(text), None, None, 0, None, None))
    score, own = _bm25(items)
    share = lambda x, grams: len(decontam._windows(x, 3) & grams) / len(decontam._windows(x, 3)) if x else 0.0
    want = set()
    for d, t, *_ in rows:
        w = decontam.tokens(t)
        for size in (64, 128, 256, 512, 1024):
            mine = [k for k, x in enumerate(items) if (size // 2 if size > 64 else 0) < len(x.split()) <= size]
            for at in range(0, max(1, len(w) - size), size):
                passage = w[at : at + 2 * size]
                scores, grams = score(set(passage)), decontam._windows(passage, 3)
                for k in mine:
                    q, a = decontam.question_and_answer(items[k])
                    if scores[k] >= 0.4 * own[k] - 1e-9 and share(q + a, grams) >= 0.5 and max(share(q, grams), share(a, grams)) >= 0.5:
                        want.add((d, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (50_000, 7):
        monkeypatch.setattr(decontam, "PASS_ITEMS", most)
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()} == want
    assert 10 <= len(want) < 80


def test_one_part_alone_is_reported_only_if_it_is_half_of_the_item(spark):
    q = " ".join(f"q{i}" for i in range(12)) + "?"
    long, short = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(8))
    bench = spark.createDataFrame([(1, f"{q} {long}"), (2, f"{q.replace('q', 'z')} {short}")], "item_id long, text string")
    docs = frame(spark, [(1, "so " + q, None, None, 0, None, None), (2, "so " + q.replace("q", "z"), None, None, 0, None, None), (3, long, None, None, 0, None, None)])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(2, 2), (3, 1)}


def test_other_items_of_any_length_change_nothing(spark):
    """An item in three parts 300 words apart is not in one passage, whatever other items there are."""
    rng = random.Random(2)
    text = lambda n, c: " ".join(f"{c}{rng.randint(0, 10_000)}" for _ in range(n))
    item, whole, other = text(30, "x"), text(40, "z"), text(1000, "y")
    w = item.split()
    apart = " ".join([*w[:10], text(300, "u"), *w[10:20], text(300, "u"), *w[20:]])
    docs = frame(spark, [(1, apart, None, None, 0, None, None), (2, f"{text(500, 'u')} {whole} {text(500, 'u')}", None, None, 0, None, None)])
    alone = spark.createDataFrame([(1, item), (3, whole)], "item_id long, text string")
    more = alone.union(spark.createDataFrame([(2, other)], alone.schema))
    assert [{(r.doc_id, r.item_id) for r in decontam.contaminated(docs, b).collect()} for b in (alone, more)] == [{(2, 3)}] * 2


# --- 8 lines


def brute_lines(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, docs):
    more = [(5000 + i, "Shared Line of text\nown line %d here\n  shared line of TEXT \t\nÉCOLE DES LIGNES\nshort" % i) for i in range(40)]
    more += [(5100, "école des lignes\nÉCOLE DES LIGNES")]
    every = [(r[0], r[1]) for r in ROWS] + more
    table = docs.union(frame(spark, [(d, t, None, None, 0, None, None) for d, t in more])).repartition(7)
    got = linededup.digest(table, linededup.keep_bitmaps(table)).drop("keep_bitmap")
    assert sorted(map(tuple, got.collect())) == brute_lines(every)
    applied = linededup.apply_bitmaps(table, linededup.keep_bitmaps(table))
    assert applied.columns == table.columns
    none = empty(spark)
    assert linededup.digest(none, linededup.keep_bitmaps(none)).count() == 0


def test_bitmap_round_trip():
    for dropped, n in (([0], 1), ([3, 8], 20), ([1999], 2000)):
        stays = linededup.unpack_bits(linededup.pack_bits(dropped), n)
        assert len(stays) == n and sorted(np.flatnonzero(~stays)) == dropped


def test_columns_with_the_names_of_helpers(spark):
    from scribelake.llm import substring

    same = " ".join(f"word{i}" for i in range(60)) + " that several documents hold"
    rows = [(1, same + "\nown one", 7, 7, 7, 7, 7), (2, same + "\nown two", 8, 8, 8, 8, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc int, __row int, __hash int, __bitmap int, __gone int")
    got = {r.doc_id: r for r in linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).collect()}
    assert got[2].text == "own two" and got[2]["__bitmap"] == 8 and got[1].text == rows[0][1]
    cut = {r.doc_id: r for r in substring.cut(docs, substring.substring_dedup(docs)).collect()}
    assert cut[2].text.split() == ["two"] and cut[2]["__gone"] == 8
    assert {r.doc_id for r in ngramjoin.keep_one(docs).collect()} == {1}


# --- 9 and 10


def brute_classes(rows, width=5, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))
    ids = sorted(sets)
    root = {i: i for i in ids}
    links = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_copies(n, seed=11):
    rng = random.Random(seed)
    base = sentence(rng, 120).split()
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(base)
        out.append((3000 + i, " ".join(words)))
    return out


def test_jaccard_join(spark, docs, monkeypatch):
    from scribelake.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 16)  # so that the group is dealt over several block pairs
    more = near_copies(60)
    table = docs.union(frame(spark, [(d, t, None, None, 0, None, None) for d, t in more]))
    want = brute_classes(list(unique_rows().items()) + more)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.jaccard_join(table).collect()}
    assert got == want
    kept = {r.doc_id for r in ngramjoin.keep_one(table).collect()}
    assert kept == {d for d, (c, _) in want.items() if c == d}


def test_jaccard_join_empty(spark):
    assert ngramjoin.jaccard_join(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(400, 450)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_bands_reach_recall():
    for threshold, recall, rows in ((0.8, 0.9995, 5), (0.8, 0.99, 2)):
        assert 1 - (1 - threshold**rows) ** choose_bands(threshold, recall, rows) >= recall


def test_null_ids_and_text_ids(spark):
    """Rows without an id, and ids that are text, are defined everywhere."""
    rng = random.Random(14)
    rows = [(f"d{i}", sentence(rng, 60), "en", "a", 300) for i in range(12)] + [(None, sentence(rng, 60), "en", None, 300), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([("d1", 1, 0), ("d2", 0, 1), (None, 1, 1)], "doc_id string, toxic int, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels), ["doc_id"]).count() == 14
    assert mixing.mix(docs).count() == 14
    assert cotrain.score_quality(docs, pages, cotrain.train(docs, pages, labels)).count() == 14
    assert tokencount.length_histogram(docs).agg({"n_docs": "sum"}).first()[0] == 14
    assert langid.predict(docs, langid.train(docs), ["doc_id"]).count() == 14 and langid.keep_identified(docs, langid.train(docs)).count() == 13
    assert rules.ledger(docs).count() == 14
    assert [r.doc_id for r in decontam.contaminated(docs, bench).collect()] == ["d3"] and decontam.drop_contaminated(docs, bench).count() == 13
    assert linededup.digest(docs, linededup.keep_bitmaps(docs)).count() == 14
    assert ngramjoin.jaccard_join(docs).count() == 12 and ngramjoin.keep_one(docs).count() == 14
