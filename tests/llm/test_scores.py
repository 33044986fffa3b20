import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runtally.llm import katz, language, pieces, toxicity, words


# --- toxicity ---------------------------------------------------------------------------


def toxic_rows(n, seed=1):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ba", "to", "ri", "sel") for b in ("ma", "ne", "lu") for c in ("n", "st", "r")]
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 400))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Grizzak", "vombul", "splorch"]))
        yield i, " ".join(words), int(bad)


def test_toxicity_on_held_out_rows_and_odd_texts(spark):
    rows = list(toxic_rows(600))
    odd = [(9001, None), (9002, ""), (9003, "ab"), (None, "vombul grizzak splorch"), (9005, "ban ma " * 60_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (77_777, 1)], "doc_id long, toxic int")
    scored = toxicity.classify(docs, labels, learn_from=F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in scored.collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9001]["score"] == got[9002]["score"] == got[9003]["score"]
    assert got[None]["predicted"] == 1 and got[9005]["predicted"] == 0
    assert scored.columns == ["doc_id", "text", "score", "predicted"]


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(0, 1)], 1.0), ([(0, 0)], 0.0)])
def test_toxicity_with_one_class_or_none(spark, labels, want):
    docs = spark.createDataFrame([(0, "one text"), (1, None)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    for r in toxicity.classify(docs, known).collect():
        assert r["score"] == pytest.approx(want, abs=1e-6)
    assert toxicity.classify(docs.limit(0), known).count() == 0


def test_n_grams_stay_inside_texts():
    texts = ["abcdef", "", "xy", "ABC"]
    found = defaultdict(set)
    for owner, bucket in toxicity.buckets(texts):
        for o, b in zip(owner, bucket):
            found[int(o)].add(int(b))
    alone = {b for _, bucket in toxicity.buckets(["abc"]) for b in bucket.tolist()}
    assert found[3] == alone and len(alone) == 1 and alone < found[0]
    assert 1 not in found and 2 not in found


# --- language ---------------------------------------------------------------------------

TAUGHT = {
    "en": "the house and the garden with thy thing what should they think through weather",
    "de": "der garten und das haus mit schönen wänden auch wenn sie zwischen straßen liegt",
    "ru": "дом и сад с красивыми стенами между улицами города который лежит",
}


def taught(spark):
    rows = [(k, TAUGHT[lang] + f" {word}", lang) for k, (lang, word) in enumerate((x, w) for x in TAUGHT for w in TAUGHT[x].split())]
    return language.train(spark.createDataFrame([*rows, (99, "xx", None), (98, None, "en")], "doc_id long, text string, lang string"))


def test_language_and_spans_of_mixed_text(spark):
    model = taught(spark)
    assert model.languages == ["de", "en", "ru"]
    first, second, third = "The weather with thy thing", "zwischen schönen straßen auch", "между улицами города"
    mixed = f"{first}, {second}! {third}."
    rows = [(1, mixed, "q"), (2, None, "q"), (3, "12 — ...", "q"), (4, "", "q"), (5, "ДОМ И САД", "q"), (5, "ДОМ И САД", "q"), (None, "Ω", "q"), (6, first * 9000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [r for r in language.label(docs, model).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in by[1]["spans"]] == [("en", first), ("de", second), ("ru", third)]
    assert by[5]["lang_pred"] == "ru" and by[5]["score"] == 1.0
    assert by[6]["lang_pred"] == "en" and len(by[6]["spans"]) == 1
    for i in (2, 3, 4):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0.0, [])
    assert by[None]["lang_pred"] == "de"  # a foreign script says nothing: first in order


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    owner = np.repeat([0, 2, 3], [5, 1, 4])
    score = rng.normal(scale=3, size=(10, 3))
    got = language.viterbi(owner, score, 4, switch=2.0)
    for text in (0, 2, 3):
        at = np.flatnonzero(owner == text)
        best, path = -np.inf, None
        for code in range(3 ** len(at)):
            states = [code // 3**k % 3 for k in range(len(at))]
            value = score[at, states].sum() - 2.0 * sum(a != b for a, b in zip(states, states[1:]))
            if value > best:
                best, path = value, states
        assert got[at].tolist() == path


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    row = language.label(docs, language.train(empty)).first()
    assert (row["lang_pred"], row["score"], row["spans"]) == ("und", 0.0, [])


# --- Katz -------------------------------------------------------------------------------


def katz_brute(rows):
    tokens = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), None]
    train = [tokens(t) for _, t, learn in rows if learn]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t], t))
    total = sum(uni.values())
    times = lambda c: np.array([sum(1 for x in c.values() if x == r) for r in range(katz.K + 2)])
    d1, d2 = (katz.discounts(np.append(times(c), [0, 0])) for c in (uni, bi))
    kept = lambda d, c: d[min(c, katz.K + 1)] * c
    p1 = {w: kept(d1, c) / (total + 1) for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    before = Counter(h for t in train for h in ["<s>", *t][:-1])
    alpha = {}
    for h in before:
        seen = {w: c for (g, w), c in bi.items() if g == h}
        left = 1 - sum(kept(d2, c) for c in seen.values()) / (before[h] + 1)
        alpha[h] = left / (1 - sum(p1[w] for w in seen))
        # exactly normalised over the vocabulary and the unknown word
        mass = sum(kept(d2, c) for c in seen.values()) / (before[h] + 1)
        mass += alpha[h] * (unknown + sum(p for w, p in p1.items() if w not in seen))
        assert mass == pytest.approx(1)
    out = []
    for doc, t, learn in rows:
        words = tokens(t)
        score = base = 0.0
        for h, w in zip(["<s>", *words], words):
            if bi[h, w]:
                score += math.log10(kept(d2, bi[h, w]) / (before[h] + 1))
            else:
                score += math.log10(alpha.get(h, 1.0) * p1.get(w, unknown))
            base += math.log10((uni[w] + 1) / (total + len(uni) + 1))
        out.append((doc, bool(learn), len(words), sum(uni[w] > 0 for w in words), total, base, score))
    return out


def test_katz_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH", 2000)
    rnd = random.Random(3)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "Ä ä A a", texts[3], "new words only here", "w1 " * 3000]
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(texts)] + [(3, texts[5], True), (None, "w1 w2", True)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, learn boolean, score double")
    got = [tuple(r) for r in katz.lm_scores(docs, "learn").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    for mine, want in zip(sorted(got, key=order), sorted(katz_brute(rows), key=order), strict=True):
        assert mine[:5] == want[:5]
        assert mine[5:] == pytest.approx(want[5:], abs=1e-8)


def test_katz_gives_memory_back_after_tasks_and_groups(spark, monkeypatch):
    calls, kind = [], type(spark.createDataFrame([], "a int"))
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tasks, groups = [], []
    monkeypatch.setattr(kind, "mapInArrow", lambda df, work, schema: tasks.append(work) or spark.createDataFrame([], schema))
    made = type(spark.createDataFrame([], "a int").groupBy("a"))
    monkeypatch.setattr(made, "applyInArrow", lambda grouped, work, schema: groups.append(work))
    docs = spark.createDataFrame([], "doc_id long, text string, train boolean")
    katz.tally(katz.ask(docs, 2))
    answers = spark.createDataFrame([], "batch long, bucket int, payload binary")
    katz.settle(docs, answers, 2, katz.Model(np.zeros(katz.K + 4, np.int64), np.zeros(katz.K + 4, np.int64)))
    for work in tasks:
        assert list(work(iter([]))) == []
    assert len(calls) == len(tasks) == len(groups) == 2
    none = katz._packed(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint16), np.empty(0, np.uint32))
    groups[0](pa.table({"bucket": pa.array([0], pa.int32()), "batch": pa.array([7]), "payload": pa.array([none])}))
    assert len(calls) == 3


def test_katz_without_training_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.lm_scores(docs, "doc_id < 0").collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[1]["score"]) == (3, 0, 0, 0.0)
    assert katz.lm_scores(docs.limit(0), "true").count() == 0


# --- word pieces ------------------------------------------------------------------------


def greedy(vocabulary, word):
    count, at = 0, 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        count += 1 if size else len(word[at].encode())
        at += size or 1
    return count


def test_automaton_is_greedy_longest_match():
    rnd = random.Random(4)
    for _ in range(300):
        vocabulary = {"".join(rnd.choice("ab▁é") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))}
        automaton = pieces.Automaton(vocabulary)
        for _ in range(40):
            word = "".join(rnd.choice("abab▁é中") for _ in range(rnd.randint(0, 20)))
            assert automaton.length(word) == greedy(vocabulary, word), (vocabulary, word)


def test_token_counts_of_a_table(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = set(pieces.load(path))
    rows = [(1, "Hello wide world"), (1, "Hello wide world"), (2, None), (3, " \n"), (None, "Straße 中文🙂"), (4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "o") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in pieces.token_counts(docs, path).collect())
    want = sorted(
        (i or 0, len((t or "").split()), sum(greedy(vocabulary, "▁" + w) for w in (t or "").split())) for i, t in rows if i != 4
    )
    assert [g for g in got if g[0] != 4] == want
    assert pieces.token_counts(docs.limit(0), path).count() == 0
