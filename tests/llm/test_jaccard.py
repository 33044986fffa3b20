import random
import time
from pathlib import Path

import pytest

from runtally.llm import jaccard, words
from runtally.llm.components import components
from runtally.session import shared_dir, tidy_shuffles


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None:
                if sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    parent[a] = b
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), None if doc is None else min(same)))
    return out


def family(rnd, size, words, edits):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 10**6)}"
        yield " ".join(copy)


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("width", "percent", "common"), [(4, 85, 16), (2, 60, 3)])
def test_same_as_all_pairs(spark, monkeypatch, width, percent, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rnd = random.Random(width)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n\t", "one", "One", "two words", "two  WORDS", "a b c d", "a b c d"]
    for size, words, edits in ((40, 120, 4), (30, 60, 5), (25, 200, 12), (1, 3000, 0)):
        texts += family(rnd, size, words, edits)
    texts += [passage + " " + " ".join(f"u{rnd.random()}" for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    rnd.shuffle(texts)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(7, texts[3]), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, component_id string, n long")
    got = [tuple(r) for r in jaccard.similar_documents(docs, width=width, percent=percent).collect()]
    # rows with one id are one document to the links: give brute force distinct ids
    want = brute(rows, width, percent)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = jaccard.similar_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(9, 9), (300, 301), (301, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in [5, *range(200, 260)]} == {5}
    assert got[301] == 300 and 9 not in got


def test_only_what_the_result_reads_stays_on_disk(spark):
    rows = [(i, " ".join(f"w{(i // 3) * 40 + k + (i % 3 == 2) * (k == 7) * 1000}" for k in range(40))) for i in range(30)]
    folders = lambda: set(Path(shared_dir(spark), "runtally").glob("jaccard-*"))
    before = folders()
    result = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=75)
    (made,) = folders() - before
    held = {path.parent.relative_to(made).as_posix() for path in made.rglob("*.parquet")}
    assert held == {"digests", "classes", "components"}
    assert sorted(map(tuple, result.collect())) == sorted(brute(rows, 4, 75))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_do_not_add_up(spark):
    """Each step's shuffles go when it is stored; the setting is as before, also after a failure."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    rnd = random.Random(5)
    rows = [(i, text) for i, text in enumerate(t for _ in range(4) for t in family(rnd, 5, 40, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffle_files(spark)
    found = jaccard.similar_documents(docs, width=4, percent=85)
    until = time.time() + 30
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key) == setting
    # read lazily, and more than once
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.collect())) == sorted(brute(rows, 4, 85))
    with pytest.raises(ValueError):
        with tidy_shuffles(spark):
            raise ValueError
    assert spark.conf.get(key) == setting


def test_worker_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(len(calls)))
    steps = words.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(steps) == 2 and next(steps) == 3 and not calls
    assert next(steps, None) is None and calls == [0]
    monkeypatch.undo()
    words.give_back()
