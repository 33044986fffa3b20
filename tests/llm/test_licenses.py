import random
import re

import pytest
from pyspark.sql import functions as F

from runtally.llm import licenses as L

from .twins import assert_twin

SMALL = "/root/testdata/sf0.001"


def brute(text, threshold=0.9, templates=L.TEMPLATES):
    lowered = (text or "").translate(str.maketrans(L._UPPER, L._UPPER.lower()))
    words = [w for w in re.split(L._BETWEEN, lowered) if w]
    places = [
        (i, label, i + len(phrase) - 1)
        for phrase, label in L.PHRASES
        for i in range(len(words))
        if tuple(words[i : i + len(phrase)]) == phrase
    ]
    blocks = []
    for t in templates:
        width, of = L.width_of(t), set(L.template_words(t.text))
        for at in range(0, len(words), width):
            n = len(of & set(words[at : at + 2 * width]))
            if n >= L.need_of(len(of), threshold):
                blocks.append((at, t.name, t.label, min(at + 2 * width, len(words)) - 1, n / len(of)))
    return len(words), sorted(places), sorted(blocks)


def found(df, **options):
    rows = L.scan(df, **options).collect()
    return {r["k"]: (r["n_words"], [tuple(x) for x in r["phrases"]], [tuple(x) for x in r["blocks"]]) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    pool = [*{w for t in L.TEMPLATES for w in L.template_words(t.text)}, "lorem", "ipsum", "dolor", "größe", "été"]
    out = [None, "", "   ", "...", "MIT", "mit license", "The MIT License, the mit\nLICENSE", "a" * 50_000]
    for t in L.TEMPLATES:
        words = t.text.split()
        out += [t.text, "x " * 37 + t.text.upper() + " y" * 90, " ".join(words[: len(words) // 2]), " ".join(words[1:])]
        for cut in range(0, len(words), 5):
            out.append(" ".join(words[:cut] + ["lorem"] + words[cut + 1 :]))
    out += [" ".join(rnd.choice(pool) for _ in range(rnd.choice([3, 30, 300, 3000]))) for _ in range(60)]
    out.append("lİcense K" * 3 + " mit lİcense mit license")
    out.append(" ".join(["filler"] * 20_000) + " released under the mit license " + "word " * 20_000)
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.9, 1.0])
def test_every_block_against_brute_force(spark, texts, threshold):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = found(df, threshold=threshold)
    assert got == {k: brute(t, threshold) for k, t in enumerate(texts)}
    assert sum(len(v[2]) for v in got.values()) > 30


def test_blocks_as_rows_and_the_plan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = L.matching_blocks(df)
    assert rows.columns == ["k", "text", "first_word", "template", "label", "last_word", "containment"]
    assert rows.count() == sum(len(brute(t)[2]) for t in texts)
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_repeated_rows_clashing_columns_empty_table_no_templates(spark):
    text = "Released under the MIT License."
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "k int, text string")
    clash = df.withColumns({c: F.lit(9) for c in ("n_words", "phrases", "blocks", "words")})
    rows = L.scan(clash).collect()
    assert sorted(r["n_words"] for r in rows) == [0, 5, 5] and {r["words"] for r in rows} == {9}
    assert sum(len(r["blocks"]) for r in rows) == 2
    assert L.scan(df.where("false")).count() == 0
    assert all(r["blocks"] == [] for r in L.scan(df, templates=()).collect())
    with pytest.raises(ValueError, match="threshold"):
        L.scan(df, threshold=0)
    with pytest.raises(ValueError, match="distinct words"):
        L.scan(df, templates=(L.Template("big", "big", " ".join(f"w{i}" for i in range(L.MOST_WORDS + 1))),))


def test_twin(spark):
    assert_twin(spark, "op12_licenses", SMALL)
