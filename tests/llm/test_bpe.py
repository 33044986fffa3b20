import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runtally.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(bpe.load(PATH))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


ALPHABET = "aabbcdethinr's'rell tTÉéÅÅİΣςσ̈̇ 12٣²—!!<|>中文字한각ᅡ각 　\n\t\x0b\x85\x1c​🙂"


def test_same_as_library_on_odd_text_in_any_chunks(merges, library):
    rnd, words = random.Random(5), bpe.Words(merges)
    for _ in range(1500):
        text = "".join(rnd.choice(ALPHABET) if rnd.random() < 0.97 else "<|endoftext|>" for _ in range(rnd.randint(0, 150)))
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(merges, text, words) == want
        assert bpe.encode_text(merges, text, words, size=rnd.choice([4, 9, 30])) == want
        assert bpe.decode_ids(merges, want, size=3) == library.decode(want, skip_special_tokens=False)


def test_long_words_stream_in_a_bounded_window(merges, library):
    rnd = random.Random(6)
    word = "".join(rnd.choice("thinaerouns") for _ in range(20_000))
    one, out, most = bpe.Transducer(merges), [], 0
    for i in range(0, len(word), 7):
        out += one.feed(word[i : i + 7].encode())
        most = max(most, len(one.held))
    out += one.finish()
    assert out == library.encode(word, add_special_tokens=False).ids
    assert most <= one.window + 7
    assert bpe.encode_text(merges, word + " " + "!" * 5000, size=64) == library.encode(word + " " + "!" * 5000, add_special_tokens=False).ids


def test_lookahead_is_sufficient_for_small_merge_lists():
    import itertools
    import json

    rnd = random.Random(7)
    letters = bpe.byte_letters()
    for _ in range(60):
        pieces, merge_list = ["a", "b"], []
        for _ in range(8):
            a, b = rnd.choice(pieces), rnd.choice(pieces)
            if a + b not in pieces:
                pieces.append(a + b)
                merge_list.append([a, b])
        vocab = {p: i for i, p in enumerate(dict.fromkeys([*letters, *pieces]))}
        made = bpe.MergeList(json.dumps({"model": {"vocab": vocab, "merges": merge_list}}).encode())
        for word in map("".join, itertools.product("ab", repeat=9)):
            whole = made.merge([made.inner[ord(c)] for c in word])
            one = bpe.Transducer(made, block=1)
            out = []
            for c in word:
                out += one.feed(c.encode())
            assert out + one.finish() == whole


def test_byte_text_state_machine_round_trip():
    whole = bpe.MergeList(bpe.load(public_tokenizers.path("byte_bpe_50k.json")))
    text = "naïve 中文 🙂 plain"
    ids = [whole.inner[b] for b in text.encode()]
    one = bpe.Decoder(whole, pieces=False)
    parts = [one.feed([i]) for i in ids]
    assert "".join(parts) + one.finish() == text
    assert "�" not in "".join(parts)


def test_tables(spark, library):
    rows = [(1, "Hello hello, WORLD's!", 9), (1, "Hello hello, WORLD's!", 9), (2, None, 9), (None, "", 9), (4, "x" * 100_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = bpe.decode(bpe.encode(docs, PATH), PATH)
    got = sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in coded.collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.digests(docs.limit(0), PATH).columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_task_forgets_its_words_at_the_end(spark, monkeypatch):
    merges_words = bpe._loaded(bpe.load(PATH))
    tasks = []
    monkeypatch.setattr(type(spark.createDataFrame([], "a int")), "mapInArrow", lambda df, work, schema: tasks.append(work) or df)
    bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, some more", None]})
    steps = tasks[0](iter([batch]))
    assert next(steps).column("n_tokens").to_pylist()[1] == 0
    assert merges_words[1].stretches and merges_words[1].words
    assert next(steps, None) is None
    assert not merges_words[1].stretches and not merges_words[1].words
