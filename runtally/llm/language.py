"""Language identification with labelled spans for mixed-language text.

Words are runs of letters of the lower-cased text. The script of a word (by code-point
ranges) narrows its candidates to the languages that were seen in that script; each candidate
gets a log-likelihood per word from hashed letter n-grams (1 to 4 letters, with word ends).
Viterbi over the words of a text, with a penalty for every switch, labels each word; equal
neighbours form a span. All texts of an Arrow batch advance together, one word a step.

Training counts n-grams over all given texts: batches pre-aggregate, a shuffle adds up, and
the model is a table of ``languages x 2^BITS`` numbers, whatever the corpus holds.

Defined results: null, empty and letterless texts are ``und`` with score 0 and no spans; ties
go to the language first in order; texts without a language teach nothing; if nothing was
learned, all texts are ``und``; repeated rows are labelled each; result columns replace input
columns of the same name, all others are carried along; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runtally.llm.words import portions, trimmed

BITS, LONGEST, SWITCH, SMOOTHING = 16, 4, 12.0, 0.5
#: A language is a candidate for a script that at least this share of its words is in.
CANDIDATE = 0.001
UNKNOWN = "und"
#: What a language that is no candidate loses per word: a word of a foreign script inside a
#: text then costs more than a switch.
EXCLUDED = -50.0

#: First code points of the ranges of scripts, in order, with the script of each.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points hashed at once; characters of text whose words advance together.
_SLICE, PORTION = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    grams: np.ndarray  # [bucket, language]: log probability
    scripts: np.ndarray  # [script, language]: whether the language is a candidate


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class Words:
    """The words of some texts: owner, start and length in code points, and distinct forms."""

    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    form: np.ndarray  # of each word
    codes: list[np.ndarray]  # letters of the distinct forms, in slices
    lengths: np.ndarray  # of the distinct forms


def _lower(text: str | None) -> str:
    low = (text or "").lower()
    # Lower case may be longer than the text (one letter, fixed); places must hold.
    return low if len(low) == len(text or "") else "".join(c.lower()[0] for c in text)


def words_of(texts: list[str | None]) -> Words:
    owner, start, length, hashes, codes = [], [], [], [], []
    k = 0
    while k < len(texts):
        some, size, first = [], 0, k
        while k < len(texts) and (not some or size < _SLICE):
            some.append(_lower(texts[k]))
            size += len(some[-1]) + 1
            k += 1
        code = np.frombuffer("\n".join([*some, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _is_letter()[code]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            continue
        width = end - begin
        inside = code[letter].astype(np.uint64)
        offset = np.concatenate(([0], np.cumsum(width)[:-1]))
        place = (np.arange(len(inside)) - np.repeat(offset, width)).astype(np.uint64)
        spread = (inside + np.uint64(1)) * _MIX
        spread = (spread ^ (spread >> np.uint64(31))) * (place * np.uint64(2) + np.uint64(0x5851F42D4C957F2D))
        spread = (spread ^ (spread >> np.uint64(27))) * _MIX
        edges = np.cumsum([len(t) + 1 for t in some])
        belongs = np.searchsorted(edges, begin, side="right")
        owner.append(belongs + first)
        start.append(begin - np.concatenate(([0], edges[:-1]))[belongs])
        length.append(width)
        hashes.append(np.add.reduceat(spread, offset) + width.astype(np.uint64))
        codes.append((inside.astype(np.uint32), offset))
    if not hashes:
        none = np.empty(0, np.int64)
        return Words(none, none, none, none, [], none)
    every = np.concatenate(hashes)
    _, at, form = np.unique(every, return_index=True, return_inverse=True)
    length_all = np.concatenate(length)
    # the letters of each distinct form, from the slice its first word lies in
    counts = [len(h) for h in hashes]
    begins = np.concatenate(([0], np.cumsum(counts)))
    order = np.argsort(at, kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    letters = []
    for s, (inside, offset) in enumerate(codes):
        own = at[order][(at[order] >= begins[s]) & (at[order] < begins[s + 1])] - begins[s]
        width = length[s][own]
        if len(own):
            base = np.concatenate(([0], np.cumsum(width)[:-1]))
            letters.append(inside[np.repeat(offset[own] - base, width) + np.arange(width.sum())])
    return Words(
        np.concatenate(owner), np.concatenate(start), length_all, rank[form], letters, length_all[at[order]]
    )


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(form, bucket) of every letter n-gram of the distinct forms, word ends included."""
    if not len(words.lengths):
        none = np.empty(0, np.int64)
        return none, none
    n = len(words.lengths)
    padded = np.zeros(int(words.lengths.sum()) + 2 * n, dtype=np.uint64)
    form = np.repeat(np.arange(n), words.lengths + 2)
    ends = np.cumsum(words.lengths + 2)
    inside = np.ones(len(padded), dtype=bool)
    inside[ends - 1] = False
    inside[np.concatenate(([0], ends[:-1]))] = False
    padded[inside] = np.concatenate(words.codes)
    owners, buckets = [], []
    rolling = padded
    for size in range(1, LONGEST + 1):
        if size > 1:
            rolling = rolling[:-1] * _MIX + padded[size - 1 :] + np.uint64(size)
        whole = form[: len(rolling)] == form[size - 1 :]
        if size == 1:
            whole &= inside
        mixed = (rolling + np.uint64(size)) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        owners.append(form[: len(rolling)][whole])
        buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[whole])
    return np.concatenate(owners), np.concatenate(buckets)


def _scripts(words: Words) -> np.ndarray:
    first = np.concatenate(words.codes)[np.concatenate(([0], np.cumsum(words.lengths)[:-1]))]
    return _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams and scripts of all texts that have a language."""

    def counted(batches):
        for batch in batches:
            for name in pc.unique(batch.column(1)).to_pylist():
                # scripts follow the n-gram buckets
                both = np.zeros((1 << BITS) + len(_NAMES), np.int64)
                of_name = batch.column(0).filter(pc.equal(batch.column(1), name))
                for texts in portions(of_name, PORTION):
                    words = words_of(texts)
                    if not len(words.form):
                        continue
                    times = np.bincount(words.form, minlength=len(words.lengths))
                    form, bucket = grams(words)
                    both[: 1 << BITS] += np.bincount(bucket, weights=times[form], minlength=1 << BITS).astype(np.int64)
                    both[1 << BITS :] += np.bincount(_scripts(words), weights=times, minlength=len(_NAMES)).astype(np.int64)
                some = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(both[some])],
                    names=["lang", "bucket", "n"],
                )

    known = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).where(F.col(lang).isNotNull())
    sums = known.mapInArrow(trimmed(counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language: bounded by languages x 2^BITS.
    rows = (
        sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toPandas().sort_values("lang")
    )
    languages = list(rows["lang"])
    table = np.zeros(((1 << BITS) + len(_NAMES), len(languages)))
    for k, counts in enumerate(rows["counts"]):
        table[[c["bucket"] for c in counts], k] = [c["n"] for c in counts]
    found, scripts = table[: 1 << BITS], table[1 << BITS :]
    logs = np.log(found + SMOOTHING) - np.log(found.sum(axis=0) + SMOOTHING * (1 << BITS))
    seen = scripts >= CANDIDATE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logs, seen & (scripts > 0))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """[form, language]: log-likelihood of each distinct form, or ``EXCLUDED``."""
    form, bucket = grams(words)
    n = len(words.lengths)
    score = np.stack(
        [np.bincount(form, weights=model.grams[bucket, k], minlength=n) for k in range(len(model.languages))], axis=1
    )
    # mean over the n-gram sizes: each letter counts once
    score /= LONGEST
    allowed = model.scripts[_scripts(words)]
    none = ~allowed.any(axis=1)
    allowed[none] = True
    # a script of no learned language says nothing
    score[none] = 0.0
    best = np.where(allowed, score, -np.inf).max(axis=1, keepdims=True)
    return np.where(allowed, score - best, EXCLUDED)


def viterbi(owner: np.ndarray, score: np.ndarray, texts: int, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; ``owner`` ascends, ``score`` is [word, language]."""
    total, languages = score.shape
    starts = np.searchsorted(owner, np.arange(texts + 1))
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], starts[:-1][order]
    most = int(length[0]) if texts else 0
    active = np.searchsorted(-length, -np.arange(most), side="left")  # texts with more words than t
    came = np.zeros(score.shape, dtype=np.int8 if languages < 127 else np.int32)
    state = np.zeros((texts, languages))
    best = np.zeros(texts, np.int64)
    own = np.arange(languages)
    for t in range(most):
        a = active[t]
        at = begin[:a] + t
        now = state[:a]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(a), top][:, None] - switch
            moved = jump > now
            came[at] = np.where(moved, top[:, None], own)
            now = np.where(moved, jump, now)
        state[:a] = now + score[at]
    label = np.zeros(total, np.int64)
    best = state.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        label[at] = best[:a]
        best[:a] = came[at, best[:a]] if t else best[:a]
    return label


def label(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """Add ``lang_pred`` (by letters), ``score`` (its share of the letters) and, if asked for,
    ``spans``: array of (start, end, lang) in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double"
    schema = T.StructType.fromDDL(added + (", spans array<struct<start:int,end:int,lang:string>>" if spans else ""))
    kept = [c for c in docs.columns if c not in schema.names]

    def work(batches):
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            some = [predict(m, texts, spans) for texts in portions(batch.column(names.index(text)), PORTION)]
            made = [pa.concat_arrays(c) for c in zip(*(some or [predict(m, [], spans)]))]
            old = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[*kept, *schema.names])

    return docs.mapInArrow(trimmed(work), T.StructType([*(docs.schema[c] for c in kept), *schema.fields]))


def predict(model: Model, texts: list[str | None], spans: bool) -> list[pa.Array]:
    n, languages = len(texts), len(model.languages)
    words = words_of(texts)
    if not len(words.form) or not languages:
        out = [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        return [*out, pa.array([[] for _ in range(n)], kind)] if spans else out
    labels = viterbi(words.owner, word_scores(words, model)[words.form], n)
    letters = np.bincount(words.owner * languages + labels, weights=words.length, minlength=n * languages)
    letters = letters.reshape(n, languages)
    total = letters.sum(axis=1)
    top = letters.argmax(axis=1)
    names = [model.languages[k] if t else UNKNOWN for k, t in zip(top, total)]
    share = letters[np.arange(n), top] / np.maximum(total, 1)
    out = [pa.array(names, pa.string()), pa.array(share)]
    if spans:
        new = np.flatnonzero(np.diff(words.owner * languages + labels, prepend=-1))
        last = np.append(new[1:], len(labels)) - 1
        ends = np.searchsorted(words.owner[new], np.arange(n + 1)).astype(np.int32)
        flat = pa.StructArray.from_arrays(
            [
                pa.array(words.start[new].astype(np.int32)),
                pa.array((words.start[last] + words.length[last]).astype(np.int32)),
                pa.array([model.languages[k] for k in labels[new]], pa.string()),
            ],
            names=["start", "end", "lang"],
        )
        out.append(pa.ListArray.from_arrays(pa.array(ends), flat))
    return out
