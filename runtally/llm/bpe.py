"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list with word ends (lower case, white space dropped) turns a text into token ids.
The text is read in chunks; a word of any length goes through :class:`Transducer`, which
holds a bounded window of symbols and emits a token as soon as no later symbol can change
it. How far ahead it must look is a property of the merge list alone (:func:`lookahead`).

Why a window is enough. Appending symbols changes an earlier token boundary only by a chain
of merges that runs leftwards: a merge ``(a, c)`` that happens in one run and not in the
other moves the changed region left by ``|a|``, and the next link ``(z, a')`` must come later
in the list and have a right side that starts with the string ``a``. The largest sum of
``|a|`` over such chains bounds the influence of unseen symbols. Tokens that end before it
are final, and as no merge crosses their end, the rest may be merged on its own.

Defined results: a null text is the empty text and has no ids; empty text decodes to ``""``;
repeated rows are encoded each; columns of the input are carried along, an existing ``ids``
or ``decoded`` column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runtally.llm.words import trimmed

#: Characters per chunk of a text, symbols per window beyond the lookahead, words remembered
#: per task, letters after which a word is streamed instead of remembered.
CHUNK, BLOCK, REMEMBERED, STREAMED = 1 << 16, 256, 1 << 18, 64

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space of the pattern; characters that only str.split() takes for white space.
_SPACE, _ONLY_PYTHON = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")
_LETTERS, _MARKS = regex.compile(r"[\p{L}]+"), regex.compile(r"[^\s\p{L}\p{N}]+")


@functools.cache
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """The number of symbols after which no later symbol can change a token's end.

    Merges are read in order of priority; ``reach[a]`` is the longest chain so far whose last
    merge has the left side ``a``, counted in characters, which is never less than symbols.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in merges:
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        here = len(left) + before
        if here > reach.get(left, 0):
            reach[left] = here
        most = max(most, here)
    return most


class MergeList:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs: list[tuple[str, str]] = pairs
        vocab = self.vocab
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [vocab[a + b] for a, b in pairs]
        self.width = {i: len(s.removesuffix(self.suffix)) for s, i in vocab.items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.lookahead = lookahead(pairs)
        found = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.decimal = {i: str(i) for i in self.names}
        self.split = regex.compile(f"({found})") if found else None
        self.margin = max(map(len, self.special), default=0)

    def merge(self, ids: list[int]) -> list[int]:
        """Tokens of a symbol run: the pair of lowest rank merges first, then the leftmost."""
        return self._short(ids) if len(ids) <= STREAMED else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, made, none = self.ranks.get, self.made, len(self.made)
        ids = list(ids)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i] = made[best]
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        ranks, made = self.ranks, self.made
        n = len(ids)
        ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j] = made[rank], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, p))
        return [x for x, kept in zip(ids, alive) if kept]


class Transducer:
    """Symbols of one word in, final token ids out; holds at most a window of symbols."""

    def __init__(self, merges: MergeList, block: int = BLOCK):
        self.merges, self.window = merges, merges.lookahead + block
        self.held: list[int] = []
        self.last: int | None = None

    def feed(self, data: bytes) -> list[int]:
        """Take more bytes of the word; its last byte waits, as the word may end there."""
        if not data:
            return []
        inner, out = self.merges.inner, []
        if self.last is not None:
            self.held.append(inner[self.last])
        self.last = data[-1]
        for start in range(0, len(data) - 1, self.window):
            self.held += [inner[b] for b in data[start : min(start + self.window, len(data) - 1)]]
            if len(self.held) > self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        end, out, limit = 0, [], len(self.held) - self.merges.lookahead
        for token in self.merges.merge(self.held):
            if end + self.merges.width[token] > limit:
                break
            end += self.merges.width[token]
            out.append(token)
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        if self.last is None:
            return []
        out = self.merges.merge([*self.held, self.merges.final[self.last]])
        self.held, self.last = [], None
        return out


class _Remembered(dict):
    """Ids by string for short strings, forgotten all at once when there are too many."""

    def __init__(self, ids_of):
        self.ids_of = ids_of

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.ids_of(key)
        if len(key) <= STREAMED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = ids
        return ids


class Words:
    """Ids of words (the pattern's matches) and of stretches between white space."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.words = _Remembered(self._word)
        self.stretches = _Remembered(self._stretch)

    def forget(self) -> None:
        self.words.clear()
        self.stretches.clear()

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        if len(data) <= STREAMED:  # within any window: the transducer would merge it at its end
            inner, final = self.merges.inner, self.merges.final
            return tuple(self.merges.merge([*[inner[b] for b in data[:-1]], final[data[-1]]]))
        one = Transducer(self.merges)
        return (*one.feed(data), *one.finish())

    def _stretch(self, text: str) -> tuple[int, ...]:
        found = _WORDS.findall(text)
        if len(found) == 1:
            return self.words[found[0]]
        return tuple(chain.from_iterable(map(self.words.__getitem__, found)))


@functools.cache
def _second() -> frozenset[str]:
    """Characters that may combine with the one before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A7, 0x11C3))}
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _apart(c: str) -> bool:
    return c.isascii() or (not unicodedata.combining(c) and c not in _second() and unicodedata.is_normalized("NFC", c))


def chunks(text: str, size: int, margin: int) -> Iterator[str]:
    """Cut a text behind white space or, in a long run without any, where normal forms and
    special tokens (of at most ``margin`` characters, starting with ``<``) are not cut."""
    start, n = 0, len(text)
    while n - start > size:
        at = next((i for i in range(start + size, start + size // 2, -1) if text[i - 1].isspace()), 0)
        if not at:
            at = start + size
            while at < n and not (_apart(text[at]) and "<" not in text[max(start, at - margin) : at]):
                at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def normal(text: str) -> str:
    """NFC, then lower case character by character."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Chunks of one text in, token ids out.

    Held between chunks: the last stretch without white space if it is short, else its last
    word if that is short, else the transducer of that word.
    """

    def __init__(self, merges: MergeList, words: Words | None = None):
        self.merges, self.words = merges, words or Words(merges)
        self.tail, self.run, self.open = "", None, None

    def feed(self, chunk: str) -> list[int]:
        special = self.merges.split
        if special is None or "<" not in chunk:
            return self._plain(chunk)
        out: list[int] = []
        for part in special.split(chunk):
            if part in self.merges.special:
                out += self.finish()
                out.append(self.merges.special[part])
            else:
                out += self._plain(part)
        return out

    def _plain(self, chunk: str) -> list[int]:
        text, out = self.tail + normal(chunk), []
        self.tail = ""
        if self.run is not None:
            more = self.run.match(text)
            if more:
                out += self.open.feed(more.group().encode())
                text = text[more.end() :]
            if not text:
                return out
            out += self.open.finish()
            self.run = self.open = None
        stretches = text.split() if _ONLY_PYTHON.search(text) is None else _SPACE.split(text)
        if stretches and text.endswith(stretches[-1]):
            self.tail = stretches.pop()
        out += chain.from_iterable(map(self.words.stretches.__getitem__, stretches))
        if len(self.tail) > STREAMED:
            out += self._long_tail()
        return out

    def _long_tail(self) -> list[int]:
        found = _WORDS.findall(self.tail)
        held = found.pop()
        if found and found[-1] == "'" and held in ("r", "v", "l"):
            held = found.pop() + held
        out = list(chain.from_iterable(map(self.words.words.__getitem__, found)))
        self.tail = held
        if len(held) > STREAMED:
            self.run = _LETTERS if _LETTERS.fullmatch(held) else _MARKS
            self.open = Transducer(self.merges)
            out += self.open.feed(held.encode())
            self.tail = ""
        return out

    def finish(self) -> list[int]:
        if self.run is not None:
            out = self.open.finish()
            self.run = self.open = None
            return out
        tail, self.tail = self.tail, ""
        return list(self.words.stretches[tail]) if tail else []


def encode_text(merges: MergeList, text: str | None, words: Words | None = None, size: int = CHUNK) -> list[int]:
    text = text or ""
    one, out = Encoder(merges, words), []
    for chunk in chunks(text, size, merges.margin):
        out += one.feed(chunk)
    return out + one.finish()


class Decoder:
    """Token ids in, text out as soon as its characters are complete.

    ``pieces``: the names of the tokens joined by one space, as for a tokenizer file without
    a decoder. Otherwise the bytes behind the names: they pass an incremental UTF-8 machine
    that holds at most three bytes, and a word end becomes a space.
    """

    def __init__(self, merges: MergeList, pieces: bool = True):
        self.names, self.suffix, self.pieces = merges.names, merges.suffix, pieces
        self.special, self.begun = set(merges.special.values()), False
        self.codes = {c: b for b, c in enumerate(byte_letters())}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.pieces:
            text = " ".join(map(self.names.__getitem__, ids))
            lead = " " if self.begun and text else ""
            self.begun = self.begun or bool(text)
            return lead + text
        return "".join(map(self._bytes, ids))

    def _bytes(self, token: int) -> str:
        name = self.names[token]
        if token in self.special:
            return self.state.decode(b"", True) + name
        ended = bool(self.suffix) and name.endswith(self.suffix)
        body = name[: -len(self.suffix)] if ended else name
        text = self.state.decode(bytes(self.codes[c] for c in body), ended)
        return text + " " if ended else text

    def finish(self) -> str:
        return "" if self.pieces else self.state.decode(b"", True)


def decode_ids(merges: MergeList, ids: list[int], pieces: bool = True, size: int = CHUNK) -> str:
    one = Decoder(merges, pieces)
    return "".join(one.feed(ids[i : i + size]) for i in range(0, len(ids), size)) + one.finish()


@functools.lru_cache(maxsize=2)
def _loaded(content: bytes) -> tuple[MergeList, Words]:
    merges = MergeList(content)
    return merges, Words(merges)


def load(path: str) -> bytes:
    """The tokenizer file, read on the driver; workers get it as a broadcast of its size."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids``, the token ids of the text column."""
    content = df.sparkSession.sparkContext.broadcast(load(path))

    def ids(batch, merges, words):
        column = batch.column(text)
        return [pa.array([encode_text(merges, x.as_py(), words) for x in column], pa.list_(pa.int32()))]

    return _adding(df, content, ids, T.StructType().add("ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, pieces: bool = True) -> DataFrame:
    """Add ``decoded``, the text of the ``ids`` column (null ids: the empty text)."""
    content = df.sparkSession.sparkContext.broadcast(load(path))

    def decoded(batch, merges, _):
        column = batch.column("ids")
        return [pa.array([decode_ids(merges, x.as_py() or [], pieces) for x in column], pa.string())]

    return _adding(df, content, decoded, T.StructType().add("decoded", T.StringType()))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass and add ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256``; ids and texts stay in the task."""
    content = df.sparkSession.sparkContext.broadcast(load(path))

    def digest(batch, merges, words):
        counts, of_ids, of_texts = [], [], []
        for x in batch.column(text):
            ids = encode_text(merges, x.as_py(), words)
            counts.append(len(ids))
            of_ids.append(sha256(" ".join(map(merges.decimal.__getitem__, ids)).encode()).hexdigest())
            of_texts.append(sha256(decode_ids(merges, ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)]

    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _adding(df, content, digest, added)


def _adding(df: DataFrame, content, columns, added: T.StructType) -> DataFrame:
    """``df`` with the columns that the function makes of each Arrow batch with a tokenizer.

    The words a task remembers go at its end: the worker may stand idle beside other stages.
    """
    kept = [c for c in df.columns if c not in added.names]

    def work(batches):
        merges, words = _loaded(content.value)
        try:
            for batch in batches:
                made = columns(batch, merges, words)
                old = [batch.column(batch.schema.names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*old, *made], names=[*kept, *added.names])
        finally:
            words.forget()

    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    return df.mapInArrow(trimmed(work), schema)
