"""Language-model scores: a Katz bigram model with Good-Turing discounts.

Tokens of a text are its words (see ``words``) and one end; the first context is a beginning.

* ``P(w)  = d(c) c(w) / (N + 1)``; what is left belongs to the one unknown word.
* ``P(w|h) = d(c) c(hw) / (c(h) + 1)`` for a seen pair, else ``alpha(h) P(w)``.
* ``d(r)`` is Good-Turing's for ``r <= K``, 1 above. The reserved count in the denominators
  leaves every context some mass, also one whose pairs are all frequent; ``alpha`` shares
  out exactly that mass: ``(1 - sum of seen P(w|h)) / (1 - sum of their P(w))``.

How it runs. A batch of documents is reduced to its distinct words and pairs; they go, as
packed arrays, to buckets by hash (``ask``), ``SPLIT`` for each shuffle partition. A bucket adds up the counts, stores its share of
the n-gram table and answers each batch in the order it asked (``tally``). The batch's token
sequence meets the answers by batch number (``settle``): that gives each document's sums, what
each context contributes to its backoff weight (every pair is owned by one batch), and the
unseen tokens, which are joined with the stored backoff table. No key is ever gathered whole:
a frequent word is one entry per batch. Buckets grow with ``spark.sql.shuffle.partitions``.

Stored under ``path``: ``counts`` (kind=table: order, bucket, keys, counts as arrays), and
``backoff`` (context, alpha). Pairs are told apart by their bucket and 48 further bits of a
64-bit hash, so by more bits the more buckets there are; words by 64 bits.

The document table is read twice and must give the same rows in the same partitions (a stored
table does); otherwise the job stops with an error.

Defined results: a null text is the empty text, one end token; repeated rows count and are
scored each; without training rows every token has probability 1; the id column is carried
along, also if null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runtally.llm.words import bounded_batches, mixed, texts_words, trimmed, trimmed_group
from runtally.session import scratch_path, tidy_shuffles

#: Counts up to K are discounted. Bytes of text per batch; one text may exceed it.
K, BATCH = 5, 2 << 20
#: Buckets for each shuffle partition: a partition takes up one after the other.
SPLIT = 3

END, BEGIN = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0xB0B0B0B0B0B0B0B1)
_LOW = np.uint64((1 << 48) - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, by place within their items, compressed."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        kind = a.dtype.str.encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts.append(len(kind).to_bytes(1, "little") + kind + len(a).to_bytes(8, "little") + planes)
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 1
    for _ in range(raw[0]):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        n = int.from_bytes(raw[at + 1 + k : at + 9 + k], "little")
        at += 9 + k
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key, even for any number of buckets below 2^32."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Batch:
    """Tokens of some documents: distinct words and pairs, and the sequences over them."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.words, self.tokens, self.lengths, self.train = words, tokens.astype(np.int64), lengths, train
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        # BEGIN is context number len(words)
        self.context = np.concatenate(([0], self.tokens[:-1]))
        self.context[starts] = len(words)
        names = np.append(words, BEGIN)
        keys = mixed(mixed(names)[self.context] * np.uint64(0x9E3779B97F4A7C15) + names[self.tokens])
        self.pairs, first, self.pair = np.unique(keys, return_index=True, return_inverse=True)
        self.pair_context, self.pair_word = self.context[first], self.tokens[first]

    @classmethod
    def of(cls, texts: list[str | None], train: np.ndarray) -> Batch:
        hashes, ends = texts_words(texts)
        n = len(texts)
        lengths = np.diff(ends) + 1
        every = np.empty(len(hashes) + n, np.uint64)
        owner = np.repeat(np.arange(n), np.diff(ends))
        every[np.arange(len(hashes)) + owner] = hashes
        every[np.cumsum(lengths) - 1] = END
        words, tokens = np.unique(every, return_inverse=True)
        return cls(words, tokens, lengths.astype(np.int64), train)

    def number(self, place: int) -> int:
        """Of the batch: by its content and its place, so that another batch is noticed."""
        some = np.concatenate((self.words, self.tokens.astype(np.uint64), self.lengths.astype(np.uint64)))
        spread = mixed(some + np.arange(len(some), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return int((mixed(np.array([spread.sum(dtype=np.uint64) + np.uint64(place)])) >> np.uint64(1))[0])


def _batches(record: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray]]:
    ids, texts, train, size = [], [], [], 0
    for i, t, learn in zip(*(record.column(k).to_pylist() for k in range(3))):
        ids.append(i)
        texts.append(t)
        train.append(bool(learn))
        size += len(t or "")
        if size >= BATCH:
            yield ids, texts, np.array(train)
            ids, texts, train, size = [], [], [], 0
    if ids:
        yield ids, texts, np.array(train)


def _numbered(records) -> Iterator[tuple[int, list, Batch]]:
    place = TaskContext.get().partitionId() << 24
    for record in records:
        for ids, texts, train in _batches(record):
            batch = Batch.of(texts, train)
            yield batch.number(place), ids, batch
            place += 1


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, payload): distinct words and pairs of each batch with training counts."""

    def work(records):
        for number, _, b in _numbered(records):
            learn = b.train[b.owner]
            counts = np.bincount(b.tokens, weights=learn, minlength=len(b.words)).astype(np.uint32)
            pair_counts = np.bincount(b.pair, weights=learn, minlength=len(b.pairs)).astype(np.uint32)
            edges = np.arange(buckets + 1, dtype=np.uint64)
            at = np.searchsorted(_bucket(b.words, buckets), edges)
            to = np.searchsorted(_bucket(b.pairs, buckets), edges)
            rows = []
            for k in range(buckets):
                w, p = slice(at[k], at[k + 1]), slice(to[k], to[k + 1])
                low = b.pairs[p] & _LOW
                payload = _packed(
                    b.words[w], counts[w], low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), pair_counts[p]
                )
                rows.append((k, number, payload))
            yield _rows(rows, ["bucket", "batch", "payload"], [pa.int32(), pa.int64(), pa.binary()])

    return docs.mapInArrow(trimmed(work), "bucket int, batch long, payload binary")


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys with totals; for each list, the totals and whether it owns the key."""
    every, weight = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    known, inverse = np.unique(every, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, weight)
    owner = np.full(len(known), -1, np.int64)
    taught = np.flatnonzero(weight)[::-1]
    owner[inverse[taught]] = taught  # the first that taught it stays
    own = owner[inverse] == np.arange(len(every))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return known, total, np.split(total[inverse], cuts), np.split(own, cuts)


_TALLY = "kind string, batch long, bucket int, payload binary, order int, keys array<long>, counts array<long>"


def tally(asked: DataFrame) -> DataFrame:
    """Per bucket: answers to the batches, its rows of the n-gram table, counts of counts."""

    def work(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        senders = table.column("batch").to_pylist()
        order = np.argsort(senders, kind="stable")
        parts = [_unpacked(table.column("payload")[int(k)].as_py()) for k in order]
        words, count, word_totals, _ = _totals([p[0] for p in parts], [p[1] for p in parts])
        low = [p[2].astype(np.uint64) | (p[3].astype(np.uint64) << np.uint64(32)) for p in parts]
        pairs, pair_count, pair_totals, own = _totals(low, [p[4] for p in parts])
        rows = [
            ("answer", senders[k], bucket, _packed(word_totals[i], pair_totals[i], own[i].astype(np.uint8)), None, None, None)
            for i, k in enumerate(order)
        ]
        for n, (keys, counts) in enumerate(((words, count), (pairs, pair_count)), 1):
            some = counts > 0
            rows.append(("table", None, bucket, None, n, keys[some].view(np.int64), counts[some]))
            times = np.bincount(np.minimum(counts[some], K + 2), minlength=K + 3)
            rows.append(("stats", None, bucket, None, n, [], np.append(times, counts.sum())))
        names = ["kind", "batch", "bucket", "payload", "order", "keys", "counts"]
        longs = pa.list_(pa.int64())
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), longs, longs]
        return pa.Table.from_batches([_rows(rows, names, types)])

    return asked.groupBy("bucket").applyInArrow(trimmed_group(work), _TALLY)


def discounts(times: np.ndarray) -> np.ndarray:
    """d(0..K+1) from counts of counts; d(K+1) stands for all above and is 1.

    Where counts of counts are too irregular for Good-Turing (a value outside (0, 1)), half a
    count is taken off instead.
    """
    d = np.ones(K + 2)
    n = times.astype(float)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d[r] = 1 - 0.5 / r
        if n[r] and common < 1:
            good = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            d[r] = good if 0 < good < 1 else d[r]
    return d


class Model:
    """The global numbers: token total, distinct words, discounts, the unknown word's mass."""

    def __init__(self, word_times: np.ndarray, pair_times: np.ndarray):
        self.total = int(word_times[-1])
        self.distinct = int(word_times[1 : K + 3].sum())
        self.word_discount, self.pair_discount = discounts(word_times), discounts(pair_times)
        r = np.arange(1, K + 1)
        taken = float((word_times[1 : K + 1] * r * (1 - self.word_discount[1 : K + 1])).sum())
        self.unknown = (1 + taken) / (self.total + 1)

    def word(self, count: np.ndarray) -> np.ndarray:
        seen = self.word_discount[np.minimum(count, K + 1)] * count / (self.total + 1)
        return np.where(count > 0, seen, self.unknown)

    def kept(self, count: np.ndarray) -> np.ndarray:
        """d(c) c of pairs."""
        return self.pair_discount[np.minimum(count, K + 1)] * count


_SETTLED = (
    "kind string, batch long, row int, doc_id long, train boolean, n_tokens long, n_known long, "
    "base_score double, score double, context long, times long, kept double, covered double"
)


def settle(docs: DataFrame, answers: DataFrame, buckets: int, model: Model) -> DataFrame:
    """Per batch: a row per document, per unseen (document, context) and per owned context."""

    def plans(records):
        for number, ids, b in _numbered(records):
            payload = _packed(b.words, b.tokens.astype(np.uint32), b.lengths, b.train.astype(np.uint8))
            known = [i is not None for i in ids]
            names = _packed(np.array([i or 0 for i in ids], np.int64), np.array(known, np.uint8))
            rows = [(number, -1, payload), (number, -2, names)]
            yield _rows(rows, ["batch", "bucket", "payload"], [pa.int64(), pa.int32(), pa.binary()])

    def work(table: pa.Table) -> pa.Table:
        rows = dict(zip(table.column("bucket").to_pylist(), table.column("payload")))
        if len(rows) != buckets + 2 or table.num_rows != buckets + 2:
            raise RuntimeError("the documents changed between two reads: pass a stored table")
        number = table.column("batch")[0].as_py()
        words, tokens, lengths, train = _unpacked(rows[-1].as_py())
        ids, known_ids = _unpacked(rows[-2].as_py())
        b = Batch(words, tokens, lengths, train.astype(bool))
        parts = [_unpacked(rows[k].as_py()) for k in range(buckets)]
        count = np.concatenate([p[0] for p in parts])
        pair_count = np.concatenate([p[1] for p in parts])
        own = np.concatenate([p[2] for p in parts]).astype(bool)
        del parts, rows
        # a context's total is its count as a token; the beginning's that of the end
        before = np.append(count, count[words == END])
        p_word = model.word(count)
        n = len(lengths)
        add = lambda values: np.bincount(b.owner, weights=values, minlength=n)
        seen = pair_count > 0
        of_pair = np.log10(p_word)[b.pair_word]
        of_pair[seen] = np.log10(model.kept(pair_count[seen]) / (before[b.pair_context[seen]] + 1))
        score = add(of_pair[b.pair])
        base = np.log10((count + 1) / (model.total + model.distinct + 1))
        out = {name.split()[0]: [] for name in _SETTLED.split(", ")}

        def put(size: int, **columns):
            for name, values in out.items():
                values.append(columns.get(name))
            sizes.append(size)

        sizes: list[int] = []
        put(
            n,
            kind="doc",
            batch=number,
            row=np.arange(n, dtype=np.int32),
            doc_id=pa.array(ids, mask=known_ids == 0),
            train=b.train,
            n_tokens=lengths,
            n_known=add((count > 0)[b.tokens].astype(float)).astype(np.int64),
            base_score=add(base[b.tokens]),
            score=score,
        )
        names = np.append(words, BEGIN).view(np.int64)
        # unseen pairs whose context is known: alpha is still missing
        need = ~seen[b.pair] & (before[b.context] > 0)
        missing, times = np.unique(b.owner[need] * (len(words) + 1) + b.context[need], return_counts=True)
        put(
            len(missing),
            kind="unseen",
            batch=number,
            row=(missing // (len(words) + 1)).astype(np.int32),
            context=names[missing % (len(words) + 1)],
            times=times,
        )
        context = b.pair_context[own]
        kept = np.bincount(context, weights=model.kept(pair_count[own]), minlength=len(names))
        covered = np.bincount(context, weights=p_word[b.pair_word[own]], minlength=len(names))
        some = np.unique(context)
        put(len(some), kind="context", context=names[some], times=before[some], kept=kept[some], covered=covered[some])
        columns = []
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2]
        types += [pa.int64()] * 2 + [pa.float64()] * 2
        for kind, values in zip(types, out.values()):
            columns.append(
                pa.chunked_array(
                    [
                        pa.nulls(size, kind)
                        if v is None
                        else pa.repeat(pa.scalar(v, kind), size)
                        if isinstance(v, (str, int))
                        else pa.array(v).cast(kind)
                        for size, v in zip(sizes, values)
                    ],
                    kind,
                )
            )
        return pa.table(columns, names=list(out))

    planned = docs.mapInArrow(trimmed(plans), "batch long, bucket int, payload binary")
    both = planned.unionAll(answers.select("batch", "bucket", "payload"))
    return both.groupBy("batch").applyInArrow(trimmed_group(work), _SETTLED)


def lm_scores(docs: DataFrame, learn: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score.

    ``learn``: SQL condition on the documents to learn from; ``path``: folder for the tables.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "katz")
    bounded_batches(spark)
    buckets = SPLIT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(F.expr(learn), F.lit(False)).alias("train"),
    )
    with tidy_shuffles(spark):
        tally(ask(plain, buckets)).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/counts")
    counted = spark.read.schema(_TALLY).parquet(f"{path}/counts")
    # Two short rows per bucket.
    stats = counted.where("kind = 'stats'").select("order", "counts").toPandas()
    times = [
        sum((np.array(c) for c in stats["counts"][stats["order"] == n]), np.zeros(K + 4, np.int64)) for n in (1, 2)
    ]
    model = Model(*times)
    settled_at = f"{path}/settled"
    with tidy_shuffles(spark):
        settle(plain, counted.where("kind = 'answer'"), buckets, model).write.partitionBy("kind").option(
            "compression", "zstd"
        ).parquet(settled_at)
    settled = spark.read.schema(_SETTLED).parquet(settled_at)
    sums = settled.where("kind = 'context'").groupBy("context").agg(
        F.max("times").alias("times"), F.sum("kept").alias("kept"), F.sum("covered").alias("covered")
    )
    left = 1 - F.col("kept") / (F.col("times") + 1)
    sums.select("context", (left / (1 - F.col("covered"))).alias("alpha")).write.parquet(f"{path}/backoff")
    backoff = spark.read.schema("context long, alpha double").parquet(f"{path}/backoff")
    unseen = settled.where("kind = 'unseen'").select("batch", "row", "context", "times")
    late = (
        unseen.join(backoff, "context")
        .groupBy("batch", "row")
        .agg(F.sum(F.col("times") * F.log10("alpha")).alias("late"))
    )
    rows = settled.where("kind = 'doc'").join(late, ["batch", "row"], "left")
    return rows.select(
        "doc_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("late", F.lit(0.0))).alias("score"),
    )
