"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a trigram with a lower model, which mixes a
bigram, a unigram and a uniform distribution.  The mixture weights depend on how often the context was
seen (one set of weights for each power of two) and are learned by expectation-maximisation on deleted
counts, the lower model's first: each training token is scored by the counts without itself.

Counting and looking up share one exchange.  Documents are gathered into chunks; a
chunk sends its distinct keys, with its own training counts, to hash buckets as sorted
compressed arrays, a key once a chunk whatever its frequency.  A bucket sums
them and answers every chunk in the order it asked.  So no key is hot, nothing about the
vocabulary is broadcast or collected, and what moves grows with the corpus.  Only the
histogram for the mixture weights (bounded by its grid) reaches the driver.

Unigram keys are 64-bit hashes of the word; bigram and trigram keys keep log2(tokens) + 22 bits (48 to 64), so
that one key in four million shares its count with another.

Defined results: null text is empty and has one token, the end; a null doc_id is held out of
nothing unless `train` says so (null counts as training); rows that repeat a doc_id or a text are texts of their own, each
counted and scored; very long texts are scored whole; columns other than id and text aren't looked at, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from . import words as W

CHUNK = 6 << 20
_END = np.uint64(0xE7037ED1A0B428DB)
_CONTENT = "chunk long, texts binary, ids array<long>, train array<boolean>, sizes array<int>"
_KINDS = ("1", "2", "3")
#: Kinds of keys whose exchange is one shuffle.
_ROUNDS = (("1", "2"), ("3",))
_TOKENS = "chunk long, ids array<long>, train array<boolean>, sizes array<long>, c1 binary, c2 binary, c3 binary"
BUCKETS = 40


def _zip(x: np.ndarray, level: int = 1) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _unzip(data: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate((sorted_keys[:1], np.diff(sorted_keys))) if len(sorted_keys) else sorted_keys


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into chunks of about CHUNK bytes; a longer document is a chunk of its own."""
    import zstandard

    pid, k = TaskContext.get().partitionId(), 0
    ids, train, texts, size = [], [], [], 0

    def row():
        nonlocal k
        k += 1
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return pa.RecordBatch.from_pydict(
            {"chunk": [pid << 32 | k], "texts": [blob], "ids": [ids], "train": [train], "sizes": [[len(t) for t in texts]]},
            schema=pa.schema([("chunk", pa.int64()), ("texts", pa.binary()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]),
        )

    for batch in batches:
        for i, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), W.encoded(batch.column(2)), strict=True):
            if texts and size + len(text) > CHUNK:
                yield row()
                ids, train, texts, size = [], [], [], 0
            ids.append(i)
            train.append(flag)
            texts.append(text)
            size += len(text)
    if texts:
        yield row()


def _tokens(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk (each document ends with the end token), the one and the two before them, tokens a document."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(sizes)
    w = W.Words([data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], lower=True)
    token = np.insert(w.hashes(), w.first[1:], _END)
    n = np.diff(w.first) + 1
    before = np.concatenate(([_END], token[:-1]))
    earlier = np.concatenate(([_END], before[:-1]))
    earlier[np.cumsum(n) - n] = _END  # nothing of the document before
    return token, before, earlier, n


def _joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(context * np.uint64(0x9E3779B97F4A7C15) ^ token)


def _keys(token: np.ndarray, before: np.ndarray, earlier: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of every token, of the pair and of the triple that it ends, and their bits."""
    cut = np.uint64(64 - bits)
    yield token, 64
    yield _joined(before, token) >> cut, bits
    yield _joined(_joined(earlier, before), token) >> cut, bits


def _split(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys: equal ranges of the key space."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _ask_schema(kinds: tuple[str, ...]) -> str:
    return "chunk long, bucket int, " + ", ".join(f"keys{k} binary, counts{k} binary" for k in kinds)


def _answer_schema(kinds: tuple[str, ...]) -> str:
    return "chunk long, bucket int, " + ", ".join(f"c{k} binary" for k in kinds)


def _ask(buckets: int, bits: int, kinds: tuple[str, ...]):
    """Mapper: the distinct keys of each chunk of some kinds and their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, train, sizes in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                token, before, earlier, n = _tokens(blob, np.array(sizes, dtype=np.int64))
                learn = np.repeat(np.array(train, dtype=bool), n)
                out = {"chunk": [chunk] * buckets, "bucket": list(range(buckets))}
                for kind, (keys, width) in zip(_KINDS, _keys(token, before, earlier, bits), strict=True):
                    if kind not in kinds:
                        continue
                    own, inverse = np.unique(keys, return_inverse=True)
                    seen = np.bincount(inverse, weights=learn, minlength=len(own)).astype(np.uint32)
                    edges = _split(own, buckets, width)
                    parts = list(zip(edges[:-1], edges[1:], strict=True))
                    out["keys" + kind] = [_zip(_deltas(own[x:y])) for x, y in parts]
                    out["counts" + kind] = [_zip(seen[x:y]) for x, y in parts]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((c + k, pa.binary()) for k in kinds for c in ("keys", "counts"))]))

    return run


def _answer(kinds: tuple[str, ...]):
    """Grouped mapper: sums the counts of a bucket's keys and answers each chunk; chunk -1 tells the bucket's tokens and distinct tokens."""

    def run(group: pa.Table) -> pa.Table:
        chunks, answers = group.column("chunk").to_pylist(), {}
        for kind in kinds:
            keys = [np.cumsum(_unzip(x, np.uint64), dtype=np.uint64) for x in group.column("keys" + kind).to_pylist()]
            counts = np.concatenate([_unzip(x, np.uint32) for x in group.column("counts" + kind).to_pylist()])
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=counts).astype(np.uint64)
            told = np.array([total.sum(), (total > 0).sum()], dtype=np.uint64).tobytes() if kind == "1" else b""
            answers["c" + kind] = pa.array([*(_zip(x) for x in np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])), told], pa.binary())
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([*chunks, -1], pa.int64()), "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int32()), **answers})

    return run


def _look_up(bits: int):
    """Cogrouped mapper: the counts of every token of a chunk, and of the pair and the triple it ends."""

    def run(content: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: content.column(c)[0].as_py() for c in content.column_names}
        token, before, earlier, n = _tokens(row["texts"], np.array(row["sizes"], dtype=np.int64))
        order = np.argsort(answers.column("bucket").to_numpy())
        out = {}
        for kind, (keys, _) in zip(_KINDS, _keys(token, before, earlier, bits), strict=True):
            parts = answers.column("c" + kind).to_pylist()
            counts = np.concatenate([_unzip(parts[i], np.uint64) for i in order if parts[i] is not None])  # other rounds' rows have none
            own, inverse = np.unique(keys, return_inverse=True)
            if len(own) != len(counts):
                raise ValueError("a chunk's answers do not fit its keys")
            out["c" + kind] = pa.array([_zip(counts[inverse].astype(np.uint64), 3)], pa.binary())
        return pa.table({"chunk": pa.array([row["chunk"]], pa.int64()), "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "train": pa.array([row["train"]], pa.list_(pa.bool_())), "sizes": pa.array([n.tolist()], pa.list_(pa.int64())), **out})

    return run


class Counts:
    """Counts at every token of some documents: of the token, the pair and the triple it ends and of their contexts."""

    def __init__(self, n: np.ndarray, own: np.ndarray, pair: np.ndarray, triple: np.ndarray, docs: float):
        first = np.cumsum(n) - n
        self.own, self.pair, self.triple = own, pair, triple
        self.context, self.wide = (np.concatenate(([0.0], x[:-1])) for x in (own, pair))
        self.context[first] = self.wide[first] = docs  # a document begins after end tokens

    def of(self, use: np.ndarray) -> Counts:
        out = object.__new__(Counts)
        out.__dict__.update({k: v[use] for k, v in self.__dict__.items()})
        return out

    def without_itself(self) -> Counts:
        out = object.__new__(Counts)
        out.__dict__.update({k: np.maximum(v - 1, 0) for k, v in self.__dict__.items()})
        return out


class Model:
    """Sizes of the training texts, and the mixture weights learned so far."""

    def __init__(self, docs: float, n_train: float, vocabulary: float):
        self.docs, self.n_train, self.vocabulary = docs, n_train, vocabulary
        self.grid = max(48, 2 * math.ceil(math.log2(n_train + 2)) + 4)  # the lowest level is below any estimate
        self.low = self.high = None

    def level(self, p: np.ndarray) -> np.ndarray:
        """A probability's place on the grid: half octaves, 0 for zero."""
        return np.where(p > 0, np.clip(self.grid - 1 + np.round(2 * np.log2(np.maximum(p, 1e-300))), 1, self.grid - 1), 0).astype(np.int64)

    def back(self, level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, 2.0 ** ((level - self.grid + 1) / 2), 0.0)

    def lower_parts(self, c: Counts, n_train: float) -> tuple[np.ndarray, np.ndarray]:
        return c.pair / np.maximum(c.context, 1), c.own / max(n_train, 1)

    def lower(self, c: Counts, n_train: float) -> np.ndarray:
        w = self.low[context_bucket(c.context)]
        p2, p1 = self.lower_parts(c, n_train)
        return w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (self.vocabulary + 1)

    def probability(self, c: Counts) -> np.ndarray:
        w = self.high[context_bucket(c.wide)]
        return w[:, 0] * c.triple / np.maximum(c.wide, 1) + w[:, 1] * self.lower(c, self.n_train)


def _opened(batch: pa.RecordBatch, docs: float) -> Iterator[tuple]:
    """For each chunk: ids, train, tokens a document and its counts."""
    for ids, train, sizes, *counts in zip(*(batch.column(c).to_pylist() for c in range(1, 7)), strict=True):
        n = np.array(sizes, dtype=np.int64)
        yield ids, np.array(train, dtype=bool), n, Counts(n, *(_unzip(x, np.uint64).astype(np.float64) for x in counts), docs)


def context_bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def deleted_cells(model: Model, c: Counts) -> np.ndarray:
    """Cell of each training token: context bucket and two estimates, all without the token itself.

    Before the lower model's weights are known these are its pair and single estimates, later the triple's and its own.
    """
    c, n_train = c.without_itself(), model.n_train - 1
    if model.low is None:
        upper, below = model.lower_parts(c, n_train)
        context = c.context
    else:
        upper, below, context = c.triple / np.maximum(c.wide, 1), model.lower(c, n_train), c.wide
    return (context_bucket(context) * model.grid + model.level(upper)) * model.grid + model.level(below)


def _deleted(model: Model):
    """Mapper: histogram of training tokens by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * model.grid**2, dtype=np.int64)
        for batch in batches:
            for _, train, n, counts in _opened(batch, model.docs):
                total += np.bincount(deleted_cells(model, counts.of(np.repeat(train, n))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return run


def learn_weights(model: Model, histogram: dict[int, int], rounds: int = 100) -> np.ndarray:
    """Weights of each context bucket by EM: pair, single and uniform estimates, or triple and lower model."""
    start = [0.3, 0.6, 0.1] if model.low is None else [0.5, 0.5]
    weights = np.tile(start, (BUCKETS, 1))
    if not histogram:
        weights[:] = [0.0] * (len(start) - 1) + [1.0]
        return weights
    cell, n = np.array(list(histogram), dtype=np.int64), np.array(list(histogram.values()), dtype=np.float64)
    bucket = cell // model.grid**2
    parts = [model.back(cell // model.grid % model.grid), model.back(cell % model.grid)]
    if model.low is None:
        parts.append(np.full(len(cell), 1.0 / (model.vocabulary + 1)))
    p = np.column_stack(parts)
    weights[0] = [0.0, *np.array(start[1:]) / sum(start[1:])]
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(len(start))])
        sums += 5 * sums.sum(axis=0) / sums.sum()  # buckets with few tokens lean on all of them
        sums[0, 0] = 0
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, train, n, c in _opened(batch, model.docs):
                base = np.log10((c.own + 1) / (model.n_train + model.vocabulary + 1))
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(~train), pa.array(n), pa.array(np.add.reduceat((c.own > 0).astype(np.int64), at)), pa.array(np.full(len(n), int(model.n_train))), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(model.probability(c)), at))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model of those for which `train` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    content = materialize(rows.mapInArrow(_gather, _CONTENT), "content", "uncompressed")
    size = content.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    tokens = max(1, size // 5)
    buckets, bits = max(4, math.isqrt(tokens // 6000)), min(64, max(48, tokens.bit_length() + 22))
    rounds = []
    for kinds in _ROUNDS:
        asked = content.mapInArrow(_ask(buckets, bits, kinds), _ask_schema(kinds))
        rounds.append(materialize(asked.groupBy("bucket").applyInArrow(_answer(kinds), _answer_schema(kinds)), "answers", "uncompressed", free=True))
    sums = [np.frombuffer(bytes(r["c1"]), dtype=np.uint64) for r in rounds[0].where("chunk = -1").select("c1").collect()]  # a row a bucket
    n_train, vocabulary = (float(sum(int(s[k]) for s in sums)) for k in (0, 1))
    n_docs = float(content.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0)
    answers = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rounds).where("chunk >= 0")
    counted = content.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_look_up(bits), _TOKENS)
    counted = materialize(counted, "counted", "uncompressed", free=True)
    discard(content, *rounds)
    model = Model(n_docs, n_train, vocabulary)
    for level in ("low", "high"):
        cells = counted.mapInArrow(_deleted(model), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        setattr(model, level, learn_weights(model, {r["cell"]: r["n"] for r in cells.collect()}))  # at most BUCKETS * grid^2 rows
    return counted.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
