"""Byte-level BPE for whole partitions: vectorised pre-tokenisation and batched merge rounds.

Encoding works on all documents of a chunk at once:

1. code points are classed (letter, number, white space, other) by table and the
   pre-token boundaries follow from class changes;
2. pre-tokens are hashed in bulk; those met before come from the worker's piece cache;
3. the new ones go through merge rounds: their symbols lie in one flat array, each
   round looks every adjacent pair up by binary search over the sorted pair keys and
   merges the lowest-ranked pair of each word, until no word has a mergeable pair;
4. ids of documents are gathered from the cache's flat array.

Decoding gathers the bytes of ids from a flat vocabulary.  Special tokens in a text
are one id, as in the tokenizers library.  Files that ask for more than this (a normaliser, another pre-tokeniser,
added tokens that strip blanks or are words of their own) are refused.

Defined results: null text is empty and has no ids; very long texts are encoded whole; rows that repeat a doc_id or a text are
rows of their own, encoded alike; columns other than id and text aren't looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import small_batches
from . import words as W

_OTHER, _LETTER, _NUMBER, _WHITE = 0, 1, 2, 3
_NONE = np.int64(1 << 40)
_MAX_PIECES = 1 << 18


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, at = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    return out


def _ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i] + counts[i] - 1 for every i, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - ends + counts, counts)


class _Pieces:
    """Hash table from a pre-token's hash to its ids; open addressing over numpy arrays."""

    def __init__(self, size: int = _MAX_PIECES):
        self.limit, slots = size, size * 4
        self.keys, self.at = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
        self.mask, self.n = np.uint64(slots - 1), 0
        self.off, self.cnt = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 20, dtype=np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece number of each hash, -1 where it isn't known."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """h: distinct hashes that aren't known yet."""
        number = np.arange(self.n, self.n + len(h))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[number] = self.used + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.cnt[number] = counts
        self.used += len(ids)
        self.n += len(h)
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            placed = free & (self.keys[slot] == h[todo])
            self.at[slot[placed]] = number[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + np.uint64(1)) & self.mask


def _refuse_others(spec: dict) -> None:
    """Raise where a vocabulary file asks for what isn't done here."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = {
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", False) or not before.get("use_regex", True),
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
    }
    if any(odd.values()):
        raise ValueError(f"unsupported in the vocabulary file: {', '.join(k for k, v in odd.items() if v)}")


class ByteBPE:
    """Encoder and decoder of one byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        _refuse_others(spec)
        model, alphabet = spec["model"], _byte_alphabet()
        vocab = {k: v for k, v in model["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for k, v in vocab.items():
            pieces[v] = bytes(alphabet[c] for c in k)
        for k, v in self.special.items():
            pieces[v] = k
        self.piece_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_len)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        self.classes = _classes()
        self.decimals = np.zeros((size, len(str(size)) + 1), dtype=np.uint8)
        for i in range(size):
            s = f"{i},".encode()
            self.decimals[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        self.pieces = _Pieces()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; rank _NONE where it doesn't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE), self.pair_made[at]

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of many words; word: each symbol's word number, ascending.

        rank and made belong to the pair that begins at a symbol; a round looks up
        only the pairs beside the symbols it has made.
        """
        n_words = int(word[-1]) + 1 if len(word) else 0
        done_s, done_w = [], []
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._ranked(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = least < _NONE
            if not live.all():  # words without a mergeable pair are finished
                done_s.append(sym[~live])
                done_w.append(word[~live])
                sym, word, rank, made, least = sym[live], word[live], rank[live], made[live], least[live]
                if not len(sym):
                    break
            run = np.flatnonzero(rank == least)
            # of overlapping hits (aaa) every second one, from the left
            fresh = np.concatenate(([True], np.diff(run) != 1))
            first = np.maximum.accumulate(np.where(fresh, run, 0))
            run = run[(run - first) % 2 == 0]
            sym[run] = made[run]
            keep = np.ones(len(sym), dtype=bool)
            keep[run + 1] = False
            at = run - np.arange(len(run))  # each removed symbol lies right after its run
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            rank[at] = _NONE
            todo = np.concatenate((at, at[at > 0] - 1))
            todo = todo[todo + 1 < len(sym)]
            todo = todo[word[todo] == word[todo + 1]]
            rank[todo], made[todo] = self._ranked(sym[todo], sym[todo + 1])
        if not done_s:
            return sym, np.zeros(n_words, dtype=np.int64)
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words)

    def _spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of the texts: UTF-8 bytes end to end, byte offsets of token starts (and the end), tokens a text."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        n = len(cp)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        kind = self.classes[cp]
        head = np.zeros(n + 1, dtype=bool)
        head[first] = True
        head[n] = True
        white, blank = kind == _WHITE, cp == 32
        start = head[:n].copy()
        if n > 1:
            start[1:] |= (kind[1:] != kind[:-1]) & (~blank[:-1] | white[1:])
            start[:-1] |= white[:-1] & ~white[1:] & ~head[1:n]
        quote = np.flatnonzero((cp == 39) & start)  # contractions: an apostrophe that begins a token, then s t re ve m ll d
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == _LETTER) & ~head[quote + 1]]
        if len(quote):
            a = cp[quote + 1]
            has_b = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)]
            b = np.where(has_b, cp[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for at, long in ((quote[one], 2), (quote[two], 3)):
                start[at + 1] = False
                end = at + long
                end = end[end < n]
                start[end] = True
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        if len(data) == n:
            offsets = np.append(np.flatnonzero(start), n)
        else:
            wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            offsets = np.append((np.cumsum(wide) - wide)[start], len(data))
        tokens = np.concatenate(([0], np.cumsum(start)))
        bounds = np.append(first, n)
        return data, offsets, np.diff(tokens[bounds])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; special tokens count as ordinary text."""
        data, offsets, per_text = self._spans(texts)
        if len(offsets) < 2:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        h = _span_hashes(data, offsets)
        if self.pieces.n + len(h) // 4 > self.pieces.limit:
            self.pieces = _Pieces()
        number = self.pieces.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            if self.pieces.n + len(new) > self.pieces.limit:
                self.pieces = _Pieces(1 << (len(h) - 1).bit_length() if len(h) > _MAX_PIECES else _MAX_PIECES)
                missing = np.arange(len(h))
                new, where = np.unique(h, return_index=True)
            at = missing[where]
            counts = offsets[at + 1] - offsets[at]
            sym = self.byte_id[data[_ragged(offsets[at], counts)]]
            ids, made = self._merge(sym, np.repeat(np.arange(len(at)), counts))
            self.pieces.add(new, ids, made)
            number[missing] = self.pieces.find(h[missing])
        p = self.pieces
        counts = p.cnt[number]
        ids = p.flat[_ragged(p.off[number], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the number of ids of each text."""
        if not any(s.decode() in t for s in self.special for t in texts):
            return self._encode_plain(texts)
        import re

        cut = re.compile("(" + "|".join(re.escape(s.decode()) for s in self.special) + ")")
        parts = [cut.split(t) for t in texts]
        ids, counts = self._encode_plain([p for x in parts for p in x[::2]])
        pieces, out, at, i = np.split(ids, np.cumsum(counts)[:-1]), [], [], 0
        for x in parts:
            own = []
            for k, part in enumerate(x):
                if k % 2:
                    own.append(np.array([self.special[part.encode()]], dtype=np.int32))
                else:
                    own.append(pieces[i])
                    i += 1
            out += own
            at.append(sum(map(len, own)))
        return np.concatenate(out).astype(np.int32), np.array(at, dtype=np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text of flat ids; invalid UTF-8 isn't replaced here."""
        sizes = self.piece_len[ids]
        data = self.piece_bytes[_ragged(self.piece_at[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def listed(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        rows = self.decimals[ids]
        data = rows[rows != 0].tobytes()
        ends = np.concatenate(([0], np.cumsum((rows != 0).sum(axis=1))))[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _span_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash (never 0) of every span between neighbouring offsets."""
    spans = object.__new__(W.Words)
    spans.data = np.concatenate((data, np.zeros(9, dtype=np.uint8)))
    spans.starts, spans.ends = offsets[:-1], offsets[1:]
    h = spans.hashes()
    h[h == 0] = np.uint64(1)
    return h


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One encoder a worker process; its piece cache serves later tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def text_chunks(batch: pa.RecordBatch, place: int, limit: int = W.CHUNK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of an Arrow batch with their texts; null is empty."""
    for a, b, _ in W.parts(batch, place, limit, texts=False):
        yield a, b, [t or "" for t in batch.column(place).slice(a, b - a).to_pylist()]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every text; null text has no ids."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for a, b, texts in text_chunks(batch, 1):
                ids, counts = t.encode(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of each row's ids, and `ids_text`, the ids in decimal; other columns stay."""
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("ids_text", T.StringType())])
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            lists = batch.column(place)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, start = np.cumsum(counts), 0
            while start < len(counts):  # about a million ids at a time
                end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 20), side="right")))
                part = batch.slice(start, end - start)
                ids = np.asarray(part.column(place).flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
                own = counts[start:end]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x.decode(errors="replace") for x in t.decode(ids, own)], pa.string()), pa.array(t.listed(ids, own), pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names, "decoded", "ids_text"],
                )
                start = end

    return encoded.mapInArrow(run, schema)
