"""Phrase entries as sorted hashes in one Arrow table, and longest matching of many lines at once.

A phrase is known by a 64-bit hash that grows with it character by character.  Lines are one flat array of
characters; the hashes of all windows of n characters follow from those of n - 1, for positions whose first
character begins a phrase that long.  Windows are looked up in the sorted hashes by way of their leading bits.
What a match rests on are the phrases themselves: they are compared with the text, and a hash that two phrases share only
costs a second, exact pass.

The table can lie in a file that all workers of a machine map: a worker's own memory is the directory of leading
bits, whatever phrases and values weigh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import text as X

ENTRY = pa.schema([("scope", pa.string()), ("phrase", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("cap", pa.string())])
#: What trimming takes away: ASCII white space and the Unicode blanks.
_BLANK = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SENTENCE_END, _NO_SPACE_BEFORE, _NO_SPACE_AFTER = (re.compile(p) for p in (X.SENTENCE_END, X.NO_SPACE_BEFORE, X.NO_SPACE_AFTER))
_WORDS = re.compile(r"(?<=[ \t\n\x0b\f\r])")
_A, _B, _LEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SHIFT = np.uint64(32)
_ROUNDS = 4


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _B
    return h ^ (h >> _SHIFT)


def _longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of windows with one more character."""
    return _mixed((h + c.astype(np.uint64)) * _A)


def _key(h: np.ndarray, n: np.ndarray | int, scopes: np.ndarray | int = 0) -> np.ndarray:
    return _mixed(h ^ np.asarray(n, dtype=np.uint64) * _LEN ^ np.asarray(scopes, dtype=np.uint64))


@lru_cache(1 << 16)
def scope_hash(scope: str | None) -> int:
    return 0 if scope is None else int.from_bytes(blake2b(scope.encode(), digest_size=8).digest(), "little")


def phrase_keys(phrases: list[str], scopes: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first character and length of each phrase (none may be empty)."""
    size = np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases))
    chars, first = characters("".join(phrases)), np.cumsum(size) - size
    h, out = np.zeros(len(phrases), dtype=np.uint64), np.zeros(len(phrases), dtype=np.uint64)
    alive = np.arange(len(phrases))
    for n in range(1, int(size.max(initial=0)) + 1):
        h[alive] = _longer(h[alive], chars[first[alive] + n - 1])
        done = alive[size[alive] == n]
        out[done] = h[done]
        alive = alive[size[alive] > n]
    salt = np.fromiter((scope_hash(s) for s in scopes), dtype=np.uint64, count=len(phrases))
    return _key(out, size, salt), chars[first] if len(phrases) else chars, size


@dataclass(frozen=True)
class Starts:
    """Which lengths phrases have by first character; small for any lexicon."""

    first: np.ndarray  # sorted characters
    has: np.ndarray  # (character, length)

    @staticmethod
    def of(first: np.ndarray, size: np.ndarray) -> Starts:
        known, at = np.unique(first, return_inverse=True)
        has = np.zeros((len(known), int(size.max(initial=0)) + 1), dtype=bool)
        has[at, size] = True
        return Starts(known, has)

    @cached_property
    def rows(self) -> np.ndarray:
        """The row of every code point, -1 where no phrase begins."""
        out = np.full(0x110000, -1, dtype=np.int32)
        out[self.first] = np.arange(len(self.first))
        return out

    def windows(self, chars: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, positions, hashes) of all windows that may be a phrase, short ones first; room: characters left in the line."""
        if not len(self.first) or not len(chars):
            return
        row = self.rows[chars]
        at = np.flatnonzero(row >= 0)
        row = row[at]
        longest = self.has.shape[1] - 1 - np.argmax(self.has[:, ::-1], axis=1)
        reach = np.minimum(longest[row], room[at]).astype(np.int32)
        h = np.zeros(len(at), dtype=np.uint64)
        for n in range(1, self.has.shape[1]):
            on = np.flatnonzero(reach >= n)
            if len(on) < len(at):
                at, row, reach, h = at[on], row[on], reach[on], h[on]
            if not len(at):
                return
            h = _longer(h, chars[at + n - 1])
            hit = np.flatnonzero(self.has[:, n][row])
            if len(hit):
                yield n, at[hit], h[hit]


class Readings:
    """Readings by character."""

    def __init__(self, rows: list[tuple[str, str]], pick):
        rows = sorted(dict(rows).items())
        self.chars = characters("".join(c for c, _ in rows))
        self.raw = pa.array([r for _, r in rows], pa.string())
        self.picked = pa.array([pick(r) for _, r in rows], pa.string())

    def of(self, chars: np.ndarray) -> np.ndarray:
        """The row of each character; -1 without a reading."""
        if not len(self.chars):
            return np.full(len(chars), -1)
        at = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        return np.where(self.chars[at] == chars, at, -1)


def entry_table(entries: pa.Table, pick) -> tuple[pa.Table, Starts, Starts]:
    """entries (ENTRY; scope null: of the lexicon) sorted by hash, with the value that `pick` chooses; where lexicon and layers begin."""
    phrases, scopes = entries["phrase"].to_pylist(), entries["scope"].to_pylist()
    key, first, size = phrase_keys(phrases, scopes)
    order = np.argsort(key, kind="stable")
    chosen = {v: pick(v) for v in entries["value"].unique().to_pylist()}
    out = entries.append_column("dst", pa.array([chosen[v] for v in entries["value"].to_pylist()], pa.string())).append_column("key", pa.array(key))
    own = np.array([s is not None for s in scopes], dtype=bool)
    return out.take(pa.array(order)).combine_chunks(), Starts.of(first[~own], size[~own]), Starts.of(first[own], size[own])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)  # one batch, so that columns are mapped as they are
    return sink.getvalue().to_pybytes()


class Index:
    """Sorted entries and a directory of their leading bits."""

    def __init__(self, table: pa.Table, plain: Starts, own: Starts, readings: Readings):
        column = lambda n: table[n].chunk(0) if table[n].num_chunks == 1 else pa.array(table[n].to_pylist(), table.schema.field(n).type)
        self.scope, self.phrase, self.kind, self.value, self.cap, self.dst = (column(n) for n in ("scope", "phrase", "kind", "value", "cap", "dst"))
        self.key = column("key").to_numpy(zero_copy_only=False)
        bits = len(self.key).bit_length()
        bits = max(1, min(24, bits), min(16, bits + 6))  # of few entries most other windows meet none
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.starts = np.append(np.searchsorted(self.key, edges), len(self.key)).astype(np.int32)
        self.plain, self.own, self.readings = plain, own, readings

    def find(self, keys: np.ndarray, agrees=None) -> np.ndarray:
        """The row of each key, -1 if there is none; `agrees(which, rows)` may refuse rows."""
        out = np.full(len(keys), -1, dtype=np.int64)
        part = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[part].astype(np.int64), self.starts[part + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.key[at[left]] == keys[left]
            if agrees is not None and same.any():
                which = np.flatnonzero(same)
                same[which] = agrees(left[which], at[left[which]])
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Lines:
    """Lines as one array of characters."""

    def __init__(self, texts: list[str], scopes: list[str | None]):
        self.text = "".join(texts)
        self.chars = characters(self.text)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(self.size)
        self.room = np.repeat(self.end, self.size) - np.arange(len(self.chars))
        self.scopes = scopes
        self.scoped = any(s is not None for s in scopes)
        hashes = np.fromiter((scope_hash(s) for s in scopes), dtype=np.uint64, count=len(scopes)) if self.scoped else np.zeros(len(texts), dtype=np.uint64)
        self.salt = np.repeat(hashes, self.size)

    def keys(self, plain: Starts, own: Starts) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(n, positions, keys, of a layer?) of all windows to look up; at each length layers come last."""
        layers = own.windows(self.chars, self.room) if self.scoped else iter(())
        ahead = next(layers, None)
        for n, at, h in plain.windows(self.chars, self.room):
            while ahead and ahead[0] < n:
                yield from self._own(ahead)
                ahead = next(layers, None)
            yield n, at, _key(h, n), False
            if ahead and ahead[0] == n:
                yield from self._own(ahead)
                ahead = next(layers, None)
        while ahead:
            yield from self._own(ahead)
            ahead = next(layers, None)

    def _own(self, found) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        n, at, h = found
        salt = self.salt[at]
        some = salt != 0
        if some.any():
            yield n, at[some], _key(h[some], n, salt[some]), True


def _longest(lines: Lines, index: Index, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each position the length of the longest entry, its row, and whether a layer has it; length 1 and -1 where none begins."""
    size, entry, layer = np.ones(len(lines.chars), dtype=np.int64), np.full(len(lines.chars), -1, dtype=np.int64), np.zeros(len(lines.chars), dtype=bool)
    line = np.repeat(np.arange(len(lines.size)), lines.size) if exact else None
    for n, at, keys, own in lines.keys(index.plain, index.own):

        def agrees(which: np.ndarray, rows: np.ndarray, n=n, at=at, own=own) -> np.ndarray:
            said = zip(at[which].tolist(), index.phrase.take(pa.array(rows)).to_pylist(), index.scope.take(pa.array(rows)).to_pylist(), strict=True)
            return np.array([lines.text[p : p + n] == phrase and scope == (lines.scopes[line[p]] if own else None) for p, phrase, scope in said], dtype=bool)

        row = index.find(keys, agrees if exact else None)
        hit = row >= 0
        size[at[hit]], entry[at[hit]], layer[at[hit]] = n, row[hit], own
    return size, entry, layer


def _from_left(size: np.ndarray) -> np.ndarray:
    """Where tokens begin, from left to right; windows end with their line, so every line begins with a token.

    Only windows of more than one character are looked at: what none of those taken covers is a token by itself.
    A window that none before it reaches is taken, and what it covers goes; after a few rounds what is left is walked over.
    """
    long = np.flatnonzero(size > 1)
    ends, parts = long + size[long], []
    for _ in range(_ROUNDS):
        if not len(long):
            break
        free = np.append(True, long[1:] >= np.maximum.accumulate(ends)[:-1])
        parts.append(long[free])
        left = long >= ends[free][np.cumsum(free) - 1]
        long, ends = long[left], ends[left]
    stop, taken = 0, []
    for place, end in zip(long.tolist(), ends.tolist(), strict=True):
        if place >= stop:
            taken.append(place)
            stop = end
    first = np.concatenate([*parts, np.array(taken, dtype=np.int64)])
    step = np.zeros(len(size) + 1, dtype=np.int8)
    step[first + 1] += 1
    step[first + size[first]] -= 1
    return np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8) == 0)


def _chosen(lines: Lines, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the tokens from left to right, their lengths and entries."""
    for exact in (False, True):
        size, entry, layer = _longest(lines, index, exact)
        at = _from_left(size)
        size, entry = size[at], entry[at]
        hit = np.flatnonzero(entry >= 0)
        rows = pa.array(entry[hit])
        spans = slices(lines.chars, np.append(at, len(lines.chars)))
        same = pc.equal(index.phrase.take(rows), spans.take(pa.array(hit)))
        scope, own = index.scope.take(rows), layer[at[hit]]
        theirs = np.flatnonzero(own)
        right = np.array_equal(pc.is_valid(scope).to_numpy(zero_copy_only=False), own)
        if right and len(theirs):
            of_line = pa.array(np.searchsorted(lines.end, at[hit[theirs]], side="right"))
            right = pc.all(pc.equal(scope.take(pa.array(theirs)), pa.array(lines.scopes, pa.string()).take(of_line)), skip_nulls=False).as_py()
        if right and pc.all(same, min_count=0).as_py():
            break
    return at, size, entry


def slices(chars: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts between consecutive positions; no character is copied twice."""
    width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(width)))[at].astype(np.int32)
    data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


@lru_cache(1 << 16)
def _marks(src: str) -> tuple[bool, bool, bool, bool]:
    """Of a token: whether it is blank, ends a sentence, takes no space before it, and none after it."""
    src = src.strip(_BLANK)
    return not src, bool(_SENTENCE_END.match(src)), bool(_NO_SPACE_BEFORE.match(src)), bool(_NO_SPACE_AFTER.match(src))


def is_blank(line: str) -> bool:
    return not line.strip(_BLANK)


def _take(values: pa.Array, rows: np.ndarray) -> pa.Array:
    return values.take(pa.array(rows, mask=rows < 0))


@lru_cache(1 << 16)
def _capital(text: str) -> str:
    """X.capitalize_first of one text."""
    for k, c in enumerate(text):
        if c.isalpha():
            return f"{text[:k]}{X.capital_of(c)}{text[k + 1 :]}"
    return text


def styled(text: str, cap: str | None) -> str:
    """X.apply_cap_style of one text."""
    if cap == "ALL_WORDS":
        return "".join(X.capital_of(w[0]) + w[1:] if w[:1].isalpha() else w for w in _WORDS.split(text))
    return _capital(text) if cap == "FIRST_LETTER" else text


def glued(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The texts between consecutive offsets, each run as one; what lies in a row needs no copy."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets]), values.buffers()[2] or pa.py_buffer(b""))


class Tokens:
    """Tokens of many lines.  Most repeat, so their texts are made once for each kind of token: an entry, or a character without one."""

    def __init__(self, texts: list[str], scopes: list[str | None], index: Index, pick):
        self.lines, self.index, self.pick = Lines(texts, scopes), index, pick
        self.at, self.size, self.entry = _chosen(self.lines, index)
        self.offsets = np.concatenate(([0], np.searchsorted(self.at, self.lines.end)))
        self.count = np.diff(self.offsets)
        n = len(index.key)
        code = pc.dictionary_encode(pa.array(np.where(self.entry >= 0, self.entry, self.lines.chars[self.at].astype(np.int64) + n)))
        self.kind, known = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_numpy(zero_copy_only=False)
        self._entry = np.where(known < n, known, -1)
        chars = np.where(known < n, 0, known - n).astype("<u4")
        self._reading = np.where(known < n, -1, index.readings.of(chars))
        self._src = pc.coalesce(_take(index.phrase, self._entry), slices(chars, np.arange(len(chars) + 1)))

    def each(self, field: str) -> pa.Array:
        """source, src, dst, raw or cap of each kind of token.  What no entry covers is its own value, so `pick` sees it too."""
        index, read = self.index, self.index.readings
        if field == "source":
            plain = pa.array(["unmatched", "hanviet_fallback"]).take(pa.array((self._reading >= 0).astype(np.int32)))
            return pc.coalesce(_take(index.kind, self._entry), plain)
        if field == "dst":
            plain = pa.array([self.pick(s) if len(s) == 1 else s for s in self._src.to_pylist()], pa.string())
            return pc.coalesce(_take(index.dst, self._entry), _take(read.picked, self._reading), plain)
        if field == "raw":
            return pc.coalesce(_take(index.value, self._entry), _take(read.raw, self._reading), self._src)
        return self._src if field == "src" else _take(index.cap, self._entry)

    def readings(self) -> pa.Array:
        """The reading of every character."""
        lines = self.lines
        return pc.coalesce(_take(self.index.readings.picked, self.index.readings.of(lines.chars)), slices(lines.chars, np.arange(len(lines.chars) + 1)))

    @cached_property
    def _flags(self) -> np.ndarray:
        """The marks of every token, a bit each."""
        return np.array([sum(m << k for k, m in enumerate(_marks(s))) for s in self._src.to_pylist()], dtype=np.uint8)[self.kind]

    def opens(self) -> np.ndarray:
        """Whether a token is the first of its line that isn't blank, or follows the end of a sentence."""
        flags, n = self._flags, len(self.at)
        if not n:
            return np.zeros(0, dtype=bool)
        last = np.full(n, -1, dtype=np.int32)
        last[1:] = np.maximum.accumulate(np.where(flags & 1, -1, np.arange(n, dtype=np.int32)))[:-1]
        return (last < np.repeat(self.offsets[:-1].astype(np.int32), self.count)) | (flags[last] & 2 != 0)

    def space(self) -> np.ndarray:
        """Whether a blank follows a token."""
        flags, apart = self._flags, np.zeros(len(self.at), dtype=bool)
        if len(self.at):
            apart[:-1] = (flags[1:] & 4 == 0) & (flags[:-1] & 8 == 0)
            apart[self.offsets[1:][self.count > 0] - 1] = False
        return apart

    def column(self, field: str) -> pa.Array:
        if field == "pos":
            return pa.array((self.at - np.repeat(self.lines.end - self.lines.size, self.count)).astype(np.int32))
        if field == "len":
            return pa.array(self.size.astype(np.int32))
        if field == "reading":
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(self.at, len(self.lines.chars)).astype(np.int32)), self.readings()), " ")
        if field in ("opens", "space"):
            return pa.array(getattr(self, field)())
        return self.each(field).take(pa.array(self.kind))

    # texts of lines

    def joined(self, field: str, between: str) -> pa.Array:
        """source, src, dst or raw of a line's tokens with a text between them."""
        values = self.each(field).to_pylist()
        more = np.ones(len(self.at), dtype=np.int32)
        more[self.offsets[1:][self.count > 0] - 1] = 0
        return glued(pa.array(values + [v + between for v in values], pa.string()).take(pa.array(self.kind + more * len(values))), self.offsets)

    def shown(self) -> pa.Array:
        """What a reader sees: narrow marks, cap styles of layers' entries, sentence capitals, natural spaces (match.displayed and match.joined)."""
        rows = zip(*[self.each(f).to_pylist() for f in ("src", "dst", "source", "cap")], strict=True)
        plain = [styled(X.NARROW.get(src, dst), cap if source == "name" else None) for src, dst, source, cap in rows]
        opening = [_capital(t) for t in plain]
        forms = pa.array([t + end for texts in (plain, opening) for end in ("", " ") for t in texts], pa.string())
        form = self.space() + 2 * self.opens().astype(np.int32)
        return glued(forms.take(pa.array(self.kind + form * len(plain))), self.offsets)

    def fallback_runs(self) -> pa.Array:
        """Of each line a list of (k, text, reading): the longest runs of fallback tokens, from the k-th token on."""
        ours = np.asarray(self._reading >= 0)[self.kind]
        fresh = np.ones(len(ours), dtype=bool)
        fresh[1:] = ~ours[:-1]
        fresh[self.offsets[:-1][self.count > 0]] = True
        first = np.flatnonzero(ours & fresh)
        own = np.flatnonzero(ours)
        cuts = np.append(np.searchsorted(own, first), len(own))
        kind = pa.array(self.kind[own])
        line = np.searchsorted(self.offsets, first, side="right") - 1
        reading = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), self.each("dst").take(kind)), " ")
        k = pa.array((first - self.offsets[line]).astype(np.int32))
        runs = pa.StructArray.from_arrays([k, glued(self._src.take(kind), cuts), reading], names=["k", "text", "reading"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, self.offsets).astype(np.int32)), runs)


def token_columns(texts: list[str], scopes: list[str | None], index: Index, fields: tuple[str, ...], pick) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Tokens of all lines: offsets of the lines in them, and a column for each field."""
    tokens = Tokens(texts, scopes, index, pick)
    return tokens.offsets, {f: tokens.column(f) for f in fields}


def readings_of(texts: list[str], read: Readings) -> pa.Array:
    """Of each line the readings of its characters, joined by blanks: whatever phrases it holds, a token's reading is that of its characters."""
    chars, size = characters("".join(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = pc.dictionary_encode(pa.array(chars))
    known = code.dictionary.to_numpy(zero_copy_only=False).astype("<u4")
    each = pc.coalesce(_take(read.picked, read.of(known)), slices(known, np.arange(len(known) + 1))).to_pylist()
    ends = np.cumsum(size)
    more = np.ones(len(chars), dtype=np.int32)
    more[ends[size > 0] - 1] = 0
    return glued(pa.array(each + [r + " " for r in each], pa.string()).take(pa.array(code.indices.to_numpy(zero_copy_only=False) + more * len(each))), np.concatenate(([0], ends)))


def laid_spans(lines: Lines, index: Index, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of finished tokens (their sizes) the runs that become one: first token, the token after it, entry; an entry's kind is its order.

    Entries are taken from the longest, then by order, then from the left.  One taken before is no shorter, so if it overlaps a span
    it covers the span's first character or its last.
    """
    end = np.cumsum(sizes)
    begin, total = end - sizes, len(lines.chars)
    begins, ends = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    begins[begin[sizes > 0]], ends[end[sizes > 0]] = True, True
    line = np.repeat(np.arange(len(lines.size)), lines.size)
    found = [np.zeros((3, 0), dtype=np.int64)]
    for n, at, keys, own in lines.keys(index.plain, index.own):
        whole = begins[at] & ends[at + n]
        at, keys = at[whole], keys[whole]

        def agrees(which: np.ndarray, rows: np.ndarray, n=n, at=at) -> np.ndarray:
            said = zip(at[which].tolist(), index.phrase.take(pa.array(rows)).to_pylist(), index.scope.take(pa.array(rows)).to_pylist(), strict=True)
            return np.array([lines.text[p : p + n] == phrase and scope == lines.scopes[line[p]] for p, phrase, scope in said], dtype=bool)

        row = index.find(keys, agrees)
        hit = row >= 0
        found.append(np.stack((at[hit], np.full(int(hit.sum()), n), row[hit])))
    at, size, row = np.concatenate(found, axis=1)
    order = np.array([-(1 << 63) if k is None else int(k) for k in index.kind.take(pa.array(row)).to_pylist()], dtype=np.int64)
    used, taken = np.zeros(total, dtype=bool), []
    rank = np.lexsort((at, order, -size))
    for k, a, b in zip(rank.tolist(), at[rank].tolist(), (at + size)[rank].tolist(), strict=True):
        if not (used[a] or used[b - 1]):
            used[a:b] = True
            taken.append(k)
    taken = np.array(taken, dtype=np.int64)
    taken = taken[np.argsort(at[taken])]
    first, last = np.searchsorted(begin, at[taken]), np.searchsorted(end, (at + size)[taken]) + 1
    return first, last, row[taken]
