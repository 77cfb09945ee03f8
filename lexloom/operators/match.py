"""Greedy leftmost-longest matching of a phrase lexicon, and the passes over its tokens.

A lexicon has phrase, value, kind and prio (1 override, 2 name, 3 pronoun, 4 word), and cap where entries have a style.  At each
position the longest phrase wins, at equal length the lowest prio; what no phrase covers
is a token of one character: `hanviet_fallback` with a reading, else `unmatched`.

A lexicon (with layers) of at most `max_entries` reaches workers as one sorted Arrow table, inside a broadcast
while it is small, else as a file that Spark hands to every machine once and all its workers map.  Beyond that
nothing is sent to all workers: rows form chunks, the windows of each chunk that may be phrases (first
character and length, and a bitmap of hashes) are joined with the entries by hash, and each chunk is matched with
what it has fetched.  Both give the same tokens.  Rows are
dealt over all cores first.  Tokens stay in an array for each line, so the later passes need no shuffle.
"""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.scratch import dealt, materialize, spread
from . import phrases as P

_KINDS = {"pos": "int", "len": "int", "source": "string", "src": "string", "dst": "string", "raw": "string", "reading": "string", "cap": "string", "opens": "boolean", "space": "boolean"}
FIELDS = tuple(_KINDS)
#: What translation and the passes over its tokens need.
SHOWN = ("source", "src", "dst", "cap", "opens", "space")
#: The index that a worker used last, and on the driver what has been sent already.
_INDEXES: dict[str, P.Index] = {}
_SENT: dict[tuple, tuple] = {}
#: Entries up to which an index travels inside a broadcast, characters of a slice, rows of a chunk, and bits of the bitmap at most.
_SMALL, _SLICE, _CHUNK_BITS, _MAP_BITS = 50_000, 1 << 18, 6, 27


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), text of every line; null text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))


def scan_window(lexicon: DataFrame) -> int:
    """The longest phrase that is looked for; pronouns don't widen the window."""
    return lexicon.where("kind <> 'pronoun'").agg(F.max(F.length("phrase"))).first()[0] or 0


def best_entries(lexicon: DataFrame, window: int | None = None) -> DataFrame:
    """One entry a phrase, the lowest prio first, no longer than the window: phrase, kind, value, cap."""
    window = scan_window(lexicon) if window is None else window
    cap = F.col("cap") if "cap" in lexicon.columns else F.lit(None).cast("string")
    fits = lexicon.where((F.length("phrase") <= window) & (F.col("phrase") != ""))
    best = fits.groupBy("phrase").agg(F.min(F.struct("prio", "kind", "value", cap.alias("cap"))).alias("e"))
    return best.select("phrase", F.when(F.col("e.prio") == 1, "name").otherwise(F.col("e.kind")).alias("kind"), F.col("e.value").alias("value"), F.when(F.col("e.prio") == 1, F.col("e.cap")).alias("cap"))


def first_alternative(value: str) -> str:
    return value.split("/", 1)[0]


def all_entries(lexicon: DataFrame, layers: DataFrame | None, window: int | None) -> DataFrame:
    """scope (null: of the lexicon), phrase, kind, value, cap."""
    out = best_entries(lexicon, window).select(F.lit(None).cast("string").alias("scope"), "phrase", "kind", "value", "cap")
    if layers is None:
        return out
    own = layers.where("phrase <> '' AND scope IS NOT NULL").select(F.col("scope").cast("string").alias("scope"), "phrase", F.lit("name").alias("kind"), "value", "cap")
    return out.unionByName(own)


def _known_readings(readings: DataFrame) -> list[tuple[str, str]]:
    """One reading a character, so at most as many as there are code points."""
    return [tuple(r) for r in readings.where("length(ch) = 1").groupBy("ch").agg(F.min("readings")).collect()]


def _file_of(data: bytes) -> str:
    """Hand a file to all machines; its name there."""
    at = tempfile.NamedTemporaryFile(prefix="index-", suffix=".arrow", delete=False)  # noqa: SIM115
    with at:
        at.write(data)
    atexit.register(lambda: os.path.exists(at.name) and os.unlink(at.name))
    return at.name


def _sent_index(entries: DataFrame, readings: DataFrame, pick: Callable[[str], str], n: int, mark: tuple):
    """A broadcast of what a worker needs to open the index; sent once for equal entries, readings and pick."""
    sc = entries.sparkSession.sparkContext
    rows = _known_readings(readings)
    chosen = cloudpickle.dumps(pick)
    key = (sc.applicationId, mark, tuple(sorted(rows)), chosen)
    if key not in _SENT:
        table = entries.select("scope", "phrase", "kind", "value", "cap").toArrow().cast(P.ENTRY)
        table, plain, own = P.entry_table(table, pick)
        data, name = P.packed(table), None
        if n > _SMALL:
            path = _file_of(data)
            sc.addFile(path)
            data, name = None, os.path.basename(path)
        _SENT.clear()  # one lexicon at a time: what is sent stays with the workers, not here
        _SENT[key] = (uuid4().hex, sc.broadcast((name, data, plain, own, rows, chosen)))
    return _SENT[key]


def _opened(key: str, sent) -> P.Index:
    if key not in _INDEXES:
        name, data, plain, own, rows, pick = sent.value
        source = pa.memory_map(SparkFiles.get(name)) if name else pa.BufferReader(data)
        _INDEXES.clear()
        _INDEXES[key] = P.Index(pa.ipc.open_file(source).read_all(), plain, own, P.Readings(rows, cloudpickle.loads(pick)))
    return _INDEXES[key]


class _Matcher:
    """Adds columns made of their tokens to Arrow batches of rows with a `text`."""

    def __init__(self, lines: DataFrame, scope_col: str | None, by_line: bool, pick: Callable[[str], str], added: list[T.StructField]):
        names = lines.columns
        for f in added:
            if f.name in names:
                raise ValueError(f"rows have a column `{f.name}` already")
        self.schema = T.StructType([*lines.schema.fields, *added])
        self.place, self.scope_at = names.index("text"), names.index(scope_col) if scope_col else None
        self.by_line, self.pick, self.added = by_line, pick, [f.name for f in added]

    def sizes(self, batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.utf8_length(batch.column(self.place)), 0).to_numpy(zero_copy_only=False)

    def slices(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of a batch with about as many characters as a slice may have."""
        ends = np.cumsum(self.sizes(batch) + 1)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _SLICE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

    def rows(self, part: pa.RecordBatch) -> tuple[list[str], list[str | None], list[int] | None]:
        """Lines (blank ones empty where texts are split), their scopes, and the number of lines of each row."""
        texts = [t or "" for t in part.column(self.place).to_pylist()]
        scopes = part.column(self.scope_at).cast(pa.string()).to_pylist() if self.scope_at is not None else [None] * len(texts)
        if not self.by_line:
            return texts, scopes, None
        split = [t.split("\n") for t in texts]
        lines = ["" if P.is_blank(x) else x for r in split for x in r]
        return lines, [s for r, s in zip(split, scopes, strict=True) for _ in r], [len(r) for r in split]

    def made(self, lines: list[str], scopes: list[str | None], index: P.Index) -> list[pa.Array]:
        """The added columns, a value for each line."""
        raise NotImplementedError

    def of_rows(self, values: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Values of lines as values of rows."""
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def matched(self, part: pa.RecordBatch, index: P.Index) -> pa.RecordBatch:
        lines, scopes, counts = self.rows(part)
        made = self.made(lines, scopes, index)
        if counts is not None:
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            made = [self.of_rows(v, offsets) for v in made]
        return pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *self.added])


class _Tokens(_Matcher):
    """Adds `tokens`."""

    def __init__(self, lines: DataFrame, scope_col: str | None, fields: tuple[str, ...], by_line: bool, pick: Callable[[str], str]):
        token = T._parse_datatype_string("array<struct<" + ", ".join(f"{f}: {_KINDS[f]}" for f in fields) + ">>")
        super().__init__(lines, scope_col, by_line, pick, [T.StructField("tokens", T.ArrayType(token) if by_line else token)])
        self.fields = fields

    def made(self, lines, scopes, index):
        offsets, columns = P.token_columns(lines, scopes, index, self.fields, self.pick)
        values = pa.StructArray.from_arrays([columns[f] for f in self.fields], names=list(self.fields))
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)]


class _Texts(_Matcher):
    """Adds columns that functions of the tokens make, so tokens themselves never leave the worker; texts of lines become texts of rows with newlines."""

    def __init__(self, lines: DataFrame, scope_col: str | None, by_line: bool, pick: Callable[[str], str], makers: dict[str, tuple[str, Callable[[P.Tokens], pa.Array]]]):
        super().__init__(lines, scope_col, by_line, pick, [T.StructField(n, T._parse_datatype_string(kind)) for n, (kind, _) in makers.items()])
        self.makers = [make for _, make in makers.values()]

    def made(self, lines, scopes, index):
        tokens = P.Tokens(lines, scopes, index, self.pick)
        return [make(tokens) for make in self.makers]

    def of_rows(self, values, offsets):
        return pc.binary_join(super().of_rows(values, offsets), "\n")


class _Overlay(_Matcher):
    """Replaces `tokens` by those with entries of the row's scope laid over them; an entry's kind is its order."""

    FIELDS = ("pos", "len", "src", "dst", "source", "reading")

    def __init__(self, lines: DataFrame, scope_col: str, pick: Callable[[str], str]):
        token = T._parse_datatype_string("array<struct<" + ", ".join(f"{f}: {_KINDS[f]}" for f in self.FIELDS) + ">>")
        self.schema = T.StructType([T.StructField("tokens", token) if f.name == "tokens" else f for f in lines.schema.fields])
        self.place, self.scope_at, self.pick = lines.columns.index("tokens"), lines.columns.index(scope_col), pick

    def sizes(self, batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(batch.column(self.place)), 0).to_numpy(zero_copy_only=False)

    def _src(self, part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        """The texts of all tokens, and where lines begin in them."""
        tokens = part.column(self.place)
        return tokens.flatten().field("src"), np.concatenate(([0], np.cumsum(self.sizes(part))))

    def rows(self, part: pa.RecordBatch) -> tuple[list[str], list[str | None], None]:
        return P.glued(*self._src(part)).to_pylist(), part.column(self.scope_at).cast(pa.string()).to_pylist(), None

    def matched(self, part: pa.RecordBatch, index: P.Index) -> pa.RecordBatch:
        src, offsets = self._src(part)
        tokens, (texts, scopes, _) = part.column(self.place), self.rows(part)
        given = {f: tokens.flatten().field(f) for f in self.FIELDS}
        lines = P.Lines(texts, scopes)
        first, last, entry = P.laid_spans(lines, index, pc.utf8_length(src).to_numpy(zero_copy_only=False))
        step = np.zeros(len(src) + 1, dtype=np.int64)
        step[first + 1] += 1
        step[last] -= 1
        kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
        laid = np.full(len(src), -1, dtype=np.int64)
        laid[first] = np.arange(len(first))
        laid = laid[kept]
        row = pa.array(entry)
        shown = [P.styled(v, cap) if v is not None else None for v, cap in zip(index.dst.take(row).to_pylist(), index.cap.take(row).to_pylist(), strict=True)]
        said = [" ".join(r for r in given["reading"].slice(a, b - a).to_pylist() if r is not None) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        phrase = index.phrase.take(row)
        new = {"len": pc.utf8_length(phrase).cast(pa.int32()), "src": phrase, "dst": pa.array(shown, pa.string()), "source": pa.array(["name"] * len(first), pa.string()), "reading": pa.array(said, pa.string())}
        which, over = pa.array(laid, mask=laid < 0), pa.array(laid >= 0)
        columns = [pc.if_else(over, new[f].take(which), given[f].take(pa.array(kept))) if f in new else given[f].take(pa.array(kept)) for f in self.FIELDS]
        cuts = np.searchsorted(kept, offsets).astype(np.int32)
        done = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(columns, names=list(self.FIELDS)), mask=pc.is_null(tokens))
        return pa.RecordBatch.from_arrays([done if k == self.place else c for k, c in enumerate(part.columns)], names=part.schema.names)


def tokenize(
    lines: DataFrame, lexicon: DataFrame, readings: DataFrame, max_scan_len: int | None = None, pick: Callable[[str], str] = first_alternative, max_entries: int = 3_000_000,
    layers: DataFrame | None = None, scope_col: str | None = None, fields: tuple[str, ...] = FIELDS, by_line: bool = False,
) -> DataFrame:
    """Adds `tokens` (an array of structs of `fields`) to lines (a column `text`; other columns stay, but none may be called tokens).

    layers: scope, phrase, value, cap; a row of lines sees those of its `scope_col` only, before the lexicon at each length.
    With `by_line` the text is split at newlines, and `tokens` has an array for each line (a blank one has none).
    Null texts are empty.  More than `max_entries` entries are joined instead of sent (not for streams).
    """
    return _applied(_Tokens(lines, scope_col, fields, by_line, pick), lines, all_entries(lexicon, layers, max_scan_len), readings, max_entries)


def _applied(matcher: _Matcher, lines: DataFrame, entries: DataFrame, readings: DataFrame, max_entries: int = 3_000_000, deal: Callable[[DataFrame], DataFrame] = dealt) -> DataFrame:
    """The rows of a matcher; entries (scope, phrase, kind, value, cap) are sent, or joined where there are more than `max_entries`."""
    own = F.struct("scope", "phrase", "kind", "value", "cap")
    n, *mark = entries.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), own).cast("decimal(38,0)")) for k in (1, 2)]).first()
    if n > max_entries:
        if lines.isStreaming:
            raise ValueError(f"{n} entries are too many for a stream")
        return _tokenize_chunks(deal(lines), entries, readings, matcher)
    key, sent = _sent_index(entries, readings, matcher.pick, n, (n, *mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(key, sent)
        for batch in batches:
            for part in matcher.slices(batch):
                yield matcher.matched(part, index)

    return deal(lines).mapInArrow(run, matcher.schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, first, size = P.phrase_keys(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], names=[*batch.schema.names, "key", "first", "len"])


def _starts(entries: DataFrame, own: bool) -> P.Starts:
    """Distinct first characters and lengths: at most code points times the longest phrase, whatever the number of entries."""
    pairs = entries.where(F.col("scope").isNotNull() if own else F.col("scope").isNull()).select("first", "len").distinct().toArrow()
    return P.Starts.of(pairs["first"].to_numpy().astype(np.uint32), pairs["len"].to_numpy().astype(np.int64))


def _bitmap(entries: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits (16 MB at most), those of the entries' keys set."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    pages = entries.groupBy(F.shiftright(slot, 15).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in pages:
        out[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _tokenize_chunks(lines: DataFrame, entries: DataFrame, readings: DataFrame, matcher: _Matcher) -> DataFrame:
    """The tokens of lines, with as many entries as there may be: none but those that occur in a chunk of rows come to it.

    A phrase that is everywhere is asked for once a chunk; these are narrow rows of two plain tables, so
    adaptive execution splits them.
    """
    spark = lines.sparkSession
    keyed = materialize(entries.mapInArrow(_hashed, "scope string, phrase string, kind string, value string, cap string, key long, first int, len int"), "entries")
    n = keyed.count()
    bits = min(_MAP_BITS, max(15, (16 * n).bit_length()))
    sent = spark.sparkContext.broadcast((_starts(keyed, False), _starts(keyed, True), _bitmap(keyed, bits)))
    known = spark.sparkContext.broadcast(_known_readings(readings))
    rows = materialize(lines.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), _CHUNK_BITS)), "chunks")
    pick = matcher.pick

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, own, bitmap = sent.value
        shift = np.uint64(64 - bits)
        for batch in batches:
            chunk = batch.column(batch.num_columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for part in matcher.slices(batch.slice(a, b - a)):
                    texts, scopes, _ = matcher.rows(part)
                    found = [np.zeros(0, dtype=np.uint64)]
                    for _, _, keys, _ in P.Lines(texts, scopes).keys(plain, own):
                        slot = keys >> shift
                        found.append(np.unique(keys[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]))
                    keys = np.unique(np.concatenate(found))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk[a])), pa.array(keys.view(np.int64))], names=["_chunk", "key"])

    asked = materialize(rows.mapInArrow(wanted, "_chunk long, key long"), "asked")  # a key twice in a chunk does no harm
    fetched = asked.join(keyed, "key").select("_chunk", "scope", "phrase", "kind", "value", "cap")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, plain, own = P.entry_table(right.select(P.ENTRY.names).cast(P.ENTRY), pick)
        index = P.Index(table, plain, own, P.Readings(known.value, pick))
        own_rows = left.drop_columns(["_chunk"]).combine_chunks()
        done = [matcher.matched(part, index) for batch in own_rows.to_batches() for part in matcher.slices(batch)]
        return pa.Table.from_batches(done) if done else None

    return rows.groupBy("_chunk").cogroup(fetched.groupBy("_chunk")).applyInArrow(run, matcher.schema)


def match_by_join(lines: DataFrame, lexicon: DataFrame, keys: list[str], max_scan_len: int | None = None) -> DataFrame:
    """The matches alone, by joins: keys, pos, len, kind, phrase, value.  For lexicons too large to broadcast.

    Positions x lengths are joined with the lexicon by phrase; a fold over each line's
    candidates, longest first at a position, takes those that begin after the last one taken.
    """
    entries = best_entries(lexicon, max_scan_len)
    lengths = sorted(r[0] for r in entries.select(F.length("phrase")).distinct().collect())  # at most the window
    spots = lines.where(F.length("text") > 0).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda p: F.substring("text", p, F.lit(max(lengths, default=1))))).alias("pos", "ahead"))
    tries = spots.select(*keys, "pos", F.explode(F.array(*[F.when(F.length("ahead") >= n, F.substring("ahead", 1, n)) for n in lengths])).alias("phrase")).where("phrase IS NOT NULL")
    best = tries.join(entries, "phrase").groupBy(*keys, "pos").agg(F.max(F.struct(F.length("phrase").alias("len"), "kind", "phrase", "value")).alias("m"))
    gathered = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("all"))
    start = F.struct(F.lit(0).alias("next"), F.filter("all", lambda x: F.lit(False)).alias("taken"))
    fold = F.aggregate("all", start, lambda s, x: F.when(x["pos"] >= s["next"], F.struct((x["pos"] + x["m"]["len"]).alias("next"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s))
    kept = gathered.select(*keys, F.explode(fold["taken"]).alias("x"))
    return kept.select(*keys, "x.pos", "x.m.len", "x.m.kind", "x.m.phrase", "x.m.value")


def displayed(tokens: Column) -> Column:
    """The shown text of each token: narrow marks, then the cap style that came with a layer's entry, then sentence capitals."""

    def one(t):
        dst = X.apply_cap_style(X.narrow_punct(t["src"], t["dst"]), F.coalesce(F.when(t["source"] == "name", t["cap"]), F.lit("NONE")))
        return F.struct(F.when(t["opens"], X.capitalize_first(dst)).otherwise(dst).alias("dst"), t["space"].alias("space"))

    return F.transform(tokens, one)


def joined(shown: Column) -> Column:
    """Shown tokens with natural spaces between them."""
    return F.array_join(F.transform(shown, lambda t: F.concat(t["dst"], F.when(t["space"], " ").otherwise(""))), "")


def _texts(lines: DataFrame, lexicon: DataFrame, readings: DataFrame, makers: dict, layers: DataFrame | None = None, scope_col: str | None = None, by_line: bool = False, max_entries: int = 3_000_000) -> DataFrame:
    return _applied(_Texts(lines, scope_col, by_line, first_alternative, makers), lines, all_entries(lexicon, layers, None), readings, max_entries)


def translate_text(docs: DataFrame, lexicon: DataFrame, readings: DataFrame, layers: DataFrame | None = None, scope_col: str | None = None, max_entries: int = 3_000_000) -> DataFrame:
    """docs and `translated`: every line of `text`, with natural spaces, lines kept as they are; no shuffle."""
    return _texts(docs, lexicon, readings, {"translated": ("string", P.Tokens.shown)}, layers, scope_col, True, max_entries)


def translate_lines(lines: DataFrame, lexicon: DataFrame, readings: DataFrame, layers: DataFrame | None = None, scope_col: str | None = None, max_entries: int = 3_000_000) -> DataFrame:
    """lines and `translated`: the tokens of `text` as displayed() and joined() make them, blank lines too."""
    return _texts(lines, lexicon, readings, {"translated": ("string", P.Tokens.shown)}, layers, scope_col, False, max_entries)


def reading_of_text(docs: DataFrame, lexicon: DataFrame, readings: DataFrame, layers: DataFrame | None = None, scope_col: str | None = None) -> DataFrame:
    """docs and `reading`: of every line the readings of its tokens, joined by spaces; lines stay lines, blank ones are empty.

    A token's reading is that of its characters, one by one, so neither lexicon nor layers change it and nothing is matched.
    """
    matcher = _Texts(docs, scope_col, True, first_alternative, {"reading": ("string", None)})
    sent = docs.sparkSession.sparkContext.broadcast(_known_readings(readings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = P.Readings(sent.value, matcher.pick)
        for batch in batches:
            for part in matcher.slices(batch):
                lines, _, counts = matcher.rows(part)
                done = matcher.of_rows(P.readings_of(lines, read), np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, done], names=matcher.schema.names)

    return dealt(docs).mapInArrow(run, matcher.schema)


def tokenize_raw(docs: DataFrame, lexicon: DataFrame, readings: DataFrame) -> DataFrame:
    """docs and `shown`: tokens of the whole text, a newline being one, joined by spaces without any pass."""
    return joined_fields(docs, lexicon, readings, {"shown": "dst"}, " ")


def joined_fields(lines: DataFrame, lexicon: DataFrame, readings: DataFrame, fields: dict[str, str], between: str, count: str | None = None) -> DataFrame:
    """lines and, for each name of `fields`, that field (source, src, dst or raw) of all tokens with `between` between them; with `count` their number under that name."""
    makers = {name: ("string", lambda t, f=f: t.joined(f, between)) for name, f in fields.items()}
    if count:
        makers[count] = ("long", lambda t: pa.array(t.count))
    return _texts(lines, lexicon, readings, makers)


def laid_over(lines: DataFrame, entries: DataFrame, scope_col: str, max_entries: int = 3_000_000) -> DataFrame:
    """lines with entries (scope, phrase, kind: their order, value, cap; one a phrase of a scope) laid over their `tokens`; see sites.overlay_personal."""
    none = lines.sparkSession.createDataFrame([], "ch string, readings string")
    return _applied(_Overlay(lines, scope_col, first_alternative), lines, entries, none, max_entries, spread)  # rows were dealt as lines; tokens weigh much more


def coverage(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and characters by source."""
    flat = tokens.select(*by, F.explode("tokens").alias("t"))
    return flat.groupBy(*by, F.col("t.source").alias("source")).agg(F.count("*").alias("n_tokens"), F.sum(F.col("t.len").cast("long")).alias("n_chars"))


def candidate_names(tokens: DataFrame, by: list[str], line_keys: list[str], cls: str = X.HAN, min_occurrences: int = 2, min_length: int = 2, max_results: int = 30) -> DataFrame:
    """Maximal runs of fallback tokens in a line that hold a character of the class: text, reading, occurrences, suggested.

    The most frequent first, then the longest, then by first place.
    """
    return rank_names(_runs_of(tokens, line_keys), by, line_keys, cls, min_occurrences, min_length, max_results)


def fallback_runs(lines: DataFrame, lexicon: DataFrame, readings: DataFrame, line_keys: list[str], max_entries: int = 3_000_000) -> DataFrame:
    """The longest runs of fallback tokens of each line: line_keys, k (the place of their first token), text, reading."""
    own = lines.select(*line_keys, "text")
    out = _texts(own, lexicon, readings, {"_runs": ("array<struct<k: int, text: string, reading: string>>", P.Tokens.fallback_runs)}, max_entries=max_entries)
    return out.select(*line_keys, F.inline("_runs"))


def _runs_of(tokens: DataFrame, line_keys: list[str]) -> DataFrame:
    """The same of tokens that are there already; a line's runs come from its own array, so nothing is shuffled."""
    ours = F.transform("tokens", lambda t: t["source"] == "hanviet_fallback")
    at = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get(F.col("_ours"), i))
    rows = tokens.where(F.size("tokens") > 0).select(*line_keys, "tokens", ours.alias("_ours")).select(*line_keys, "tokens", "_ours", at.alias("_at"))
    starts = F.filter("_at", lambda i: (i == 0) | ~F.coalesce(F.get(F.col("_ours"), i - 1), F.lit(False)))
    ends = F.filter("_at", lambda i: ~F.coalesce(F.get(F.col("_ours"), i + 1), F.lit(False)))
    cuts = rows.select(*line_keys, "tokens", F.inline(F.arrays_zip(starts.alias("k"), ends.alias("to"))))
    part = F.slice("tokens", F.col("k") + 1, F.col("to") - F.col("k") + 1)
    glue = lambda f, between: F.array_join(F.transform(part, lambda t: t[f]), between)
    return cuts.select(*line_keys, "k", glue("src", "").alias("text"), glue("dst", " ").alias("reading"))


def rank_names(runs: DataFrame, by: list[str], line_keys: list[str], cls: str = X.HAN, min_occurrences: int = 2, min_length: int = 2, max_results: int = 30) -> DataFrame:
    """Of runs (line_keys, k, text, reading) the candidates of candidate_names()."""
    from pyspark.sql.window import Window

    seen = runs.where((F.length("text") >= min_length) & F.col("text").rlike(cls))
    place = F.struct(*line_keys, "k")
    counted = seen.groupBy(*by, "text").agg(F.count("*").alias("occurrences"), F.min(place).alias("first"), F.min_by("reading", place).alias("reading"))
    top = Window.partitionBy(*by).orderBy(F.desc("occurrences"), F.desc(F.length("text")), "first")
    kept = counted.where(F.col("occurrences") >= min_occurrences).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max_results)
    return kept.select(*by, "text", "reading", "occurrences", X.capitalize_syllables(F.col("reading")).alias("suggested"), "rank")
