"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for all operators and stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexloom.llm import queries as Q
from lexloom.llm.chat import format_replies, read_back
from lexloom.llm.exact import exact_dedup
from lexloom.llm.minhash import near_dedup
from lexloom.llm.packing import plan_bins
from lexloom.llm.quality import fit_quality, score_quality
from lexloom.llm.substring import substring_dedup
from lexloom.llm.suffixes import suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"long{i % 997}" for i in range(30_000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    talk = " ".join(f"t{i}" for i in range(80))
    rows = [(1, talk), (1, talk), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, LONG), (None, talk + " end"), (None, None), (7, "Mixed CASE words"), (8, "mixed case words"), (9, "é" * 3000)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).coalesce(1).write.parquet(f"{at}/full/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/full/labels.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (2, 1, None, "x"), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/full/conversations.parquet")
    for name in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{at}/full/{name}.parquet").limit(0).write.parquet(f"{at}/none/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_on_edges_and_empty_tables(spark, folder, name):
    full = Q.queries()[name](spark, f"{folder}/full").collect()
    assert full
    if name not in ("op7_chat_format", "op10_best_fit_packing", "op11_filter_audit"):
        assert len(full) == 12
    assert len(Q.queries()[name](spark, f"{folder}/none").collect()) == (1 if name == "op7_chat_format" else 0)


def _rows(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/full/documents.parquet").collect()]


def test_values_of_tokenising_on_edges(spark, folder):
    import hashlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(d, t.encode(x, add_special_tokens=False).ids) for d, x in _rows(spark, folder)]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.op2_bpe(spark, f"{folder}/full").collect())
    assert got == sorted((str(d), len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in ids)
    packed = Q.op10_best_fit_packing(spark, f"{folder}/full").collect()
    length = lambda rows: sorted((str(d), n) for d, n in rows)
    whole = {}
    for r in packed:
        whole[r["sequence_id"]] = whole.get(r["sequence_id"], 0) + r["length"]
    assert max(whole.values()) <= 1024 and sum(whole.values()) == sum(len(i) + 1 for _, i in ids)
    pieces = [(d, n) for d, i in ids for n in [(len(i) + 1) - 1024 * (-(-(len(i) + 1) // 1024) - 1), *[1024] * (-(-(len(i) + 1) // 1024) - 1)]]
    assert length((r["doc_id"], r["length"]) for r in packed) == length(pieces)


def test_values_of_near_copies_and_fingerprints_on_edges(spark, folder):
    from test_llm_contracts import plain_fingerprint

    rows = _rows(spark, folder)
    words = lambda t: t.translate({c: c + 32 for c in range(65, 91)}).split()
    sets = [(d, {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())) for d, w in ((d, words(t)) for d, t in rows)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in Q.op4_minhash_forest(spark, f"{folder}/full").collect())
    linked = lambda a, b: bool(a | b) and 100 * len(a & b) >= 85 * len(a | b)
    # a null id is last; a row with words reaches what its text is like, one without reaches nothing
    least = lambda d, s: min([str(d), *[str(e) for e, r in sets if e is not None and linked(s, r)]], key=lambda x: (x == "None", int(x) if x != "None" else 0))
    assert got == sorted((str(d), len(s), least(d, s)) for d, s in sets)
    prints = sorted((str(r["doc_id"]), r["n_chars"], r["fingerprint"].split(":")[0], r["fingerprint"].split(":")[2]) for r in Q.op8_fingerprints(spark, f"{folder}/full").collect())
    assert prints == sorted((str(d), len(t), "".join(f"{v:08x}" for v in plain_fingerprint(t)[0]), str(plain_fingerprint(t)[2])) for d, t in rows)


def test_scores_on_edges(spark, folder):
    """Rows with one text have one score; without words only the end is scored."""
    for name in ("op5_quality", "op6_lm_scores"):
        got = Q.queries()[name](spark, f"{folder}/full").collect()
        by = {r["doc_id"]: r for r in got}
        assert by[2]["score"] == by[3]["score"] and by[5]["score"] == by[6]["score"] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1, name
        if name == "op6_lm_scores":
            assert [by[d]["n_tokens"] for d in (2, 3, 4, 7)] == [1, 1, 1, 4] and all(r["score"] < 0 for r in got)
        else:
            assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_other_vocabulary_files_are_refused(tmp_path):
    import json
    from pathlib import Path

    from lexloom.llm.bpe import ByteBPE

    spec = json.loads(Path(Q.vocabulary()).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "odd.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            ByteBPE(str(tmp_path / "odd.json"))


def test_pipeline_on_empty_tables_and_labels(spark, folder):
    assert P.run(spark, f"{folder}/none").count() == 0
    assert P.run(spark, f"{folder}/full").count() > 0


def test_stages_keep_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    names = ["score", "kept", "_kept", "_row", "own", "spans", "locator", "_text", "_gone", "_path", "_at", "_slot", "a.b"]
    for c in names:
        docs = docs.withColumn(c, F.lit("z"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, f"{folder}/full")
        assert out.columns == docs.columns, name
        assert {r["score"] for r in out.collect()} == {"z"}, name


def test_equal_rows_of_one_id_are_copies(spark, folder):
    rows = spark.read.parquet(f"{folder}/full/documents.parquet")
    assert sum(r["kept"] for r in exact_dedup(rows).where("doc_id = 1").collect()) == 1
    assert P.exact(spark, rows, "").where("doc_id = 1").count() == 1


def test_passages_of_periodic_texts(spark):
    """Suffixes against windows, where phrases repeat inside texts and grams are split over parts."""
    rng = random.Random(3)
    parts = [lambda: " ".join(["a b c"] * rng.randint(5, 60)), lambda: " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 60))), lambda: " ".join(f"s{i}" for i in range(rng.randint(30, 80)))]
    docs = spark.createDataFrame([(d, " ".join(rng.choice(parts)() for _ in range(rng.randint(1, 4)))) for d in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup(docs).collect()))
    for hot in (50_000, 3):
        assert sorted(map(tuple, suffix_dedup(docs, hot_rows=hot).collect())) == want


def test_near_components_are_brute_force(spark):
    rng = random.Random(9)
    texts = {}
    for d in range(0, 300):
        if d % 3 and texts:
            words = texts[rng.choice(list(texts))].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
        else:
            words = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(60, 120))]
        texts[d] = " ".join(words)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in texts:
        for b in texts:
            k = len(sets[a] & sets[b])
            if a < b and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup(docs).collect()} == {d: root(d) for d in texts}


def test_branches_are_ranked(spark):
    """A bushy tree, a missing parent and a cycle."""
    rows = [("t", "r", None, 1.0), ("t", "a", "r", 5.0), ("t", "b", "r", 1.0), ("t", "c", "b", 9.0), ("t", "d", "b", None), ("u", "x", "gone", 0.0), ("v", "p", "q", 0.0), ("v", "q", "p", 0.0)]
    messages = spark.createDataFrame([(t, n, p, "user", n.upper(), s) for t, n, p, s in rows], "tree string, node string, parent string, role string, text string, score double")
    said = lambda k: sorted((r["tree"], "".join(x["text"] for x in r["turns"])) for r in format_replies(messages, k).select("tree", read_back(F.col("formatted")).alias("turns")).collect())
    assert said(1) == [("t", "RBC"), ("u", "X")]
    assert said(2) == [("t", "RA"), ("t", "RBC"), ("u", "X")]
    assert said(9) == [("t", "RA"), ("t", "RBC"), ("t", "RBD"), ("u", "X")]


def test_reductions_lose_no_bin():
    """Patterns hold every item once, and are as few as an exhaustive search finds on small cases."""
    from functools import lru_cache

    rng = random.Random(2)
    for _ in range(60):
        items = tuple(sorted((rng.randint(2, 10) for _ in range(rng.randint(1, 8))), reverse=True))

        @lru_cache(None)
        def least(left, room):
            if not left:
                return 0
            best = 99
            for i, x in enumerate(left):
                if i and left[i - 1] == x:
                    continue
                rest = left[:i] + left[i + 1 :]
                best = min(best, least(rest, room - x) if x <= room else 1 + least(rest, 10 - x))
            return best

        bins = plan_bins({x: items.count(x) for x in set(items)}, 10)
        held = sorted((x for p, n in bins for x in p * n), reverse=True)
        assert held == list(items) and all(sum(p) <= 10 for p, _ in bins)
        assert sum(n for _, n in bins) <= least(items, 0) + 1


def test_even_score_without_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, labels)).collect()} == {0.5}
