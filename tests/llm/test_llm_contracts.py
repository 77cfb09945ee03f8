"""Registered queries against brute-force versions on a small table, and edge cases of the operators."""

import hashlib
import json
import math
import random
import re
import zlib

import pytest

from lexloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def removed(texts, size=50):
    """Brute force of the 50-word rule: n_words, n_removed, kept by document."""
    words = {d: WORD.findall(t) for d, t in texts.items()}
    least = {}
    for d, ws in words.items():
        for i in range(len(ws) - size + 1):
            key = tuple(ws[i : i + size])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - size + 1):
            if least[tuple(ws[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out[d] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def test_op1_is_brute_force(spark, texts):
    want = {d: (n, k, sha(kept)) for d, (n, k, kept) in removed(texts).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op1_substring_dedup(spark, SF).collect()}
    assert got == want


def test_op2_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    for r in Q.op2_bpe(spark, SF).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))


def test_op3_is_brute_force(spark, texts):
    groups = {}
    body = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t) for d, t in texts.items()}
    for d, b in body.items():
        groups.setdefault(b, []).append(d)
    for r in Q.op3_exact_dedup(spark, SF).collect():
        own = groups[body[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own), len(own), r["doc_id"] == min(own), sha(body[r["doc_id"]]))


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op5_quality(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.9


def test_op7_reads_back(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    talks = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: r["turn"]):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in Q.op7_chat_format(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for k, turns in talks.items():
        scored = "".join(t for role, t in turns if role == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(scored), sha(scored))


def plain_fingerprint(text):
    """Paragraphs, pieces of each, and every lane, one by one."""
    import struct

    import xxhash

    from lexloom.llm import fingerprint as P

    seed = lambda s: xxhash.xxh64(struct.pack("<i", s), seed=42).intdigest()
    lines = [p for p in text.split("\n") if p]
    cut = [p for line in lines for p in re.split(r"(?<=[.,;:!?aeosnd])[\x20\x09\x0B-\x0D]+", line) if p]
    bits = []
    for s in P._SEEDS:
        h = [xxhash.xxh64(p.encode(), seed=seed(s)).intdigest() for p in cut]
        bits += [sum(x >> (i + 21 * k) & 1 for x in h) for i in range(21) for k in range(3)]
    wide = []
    for s in P._WIDE_SEEDS:
        h = [xxhash.xxh64(p.encode(), seed=seed(s)).intdigest() for p in lines]
        wide += [sum(x & 0xFFFFFFFF for x in h) % 2**32, sum(x >> 32 for x in h) % 2**32]
    return wide, bits, len(lines), len(cut)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a[3] or not b[3]:
        return 0.0
    x, y = ([2 * v - f[3] for v in f[1]] for f in (a, b))
    dot = lambda p, q: sum(u * v for u, v in zip(p, q, strict=True))
    return max(0.0, min(1.0, dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5))


def test_op8_is_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in Q.op8_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    shown = lambda f: ":".join(["".join(f"{v:08x}" for v in f[0]), "".join(f"{v:08x}" for v in f[1]), str(f[2]), str(f[3])])
    known = {d: plain_fingerprint(texts[d]) for d in ids}
    better = 0
    for i, d in enumerate(ids):
        t, n = texts[d], ids[(i + 1) % len(ids)]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[n][:half]
        own, other = known[d], plain_fingerprint(edited)
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), sha(edited))
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (shown(own), shown(other))
        assert abs(got[d]["near_edited"] - plain_likeness(own, other)) < 1e-9 and abs(got[d]["near_next"] - plain_likeness(own, known[n])) < 1e-9
        better += got[d]["near_edited"] > got[d]["near_next"] or edited == t
    assert better > 0.9 * len(ids)


def test_fingerprints_add_and_subtract(spark):
    """Any order of paragraphs gives one fingerprint; paragraphs are inserted and deleted without the others."""
    from pyspark.sql import functions as F

    from lexloom.llm.fingerprint import add, as_text, fingerprints, subtract

    lines = [f"Line {k}, said once. And more e  \t" for k in range(9)] + ["", "  odd", "odd", "odd"]
    a, b = lines[:5] + ["odd"], lines[5:]
    rows = {"a": a, "b": b, "both": a + b, "mixed": (b + a)[::-1], "less": lines[:5], "none": []}
    found = fingerprints(spark.createDataFrame([(k, "\n".join(v)) for k, v in rows.items()], "id string, text string"), ["id"])
    one = found.groupBy().pivot("id", list(rows)).agg(F.first("lanes"))
    c = F.col
    got = one.select(as_text(c("both")).alias("both"), as_text(c("mixed")).alias("mixed"), as_text(add(c("a"), c("b"))).alias("sum"), as_text(subtract(c("both"), c("b"))).alias("rest"), as_text(c("a")).alias("a"), as_text(add(c("none"), c("a"))).alias("same"), as_text(c("less")).alias("less")).first()
    assert got["both"] == got["mixed"] == got["sum"] and got["rest"] == got["a"] == got["same"] != got["less"]
    assert got["less"] == ":".join(["".join(f"{v:08x}" for v in x) for x in plain_fingerprint("\n".join(lines[:5]))[:2]] + ["5", str(plain_fingerprint("\n".join(lines[:5]))[3])])


def test_op10_packs_all(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    rows = Q.op10_best_fit_packing(spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for d, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        own, at = sorted(by_doc[d], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start"] == at and (r["length"] == 1024 or r["piece"] == 0)
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
        total += at
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= math.ceil(total / 1024) * 1.02 + 1


def lower_split(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)), "\0end"]


def deleted_interpolation(train, rounds=100):
    """Plain version: p(words) for both models, weights by EM over single tokens, no grid of estimates."""
    from collections import Counter, defaultdict

    end = "\0end"
    grams = lambda ws: [(u, v, w) for u, v, w in zip([end, end, *ws], [end, *ws], ws)]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for ws in train:
        for u, v, w in grams(ws):
            c1[w] += 1
            c2[v, w] += 1
            c3[u, v, w] += 1
    n, size, docs = sum(c1.values()), len(c1), len(train)

    def counts(ws):
        for i, (u, v, w) in enumerate(grams(ws)):
            yield c1[w], c2[v, w], c3[u, v, w], c1[v] if i else docs, c2[u, v] if i else docs

    power = lambda c: c.bit_length()

    def em(cells, start):
        weights = defaultdict(lambda: list(start))
        for _ in range(rounds):
            sums = defaultdict(lambda: [0.0] * len(start))
            for (bucket, *p), k in cells.items():
                w = weights[bucket]
                share = [(0 if bucket == 0 and i == 0 else w[i]) * x for i, x in enumerate(p)]
                for i, x in enumerate(share):
                    sums[bucket][i] += k * x / sum(share)
            overall = [sum(v[i] for v in sums.values()) for i in range(len(start))]
            overall = [5 * x / sum(overall) for x in overall]
            weights = defaultdict(lambda: [x / 5 for x in overall])
            for bucket, v in [*sums.items(), *([] if 0 in sums else [(0, [0.0] * len(start))])]:
                v = [x + y for x, y in zip(v, overall)]
                v[0] = 0 if bucket == 0 else v[0]
                weights[bucket] = [x / sum(v) for x in v]
        return weights

    def low(k, own, pair, ctx, total):
        return k[0] * pair / max(ctx, 1) + k[1] * own / total + k[2] / (size + 1)

    cells = Counter()
    for ws in train:
        for own, pair, _, ctx, _ in counts(ws):
            cells[power(ctx - 1), (pair - 1) / max(ctx - 1, 1), (own - 1) / (n - 1), 1 / (size + 1)] += 1
    first = em(cells, [0.3, 0.6, 0.1])
    cells = Counter()
    for ws in train:
        for own, pair, triple, ctx, wide in counts(ws):
            cells[power(wide - 1), (triple - 1) / max(wide - 1, 1), low(first[power(ctx - 1)], own - 1, pair - 1, ctx - 1, n - 1)] += 1
    second = em(cells, [0.5, 0.5])

    def score(ws):
        both = [0.0, 0.0]
        for own, pair, triple, ctx, wide in counts(ws):
            p = low(first[power(ctx)], own, pair, ctx, n)
            k = second[power(wide)]
            both[0] += math.log10(p)
            both[1] += math.log10(k[0] * triple / max(wide, 1) + k[1] * p)
        return both

    return score


def test_op6_is_brute_force(spark, texts):
    from collections import Counter

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, t in texts.items() if not held[d] for w in lower_split(t))
    plain = deleted_interpolation([lower_split(t) for d, t in texts.items() if not held[d]])
    n, v = sum(count.values()), len(count)
    rows = Q.op6_lm_scores(spark, SF).collect()
    assert len(rows) == len(texts)
    sums = {False: [0.0] * 5, True: [0.0] * 5}
    for r in rows:
        tokens = lower_split(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), n)
        assert r["n_known"] == sum(count[w] > 0 for w in tokens)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        low, high = plain(tokens)
        assert abs(r["score"] - high) < 0.02 * len(tokens) + 0.2  # the grid of half octaves moves the weights a little
        sums[r["held_out"]] = [a + b for a, b in zip(sums[r["held_out"]], (r["base_score"], low, high, r["score"], len(tokens)))]
    for base, low, high, score, tokens in sums.values():
        assert base < low < high and low < score and abs(score - high) < 0.005 * tokens, sums


def test_lm_is_a_distribution():
    """Given any two words before, the model sums to one over the vocabulary and the unknown word."""
    from collections import Counter

    import numpy as np

    from lexloom.llm.lm import Counts, Model, deleted_cells, learn_weights

    words = [random.Random(d).choices("abcdefg", k=60) + ["end"] for d in range(8)]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for ws in words:
        for g in zip(["end", "end", *ws], ["end", *ws], ws):
            c1[g[2]] += 1
            c2[g[1:]] += 1
            c3[g] += 1
    model = Model(8.0, float(sum(c1.values())), float(len(c1)))
    of = lambda grams: [np.array(x, dtype=float) for x in zip(*((c1[g[2]], c2[g[1:]], c3[g]) for g in grams))]
    flat = [g for ws in words for g in zip(["end", "end", *ws], ["end", *ws], ws)]
    for level in ("low", "high"):
        cells = Counter(deleted_cells(model, Counts(np.array([61] * 8), *of(flat), 8.0)).tolist())
        w = learn_weights(model, dict(cells))
        assert abs(w.sum(axis=1) - 1).max() < 1e-9 and (w >= 0).all()
        setattr(model, level, w)
    for u, v in [("a", "b"), ("c", "c"), ("g", "unseen"), ("unseen", "a")]:
        total = 0.0
        for w in [*c1, "unseen"]:
            c = Counts(np.array([3]), *of([("end", "end", u), ("end", u, v), (u, v, w)]), 8.0)
            c.context[2], c.wide[2] = c1[v], c2[u, v]
            total += model.probability(c)[2]
        assert abs(total - 1) < 1e-9


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "exact", "near", "passages", "packing"]
    kept = P.exact(spark, docs, SF)
    body = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t) for d, t in texts.items()}
    least = {}
    for d, b in body.items():
        least[b] = min(least.get(b, d), d)
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    cut = {r["doc_id"]: r for r in P.passages(spark, docs, SF).collect()}
    want = removed(texts)
    assert set(cut) == {d for d, (n, k, _) in want.items() if not (k and k == n)}
    assert all(cut[d]["text"] == (want[d][2] if want[d][1] else texts[d]) for d in cut)
    assert cut and P.passages(spark, docs, SF).columns == docs.columns
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < len(texts)
