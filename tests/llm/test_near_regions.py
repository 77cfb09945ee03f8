"""Near copies in groups that are larger than the neighbours of the sorted orders."""

import random

from lexloom.llm.minhash import near_dedup


def test_star_of_copies(spark):
    """1000 copies whose only link is the one to their base."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    docs = {500: list(base)}
    for d in range(1, 1002):
        if d != 500:
            docs[d] = list(base)
            for k, at in enumerate(rng.sample(range(3, 296), 7)):
                docs[d][at] = f"e{d}x{k}"
    sets = {d: {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} for d, ws in docs.items()}
    ids, reach = sorted(docs), {d: d for d in docs}

    def root(d):
        while reach[d] != d:
            d = reach[d]
        return d

    for a in ids:
        for b in ids:
            if a < b:
                k = len(sets[a] & sets[b])
                if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((root(a), root(b)))
                    reach[y] = x
    want = {d: root(d) for d in ids}
    assert len(set(want.values())) < 20
    rows = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup(rows, size=3, percent=85).collect()} == want
