"""Large groups of near copies, whose parts are joined without all pairs of them."""

import random

from graywacke.llm import minhash


def test_parts_of_one_group_do_not_meet_pair_by_pair(spark, monkeypatch):
    rng, n = random.Random(4), 160
    first = [f"w{k}" for k in range(120)]
    texts = [" ".join(f"x{i}-{k}" if k in changed else w for k, w in enumerate(first)) for i in range(n) for changed in [set(rng.sample(range(120), rng.randrange(4)))]]
    texts += [" ".join(f"{g}-{k // 2 if i else k}" for k in range(40)) for g in "pq" for i in range(2)]
    listed, across = [], minhash.across

    def counted(*args):
        pairs = across(*args)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "across", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, turns=0).collect()}
    sets = [set(s.tolist()) for s in minhash.sets(texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert found == dict(enumerate(root)) and len(set(root[:n])) < n / 4
    assert sum(listed) < 4 * n
