"""Refs of a batch that share keys: rounds run on the heads of their stars."""

import random

from chronofact.operators import batch


def test_refs_of_one_star_take_no_part_in_rounds(spark, monkeypatch):
    r = random.Random(6)
    held = {f"r{i:04d}": {f"k{r.randrange(60)}" for _ in range(1 if i % 9 else 2)} for i in range(700)}
    members = {}
    for ref, keys in held.items():
        for k in keys:
            members.setdefault(k, []).append(ref)
    stars = [(ref, min(members[k])) for ref, keys in held.items() for k in keys]
    pairs = [(min(members["k1"]), min(members["k2"]))]
    at = {ref: ref for ref in held}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in stars + pairs:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    seen, rounds = [], batch.components
    monkeypatch.setattr(batch, "components", lambda e: (seen.append(e), rounds(e))[1])
    found = batch.linked(spark.createDataFrame(stars, "ref string, head string"), spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {x.ref: x.component for x in found} == {ref: top(ref) for ref in held} and len(found) == 700
    heads = {h for _, h in stars}
    assert all(x.a in heads and x.b in heads for x in seen[0].collect())
