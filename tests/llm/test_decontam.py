import hashlib
import random
import re
import string

from chronofact.llm import decontam
from tests.llm.helpers import documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=13):
    windows: dict = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = documents(spark, docs)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words long")
    got = decontam.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)


def test_random_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 30
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30, 60])))) for i in range(40)]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts.append(rng.choice([", ", " ", "; "]).join(w[a : a + rng.randrange(1, 50)]).upper())
            parts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(20))))
        docs.append((d, " ".join(parts)))
    run(spark, docs, items)


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(0, None), (1, ""), (2, "..."), (3, passage), (3, passage), (3, f"x {passage}"), (None, passage), (4, f"{passage} {passage}"), (5, "alpha"), (6, "ÄÖÜ straße " * 3)]
    items = [(0, None), (1, "!!"), (2, passage), (2, passage), (3, f"q {passage}"), (None, passage), (4, "Alpha"), (5, "ÄÖÜ straße")]
    run(spark, docs, items)
    run(spark, docs, [])
    run(spark, [], items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta likes omega very much"), (2, "omega zeta"), (3, "zeta " + "x " * 50 + "omega")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "zeta omega")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in decontam.proximity(docs, items).collect()}
    assert got == {(1, 9, 0, 3), (2, 9, 0, 2)}


def brute_near(docs, items, size=13, slop=8):
    """Every window of every item at every place of its rarest word."""
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    texts, passages = {(d, t): cut(t) for d, t in docs}, {(i, t): cut(t) for i, t in items}
    df: dict = {}
    for _, t in docs:
        for x in cut(t):
            df[x] = df.get(x, 0) + 1
    out = set()
    for (i, _), v in passages.items():
        n = min(size, len(v))
        windows = [(a, sorted((df[v[p]], p) for p in range(a, a + n) if v[p] in df)[:2]) for a in range(len(v) - n + 1)] if n else []
        own = {p for _, r in windows for _, p in r}
        for (d, _), w in texts.items():
            for a, r in windows:
                if len(r) == 2 or (r and n == 1):
                    inside = [p for p in own if a <= p < a + n]
                    for x in range(len(w)):
                        if w[x] == v[r[0][1]]:
                            s = x - r[0][1]
                            held = {(p, q + p) for p in inside for q in range(s - slop, s + slop + 1) if 0 <= q + p < len(w) and w[q + p] == v[p]}
                            seen = {p for p, _ in held}
                            if r[-1][1] in seen and 5 * len(seen) >= 4 * len(inside):
                                out.add((d, i, min(q for _, q in held), max(q for _, q in held) + 1))
    return out


def test_near_passages_are_those_of_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 30
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 13, 20, 40])))) for i in range(15)]
    items += [(None, "zeta omega iota"), (20, "never seen words"), (21, "zeta nowhere omega"), (22, ""), (23, None), (3, items[3][1])]
    docs = [(None, "zeta omega iota"), (900, "omega, zeta"), (901, None), (902, ""), (900, "omega, zeta")]
    for d in range(50):
        w = rng.choice(items[:15])[1].split()
        for _ in range(rng.randrange(4)):  # words inserted, dropped and replaced
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
        docs.append((d, " ".join(rng.choices(vocabulary, k=rng.randrange(30)) + w + rng.choices(vocabulary, k=rng.randrange(30)))))
    d, b = documents(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words long")
    wanted = brute_near(docs, items)
    got = [(r.doc_id, r.item_id, r.start, r.end) for r in decontam.proximity(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len({k[0] for k in wanted}) > 40
    lists = {r.doc_id: set(r.near_items) for r in decontam.contamination(d, b, slop=8).collect()}
    assert lists == {k: {str(i) for e, i, *_ in wanted if e == k and i is not None} for k in {k for k, _ in docs}}
    assert decontam.proximity(d.limit(0), b).count() == decontam.proximity(d, b.limit(0)).count() == 0


def test_an_edited_passage_is_near_and_not_exact(spark):
    rng = random.Random(4)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(40)]
    edited = [x for k, w in enumerate(passage) for x in ([w] if k % 9 else ["another", w] if k % 2 else ["swapped"])]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(passage)), (3, (" x" * 20 + " ").join(passage))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string"), slop=8).collect()}
    assert (got[1].n_items, got[1].near_items) == (0, ["7"]) and (got[2].n_items, got[2].near_items) == (1, ["7"]) and got[3].near_items == []
