import hashlib
import itertools
import random
import re
import zlib

import pytest

from chronofact.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, place string"


def damage(rows):
    out, convs = [], set()
    for c, t, role, text in rows:
        convs.add(c)
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out, convs


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        said = text.strip(" \t\n\v\f\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(turns, fault):
    """Audits as strings, a state (the last initial, empty at first) at a time."""
    best = {"": (0, "", ())}
    say = lambda s: "a" if s == "u" else "u"
    full = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        best = dict(best)
        for _ in range(3):
            for s, (c, a, lines) in list(best.items()):
                t = say(s)
                new = (c + 2, a + "I", (*lines, full[t] + ":"))
                if t not in best or new < best[t]:
                    best[t] = new
        return best

    for (_, role, text), f in zip(turns, fault):
        after = {}
        for s, (c, a, lines) in with_inserts(best).items():
            options = [(s, c + 3, "D", ())]
            if f not in ("blank", "duplicate"):
                more = int(f == "truncated")
                if (s, role[:1]) in STEP:
                    options.append((STEP[s, role[:1]], c + more, "K", (f"{role}:{text}",)))
                options.append((say(s), c + more + 2, "R", (f"{full[say(s)]}:{text}",)))
            for t, cost, letter, line in options:
                new = (cost, a + letter, (*lines, *line))
                if t not in after or new < after[t]:
                    after[t] = new
        best = after
    best = with_inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    left, convs = damage(rows)
    out = {}
    for c in convs:
        turns = sorted(((t, r, x) for d, t, r, x in left if d == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        f = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = min(max(known) - min(known) + 1 - len(set(known)), 2**63 - 1) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(turns, f)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, digest)
    return out


def repaired(spark, rows, **how):
    table = spark.createDataFrame([(*r, 7, "p") for r in rows], SCHEMA)
    got = repair.repair(table, **how).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["ok.", "Why?", "so it is", "", " \t", "ends. ", "no! and", None, "Ünï.", "x" * 50]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "admin"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, longest)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"word {rng.randint(0, 5)}."
            rows.append((c, None if rng.random() < 0.05 else t + (rng.random() < 0.1) * 5, role, text))
    return rows


def test_against_brute_force(spark):
    rows = conversations(1, 300, 9)
    rows += [(None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (-5, -(2**63), "user", "a."), (-5, 2**63 - 1, "user", "b."), *[(-7, 1, "user", "same.")] * 30]
    rows += [(-8, 0, "user", "long " * 300_000 + "."), (-8, 1, "assistant", "!" * 1_000_000)]
    got, want = repaired(spark, rows), brute(rows)
    assert got == want
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("size", [1, 2500, 9000])
def test_segments_give_what_whole_conversations_give(spark, size):
    rows = conversations(2, 25, 60) + [(99, t, "user", "same.") for t in range(300)] + [(98, 0, "user", "again.")] * 200
    assert repaired(spark, rows, segment=size) == brute(rows)


def test_audits_are_the_least_of_all_strings():
    """Every string of edits of short conversations, tried out."""
    for roles in itertools.product("suax", repeat=3):
        turns = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[r], f"t{i}.") for i, r in enumerate(roles)]
        best = None
        for runs in itertools.product(range(3), repeat=4):
            for edits in itertools.product("DKR", repeat=3):
                state, cost, audit = "", 0, ""
                for run, edit, (_, role, _) in itertools.zip_longest(runs, edits, turns, fillvalue=(None, None, None)):
                    for _ in range(run):
                        state, cost, audit = "a" if state == "u" else "u", cost + 2, audit + "I"
                    if edit == (None, None, None) or state is None:
                        continue
                    audit += edit
                    if edit == "D":
                        cost += 3
                    elif edit == "K":
                        state = STEP.get((state, role[0]))
                    else:
                        state, cost = "a" if state == "u" else "u", cost + 2
                    if state is None:
                        break
                if state in ("", "a") and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        layers = repair.Layers(repair.NOTHING)
        for r in roles:
            layers.add(r, repair.NONE, 1)
        cost, state, run = repair.last_run(layers.cost, layers.rank)
        assert (cost, "".join(c for c, _, _ in layers.edits(state)) + "I" * run) == best == cheapest(turns, [None] * 3)[:2]
