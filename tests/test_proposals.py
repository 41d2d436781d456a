"""Proposals as a log: every transition against a plain state machine."""

import itertools
import random

from chronofact.operators import registry

TABLE = {(None, "propose"): "pending", ("rejected", "propose"): "pending", ("pending", "amend"): "amended", ("amended", "amend"): "amended", ("pending", "reject"): "rejected", ("amended", "reject"): "rejected", ("pending", "approve"): "approved", ("amended", "approve"): "approved"}


def test_transitions(spark):
    rng = random.Random(1)
    words = [*registry.ACTIONS, "sign", None]
    rows = [(p, s, a, s * 10) for p, actions in enumerate(itertools.product(registry.ACTIONS, repeat=4)) for s, a in enumerate(actions)]
    rows += [(1000 + p, s, rng.choice(words), s) for p in range(60) for s in range(rng.randint(1, 12))]
    events = spark.createDataFrame(rows, "proposal_id long, seq long, action string, value long")
    got = {(r.proposal_id, r.seq): (r.legal, r.state) for r in registry.transitions(events).collect()}
    state, content, decided, illegal = {}, {}, {}, {}
    for p, s, a, v in rows:
        nxt = TABLE.get((state.get(p), a))
        assert got[p, s] == (nxt is not None, nxt or state.get(p))
        illegal[p] = illegal.get(p, 0) + (nxt is None)
        if nxt:
            state[p] = nxt
            content[p] = v if a in ("propose", "amend") else content[p]
            decided[p] = s if nxt in ("rejected", "approved") else None
    last = {r.proposal_id: (r.status, r.decided_at, r.illegal, r.value) for r in registry.proposals(events, ["value"]).collect()}
    assert last == {p: (state.get(p), decided.get(p), illegal[p], content.get(p)) for p in illegal}


def test_pairs(spark):
    rows = [("likes", "approved", "liked_by"), ("liked_by", "approved", None), ("owns", "approved", "owned_by"), ("owned_by", "pending", None), ("lone", "approved", None), ("no", "rejected", "lone")]
    got = registry.approved_pairs(spark.createDataFrame(rows, "proposal_id string, status string, inverse_id string"))
    assert {r.proposal_id: (r.inverse_id, r.approved) for r in got.collect()} == {"likes": ("liked_by", True), "liked_by": ("likes", True), "owns": ("owned_by", False), "lone": (None, True)}
