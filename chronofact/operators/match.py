"""Conjunctive triple patterns over visible statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.model import Store
from chronofact.operators import filters, registry, resolve


@dataclass(frozen=True)
class Text:
    """An object position that fixes the text value."""

    value: str


Position = str | Text
Pattern = tuple[Position, Position, Position]


def is_variable(x: Position) -> bool:
    return isinstance(x, str) and x.startswith("?")


def check(patterns: list[Pattern], select: list[str]) -> None:
    if not patterns:
        raise ValueError("at least one pattern is needed")
    entity, predicate = set(), set()
    for s, p, o in patterns:
        if isinstance(s, Text) or isinstance(p, Text):
            raise ValueError("only an object can fix a text")
        entity |= {x for x in (s, o) if is_variable(x)}
        predicate |= {p} if is_variable(p) else set()
    if both := entity & predicate:
        raise ValueError(f"{', '.join(sorted(both))} can't be an entity and a predicate")
    if lost := set(select) - entity - predicate:
        raise ValueError(f"{', '.join(sorted(lost))} isn't in any pattern")


def joined_order(patterns: list[Pattern]) -> list[Pattern]:
    """Most constants first; then always a pattern that shares a variable with those before, if there is one."""
    free = lambda t: {x for x in t if is_variable(x)}
    left = sorted(patterns, key=lambda t: len(free(t)))
    out, bound = [left.pop(0)], set()
    bound |= free(out[0])
    while left:
        nxt = next((t for t in left if free(t) & bound), left[0])
        left.remove(nxt)
        out.append(nxt)
        bound |= free(nxt)
    return out


def bindings(store: Store, pattern: Pattern, **when) -> DataFrame:
    """The variables of one pattern: its constants are filters, and a variable used twice is an equality."""
    said = store.statements.where(filters.visible(when.get("valid_at"), when.get("system_at"), None, when.get("min_confidence")))
    columns: dict[str, str] = {}
    for place, x in zip(("subject_id", "predicate_id", "object_id"), pattern, strict=True):
        if isinstance(x, Text):
            said = said.where(F.col("value_text") == x.value)
        elif not is_variable(x):
            said = said.where(F.col(place) == x)
        else:
            if place == "object_id":
                said = said.where(F.col("value_type") == "entity")
            if x in columns:
                said = said.where(F.col(columns[x]) == F.col(place))
            else:
                columns[x] = place
    return said.select(*[F.col(c).alias(v[1:]) for v, c in columns.items()]).distinct()


def match(store: Store, patterns: list[Pattern], select: list[str], **when) -> DataFrame:
    """Distinct bindings of the selected variables (columns without their question mark). An id that was merged away stands for
    the entity it went into; unknown ids and predicates are errors. Patterns that share no variable
    multiply, as they are meant to; Catalyst chooses how the others are joined."""
    check(patterns, select)
    registry.known_predicates(store.predicates, sorted({p for _, p, _ in patterns if not is_variable(p)}))
    ends = sorted({x for s, _, o in patterns for x in (s, o) if isinstance(x, str) and not is_variable(x)})
    stands = {x: resolve.canonical_inputs(store, [x])[0] for x in ends}
    patterns = [tuple(stands.get(x, x) if isinstance(x, str) and i != 1 else x for i, x in enumerate(t)) for t in patterns]
    out = None
    for t in joined_order(patterns):
        own = bindings(store, t, **when)
        if out is None:
            out = own
        else:
            shared = [c for c in own.columns if c in out.columns]
            out = out.join(own, shared) if shared else out.crossJoin(own)
    return out.select(*[v[1:] for v in select]).distinct()


def page(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of bindings in order, each row with the total of all pages."""
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*found.columns).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


#: Filters that a set may name.
KEYS = {"predicate_id", "object_id", "subject_id", "value_text", "min_confidence", "valid_at"}


def members(store: Store, where: dict, on: str) -> DataFrame:
    """id: who or what the visible statements with these filters are about. Merged ids stand for their entity, unknown ones are errors."""
    if odd := set(where) - KEYS:
        raise ValueError(f"unknown filters: {', '.join(sorted(odd))}")
    registry.known_predicates(store.predicates, [where["predicate_id"]] if "predicate_id" in where else [])
    where = where | {c: resolve.canonical_inputs(store, [where[c]])[0] for c in ("subject_id", "object_id") if c in where}
    said = store.statements.where(filters.visible(where.get("valid_at"), None, None, where.get("min_confidence")))
    for c in ("predicate_id", "object_id", "subject_id", "value_text"):
        if c in where:
            said = said.where(F.col(c) == where[c])
    return said.where(F.col(f"{on}_id").isNotNull()).select(F.col(f"{on}_id").alias("id")).distinct()


def set_operation(store: Store, operation: str, sets: list[dict], on: str = "subject") -> DataFrame:
    """intersect, union or difference (the first without all others) of 2 to 10 sets of subjects or objects."""
    filters.known(operation, ["intersect", "union", "difference"], "operation")
    filters.known(on, ["subject", "object"], "side")
    if not 2 <= len(sets) <= 10:
        raise ValueError("between 2 and 10 sets are needed")
    first, *rest = [members(store, s, on) for s in sets]
    for other in rest:
        if operation == "intersect":
            first = first.join(other, "id", "left_semi")
        elif operation == "difference":
            first = first.join(other, "id", "left_anti")
        else:
            first = first.union(other)
    return first.distinct() if operation == "union" else first
