"""Entity resolution: identifiers, labels and vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofact.model import Store
from chronofact.operators import filters, registry
from chronofact.session import shuffle_partitions, stored

DIMENSIONS = 1024
CANDIDATE = 0.80
AUTOMATIC = 0.93


def canonical_ids(entities: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id, canonical_id for the entities that were merged, at the end of their chain, by pointer doubling: each round halves what is
    left of every chain. A cycle ends at its least id."""
    spark = entities.sparkSession
    hop = stored(spark, entities.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("to")), "canonical")
    for _ in range(most_rounds):
        nxt = hop.select(F.col("id").alias("to"), F.col("to").alias("next"))
        fresh = stored(spark, hop.join(nxt, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "canonical")
        hop = fresh.select("id", "to")
        if not fresh.where("moved AND id <> to").limit(1).count():
            return hop.withColumnRenamed("to", "canonical_id")
    looped = hop.join(hop.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    least = looped.groupBy("to").agg(F.min("id").alias("least"))
    return hop.join(least, "to", "left").select("id", F.coalesce("least", "to").alias("canonical_id"))


def canonical_inputs(store: Store, ids: list[str]) -> list[str]:
    """The entities that some given ids stand for now, in their order, each once: the ends of their merge chains (the least id of a cycle).
    An unknown id is an error. One small job for each step of the longest chain."""
    hop: dict[str, str | None] = {}
    asked = set(ids)
    while asked:
        rows = store.entities.where(F.col("id").isin(sorted(asked))).select("id", "merged_into").collect()  # a row for each id
        if lost := asked - {r["id"] for r in rows}:
            raise ValueError(f"unknown entity {', '.join(sorted(lost))}")
        hop |= {r["id"]: r["merged_into"] for r in rows}
        asked = {x for x in hop.values() if x is not None and x not in hop}
    out = []
    for x in ids:
        seen = [x]
        while (nxt := hop[seen[-1]]) is not None and nxt not in seen:
            seen.append(nxt)
        out.append(seen[-1] if nxt is None else min(seen[seen.index(nxt) :]))
    return list(dict.fromkeys(out))


def rewritten(said: DataFrame, canonical: DataFrame) -> DataFrame:
    """Statements after merges: both ends canonical, and loops that a merge made taken out."""
    was_loop = F.col("subject_id") == F.col("object_id")
    s, o = canonical.toDF("subject_id", "s"), canonical.toDF("object_id", "o")
    out = said.withColumn("_loop", F.coalesce(was_loop, F.lit(False))).join(s, "subject_id", "left").join(o, "object_id", "left")
    out = out.withColumn("subject_id", F.coalesce("s", "subject_id")).withColumn("object_id", F.coalesce("o", "object_id"))
    made = (F.col("subject_id") == F.col("object_id")) & ~F.col("_loop")
    return out.where(~F.coalesce(made, F.lit(False))).select(*said.columns)


def padded(text: Column) -> Column:
    return F.concat(F.lit("  "), F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("  "))


#: Trigrams whose dimension and sign a task remembers.
REMEMBERED = 200_000


def vectors_of(rows: DataFrame, texts: str) -> DataFrame:
    """rows with dims, xs, sq: the hashed trigram vector of their padded texts (an array) together, before it is made of length one, as its
    dimensions in order, its values and its squared norm. A trigram's SHA-1 gives its dimension (the low ten bits of the first eight bytes)
    and its sign (the top bit). A row's vector is made in one call, so no trigram is shuffled."""

    def count(batch: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for own in batch:
            sums: dict[int, float] = {}
            for t in own:
                for i in range(len(t) - 2):
                    at = known.get(t[i : i + 3])
                    if at is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        h = hashlib.sha1(t[i : i + 3].encode()).digest()
                        at = known[t[i : i + 3]] = (int.from_bytes(h[6:8], "big") % DIMENSIONS, -1.0 if h[0] >> 7 else 1.0)
                    sums[at[0]] = sums.get(at[0], 0.0) + at[1]
            dims = sorted(d for d, x in sums.items() if x)
            xs = [sums[d] for d in dims]
            out.append((dims, xs, sum(x * x for x in xs)))
        return pd.DataFrame(out, columns=["dims", "xs", "sq"])

    made = F.pandas_udf(count, "dims array<int>, xs array<double>, sq double")
    return rows.withColumn("_made", made(F.col(texts))).select(*rows.columns, "_made.dims", "_made.xs", "_made.sq")


def texts_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, texts: the padded texts of each key, which are one where it is unique."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(padded(F.col(text)))).alias("texts"))


def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, dim, w: the hashed trigram vector of a text (see vectors_of), sparse and of length one."""
    held = vectors_of(texts_of(rows, key, text), "texts")
    each = held.select(key, "sq", F.explode(F.arrays_zip("dims", "xs")).alias("e"))
    return each.select(key, F.col("e.dims").alias("dim"), (F.col("e.xs") / F.sqrt("sq")).alias("w"))


def cosine(queries: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """query, id, similarity for sparse vectors (query, dim, w) and (id, dim, w) that share a dimension."""
    a = queries.select("query", "dim", F.col("w").alias("a"))
    found = a.join(vectors.select("id", "dim", F.col("w").alias("b")), "dim").groupBy("query", "id").agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))
    return found if least is None else found.where(F.col("similarity") >= least)


#: Vectors that one task compares with QUERIES queries; what it finds is held in the task, so there are fewer of these.
BLOCK = 4096
QUERIES = 1024
#: Rows of one text that go through a comparison together.
MEMBERS = 1024


def rare_dims(rows: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """rows (dims, xs, sq) with rare: those of a vector's dimensions that a pair of `least` or more must share one of. In an order of all
    dimensions, the most frequent first, the entries before them have a norm below `least`; so if two vectors shared none but such,
    or the rarest that they share were such in one of them, their product would be too small. counts: how often each dimension occurs."""

    def pick(dims: pd.Series, xs: pd.Series, sq: pd.Series) -> pd.Series:
        out = []
        for d, x, n in zip(dims, xs, sq):
            d = np.asarray(d, dtype=np.int64)
            order = np.lexsort((d, -counts[d]))
            out.append(d[order][np.cumsum(np.asarray(x)[order] ** 2) >= (least * least - 1e-8) * n].tolist())
        return pd.Series(out)

    return rows.withColumn("rare", F.pandas_udf(pick, "array<int>")("dims", "xs", "sq"))


def _listed(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a column of arrays where each begins, how long it is, and all values."""
    held = rows.column(column).combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    ends = held.offsets.to_numpy()
    return ends[:-1], np.diff(ends), held.values


def _compared(key: str, other: str, least: float, kinds: pa.Schema):
    """A task's comparison of a block of queries with a block of vectors: those of `least` or more that share no rare dimension below its own,
    each of whose members gets a row with each of the other's. Values that are whole numbers give exact products."""

    def dense(rows: pa.Table, kind: type) -> np.ndarray:
        _, sizes, dims = _listed(rows, "dims")
        out = np.zeros((len(rows), DIMENSIONS), dtype=kind)
        out[np.repeat(np.arange(len(rows)), sizes), dims.to_numpy()] = _listed(rows, "xs")[2].to_numpy()
        return out

    def marked(rows: pa.Table) -> np.ndarray:
        _, sizes, dims = _listed(rows, "rare")
        out = np.zeros((len(rows), DIMENSIONS), dtype=bool)
        out[np.repeat(np.arange(len(rows)), sizes), dims.to_numpy()] = True
        return out

    def each(at: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each member of the rows `at` which of `at` it is of, and its place."""
        n = sizes[at]
        of = np.repeat(np.arange(len(at)), n)
        return of, begins[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)

    def compare(place: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        dim = place[0].as_py()
        found = []
        if len(q) and len(v):
            sizes = [t.column("sq").to_numpy() for t in (q, v)]
            whole = all((_listed(t, "xs")[2].to_numpy() % 1 == 0).all() and s.max() < 2**23 for t, s in zip((q, v), sizes))
            kind = np.float32 if whole else np.float64
            left, right = dense(q, kind), dense(v, kind).T
            marks = (marked(q), marked(v)) if dim > 0 else None
            (q_begins, q_sizes, q_members), (v_begins, v_sizes, v_members) = _listed(q, key), _listed(v, other)
            for start in range(0, len(q), 256):
                s = (left[start : start + 256] @ right).astype(np.float64) / np.sqrt(np.outer(sizes[0][start : start + 256], sizes[1]))
                a, b = np.nonzero(s >= least - 1e-9)
                if marks is not None:
                    keep = np.concatenate([~(marks[0][start + a[i : i + 50_000], :dim] & marks[1][b[i : i + 50_000], :dim]).any(axis=1) for i in range(0, len(a), 50_000)] or [np.zeros(0, dtype=bool)])
                    a, b = a[keep], b[keep]
                s = s[a, b]
                of, ids = each(b, v_begins, v_sizes)
                again, asked = each(start + a[of], q_begins, q_sizes)
                found.append(pa.table([q_members.take(pa.array(asked)), v_members.take(pa.array(ids[again])), pa.array(s[of][again])], schema=kinds))
        return pa.concat_tables(found) if found else kinds.empty_table()

    return compare


def alike(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The first columns of queries and vectors (each with dims, xs, sq) and the similarity of all pairs of `least` - 1e-9 or more. A first column that is
    an array has the members of a class, which are paired each. The allowance
    keeps those at the threshold. Pairs that share a rare dimension meet in a block of it, and are kept at the least that they share; where
    rare dimensions would bring more pairs together than there are, blocks of all rows meet. Both are read several times and should be stored."""
    key, other = queries.columns[0], vectors.columns[0]
    spark = queries.sparkSession
    queries, vectors = (df if df.dtypes[0][1].startswith("array") else df.withColumn(df.columns[0], F.array(df.columns[0])) for df in (queries, vectors))
    counts = np.zeros(DIMENSIONS)
    for r in vectors.select(F.explode("dims").alias("d")).groupBy("d").count().collect():  # a row for each of the dimensions, which are 1,024
        counts[r["d"]] = r["count"]
    sides = [stored(spark, rare_dims(df.where("sq > 0"), counts, least), "rare") for df in (queries, vectors)]
    sizes = [df.count() for df in sides]
    rare = [{r["d"]: r["count"] for r in df.select(F.explode("rare").alias("d")).groupBy("d").count().collect()} for df in sides]  # likewise
    met = sum(n * rare[1].get(d, 0) for d, n in rare[0].items())
    if met < sizes[0] * sizes[1]:
        blocks = [(d, -(-n // QUERIES), -(-rare[1][d] // BLOCK)) for d, n in rare[0].items() if d in rare[1]]
        sides = [df.withColumn("dim", F.explode("rare")) for df in sides]
    else:
        blocks = [(0, -(-sizes[0] // QUERIES), -(-sizes[1] // BLOCK))]
        sides = [df.withColumn("dim", F.lit(0)) for df in sides]
    dealt = F.broadcast(spark.createDataFrame(blocks, "dim int, qs long, vs long"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = sides[0].join(dealt, "dim").withColumn("i", own(key, "qs")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).drop("qs", "vs")
    v = sides[1].join(dealt, "dim").withColumn("j", own(other, "vs")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("qs", "vs")
    own_type = lambda df, c: df.schema[c].dataType.elementType
    found = StructType([StructField(key, own_type(queries, key)), StructField(other, own_type(vectors, other)), StructField("similarity", DoubleType())])
    by = ["dim", "i", "j"]
    return q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(_compared(key, other, least, to_arrow_schema(found)), found)


def similar(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The rows of cosine(queries, vectors, least - 1e-9), for vectors of length one in DIMENSIONS dimensions, by alike()."""
    spark = vectors.sparkSession

    def held(df: DataFrame, key: str) -> DataFrame:
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "w"))).alias("e"))
        return stored(spark, rows.select(key, F.col("e.dim").alias("dims"), F.col("e.w").alias("xs"), F.lit(1.0).alias("sq")), "held")

    return alike(held(queries, "query"), held(vectors, "id"), least)


def similar_texts(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """query, id, similarity of the texts of queries (query, text) and rows (id, text) whose vectors are alike. Copies of a text are compared once, up to
    MEMBERS of them, and go through the comparison together, so that no pairs are shuffled to be named."""
    spark = rows.sparkSession

    def classes(df: DataFrame, key: str) -> DataFrame:
        own = texts_of(df, key, "text").repartition(shuffle_partitions(spark), "texts").sortWithinPartitions("texts")
        some = F.floor(F.monotonically_increasing_id() / F.lit(MEMBERS)).alias("_some")
        own = own.select("texts", key, some).groupBy("texts", "_some").agg(F.collect_list(key).alias(key))
        return stored(spark, vectors_of(own, "texts").select(key, "dims", "xs", "sq"), "vectors")

    asked = classes(queries, "query")
    if not asked.limit(1).count():
        return spark.range(0).join(queries.select("query"), F.lit(False)).join(rows.select(F.col("id").alias("_id")), F.lit(False)).select("query", F.col("_id").alias("id"), F.lit(0.0).alias("similarity"))
    return alike(asked, classes(rows, "id"), least)


#: Vectors that one task compares with as many queries.
VECTOR_BLOCK = 16_384
#: Scores of a query of which only the best is looked at first.
SCORES = 128


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction, and their vectors in double precision and of length one."""
    at = np.flatnonzero(vectors.notna().to_numpy())
    if not len(at):
        return at, np.zeros((0, 1))
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[at]])
    size = np.sqrt((x * x).sum(axis=1))
    return at[size > 0], x[size > 0] / size[size > 0, None]


def _at_least(scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row a value that `most` of its scores reach: that place among the best of its runs of SCORES, if there are as many runs."""
    runs = scores.shape[1] // SCORES
    if runs >= most:
        scores = scores[:, : runs * SCORES].reshape(len(scores), runs, SCORES).max(axis=2)
    return np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query, id, similarity, place: the k nearest of all dense vectors (id, v) to each query (query, q), exactly; ids break ties. Blocks of queries
    meet blocks of vectors, and a task keeps of its block the k nearest to each query. A null or zero vector has no similarity and comes last.
    Vectors in a block that are equal are compared once, and with equal arithmetic, so that they tie. Single precision, with an allowance for
    its error, leaves out what can't be among the nearest."""
    spark = vectors.sparkSession

    def meet(place: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("id", ignore_index=True)
        ids, asked = v["id"].to_numpy(), q["query"].to_numpy()
        with_q, a = _unit(q["q"])
        with_v, b = _unit(v["v"])
        found = []

        def add(rows: np.ndarray, at: np.ndarray, s: np.ndarray | None) -> None:
            found.append(pd.DataFrame({"query": asked[rows], "id": ids[at], "similarity": np.full(len(rows), np.nan) if s is None else s}))

        if len(a) and len(b):
            b = np.ascontiguousarray(b + 0.0)  # one zero
            _, first, kind = np.unique(b.view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel(), return_index=True, return_inverse=True)
            different, single = b[first], b[first].astype(np.float32).T
            order = np.argsort(kind, kind="stable")
            starts, sizes = np.searchsorted(kind[order], np.arange(len(first))), np.minimum(np.bincount(kind), k + 1)
            most, error = min(k + 1, len(first)), (b.shape[1] + 4) * 2.0**-23
            for start in range(0, len(a), 512):
                part = a[start : start + 512]
                rough = part.astype(np.float32) @ single
                r, c = np.nonzero(rough >= (_at_least(rough, most) - 2 * error)[:, None])
                s = np.concatenate([(part[r[i : i + 100_000]] * different[c[i : i + 100_000]]).sum(axis=1) for i in range(0, len(r), 100_000)] or [np.zeros(0)])
                counts = sizes[c]
                copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                add(np.repeat(with_q[start + r], counts), with_v[order[np.repeat(starts[c], counts) + copy]], np.repeat(s, counts))
        none_v, none_q = np.setdiff1d(np.arange(len(v)), with_v)[: k + 1], np.setdiff1d(np.arange(len(q)), with_q)
        add(np.repeat(with_q, len(none_v)), np.tile(none_v, len(with_q)), None)
        add(np.repeat(none_q, min(k + 1, len(v))), np.tile(np.arange(min(k + 1, len(v))), len(none_q)), None)
        out = pd.concat(found).query("query != id").sort_values(["similarity", "id"], ascending=[False, True], na_position="last")
        return out.groupby("query").head(k)

    n, m = queries.count(), vectors.count()
    qs, vs = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // VECTOR_BLOCK))
    own = lambda c, most: F.pmod(F.xxhash64(c), F.lit(most)).cast("int")
    # both sides' keys are of one type: blocks of another would be hashed to other tasks
    q = queries.select("query", "q", own("query", qs).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(vs - 1))).alias("j"))
    v = vectors.select("id", "v", own("id", vs).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("i"))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, similarity double"
    scored = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInPandas(meet, schema).withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))
    scored = stored(spark, scored, "nearest")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def semantic_search(store: Store, query: str, type_id: str | None = None, limit: int = 10) -> DataFrame:
    """The nearest labels, then as many that contain the query and weren't found before (similarity null)."""
    own = store.entities.where("merged_into IS NULL AND label IS NOT NULL")
    if type_id is not None:
        own = own.where(F.col("type_id").isin(registry.descendants(store.types, type_id)))
    asked = own.sparkSession.range(1).select(F.lit("q").alias("query"), F.lit(query).alias("text"))
    near = cosine(embed(asked, "query", "text"), embed(own, "id", "label")).orderBy(F.desc("similarity"), "id").limit(limit)
    near = near.select("id", "similarity")
    like = own.where(F.ilike("label", F.lit(f"%{query}%"))).select("id").join(near, "id", "left_anti").orderBy("id").limit(limit)
    return near.unionByName(like.withColumn("similarity", F.lit(None).cast("double"))).join(own.select("id", "label", "type_id"), "id")


def _by_stage(store: Store, rows: DataFrame, identifying: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ref, id, stage, similarity by identifier or label, and by vector for refs without those; and the typed live labels."""
    now = store.statements.where(filters.visible() & (F.col("predicate_id") == identifying))
    alive = store.entities.where("merged_into IS NULL")
    owner = now.join(alive.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").groupBy(F.col("value_text").alias("key")).agg(F.min("subject_id").alias("id"))
    live = alive.where("label IS NOT NULL")
    typed = live.join(registry.closure(store.types), "type_id").select("id", "label", F.col("ancestor_id").alias("type_id"))
    by_key = rows.join(owner, "key").select("ref", "id", F.lit(1).alias("stage"), F.lit(1.0).alias("similarity"))
    low = F.lower("label")
    same = rows.select("ref", "type_id", low.alias("low")).join(typed.select("type_id", "id", low.alias("low")), ["type_id", "low"])
    exact = by_key.unionByName(same.select("ref", "id", F.lit(2).alias("stage"), F.lit(1.0).alias("similarity")))
    return exact, _by_vector(rows.join(exact.select("ref"), "ref", "left_anti"), live, typed, least), typed


def _by_vector(wanted: DataFrame, live: DataFrame, typed: DataFrame, least: float) -> DataFrame:
    asked = stored(wanted.sparkSession, wanted.select("ref", "type_id", "label"), "asked")
    # of the store only what lies under a type that is asked for
    held = live.join(typed.join(asked.select("type_id").distinct(), "type_id", "left_semi").select("id").distinct(), "id", "left_semi")
    near = similar_texts(asked.select(F.col("ref").alias("query"), F.col("label").alias("text")), held.select("id", F.col("label").alias("text")), least).withColumnRenamed("query", "ref")
    wanted = asked
    near = near.join(wanted.select("ref", "type_id"), "ref").join(typed.select("id", "type_id"), ["id", "type_id"], "left_semi")
    return near.select("ref", "id", F.lit(3).alias("stage"), "similarity")


def _method(stage: Column) -> Column:
    return F.when(stage == 1, "identifier").when(stage == 2, "label").when(stage == 3, "vector").when(stage == 4, "substring").otherwise("new")


def containing(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """ref, id where a label of typed (id, label, type_id) contains that of the row (ref, type_id, label) in any case. The rarest piece of
    three characters (of all, in shorter labels) finds those to compare."""
    pieces = lambda c, n: F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))))
    asked = rows.where("length(label) > 0").select("ref", "type_id", F.lower("label").alias("part"))
    part = F.col("part")
    wanted = asked.withColumn("piece", F.explode(F.coalesce(pieces(part, 3), F.array(part))))
    low = F.col("low")
    stock = typed.select("id", F.lower("label").alias("low")).distinct()
    none = F.array().cast("array<string>")
    held = stock.withColumn("piece", F.explode(F.concat(*[F.coalesce(pieces(low, n), none) for n in (1, 2, 3)])))
    held = held.join(wanted.select("piece").distinct(), "piece", "left_semi")
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "piece", "left").groupBy("ref", "type_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
    found = rarest.select("ref", "type_id", "part", F.col("p.piece").alias("piece")).join(held, "piece").where(F.contains("low", "part"))
    return found.join(typed.select("id", "type_id"), ["id", "type_id"], "left_semi").select("ref", "id")


def candidates(store: Store, rows: DataFrame, identifying: str = "name", least: float = CANDIDATE) -> DataFrame:
    """All candidates of a batch (ref, type_id, label, key): ref, id, method, similarity. A ref with a match by identifier has only that. Others
    have all entities of the type or below with the same label in any case, those with vectors of `least` or more, and those whose
    label contains theirs (similarity null: no reason to merge), each by its first stage. A ref without any is `new`, with a null id."""
    exact, _, typed = _by_stage(store, rows, identifying, least)
    open_rows = rows.join(exact.where("stage = 1").select("ref"), "ref", "left_anti")
    live = store.entities.where("merged_into IS NULL AND label IS NOT NULL")
    like = containing(open_rows, typed).select("ref", "id", F.lit(4).alias("stage"), F.lit(None).cast("double").alias("similarity"))
    later = exact.where("stage = 2").unionByName(_by_vector(open_rows, live, typed, least)).unionByName(like).join(open_rows.select("ref"), "ref", "left_semi")
    found = exact.where("stage = 1").unionByName(later)
    first = found.groupBy("ref", "id").agg(F.min(F.struct("stage", "similarity")).alias("b"))
    return rows.select("ref").join(first, "ref", "left").select("ref", "id", _method(F.col("b.stage")).alias("method"), F.col("b.similarity").alias("similarity"))


def resolve(store: Store, rows: DataFrame, identifying: str = "name", least: float = CANDIDATE) -> DataFrame:
    """The match of each row of a batch (ref, type_id, label, key): ref, id, method, similarity. The owner of an identifying value comes first,
    then an entity of the type or below with the same label in any case, then the nearest vector of `least` or more."""
    exact, near, _ = _by_stage(store, rows, identifying, least)
    best = exact.unionByName(near).groupBy("ref").agg(F.min(F.struct("stage", (-F.col("similarity")).alias("d"), "id")).alias("b"))
    return rows.select("ref").join(best, "ref", "left").select("ref", F.col("b.id").alias("id"), _method(F.col("b.stage")).alias("method"), (-F.col("b.d")).alias("similarity"))


def get_or_create(store: Store, rows: DataFrame) -> DataFrame:
    """ref, id, created: a match by identifier or label, a vector of 0.93 or more, else a new id, the same for rows of the batch that share
    type and label in any case. A row without a label has an id of its own, made from its ref: what has no name is nobody else."""
    found = resolve(store, rows, least=AUTOMATIC)
    named = F.length(F.trim("label")) > 0
    fresh = F.concat(F.lit("new:"), F.sha1(F.concat_ws("|", "type_id", F.when(named, F.lower("label")).otherwise(F.concat(F.lit("\0"), F.col("ref").cast("string"))))))
    return found.join(rows, "ref").select("ref", F.coalesce("id", fresh).alias("id"), F.col("id").isNull().alias("created"))
