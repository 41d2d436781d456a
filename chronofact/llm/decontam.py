"""Benchmark decontamination by a positional inverted index.

The corpus is cut into words once. Every 13-word window of a benchmark item is looked up by its two rarest words: their
counts over the whole corpus choose them, and their postings (document, place) are stored as the index. A posting less the
word's place in the item gives the shift between document and item; shifts that both words of a window share are
candidates, and the words of document and item at that shift decide. A shift covers all windows of an item, so overlapping
windows cost one candidate. Proximity matches come from the same lists: they let shifts differ by a few words, and take most of
the indexed places of a window instead of all its words, so passages with words inserted, dropped or replaced are found.

Everything is DataFrame functions. What is broadcast (terms, places of terms, keys of candidate documents) is counted first
and joined by a shuffle beyond a stated number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.text import NOT_WORD, lower_ascii, named, words
from chronofact.session import stored

WINDOW = 13
#: Words by which the shifts of a proximity match may differ from that of its window's rarest word.
SLOP = 8
#: Rows of a join's small side that are broadcast at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count says that it is small. df is stored, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= most else df


def parse(table: DataFrame, key: str, name: str) -> DataFrame:
    """key, hash (of the text; key and hash name a row), n_words and words; stored."""
    rows = named(table, key, "text").select(key, F.xxhash64("text").alias("hash"), words(lower_ascii(F.col("text")), NOT_WORD).alias("words"))
    return stored(table.sparkSession, rows.select(key, "hash", F.size("words").cast("long").alias("n_words"), "words"), name)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in all docs (parsed); terms that don't occur are left out."""
    tokens = docs.select(F.explode("words").alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms (a stored column term): term, doc_id, hash, pos; stored."""
    tokens = docs.select("doc_id", "hash", F.posexplode("words").alias("pos", "term"))
    return stored(docs.sparkSession, tokens.join(small(terms), "term"), "postings")


def item_windows(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_hash, at, size, the rarest (p1, t1) and second rarest (p2, t2; null for one) places and terms of each window,
    by counts, and whole: whether all its terms occur. Terms that don't occur are never the rarest; windows of such alone are left out."""
    own = items.select("item_id", F.col("hash").alias("item_hash"), F.col("n_words").alias("n"), F.posexplode("words").alias("pos", "term"))
    own = own.join(counts.select("term", F.col("n").alias("df")), "term", "left")
    w = Window.partitionBy("item_id", "item_hash").orderBy("pos").rowsBetween(0, window - 1)
    rarest = F.slice(F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "pos", "term"))).over(w)), 1, 2)
    size = F.least(F.col("n"), F.lit(window)).cast("int")
    rows = own.withColumn("r", rarest).withColumn("whole", F.count("df").over(w) == F.count(F.lit(1)).over(w))
    rows = rows.where((F.col("pos") + size <= F.col("n")) & (F.size("r") > 0)).withColumn("size", size)
    second = F.get("r", F.lit(1))
    return rows.select(
        "item_id", "item_hash", F.col("pos").alias("at"), "size", F.col("r")[0]["pos"].alias("p1"), F.col("r")[0]["term"].alias("t1"),
        second["pos"].alias("p2"), second["term"].alias("t2"), "whole",
    )


def _union_length(spans: Column) -> Column:
    """Places that sorted (start, end) spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, x: Column) -> Column:
        more = F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0).cast("long"))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def candidates(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """One row for each document (doc_id, hash), item (item_id, item_hash) and shift that may be a match; stored. w: the item's
    windows whose two rarest words stand in the document at this shift, with item_words to compare. near: places (start, end) of
    proximity matches, none without slop. docs and items are parsed.

    A window is near at a shift if its rarest word stands there, its second rarest at a shift that differs by slop words at most, and
    so do four fifths of the places in the window that the item has in the index. A window of several words needs both. start and
    end are the first and the last place of these words.
    """
    spark = docs.sparkSession
    items = items.where("n_words > 0").dropDuplicates(["item_id", "hash"])
    terms = stored(spark, items.select(F.explode("words").alias("term")).distinct(), "terms")
    windows = item_windows(items, term_counts(docs, terms), window)
    windows = stored(spark, windows if slop is not None else windows.where("whole"), "windows")
    place = windows.select("item_id", "item_hash", F.explode(F.array(F.struct(F.col("p1").alias("p"), F.col("t1").alias("term")), F.struct(F.col("p2").alias("p"), F.col("t2").alias("term")))).alias("a"))
    places = stored(spark, place.where("a.p IS NOT NULL").select("item_id", "item_hash", F.col("a.p").alias("p"), F.col("a.term").alias("term")).distinct(), "places")
    postings = index(docs, stored(spark, places.select("term").distinct(), "anchors"))
    key = ["doc_id", "hash", "item_id", "item_hash"]
    shifts = postings.join(small(places), "term").select(*key, (F.col("pos") - F.col("p")).alias("shift"), "p")
    if slop is not None:
        shifts = shifts.repartition(*key)  # serves the groups and the frames, which a (document, item) has to itself
    shifts = shifts.groupBy(*key, "shift").agg(F.collect_set("p").alias("found"))
    if slop is not None:
        at = F.transform("found", lambda p: F.struct(p.alias("p"), (p + F.col("shift")).cast("long").alias("pos")))
        frame = Window.partitionBy(*key).orderBy("shift").rangeBetween(-slop, slop)
        shifts = shifts.withColumn("around", F.flatten(F.collect_list(at).over(frame)))
    each = windows.groupBy("item_id", "item_hash").agg(F.collect_list(F.struct("at", "size", "p1", "p2", "whole")).alias("w"))
    own = places.groupBy("item_id", "item_hash").agg(F.collect_list("p").alias("ps"))
    whole = items.select(F.col("item_id").alias("i"), F.col("hash").alias("ih"), F.col("words").alias("item_words"))
    one = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih"))
    each = each.join(whole, one).select("i", "ih", "w", "item_words").join(own, one).select("i", "ih", "w", "item_words", "ps")
    each = small(stored(spark, each, "item-windows"), 20_000)
    rows = shifts.join(each, one)
    exact = lambda x: x["whole"] & F.array_contains("found", x["p1"]) & (x["p2"].isNull() | F.array_contains("found", x["p2"])) & (x["at"] + F.col("shift") >= 0)
    near = F.array().cast("array<struct<start:bigint,end:bigint>>")
    if slop is not None:
        near = F.transform(F.filter("w", lambda x: F.array_contains("found", x["p1"]) & (x["p2"].isNotNull() | (x["size"] == 1))), _near)
        near = F.array_distinct(F.filter(near, lambda x: x.isNotNull()))
    rows = rows.withColumn("near", near).withColumn("w", F.filter("w", exact)).where((F.size("w") > 0) | (F.size("near") > 0))
    rows = rows.withColumn("item_words", F.when(F.size("w") > 0, F.col("item_words")))
    return stored(spark, rows.select(*key, "shift", "w", "near", "item_words"), "candidates")


def _near(window: Column) -> Column:
    """The places of a proximity match of a window with the words around a shift, or null."""
    inside = lambda p: (p >= window["at"]) & (p < window["at"] + window["size"])
    held = F.filter("around", lambda x: inside(x["p"]))
    seen = F.size(F.array_distinct(F.transform(held, lambda x: x["p"])))
    enough = 5 * seen >= 4 * F.size(F.filter("ps", inside))
    second = window["p2"].isNull() | F.exists("around", lambda x: x["p"] == window["p2"])
    pos = F.transform(held, lambda x: x["pos"])
    return F.when(second & enough, F.struct(F.array_min(pos).alias("start"), (F.array_max(pos) + 1).alias("end")))


def matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Exact occurrences among candidates of parsed docs, one row for each document (doc_id, hash), item (item_id, item_hash) and
    shift that has any: spans, an array of (start, end) places of words in the document."""
    spark = docs.sparkSession
    exact = found.where(F.size("w") > 0).drop("near")
    keys = stored(spark, exact.select(F.col("doc_id").alias("d"), F.col("hash").alias("h")).distinct(), "candidate-docs")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    texts = docs.join(small(keys), same, "left_semi").select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "words")
    rows = exact.join(texts, same)
    there = lambda x: F.slice("words", x["at"] + F.col("shift") + 1, x["size"]) == F.slice("item_words", x["at"] + 1, x["size"])
    span = lambda x: F.struct((x["at"] + F.col("shift")).cast("long").alias("start"), (x["at"] + F.col("shift") + x["size"]).cast("long").alias("end"))
    rows = rows.withColumn("spans", F.transform(F.filter("w", there), span)).where(F.size("spans") > 0)
    return rows.select("doc_id", "hash", "item_id", "item_hash", "shift", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items (sorted ids), items_sha256
    (of the ids, comma-joined), contaminated (some hit, and a twentieth of the words or more), hash (of the text), and near_items:
    sorted ids of items with a proximity match, none without slop. These have no part in contaminated.

    A row for each row of docs. Null, empty and wordless texts have no words and no hits; so have items without words.
    Items of fewer words than the window are one window. Repeated rows of a document each get the same result; items that
    repeat count once for each id; null ids of items are left out of the lists. Empty tables: no rows, or no hits.
    """
    parsed = parse(docs, "doc_id", "documents-words")
    found = candidates(parsed, parse(benchmark, "item_id", "items-words"), window, slop)
    ident = F.col("item_id").cast("string")
    spans = "array<struct<start:bigint,end:bigint>>"
    rows = matches(parsed, found).select("doc_id", "hash", "spans", ident.alias("item"), F.lit(None).cast("string").alias("near"))
    near = found.where(F.size("near") > 0).select("doc_id", "hash", F.array().cast(spans).alias("spans"), F.lit(None).cast("string").alias("item"), ident.alias("near"))
    per = rows.unionByName(near.distinct()).groupBy("doc_id", "hash").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set("near")).alias("near_items"),
    )
    per = per.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), _union_length(F.col("spans")).alias("n_hit"), "items", "near_items")
    out = parsed.select("doc_id", "hash", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    ids = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    out = out.select("doc_id", "hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), ids("items").alias("items"), ids("near_items").alias("near_items"))
    out = out.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start, end: places of the words of each proximity match (see candidates), exact occurrences included.

    Distinct rows: documents or items that repeat give theirs once, and windows with the same words are one match. Null ids of
    documents and items are kept as ids. Null, empty and wordless texts match nothing; of equally rare words, that which stands first
    in the item counts as the rarer. Empty tables give no rows.
    """
    found = candidates(parse(docs, "doc_id", "documents-words"), parse(benchmark, "item_id", "items-words"), window, slop)
    return found.select("doc_id", "item_id", F.explode("near").alias("n")).select("doc_id", "item_id", "n.start", "n.end").distinct()
