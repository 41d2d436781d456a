"""The statement store: entities, statements, qualifiers, references and sources as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a statement, with their types. Exactly one value column is set, by value_type.
STATEMENT = {
    "id": "string", "subject_id": "string", "predicate_id": "string", "value_type": "string", "object_id": "string",
    "value_text": "string", "value_number": "double", "value_unit": "string", "value_datetime": "timestamp_ntz",
    "rank": "string", "confidence": "double", "origin": "string", "valid_from": "timestamp_ntz", "valid_to": "timestamp_ntz",
    "system_from": "timestamp_ntz", "system_to": "timestamp_ntz",
}

#: Fixed vocabulary of the reified tables: type, parent, kind, abstract.
TYPES = [
    ("Place", None, "continuant", True),
    ("Region", "Place", "continuant", False),
    ("Nation", "Place", "continuant", False),
    ("Agent", None, "continuant", True),
    ("Customer", "Agent", "continuant", False),
    ("Supplier", "Agent", "continuant", False),
    ("User", "Agent", "continuant", False),
    ("Part", None, "continuant", False),
    ("Document", None, "continuant", False),
    ("Page", None, "continuant", False),
    ("Conversation", None, "continuant", False),
    ("Happening", None, "occurrent", True),
    ("Order", "Happening", "occurrent", False),
]
#: type, interface.
IMPLEMENTS = [("Place", "Nameable"), ("Agent", "Nameable"), ("Part", "Nameable"), ("Happening", "Temporal"), ("Document", "Embeddable")]
#: predicate, domain type, domain interface, range kind, range type, cardinality, identifying.
PREDICATES = [
    ("part_of", "Nation", None, "entity", "Region", "n:m", False),
    ("located_in", "Agent", None, "entity", "Nation", "n:m", False),
    ("name", None, "Nameable", "string", None, "1:1", True),
    ("segment", "Customer", None, "string", None, "1:1", False),
    ("balance", "Agent", None, "quantity", None, "1:1", False),
    ("placed_by", "Order", None, "entity", "Customer", "1:1", False),
    ("status", "Order", None, "string", None, "1:1", False),
    ("total", "Order", None, "quantity", None, "1:1", False),
    ("started", "Happening", None, "datetime", None, "1:1", False),
    ("contains", "Order", None, "entity", "Part", "n:m", False),
    ("supplied_by", "Order", None, "entity", "Supplier", "n:m", False),
    ("did", "User", None, "string", None, "n:m", False),
]


@dataclass(frozen=True)
class Store:
    entities: DataFrame
    statements: DataFrame
    qualifiers: DataFrame
    references: DataFrame
    sources: DataFrame
    types: DataFrame
    implements: DataFrame
    predicates: DataFrame
    #: statement_id of each statement that has qualifiers, where a store can tell without making these.
    qualified: DataFrame | None = None


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as literals of the plan."""
    return spark.createDataFrame(rows, schema)


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        literal_table(spark, TYPES, "id string, parent_id string, kind string, abstract boolean"),
        literal_table(spark, IMPLEMENTS, "type_id string, interface_id string"),
        literal_table(spark, PREDICATES, "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean"),
    )


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def merged_customer(key: Column) -> Column:
    """The fixture's merge chains: of each hundred customers, number 99 went into 98 and 98 into 97."""
    return F.when(key % 100 >= 98, key - 1)


def canonical_customer(key: Column) -> Column:
    return F.when(key % 100 >= 98, key - (key % 100 - 97)).otherwise(key)


def _statements(df: DataFrame, **given: Column | str) -> DataFrame:
    """df's rows as statements; columns that aren't given have their defaults."""
    defaults = {"rank": F.lit("normal"), "confidence": F.lit(1.0), "origin": F.lit("asserted")}
    columns = {c: given.get(c, defaults.get(c, F.lit(None))) for c in STATEMENT}
    columns["predicate_id"] = F.lit(given["predicate_id"])
    columns["value_type"] = F.lit(given["value_type"])
    return df.select(*[v.cast(STATEMENT[c]).alias(c) for c, v in columns.items()])


#: When the master data entered the store.
START = "1995-01-01 00:00:00"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = "region nation customer supplier part orders lineitem events documents pages conversations".split()
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def entities(t: dict[str, DataFrame]) -> DataFrame:
    start = F.lit(START).cast("timestamp_ntz")
    none = F.lit(None).cast("string")

    def of(df: DataFrame, kind: str, type_id: str, key: str, label: Column = none, merged: Column = none, created: Column = start) -> DataFrame:
        return df.select(_id(kind, F.col(key)).alias("id"), F.lit(type_id).alias("type_id"), label.alias("label"), merged.alias("merged_into"), created.alias("created_at"))

    parts = [
        of(t["region"], "region", "Region", "r_regionkey", F.col("r_name")),
        of(t["nation"], "nation", "Nation", "n_nationkey", F.col("n_name")),
        of(t["customer"], "customer", "Customer", "c_custkey", F.col("c_name"), _id("customer", merged_customer(F.col("c_custkey")))),
        of(t["supplier"], "supplier", "Supplier", "s_suppkey", F.col("s_name")),
        of(t["part"], "part", "Part", "p_partkey", F.col("p_name")),
        of(t["orders"], "order", "Order", "o_orderkey", created=F.col("o_orderdate")),
        of(t["events"].select("user_id").distinct(), "user", "User", "user_id"),
        of(t["documents"], "doc", "Document", "doc_id"),
        of(t["pages"], "page", "Page", "page_id", F.col("url")),
        of(t["conversations"].select("conv_id").distinct(), "conv", "Conversation", "conv_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n, the number of a row among those of its key in the order of all columns. Spark leaves the window out where n isn't read."""
    from pyspark.sql import Window

    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*df.columns)))


def statements(t: dict[str, DataFrame]) -> DataFrame:
    """All predicates of the reified tables. Endpoints are canonical, as they are after merges."""
    start = F.lit(START).cast("timestamp_ntz")
    named_id = lambda p, s, n=F.lit(1): F.concat_ws("|", F.lit(p), s, n.cast("string"))
    out = []

    def add(df: DataFrame, predicate: str, subject: Column, value_type: str, n: Column | None = None, **rest) -> None:
        rest.setdefault("system_from", start)
        out.append(_statements(df, id=named_id(predicate, subject, F.lit(1) if n is None else n), subject_id=subject, predicate_id=predicate, value_type=value_type, **rest))

    nation = _id("nation", F.col("n_nationkey"))
    customer, supplier = _id("customer", F.col("c_custkey")), _id("supplier", F.col("s_suppkey"))
    add(t["nation"], "part_of", nation, "entity", object_id=_id("region", F.col("n_regionkey")))
    add(t["customer"], "located_in", customer, "entity", object_id=_id("nation", F.col("c_nationkey")))
    add(t["supplier"], "located_in", supplier, "entity", object_id=_id("nation", F.col("s_nationkey")))
    for table, kind, key, name in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name")):
        add(t[table], "name", _id(kind, F.col(key)), "string", value_text=F.col(name))
    add(t["customer"], "segment", customer, "string", value_text=F.col("c_mktsegment"), confidence=F.lit(0.9))
    unit = lambda k: F.when(F.col(k) % 2 == 0, "USD").otherwise("EUR")
    add(t["customer"], "balance", customer, "quantity", value_number=F.col("c_acctbal"), value_unit=unit("c_nationkey"))
    add(t["supplier"], "balance", supplier, "quantity", value_number=F.col("s_acctbal"), value_unit=unit("s_nationkey"))
    order = _id("order", F.col("o_orderkey"))
    dated = {"valid_from": F.col("o_orderdate"), "system_from": F.col("o_orderdate")}
    add(t["orders"], "placed_by", order, "entity", object_id=_id("customer", canonical_customer(F.col("o_custkey"))), **dated)
    add(t["orders"], "status", order, "string", value_text=F.col("o_orderstatus"), **dated)
    add(t["orders"], "total", order, "quantity", value_number=F.col("o_totalprice"), value_unit=F.lit("USD"), **dated)
    add(t["orders"], "started", order, "datetime", value_datetime=F.col("o_orderdate"), system_from=F.col("o_orderdate"))
    lines = _numbered(t["lineitem"], "l_orderkey")
    line = {
        "rank": F.when(F.col("l_returnflag") == "A", "preferred").when(F.col("l_returnflag") == "R", "deprecated").otherwise("normal"),
        "confidence": F.round(1 - 5 * F.col("l_discount"), 2),
        "valid_from": F.col("l_shipdate"),
        "valid_to": F.col("l_shipdate") + F.expr("INTERVAL 60 DAYS"),
        "system_from": F.col("l_shipdate"),
        "system_to": F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")),
    }
    of_line = _id("order", F.col("l_orderkey"))
    add(lines, "contains", of_line, "entity", F.col("n"), object_id=_id("part", F.col("l_partkey")), **line)
    add(lines, "supplied_by", of_line, "entity", F.col("n"), object_id=_id("supplier", F.col("l_suppkey")), **line)
    seen = {"valid_from": F.col("ts"), "system_from": F.col("ts")}
    add(t["events"], "did", _id("user", F.col("user_id")), "string", F.col("event_id"), value_text=F.col("event_type"), **seen)
    return reduce(DataFrame.unionByName, out)


def qualifiers(t: dict[str, DataFrame]) -> DataFrame:
    """Quantity and extended price of each `contains` statement."""
    lines = _numbered(t["lineitem"], "l_orderkey")
    owner = F.concat_ws("|", F.lit("contains"), _id("order", F.col("l_orderkey")), F.col("n").cast("string"))
    each = F.explode(F.array(
        F.struct(F.lit("quantity").alias("predicate_id"), F.col("l_quantity").alias("value_number"), F.lit(None).cast("string").alias("value_unit")),
        F.struct(F.lit("price").alias("predicate_id"), F.col("l_extendedprice").alias("value_number"), F.lit("USD").alias("value_unit")),
    ))
    return lines.select(owner.alias("statement_id"), each.alias("q")).select("statement_id", "q.*")


def qualified(t: dict[str, DataFrame]) -> DataFrame:
    """The statements that have qualifiers: the lines of an order are numbered from 1, so their number says which there are."""
    sizes = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    each = sizes.select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lines"))).alias("n"))
    return each.select(F.concat_ws("|", F.lit("contains"), _id("order", F.col("l_orderkey")), F.col("n").cast("string")).alias("statement_id"))


def references(all_statements: DataFrame) -> DataFrame:
    """One source for all that is said of an order, one for the master data; (statement_id, source_id) is unique."""
    of_order = F.col("subject_id").startswith("order:")
    source = F.when(of_order, F.concat(F.lit("src:"), F.col("subject_id"))).otherwise(F.lit("src:master"))
    return all_statements.select(F.col("id").alias("statement_id"), source.alias("source_id"))


def sources(t: dict[str, DataFrame]) -> DataFrame:
    orders = t["orders"].select(F.concat(F.lit("src:order:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("order entry").alias("activity"), F.col("o_orderdate").alias("retrieved_at"))
    docs = t["documents"].select(F.concat(F.lit("src:doc:"), F.col("doc_id").cast("string")), F.lit("crawl"), F.lit(None).cast("timestamp_ntz"))
    master = orders.sparkSession.range(1).select(F.lit("src:master"), F.lit("load"), F.lit(START).cast("timestamp_ntz"))
    return orders.union(docs).union(master)


def reify(spark: SparkSession, sf_dir: str) -> Store:
    """The tables of a folder as a statement store; nothing is read until a query runs."""
    t = tables(spark, sf_dir)
    said = statements(t)
    types, implements, predicates = vocabulary(spark)
    return Store(entities(t), said, qualifiers(t), references(said), sources(t), types, implements, predicates, qualified(t))
