"""Projection, joins, aggregates, order and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.flatten import flatten_record
from tableloom.functions.schema import apply_schema
from tableloom.operators import aggregates, bucketed, columns, combine, joins, ranking, skew
from tableloom.plans.federated import sql_join as run_sql_join
from tableloom.sinks.files import FileTarget, write_files
from tableloom.staging import new_path
from workload.registry import query, ranked, table

# ---- projection and filters


@query("SELECT p_partkey, p_name, p_brand FROM part")
def project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")


@query(
    "SELECT p_partkey AS PART_KEY, p_name AS PART_NAME, p_retailprice AS RETAIL_PRICE FROM part"
)
def normalise_names(spark: SparkSession, sf: str) -> DataFrame:
    spaced = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Part Key"),
        F.col("p_name").alias("Part Name"),
        F.col("p_retailprice").alias("Retail Price"),
    )
    return columns.normalise_names(spaced, upper=True)


@query(
    """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey AS nation_id,
              s_acctbal AS balance FROM supplier"""
)
def positional_rename(spark: SparkSession, sf: str) -> DataFrame:
    names = ["supplier_id", "supplier_name", "nation_id", "balance"]
    return columns.rename_all(table(spark, sf, "supplier"), names)


@query(
    """SELECT a.o_orderkey AS o_orderkey_1, a.o_custkey AS o_custkey_1,
              b.o_orderkey AS o_orderkey_2, b.o_totalprice AS o_totalprice_1,
              c.o_orderkey AS o_orderkey, c.o_custkey AS o_custkey, c.o_totalprice AS o_totalprice
       FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey
                     JOIN orders c ON a.o_orderkey = c.o_orderkey"""
)
def dedupe_columns(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    a = orders.select("o_orderkey", "o_custkey").alias("a")
    b = orders.select("o_orderkey", "o_totalprice").alias("b")
    c = orders.select("o_orderkey", "o_custkey", "o_totalprice").alias("c")
    three = a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey")).join(
        c, F.col("a.o_orderkey") == F.col("c.o_orderkey")
    )
    return joins.dedupe_columns(three)


@query(
    """SELECT a.o_orderkey AS bbl_o_orderkey, a.o_orderstatus,
              b.o_orderkey, b.o_totalprice
       FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey"""
)
def dedupe_columns_prefix(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    a = orders.select("o_orderkey", "o_orderstatus")
    b = orders.select("o_orderkey", "o_totalprice")
    # The key is unique on both sides.
    return joins.equi_join(a, b, "o_orderkey", "o_orderkey", repair="prefix", skew_safe=False)


@query(
    """SELECT a.o_orderstatus, a.o_orderkey AS o_orderkey_1,
              b.o_orderkey, b.o_totalprice
       FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey"""
)
def dedupe_columns_position(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    a = orders.select("o_orderstatus", "o_orderkey")
    b = orders.select("o_orderkey", "o_totalprice")
    return joins.equi_join(a, b, "o_orderkey", "o_orderkey", repair="position", skew_safe=False)


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_text, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
              CAST(l_shipdate AS DATE) AS ship_day, TRY_CAST(l_returnflag AS INTEGER) AS flag_number
       FROM lineitem"""
)
def cast_project(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    types = {"l_orderkey": "string", "l_quantity": "int", "l_shipdate": "date", "l_returnflag": "int"}
    return columns.cast_columns(lines, types).toDF("order_text", "quantity", "ship_day", "flag_number")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return columns.filter_eq(orders, "o_orderstatus", "F")


@query(
    """SELECT c_custkey, c_nationkey,
              nullif(trim(CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE c_mktsegment END), '') AS segment,
              nullif(trim(CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END), '') AS name
       FROM customer"""
)
def blank_to_null(spark: SparkSession, sf: str) -> DataFrame:
    blanks = table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE c_mktsegment END").alias("segment"),
        F.expr("CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END").alias("name"),
    )
    return columns.blank_to_null(blanks)


_GAPS = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
                  nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer"""


@query(f"SELECT * FROM ({_GAPS}) WHERE balance IS NOT NULL AND segment IS NOT NULL")
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return columns.drop_nulls(_with_gaps(spark, sf))


@query(f"SELECT * FROM ({_GAPS}) WHERE balance IS NOT NULL")
def drop_nulls_subset(spark: SparkSession, sf: str) -> DataFrame:
    return columns.drop_nulls(_with_gaps(spark, sf), ["balance"])


def _with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
    )


@query(
    """SELECT 'priority_number' AS column_name, count(*) AS applied, 0::BIGINT AS failed, '' AS missing FROM orders
       UNION ALL
       SELECT 'price_per_status', count(*) FILTER (o_orderstatus <> 'F'), count(*) FILTER (o_orderstatus = 'F'), '' FROM orders
       UNION ALL
       SELECT 'from_elsewhere', 0, count(*), 'not_there' FROM orders"""
)
def derived_column_report(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    derived, counts = columns.derive(
        orders,
        [
            columns.DerivedColumn(
                "priority_number", "try_cast(substr(o_orderpriority, 1, 1) AS int)", ("o_orderpriority",)
            ),
            columns.DerivedColumn(
                "price_per_status",
                "try_divide(o_totalprice, if(o_orderstatus = 'F', 0, 1))",
                ("o_totalprice", "o_orderstatus"),
            ),
            columns.DerivedColumn("from_elsewhere", "not_there + 1", ("not_there",)),
        ],
    )
    derived.write.format("noop").mode("overwrite").save()
    lines = [(r.column_name, r.applied, r.failed, ",".join(r.missing)) for r in counts.report()]
    return spark.createDataFrame(lines, "column_name string, applied long, failed long, missing string")


@query(
    """SELECT CAST(trunc(o_totalprice) AS INTEGER) AS WHOLE_PRICE, o_orderkey AS ORDER_ID,
              CAST(o_orderdate AS DATE) AS ORDER_DAY, o_orderstatus AS STATUS, o_totalprice AS PRICE
       FROM orders"""
)
def typed_by_descriptor(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ORDER_ID"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("ORDER_DAY"),
        F.col("o_orderstatus").alias("STATUS"),
        F.col("o_totalprice").cast("string").alias("PRICE"),
        F.col("o_totalprice").cast("string").alias("WHOLE_PRICE"),
        F.lit("unused").alias("NOTE"),
    )
    descriptor = {
        "ORDER_ID": {"type": "LongType()", "order": 2},
        "ORDER_DAY": {"type": "DateType()", "order": 3, "active": True, "date_format": "yyyy/MM/dd"},
        "STATUS": {"type": "StringType()", "order": 4},
        "PRICE": {"type": "DoubleType()", "order": 5},
        "WHOLE_PRICE": {"type": "IntegerType()", "order": 1},
        "NOTE": {"type": "StringType()", "order": 6, "active": False},
    }
    return apply_schema(text, descriptor)


@query(
    """SELECT 'doc_id' AS column_name, CAST(max(length(CAST(doc_id AS VARCHAR))) AS BIGINT) AS max_length FROM documents
       UNION ALL SELECT 'text', max(length(text)) FROM documents
       UNION ALL SELECT 'lang', max(length(lang)) FROM documents
       UNION ALL SELECT 'source', max(length(source)) FROM documents"""
)
def column_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return columns.column_sizes(table(spark, sf, "documents"), ["doc_id", "text", "lang", "source"])


@query(
    """SELECT CAST(c_nationkey AS VARCHAR) AS key, c_custkey, c_name, c_acctbal,
              nullif(c_mktsegment, 'BUILDING') AS segment, c_mktsegment <> 'BUILDING' AS has_segment
       FROM customer"""
)
def encode_key_json(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        "c_nationkey",
        "c_custkey",
        "c_name",
        "c_acctbal",
        F.expr("if(c_mktsegment = 'BUILDING', ' ', c_mktsegment)").alias("segment"),
    )
    messages = columns.encode_key_json(
        customers, "c_nationkey", ["c_custkey", "c_name", "c_acctbal", "segment"]
    )
    schema = "c_custkey long, c_name string, c_acctbal double, segment string"
    return messages.select(
        "key",
        F.from_json("value", schema).alias("row"),
        F.contains("value", F.lit('"segment"')).alias("has_segment"),
    ).select("key", "row.*", "has_segment")


@query(
    """SELECT event_id, 'user|id' AS path, CAST(user_id AS VARCHAR) AS value FROM events
       UNION ALL SELECT event_id, 'user|seen|kind', event_type FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 'props|k', json_extract_string(props, '$.k') FROM events"""
)
def flatten_kv(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "events").select(
        "event_id",
        F.struct(
            F.col("user_id").alias("id"),
            F.struct(F.nullif("event_type", F.lit("error")).alias("kind")).alias("seen"),
        ).alias("user"),
        F.from_json("props", "map<string,int>").alias("props"),
    )
    flat = flatten_record(nested, ["user", "props"])
    return nested.select("event_id", F.explode(flat).alias("path", "value"))


# ---- joins

_CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
# Every order has a customer and every customer an order. So where a join is about rows without
# a partner, one side leaves some out.
_RICH = "c_acctbal > 2000"
_DEAR = "o_orderstatus = 'F' AND o_totalprice > 300000"


def _join_sides(spark: SparkSession, sf: str, customers: str = "true", orders: str = "true") -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf, "customer").where(customers).select("c_custkey", "c_name", "c_mktsegment"),
        table(spark, sf, "orders").where(orders).select("o_orderkey", "o_custkey", "o_totalprice"),
    )


def _joined(spark: SparkSession, sf: str, how: str, customers: str = "true", orders: str = "true") -> DataFrame:
    return joins.equi_join(*_join_sides(spark, sf, customers, orders), "c_custkey", "o_custkey", how)


@query(f"SELECT * FROM ({_CUSTOMERS}) JOIN ({_ORDERS}) ON c_custkey = o_custkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "inner")


@query(f"SELECT * FROM ({_CUSTOMERS}) LEFT JOIN ({_ORDERS} WHERE {_DEAR}) ON c_custkey = o_custkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "left", orders=_DEAR)


@query(f"SELECT * FROM ({_CUSTOMERS}) RIGHT JOIN ({_ORDERS}) ON c_custkey = o_custkey")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "right")


@query(f"SELECT * FROM ({_CUSTOMERS} WHERE {_RICH}) FULL JOIN ({_ORDERS}) ON c_custkey = o_custkey")
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "full", customers=_RICH)


@query(f"SELECT * FROM ({_CUSTOMERS}) SEMI JOIN ({_ORDERS} WHERE {_DEAR}) ON c_custkey = o_custkey")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "semi", orders=_DEAR)


@query(f"SELECT * FROM ({_CUSTOMERS}) ANTI JOIN ({_ORDERS} WHERE {_DEAR}) ON c_custkey = o_custkey")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf, "anti", orders=_DEAR)


@query(
    """SELECT l.o_orderkey AS o_orderkey_1, l.o_totalprice, r.o_orderkey, r.o_orderpriority
       FROM orders l JOIN orders r ON l.o_orderkey = r.o_orderkey"""
)
def sql_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return run_sql_join(
        orders.select("o_orderkey", "o_totalprice"),
        orders.select("o_orderkey", "o_orderpriority"),
        "SELECT l.*, r.o_orderkey, r.o_orderpriority FROM left l JOIN right r ON l.o_orderkey == r.o_orderkey",
    )


@query(
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, r.returns
       FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS returns FROM lineitem
                             WHERE l_returnflag = 'R' GROUP BY ALL) r
         ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey"""
)
def join_composite(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    returned = (
        lines.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("returns"))
    ).toDF("part", "supplier", "returns")
    kept = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    keys, others = ["l_partkey", "l_suppkey"], ["part", "supplier"]
    both = joins.equi_join(kept, returned, keys, others, skew_safe=["left"])
    return both.drop("part", "supplier")


@query(
    """SELECT l.o_orderkey, l.o_custkey, l.o_orderpriority,
              r.o_orderkey AS Ro_orderkey, r.o_custkey AS Ro_custkey, r.o_orderpriority AS Ro_orderpriority
       FROM orders l LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) r
         ON l.o_orderkey = r.o_orderkey"""
)
def self_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderpriority"]
    # The key is unique, so no side can be hot and one pass is enough.
    both = joins.equi_join(
        orders.select(*names),
        orders.where("o_totalprice > 200000").select(*names),
        "o_orderkey",
        "o_orderkey",
        "left",
        skew_safe=False,
    )
    return columns.rename_all(both, names + [f"R{n}" for n in names])


_MAPPED = [
    joins.MappedColumn("customer", "c_custkey", "o_custkey"),
    joins.MappedColumn("segment", left="c_mktsegment"),
    joins.MappedColumn("order_id", right="o_orderkey"),
    joins.MappedColumn("price", right="o_totalprice"),
]


@query(
    f"""SELECT c_custkey AS customer, c_mktsegment AS segment, o_orderkey AS order_id, o_totalprice AS price
        FROM ({_CUSTOMERS}) LEFT JOIN ({_ORDERS}) ON c_custkey = o_custkey"""
)
def join_mapped(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = _join_sides(spark, sf)
    return joins.mapped_join(customers, orders, "c_custkey", "o_custkey", _MAPPED)


@query(
    f"""SELECT coalesce(c_custkey, o_custkey) AS customer, c_mktsegment AS segment,
               o_orderkey AS order_id, o_totalprice AS price
        FROM ({_CUSTOMERS} WHERE {_RICH}) FULL JOIN ({_ORDERS}) ON c_custkey = o_custkey"""
)
def join_mapped_full(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = _join_sides(spark, sf, customers=_RICH)
    return joins.mapped_join(customers, orders, "c_custkey", "o_custkey", _MAPPED, "full")


@query("SELECT c_custkey, c_name, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.broadcast_join(customers, nations, "c_nationkey", "n_nationkey")


@query(
    """SELECT event_id, user_id, value, c_custkey, c_name
       FROM events JOIN customer ON user_id = c_custkey"""
)
def join_salted(spark: SparkSession, sf: str) -> DataFrame:
    events, customers = _event_sides(spark, sf)
    return joins.equi_join(events, customers, "user_id", "c_custkey", hot_rows=_hot_rows(events))


@query(
    """SELECT event_id, user_id, value, c_custkey, c_name
       FROM events FULL JOIN customer ON user_id = c_custkey"""
)
def join_salted_full(spark: SparkSession, sf: str) -> DataFrame:
    events, customers = _event_sides(spark, sf)
    return joins.equi_join(events, customers, "user_id", "c_custkey", "full", hot_rows=_hot_rows(events))


def _hot_rows(events: DataFrame) -> int:
    """A two-hundredth of the table: at the small scales every user has more than that."""
    return max(1, events.count() // 200)


def _event_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return table(spark, sf, "events").select("event_id", "user_id", "value"), customers


@query(
    """SELECT l_orderkey, o_orderkey, o_orderpriority, l_linenumber, l_quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def join_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    mark = uuid.uuid4().hex
    names = [f"bucketed_{side}_{mark}" for side in ("lines", "orders")]
    buckets = bucketed.buckets_for([lines, orders], 8)
    left = bucketed.write_bucketed(lines, names[0], ["l_orderkey"], buckets)
    right = bucketed.write_bucketed(orders, names[1], ["o_orderkey"], buckets)
    both = bucketed.bucketed_join(left, right)
    # The plan knows the files by now, and they go with the work folder.
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return both.select("l_orderkey", "o_orderkey", "o_orderpriority", "l_linenumber", "l_quantity")


# ---- aggregates


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank
       FROM events GROUP BY event_type"""
)
def value_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(aggregates.frequency(table(spark, sf, "events"), ["event_type"]))


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("SELECT DISTINCT p_type FROM part")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_type").distinct()


@query("SELECT count(nullif(event_type, 'error')) AS known, count(*) AS n FROM events")
def count_non_null(spark: SparkSession, sf: str) -> DataFrame:
    known = F.count(F.nullif("event_type", F.lit("error"))).alias("known")
    return table(spark, sf, "events").agg(known, F.count(F.lit(1)).alias("n"))


@query(
    """SELECT '199603' AS month_period, o_orderpriority, count(*) AS n FROM orders
       WHERE strftime(o_orderdate, '%Y%m') = '199603' GROUP BY o_orderpriority"""
)
def month_segment_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return aggregates.month_segment_counts(orders, "o_orderdate", "o_orderpriority", "199603")


@query(
    """SELECT '199603' AS month_period, o_orderpriority, count(*) AS n FROM orders
       WHERE strftime(o_orderdate, '%Y%m') = '199603' GROUP BY o_orderpriority"""
)
def month_segment_counts_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """The same over orders written by month, of which one folder is read."""
    orders = table(spark, sf, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyyMM").alias("month_period"))
    path = new_path(spark, "by_month")
    write_files(orders, FileTarget(path, "parquet", partition_by=["month_period"]))
    written = spark.read.parquet(path)
    return aggregates.month_segment_counts(written, "month_period", "o_orderpriority", "199603")


_DESCRIBED = """SELECT '{0}' AS column_name, count({0}) AS count, round(avg({0}), 4) AS mean,
  round(stddev_samp({0}), 4) AS stddev, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM lineitem"""


@query(" UNION ALL ".join(_DESCRIBED.format(c) for c in ("l_quantity", "l_discount", "l_linenumber")))
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    summary = aggregates.describe(lines, ["l_quantity", "l_discount", "l_linenumber"])
    return summary.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@query(
    """SELECT o_orderpriority, batch_no, count(*) AS n,
              string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS items
       FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS batch_no
             FROM orders) GROUP BY ALL"""
)
def collect_by_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    lists = aggregates.collect_by_key(
        orders, "o_orderpriority", ["o_orderkey", "o_orderstatus"], ["o_orderkey"], 100, unique=True
    )
    text = F.array_join(F.transform("items", lambda row: F.array_join(row, ":")), ",")
    return lists.withColumn("items", text)


@query("SELECT CAST(round(sum(CAST(l_quantity AS DECIMAL(18, 2))) * 5, 2) AS DOUBLE) AS result FROM lineitem")
def sum_scale(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    return aggregates.sum_scale(lines, "q", 5).select(F.col("result").cast("double").alias("result"))


@query(
    """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
              round(avg(o_custkey), 6) AS mean_customer
       FROM orders GROUP BY o_orderpriority"""
)
def salted_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderpriority",
        "o_custkey",
        "o_totalprice",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    result = skew.salted_aggregate(
        orders,
        ["o_orderpriority"],
        {
            "n": ("count", "o_custkey"),
            "low": ("min", "o_totalprice"),
            "high": ("max", "o_totalprice"),
            "total": ("sum", "price"),
            "mean_customer": ("avg", "o_custkey"),
        },
    )
    return result.withColumns(
        {"total": F.col("total").cast("double"), "mean_customer": F.round("mean_customer", 6)}
    )


@query(
    """SELECT user_id, event_id, ts, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return aggregates.keep_last(events, ["user_id"], ["ts", "event_id"])


# ---- order


@query(
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
       FROM orders QUALIFY rank <= 100"""
)
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranked(ranking.top_n(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 100))


@query(
    """SELECT o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS rank
       FROM orders QUALIFY rank <= 400"""
)
def top_n_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Only copies tie on both columns, so which of them are taken does not show."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    return ranked(ranking.top_n(orders, ["o_orderpriority", "o_orderstatus"], 400))


@query(
    """SELECT p_partkey, p_size, p_retailprice, p_brand,
              row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_brand DESC, p_partkey) AS position
       FROM part"""
)
def multi_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    order = [F.col(c).desc() for c in ("p_size", "p_retailprice", "p_brand")] + [F.col("p_partkey")]
    return ranking.with_position(parts, order, unique=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def row_slice(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.row_slice(orders, ["o_orderkey"], 1000, 1500, unique=True)


@query(
    """SELECT event_id, user_id, position FROM (
         SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events)
       WHERE position > 0 AND position < 100"""
)
def indexed_range(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    indexed = ranking.with_position(events, ["ts", "event_id"], unique=True)
    indexed = indexed.withColumn("position", F.col("position") - 1).drop("ts")
    return indexed.where("position > 0 AND position < 100")


@query(
    """SELECT l_orderkey, CAST(sum(price) AS DOUBLE) AS total FROM (
         SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price FROM lineitem
         QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) <= 3)
       GROUP BY l_orderkey"""
)
def topk_sum(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    best = ranking.top_k_sum(lines, ["l_orderkey"], "price", 3)
    return best.withColumn("total", F.col("total").cast("double"))


@query(
    """SELECT p_partkey, p_name, row_number() OVER (ORDER BY list_transform(string_split(p_name, ''),
                lambda c: CASE WHEN instr('zyxcdefgh', c) = 0 THEN 10 ELSE instr('zyxcdefgh', c) END),
              p_name, p_partkey) AS position FROM part"""
)
def custom_collation(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return ranking.custom_collation(parts, "p_name", "zyxcdefgh", ["p_partkey"])


@query(
    """WITH numbered AS (
         SELECT event_id, user_id, row_number() OVER w AS round,
                first_value(ts) OVER w AS first_ts, first_value(event_id) OVER w AS first_id
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, round,
              row_number() OVER (ORDER BY round, first_ts, first_id) AS position FROM numbered"""
)
def fair_interleave(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ranking.fair_interleave(events, "user_id", ["ts", "event_id"], unique=True).drop("ts")


# ---- sets, pairs, combinations


@query(
    """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier"""
)
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return customers.toDF("id", "nation", "balance").unionAll(suppliers)


@query(
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL BY NAME SELECT s_name AS name, s_suppkey AS id FROM supplier"""
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_suppkey AS id")
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query(
    """WITH v AS (SELECT DISTINCT p_size AS x FROM part)
       SELECT a.x AS low, b.x AS high FROM v a JOIN v b ON b.x = 36 - a.x AND a.x < b.x"""
)
def pairs_with_sum(spark: SparkSession, sf: str) -> DataFrame:
    return combine.pairs_with_sum(table(spark, sf, "part"), "p_size", 36)


@query(
    """WITH v AS (SELECT DISTINCT p_size AS x FROM part)
       SELECT a.x AS low, b.x AS high FROM v a JOIN v b ON b.x = a.x + 6"""
)
def pairs_with_diff(spark: SparkSession, sf: str) -> DataFrame:
    return combine.pairs_with_difference(table(spark, sf, "part"), "p_size", 6)


_BASKETS = "SELECT DISTINCT l_orderkey AS g, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey"


def _baskets(spark: SparkSession, sf: str, size: int) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    branded = joins.equi_join(lines, parts, "l_partkey", "p_partkey", skew_safe=["left"])
    branded = branded.select("l_orderkey", "p_brand")
    found = combine.item_combinations(branded, "l_orderkey", "p_brand", size, parts.select("p_brand"))
    return found.withColumn("items", F.array_join("items", "+"))


@query(
    f"""WITH b AS ({_BASKETS}) SELECT x.i || '+' || y.i AS items, count(*) AS support
        FROM b x JOIN b y ON x.g = y.g AND x.i < y.i GROUP BY ALL"""
)
def item_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _baskets(spark, sf, 2)


@query(
    f"""WITH b AS ({_BASKETS}) SELECT x.i || '+' || y.i || '+' || z.i AS items, count(*) AS support
        FROM b x JOIN b y ON x.g = y.g AND x.i < y.i JOIN b z ON y.g = z.g AND y.i < z.i GROUP BY ALL"""
)
def item_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _baskets(spark, sf, 3)


_PARTS = "SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem"


@query(
    f"""WITH b AS ({_PARTS}) SELECT x.i || '+' || y.i AS items, count(*) AS support
        FROM b x JOIN b y ON x.g = y.g AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2"""
)
def item_pairs_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs out of all parts, far more than one mask holds."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    found = combine.item_combinations(lines, "l_orderkey", "l_partkey", 2, min_support=2)
    return found.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), "+"))


@query(
    f"""WITH b AS (SELECT DISTINCT l_orderkey // 2 AS g, l_partkey AS i FROM lineitem)
        SELECT x.i || '+' || y.i || '+' || z.i AS items, count(*) AS support
        FROM b x JOIN b y ON x.g = y.g AND x.i < y.i JOIN b z ON y.g = z.g AND y.i < z.i
        GROUP BY ALL HAVING count(*) >= 2"""
)
def item_triples_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Triples out of all parts; few pairs are frequent, so few triples are built."""
    lines = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("g"), "l_partkey")
    found = combine.item_combinations(lines, "g", "l_partkey", 3, min_support=2)
    return found.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), "+"))
