import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions import schema as S
from tableloom.functions.collation import collation_key
from tableloom.functions.decode import decode_positional, encode_positional, pad_ragged, split_rejects
from tableloom.functions.flatten import flatten_record
from tableloom.functions.names import normal_names, unique_names

NAMES = st.lists(st.sampled_from(["a", "A", "b", "a_1", "A_2", "bbl_a", "a_0", "id"]), max_size=9)


@given(names=NAMES, style=st.sampled_from(["suffix", "prefix", "position"]))
@settings(max_examples=300)
def test_names_are_unique_and_the_last_one_stays(names, style):
    result = unique_names(names, style)
    assert len({n.lower() for n in result}) == len(names) == len(result)
    for name in {n.lower() for n in names}:
        last = max(i for i, n in enumerate(names) if n.lower() == name)
        assert result[last] == names[last]


def test_repair_styles():
    assert unique_names(["id", "x", "id", "y", "id"]) == ["id_1", "x", "id_2", "y", "id"]
    assert unique_names(["id", "x", "id"], "prefix") == ["bbl_id", "x", "id"]
    assert unique_names(["x", "id", "id"], "position") == ["x", "id_1", "id"]
    assert unique_names(["ID", "id"]) == ["ID_1", "id"]
    with pytest.raises(ValueError):
        unique_names(["a"], "other")


def test_normal_names():
    assert normal_names(["Order ID", "Units Sold"]) == ["Order_ID", "Units_Sold"]
    assert normal_names(["Order ID", "order_id"], upper=True) == ["ORDER_ID_1", "ORDER_ID"]


def test_import_orders_and_drops_inactive_columns():
    specs = S.import_schema(
        '{"B": {"type": "FloatType()", "order": 2}, "A": {"type": "Odd()", "order": 1},'
        ' "C": {"type": "IntegerType()", "order": 3, "active": false}}'
    )
    assert [s.name for s in specs] == ["A", "B", "C"]
    assert S.struct_type(specs) == T.StructType(
        [T.StructField("A", T.StringType()), T.StructField("B", T.FloatType())]
    )


def test_export_keeps_every_column_and_imports_again(spark):
    df = spark.createDataFrame(
        [], "i int, l long, s string, f float, d double, b boolean, t timestamp, m decimal(9,2), a date"
    )
    descriptor = S.export_schema(df)
    assert list(descriptor) == ["I", "L", "S", "F", "D", "B", "T", "M", "A"]
    assert [d["order"] for d in descriptor.values()] == list(range(1, 10))
    back = S.struct_type(S.import_schema(descriptor))
    assert [f.dataType for f in back] == [f.dataType for f in df.schema]


@pytest.mark.parametrize(
    "text,kind,expected",
    [
        ("12.9", T.IntegerType(), 12),
        ("-12.9", T.IntegerType(), -12),
        ("1e20", T.IntegerType(), None),
        ("nan", T.IntegerType(), None),
        ("x", T.DoubleType(), None),
        ("9007199254740993", T.LongType(), 9007199254740993),
        ("7.5", T.LongType(), 7),
        ("text", T.StringType(), "text"),
        (None, T.IntegerType(), None),
    ],
)
def test_coercion(spark, text, kind, expected):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(S.from_text(F.col("c"), S.ColumnSpec("c", kind, 1))).first()[0] == expected


def test_apply_schema_with_dates(spark):
    df = spark.createDataFrame([("03/02/2020", "1.5"), ("bad", "x")], "day string, n string")
    typed = S.apply_schema(
        df,
        {"n": {"type": "DoubleType()", "order": 1}, "day": {"type": "DateType()", "order": 2, "date_format": "dd/MM/yyyy"}},
    )
    assert [tuple(r) for r in typed.collect()] == [(1.5, dt.date(2020, 2, 3)), (None, None)]
    with pytest.raises(ValueError):
        S.apply_schema(df, {"other": {"type": "StringType()"}})


SPECS = S.import_schema(
    {
        "ID": {"type": "LongType()", "order": 1},
        "PRICE": {"type": "DoubleType()", "order": 2},
        "NAME": {"type": "StringType()", "order": 3},
    }
)


@given(
    rows=st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)),
            st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False)),
            st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"))),
        ),
        min_size=1,
        max_size=8,
    )
)
@settings(max_examples=15, deadline=None)
def test_encode_then_decode_gives_the_row_back(spark, rows):
    df = spark.createDataFrame(rows, "a long, b double, c string")
    good, rejects = split_rejects(
        decode_positional(df.select(encode_positional(["a", "b", "c"]).alias("value")), SPECS)
    )
    assert rejects.isEmpty()
    assert [tuple(r) for r in good.collect()] == [tuple(r) for r in df.collect()]


def test_bad_cells_are_named(spark):
    df = spark.createDataFrame(
        [('["1","2.5","x"]',), ('["one","2","x"]',), ('["1","b"]',), ("no json",), (None,), ('["1",null,null]',)],
        "value string",
    )
    good, rejects = split_rejects(decode_positional(df, SPECS))
    assert [tuple(r) for r in good.collect()] == [(1, 2.5, "x"), (1, None, None)]
    assert [r.decode_errors for r in rejects.collect()] == ["ID", "PRICE", "value", "value"]


def test_padding(spark):
    specs = S.import_schema(
        {"C": {"type": "StringType()", "order": 3}, "A": {"type": "StringType()", "order": 1},
         "B": {"type": "StringType()", "order": 2, "active": False}}
    )
    df = spark.createDataFrame([(["1"],), (["1", "2", "3", "4"],), ([],)], "cells array<string>")
    assert [tuple(r) for r in pad_ragged(df, specs, "cells").collect()] == [("1", ""), ("1", "3"), ("", "")]


def test_flatten(spark):
    df = spark.sql(
        """SELECT named_struct('b', 1, 'c', named_struct('d', 2.5D, 'e', cast(null AS string))) AS a,
                  map('x', map('y', true)) AS m, map('k', named_struct('z', 'v')) AS n, cast(null AS map<string,int>) AS o,
                  encode('raw', 'utf-8') AS raw"""
    )
    flat = df.select(flatten_record(df).alias("f")).first().f
    assert flat == {"a|b": "1", "a|c|d": "2.5", "m|x|y": "true", "n|k|z": "v", "raw": "raw"}
    with pytest.raises(TypeError):
        flatten_record(spark.sql("SELECT array(1) AS a"))


WORDS = st.lists(st.text("toxkabc-]^\\$ é"), min_size=1, max_size=12)


@given(words=WORDS, order=st.sampled_from(["toxk", "]^-\\", "z", "$é "]))
@settings(max_examples=20, deadline=None)
def test_collation(spark, words, order):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in df.orderBy(collation_key(F.col("w"), order), "w").collect()]
    place = {c: i for i, c in enumerate(order)}
    assert got == sorted(words, key=lambda w: ([place.get(c, len(order)) for c in w], w.encode()))


def test_collation_example(spark):
    df = spark.createDataFrame([(w,) for w in ("ox", "kit", "to", "ok", "x", "tk", "o")], "w string")
    got = [r.w for r in df.orderBy(collation_key(F.col("w"), "toxk")).collect()]
    assert got == ["to", "tk", "o", "ox", "ok", "x", "kit"]
