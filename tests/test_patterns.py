"""Selection lists from a table against the expression form, server by server."""

import random

from pyspark.sql import functions as F

from opslens.operators.patterns import distinct_patterns, parse_items, select_by_list
from opslens.operators.selection import select_by_spec

NAMES = "server_id int, database_id int, name string, kind string, grouped boolean"


def draw_name(draw):
    return "".join(draw.choices("abA_\\].é%"[:8], k=draw.randint(1, 7)))


def draw_item(draw):
    body = "".join(draw.choices(["a", "b", "B", "_", "%", "%", "\\", "é", "ab"], k=draw.randint(1, 5)))
    if draw.random() < 0.1:
        body = draw.choice(["USER_DATABASES", "system_databases", "ALL_DATABASES", "AVAILABILITY_GROUP_DATABASES"])
    elif draw.random() < 0.2:
        body = f"[{body}]"
    return draw.choice(["", "", "-"]) + body


def test_equals_one_expression_per_server(spark, rows):
    draw = random.Random(6)
    databases = [(s, i, draw_name(draw), draw.choice("SU"), draw.choice([True, False, None])) for s in range(6) for i in range(120)]
    databases += [(0, 900, None, "U", None), (1, 901, "x", None, None), (0, 5, databases[5][2], "U", True)]
    lists = {s: [draw_item(draw) for _ in range(12)] for s in range(5)}  # the last server has no list
    items = [(s, k + 1, f" {t}\n") for s, ts in lists.items() for k, t in enumerate(ts)] + [(0, 99, None), (0, 98, "-")]
    df = spark.createDataFrame(databases, NAMES)
    got = select_by_list(
        df, spark.createDataFrame(items, "server_id int, position int, item string"),
        scope=["server_id"], type_column="kind", group_flag_column="grouped",
    )
    assert got.where("server_id = 5 AND (selected OR start_position IS NOT NULL)").isEmpty()
    for s, texts in lists.items():
        one = select_by_spec(
            df.where(F.col("server_id") == s), ",".join(texts), ("name",), type_column="kind", group_flag_column="grouped"
        )
        assert rows(got.where(F.col("server_id") == s)) == rows(one)


def test_ten_thousand_patterns_need_no_nested_loop(spark):
    names = spark.range(20_000).select((F.col("id") % 50).alias("server_id"), F.concat(F.lit("db_"), "id").alias("name"))
    number = F.col("id").cast("string")
    item = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("DB_"), number))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("db_1"), number, F.lit("%")))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("%_"), number))
        .otherwise(F.concat(F.lit("-%b_"), number, F.lit("%9")))
    )
    items = spark.range(10_000).select((F.col("id") % 50).alias("server_id"), F.col("id").alias("position"), item.alias("item"))
    chosen = select_by_list(names, items, scope=["server_id"]).where("selected")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert chosen.count() > 5000


def test_copies_of_a_pattern_are_filed_once(spark, rows):
    texts = ["a%b%", "[a%b%]", "A%B%", "-a%b%", "%", "ALL_DATABASES", "USER_DATABASES", "%x"]
    item = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % len(texts) + 1).cast("int"))
    items = spark.range(4_000).select((F.col("id") % 2).alias("server_id"), (F.col("id") + 5).alias("position"), item.alias("item"))
    filed = distinct_patterns(parse_items(items), ["server_id"])
    assert rows(filed, "server_id", "include", "pattern", "wanted_type", "__position") == [
        (0, True, "%", "U", 11), (0, True, "%", None, 9), (0, True, "a%b%", None, 5),
        (1, False, "a%b%", None, 8), (1, True, "%", None, 10), (1, True, "%x", None, 12), (1, True, "a%b%", None, 6),
    ]
    names = spark.createDataFrame([(0, "aXbX", "S"), (0, "c", "U"), (1, "aXbX", "U"), (1, "cx", "S")], "server_id int, name string, kind string")
    got = select_by_list(names, items, scope=["server_id"], type_column="kind")
    assert rows(got, "server_id", "name", "selected", "start_position") == [
        (0, "aXbX", True, 5), (0, "c", True, 9), (1, "aXbX", False, 6), (1, "cx", True, 10),
    ]
