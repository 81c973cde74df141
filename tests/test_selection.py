from itertools import permutations

import pytest
from pyspark.sql import functions as F

from opslens.operators import selection as sel
from opslens.operators.maintenance import ACTIONS, preferences, uniform_actions


@pytest.fixture(scope="module")
def databases(spark):
    data = [
        (1, "master", "S", "ONLINE", True), (5, "Sales_EU", "U", "ONLINE", False),
        (6, "SalesXEU", "U", "OFFLINE", False), (7, "sales_us", "U", "ONLINE", True),
        (8, "HR", "U", "ONLINE", False), (9, None, "U", "ONLINE", False),
    ]
    return spark.createDataFrame(
        data, "database_id long, name string, database_type string, state_desc string, is_read_only boolean"
    )


def chosen(databases, spec, **kw):
    picked = sel.select_by_spec(databases, spec, type_column="database_type", **kw).where("selected")
    return {r["name"]: r["start_position"] for r in picked.collect()}


def test_wildcard_and_literal_underscore(databases):
    assert chosen(databases, "Sales_%") == {"Sales_EU": 1, "sales_us": 1}


def test_exclusion_wins_in_any_order(databases):
    items = ["USER_DATABASES", "-Sales_EU", "Sales%"]
    results = [set(chosen(databases, ",".join(p))) for p in permutations(items)]
    assert all(r == {"SalesXEU", "sales_us", "HR"} for r in results)


def test_lowest_including_position(databases):
    assert chosen(databases, "HR, [sales_us] ,%Sales%")["sales_us"] == 2


def test_keywords(databases):
    assert set(chosen(databases, "SYSTEM_DATABASES")) == {"master"}
    assert set(chosen(databases, "ALL_DATABASES,-USER_DATABASES")) == {"master"}


def test_no_list_selects_all(databases):
    assert len(chosen(databases, None)) == 6


@pytest.mark.parametrize("spec", ["", "a,,b", "-", "[]", "a.b"])
def test_bad_items_are_refused(spec):
    with pytest.raises(ValueError, match="item|supported"):
        sel.parse_spec(spec, parts=1 if spec != "a.b" else 3)


def test_multi_part_names():
    (item,) = sel.parse_spec("db.dbo.t", parts=4, optional_last=True)
    assert item.parts == ("db", "dbo", "t", "%")
    (item,) = sel.parse_spec("[a.b].dbo.[t]", parts=3)
    assert item.parts == ("a.b", "dbo", "t")
    assert sel.parse_spec("ALL_INDEXES", parts=4)[0].parts == ("%",) * 4


def test_keyword_list():
    assert sel.parse_list("a, b", ["a", "b", "c"]) == ["a", "b"]
    for bad in ("a,a", "x"):
        with pytest.raises(ValueError, match="supported"):
            sel.parse_list(bad, ["a", "b"])


def test_optional_filters(databases, rows):
    assert sel.contains_filters(databases, {"name": "SALES", "state_desc": None}).count() == 3
    assert sel.contains_filters(databases, {"name": "ales_e"}).count() == 2  # _ is a wildcard
    assert sel.like_filters(databases, {"name": "sales_%"}).count() == 3
    assert sel.eq_filters(databases, {"state_desc": "OFFLINE"}).count() == 1
    assert sel.tristate(databases, "is_read_only", True).count() == 2
    assert sel.tristate(databases, "is_read_only", None).count() == 6
    assert sel.tristate(databases, "database_id", False).count() == 0
    assert sel.exclude_ids(databases, "database_id", [1, 5]).count() == 4


def test_caller_predicates_are_checked(databases):
    names = databases.columns
    assert sel.where_expr(databases, "database_id > 5 AND name LIKE 'S%'", names).count() == 1
    with pytest.raises(ValueError, match="word"):
        sel.where_expr(databases, "reflect('java.lang.System', 'exit') = 1", names)
    with pytest.raises(ValueError, match="ordering"):
        sel.order_expr(databases, "rand()", names)
    ids = [r[0] for r in sel.order_expr(databases, "database_id DESC", names).collect()]
    assert ids == sorted(ids, reverse=True)


def test_letters_and_blank_match(spark):
    df = spark.createDataFrame([("c",), ("x",), (None,)], "d string")
    assert df.where(sel.in_chars(F.col("d"), "CDE")).count() == 2
    assert df.where(sel.match_or_all("d", "  ")).count() == 3
    assert df.where(sel.match_or_all("d", " x ")).count() == 1


def test_require_nonempty(databases):
    sel.require_nonempty(databases, "present")
    with pytest.raises(LookupError, match="role"):
        sel.require_nonempty(databases.where("1 = 0"), "role is absent")


def test_filter_databases(databases):
    assert sel.filter_databases(databases, system_only=True).count() == 1
    assert sel.filter_databases(databases, user_only=True, database_list="hr, master").count() == 1
    assert sel.filter_databases(databases, name_pattern="%", is_read_only=True).count() == 2


def test_missing_items(databases, rows):
    assert rows(sel.spec_missing("hr,-gone,x%,Master", databases, "name")) == [("gone",)]


def test_outside_selection(spark, databases, rows):
    picked = sel.select_by_spec(databases, "HR", type_column="database_type")
    sub = spark.createDataFrame([("HR",), ("Sales_EU",)], "name string")
    assert rows(sel.outside_selection(sub, picked)) == [("Sales_EU",)]


def test_duplicate_names_need_a_selected_member(spark, rows):
    df = spark.createDataFrame(
        [("A", True), ("a", False), ("b", False), ("B", False), ("", True), ("", True)],
        "name string, chosen boolean",
    )
    assert rows(sel.duplicate_names(df, "name", F.col("chosen"), scope=()), "name") == [("A",), ("a",)]


def test_order_modes(databases):
    picked = sel.select_by_spec(databases, "HR,Sales%", type_column="database_type").where("selected")
    by_list = sel.order_databases(picked).orderBy("order_no").collect()
    assert [r["name"] for r in by_list] == ["HR", "SalesXEU", "Sales_EU", "sales_us"]
    by_name = sel.order_databases(picked, "DATABASE_NAME_DESC").orderBy("order_no").collect()
    assert [r["name"] for r in by_name] == ["sales_us", "Sales_EU", "SalesXEU", "HR"]
    with pytest.raises(ValueError, match="order mode"):
        sel.order_databases(picked, "DATABASE_COLOUR_ASC")


def test_uniform_actions():
    same = ",".join(ACTIONS[:2])
    assert uniform_actions(preferences(same, same, same))
    assert not uniform_actions(preferences())
    with pytest.raises(ValueError, match="supported"):
        preferences(medium="INDEX_POLISH")
