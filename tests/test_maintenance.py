import pytest
from pyspark.sql import functions as F

from opslens.operators import maintenance as m

INDEX = {
    "database_name": "D", "schema_name": "dbo", "object_name": "T", "index_name": "I", "index_type": 1,
    "allow_page_locks": True, "on_read_only_group": False, "is_memory_optimized": None, "is_image_text": False,
    "is_new_lob": False, "is_file_stream": False, "is_column_store": False, "is_computed": False,
    "is_timestamp": False, "resumable": False, "page_count": 5000, "frag_pct": 50.0, "is_partition": False,
    "partition_number": 1,
}
SCHEMA = """database_name string, schema_name string, object_name string, index_name string, index_type int,
  allow_page_locks boolean, on_read_only_group boolean, is_memory_optimized boolean, is_image_text boolean,
  is_new_lob boolean, is_file_stream boolean, is_column_store boolean, is_computed boolean, is_timestamp boolean,
  resumable boolean, page_count long, frag_pct double, is_partition boolean, partition_number int"""


def decide(spark, preferred=None, command=None, **overrides):
    options = {k: overrides.pop(k) for k in ("min_pages", "max_pages", "edition") if k in overrides}
    df = spark.createDataFrame([tuple({**INDEX, **overrides}.values())], SCHEMA)
    out = m.choose_action(df, preferred, **options)
    return out.withColumn("command_text", m.index_command(**(command or {}))).first()


@pytest.mark.parametrize(
    ("overrides", "action"),
    [
        ({}, m.REBUILD_ONLINE),
        ({"frag_pct": 30.0}, m.REBUILD_ONLINE),
        ({"frag_pct": 29.9}, m.REORGANIZE),
        ({"frag_pct": 5.0}, m.REORGANIZE),
        ({"frag_pct": 4.9}, None),
        ({"frag_pct": None}, None),
        ({"page_count": 999}, None),
        ({"page_count": 999, "min_pages": 0}, m.REBUILD_ONLINE),
        ({"max_pages": 4999}, None),
        ({"page_count": None}, None),
        ({"on_read_only_group": True}, None),
        ({"is_memory_optimized": True}, None),
        ({"edition": 2}, m.REBUILD_OFFLINE),
        ({"is_image_text": True}, m.REBUILD_OFFLINE),
        ({"is_new_lob": True}, m.REBUILD_ONLINE),
        ({"is_new_lob": True, "is_file_stream": True}, m.REBUILD_OFFLINE),
        ({"index_type": 2, "is_new_lob": True}, m.REBUILD_ONLINE),
        ({"index_type": 5, "is_column_store": True}, m.REBUILD_OFFLINE),
        ({"index_type": 6, "is_column_store": True}, None),
        ({"frag_pct": 10.0, "allow_page_locks": False}, m.REBUILD_ONLINE),
        ({"frag_pct": 10.0, "allow_page_locks": False, "index_type": 5}, m.REORGANIZE),
        ({"resumable": True, "frag_pct": 0.0}, m.REBUILD_ONLINE),
    ],
)
def test_action(spark, overrides, action):
    assert decide(spark, **overrides)["index_action"] == action


def test_uniform_preferences_ignore_fragmentation(spark):
    every = m.preferences(m.REORGANIZE, m.REORGANIZE, m.REORGANIZE)
    assert decide(spark, every, frag_pct=None)["index_action"] == m.REORGANIZE


def test_commands(spark):
    assert decide(spark)["command_text"] == (
        "ALTER INDEX [I] ON [D].[dbo].[T] REBUILD WITH (SORT_IN_TEMPDB = OFF, ONLINE = ON, RESUMABLE = OFF)"
    )
    assert decide(spark, frag_pct=10.0, is_partition=True, partition_number=3)["command_text"] == (
        "ALTER INDEX [I] ON [D].[dbo].[T] REORGANIZE PARTITION = 3 WITH (LOB_COMPACTION = ON)"
    )
    assert decide(spark, resumable=True, allow_page_locks=False)["command_text"] == (
        "ALTER INDEX [I] ON [D].[dbo].[T] RESUME WITH (MAXDOP = 1)"
    )
    assert decide(spark, frag_pct=0.0)["command_text"] is None


STATS = {
    "stats_id": 1, "index_id": 1, "index_type": 1, "index_action": None, "is_partition": False,
    "partition_number": 1, "partition_count": 1, "is_incremental": False, "row_cnt": 1000,
    "modification_counter": 10, "no_recompute": False,
}
STATS_SCHEMA = """stats_id int, index_id int, index_type int, index_action string, is_partition boolean,
  partition_number int, partition_count int, is_incremental boolean, row_cnt long, modification_counter long,
  no_recompute boolean"""


@pytest.mark.parametrize(
    ("overrides", "options", "due"),
    [
        ({}, {}, True),
        ({}, {"update": None}, False),
        ({"index_id": None, "index_type": None}, {"update": "INDEX"}, False),
        ({"index_id": None, "index_type": None}, {"update": "COLUMNS"}, True),
        ({"index_type": 5}, {}, False),
        ({"modification_counter": 0}, {"only_modified": True}, False),
        ({"modification_counter": None}, {"only_modified": True}, False),
        ({}, {"modification_level": 1}, True),
        ({}, {"modification_level": 2}, False),
        ({"modification_counter": 1000}, {"modification_level": 101}, True),  # sqrt(1000 * 1000)
        ({"modification_counter": 999}, {"modification_level": 101}, False),
        ({"row_cnt": 0, "modification_counter": 0}, {"modification_level": 1}, False),
        ({"index_action": m.REBUILD_ONLINE}, {}, False),
        ({"index_action": m.REORGANIZE}, {}, True),
        ({"is_partition": True, "partition_count": 2}, {}, False),
        ({"is_partition": True, "partition_count": 2, "is_incremental": True}, {"partition_level": True}, True),
        ({"is_partition": True, "index_action": m.REBUILD_ONLINE}, {}, True),
    ],
)
def test_statistics_update(spark, overrides, options, due):
    df = spark.createDataFrame([tuple({**STATS, **overrides}.values())], STATS_SCHEMA)
    assert m.choose_stats_update(df, **options).first()["update_statistics"] is due


def test_statistics_mode(spark):
    df = spark.createDataFrame([tuple(STATS.values())], STATS_SCHEMA)
    assert df.select(m.stats_mode(100)).first()[0] == "FULLSCAN"
    assert df.select(m.stats_mode(5, resample=True)).first()[0] == "SAMPLE 5 PERCENT, RESAMPLE"
    assert df.select(m.stats_mode()).first()[0] is None
    incremental = df.withColumn("is_incremental", F.lit(True))
    assert incremental.select(m.stats_mode(5, partition_level=True)).first()[0] == "RESAMPLE"


def test_check_commands_do_not_overlap(spark):
    databases = spark.createDataFrame([(1, "D")], "database_id long, name string")
    for bad in ("CHECKDB,CHECKTABLE", "CHECKALL", "CHECKDB,CHECKDB", "CHECKFILEGROUP,CHECKALLOC"):
        with pytest.raises(ValueError, match="supported|covers"):
            m.check_plan(databases, bad, scope=())
    row = m.check_plan(databases, no_index=True, tab_lock=True, scope=()).first()
    assert row["command_text"] == (
        "DBCC CHECKDB ([D], NOINDEX) WITH NO_INFOMSGS, ALL_ERRORMSGS, DATA_PURITY, TABLOCK"
    )
