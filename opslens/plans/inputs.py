"""Telemetry views over the supplied test tables.

A collector would deliver these rows.  Here they are projections of whole test
tables, written in SQL both Spark and the oracle engine accept, so both sides
see the same input.  ``{name}`` is a table, ``{ts}`` the zone-free timestamp type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["v_session"] = """
SELECT c_custkey + 1 AS session_id,
  CASE WHEN (c_custkey + 1) % 7 = 0 OR c_custkey = 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(FLOOR((c_custkey + 1) / 2) AS BIGINT) END AS blocking_session_id,
  c_name AS login_name, concat('HOST', c_nationkey) AS host_name,
  concat('DB', c_nationkey % 5) AS database_name, c_mktsegment AS status,
  c_custkey % 10 <> 0 AS is_user_process, c_custkey % 7 AS isolation_level,
  c_nationkey % 3 AS open_transaction_count,
  CASE c_custkey % 6
    WHEN 0 THEN concat('SQLAgent - TSQL JobStep (Job 0x', upper(md5(CAST(c_custkey * 2 AS STRING))),
                       ' : Step ', c_custkey % 4 + 1, ')')
    WHEN 1 THEN 'Microsoft SQL Server Management Studio - Query'
    WHEN 2 THEN 'SQL Monitor 9'
    WHEN 3 THEN 'DatabaseMail - X'
    WHEN 4 THEN 'Microsoft SQL Server'
    ELSE concat('app-', c_nationkey) END AS program_name
FROM {customer}
"""

VIEWS["v_connection"] = """
SELECT c_custkey + 1 AS session_id, concat('10.0.', c_nationkey, '.', c_custkey % 250) AS client_net_address,
  CASE WHEN c_custkey % 3 = 0 THEN 'Shared memory' ELSE 'TCP' END AS net_transport,
  CASE WHEN c_custkey % 2 = 0 THEN 'NTLM' ELSE 'SQL' END AS auth_scheme
FROM {customer}
"""

VIEWS["v_job"] = """
SELECT concat('job-', p_partkey) AS name, p_partkey AS job_number,
  concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2), '-', substr(h, 11, 2),
         substr(h, 9, 2), '-', substr(h, 15, 2), substr(h, 13, 2), '-', substr(h, 17, 4), '-',
         substr(h, 21, 12)) AS job_id,
  md5(CAST(p_partkey % 7 AS STRING)) AS owner_sid
FROM (SELECT p_partkey, upper(md5(CAST(p_partkey AS STRING))) AS h FROM {part}) x
"""

VIEWS["v_job_step"] = """
SELECT concat('job-', p_partkey) AS job_name, p_partkey % 3 + 1 AS step_id,
  CASE WHEN p_size % 4 = 0 THEN 'CmdExec' ELSE 'TSQL' END AS subsystem,
  CASE WHEN p_partkey % 6 = 0 THEN concat('IF sys.fn_hadr_is_primary_replica(DB_NAME()) = 1 EXEC run_', p_partkey)
       ELSE concat('EXEC run_', p_partkey) END AS command,
  n_name AS database_name
FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25
"""

VIEWS["v_request"] = """
SELECT o_orderkey AS request_id, o_custkey + 1 AS session_id,
  CASE o_orderstatus WHEN 'F' THEN 'BACKUP DATABASE' WHEN 'O' THEN 'SELECT' ELSE 'RESTORE LOG' END AS command,
  o_orderpriority AS status, o_orderdate AS start_time, concat('DB', o_custkey % 25) AS database_name,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(FLOOR(o_custkey / 2) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS blocking_session_id,
  CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS total_elapsed_ms,
  CAST(FLOOR(o_totalprice * 10) AS BIGINT) AS cpu_ms,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS estimated_completion_ms,
  CAST(o_orderkey % 10000 AS DOUBLE) / 100 AS percent_complete, o_custkey AS sql_handle,
  2 * (o_orderkey % 50) AS statement_start_offset,
  CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 2 * (o_orderkey % 50) + 2 * (o_custkey % 80) END AS statement_end_offset,
  o_orderkey % 7 AS isolation_level
FROM {orders}
"""

VIEWS["v_batch"] = "SELECT doc_id AS sql_handle, text FROM {documents}"

VIEWS["v_task"] = """
SELECT DISTINCT l_orderkey AS request_id, l_linenumber AS exec_context_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'SUSPENDED' ELSE 'RUNNING' END AS task_state
FROM {lineitem}
"""

VIEWS["v_wait"] = """
SELECT l_orderkey AS request_id, l_linenumber AS exec_context_id,
  CASE l_returnflag WHEN 'A' THEN 'PAGELATCH_SH' WHEN 'N' THEN 'PAGEIOLATCH_EX' ELSE 'LCK_M_X' END AS wait_type,
  concat('5:1:', CASE l_linenumber % 4 WHEN 0 THEN l_partkey * 8088 WHEN 1 THEN l_suppkey * 511232
         WHEN 2 THEN l_suppkey * 511232 + 1 ELSE l_partkey END) AS resource_description,
  CASE l_linenumber % 5 WHEN 0 THEN concat('KEY: 5:', l_partkey, ' (8194443284a0)')
       WHEN 1 THEN concat('OBJECT: 30:', CAST(FLOOR(l_partkey / 20) AS BIGINT), ':0 ')
       WHEN 2 THEN concat('PAGE: 30:1:', l_partkey)
       WHEN 3 THEN concat('RID: 30:1:', l_partkey, ':', l_linenumber) ELSE '' END AS wait_resource
FROM {lineitem}
"""

VIEWS["v_grant"] = """
SELECT o_orderkey AS request_id, o_custkey + CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS session_id,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS requested_memory_kb,
  CAST(FLOOR(o_totalprice * 0.5) AS BIGINT) AS granted_memory_kb
FROM {orders}
"""

VIEWS["v_group"] = """
SELECT n_nationkey % 3 AS server_id, CAST(FLOOR(n_nationkey / 3) AS BIGINT) AS group_id, n_name AS name FROM {nation}
"""

VIEWS["v_poll"] = """
SELECT concat('S', user_id % 7) AS server_id, CAST(date_trunc('hour', ts) AS {ts}) AS snapshot_ts, CAST(ts AS DATE) AS snapshot_date,
  concat('DB', user_id) AS database_name, CAST(event_id AS DOUBLE) AS log_size_mb, value AS log_used_percent,
  CAST(event_id % 3 AS INT) AS status
FROM {events}
"""

VIEWS["v_partition"] = """
SELECT CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 30 END AS database_id,
  CAST(FLOOR(p_partkey / 3) AS BIGINT) AS hobt_id, CAST(FLOOR(p_partkey / 60) AS BIGINT) AS object_id,
  p_size % 3 AS index_id, p_partkey * 10 AS partition_id
FROM {part}
"""

VIEWS["v_wait_name"] = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 30 END AS database_id,
  CAST(FLOOR(s_suppkey / 3) AS BIGINT) AS object_id, s_name AS object_name
FROM {supplier}
"""

VIEWS["v_file"] = """
SELECT database_id, file_id, concat('DB', database_id) AS database_name, p_name AS file_name,
  CASE WHEN file_id % 4 = 0 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
  CASE WHEN file_id % 4 = 0 THEN NULL ELSE p_type END AS group_name,
  CAST(FLOOR(p_retailprice * 1280) AS BIGINT) * (file_id % 3) AS size_pages,
  CAST(FLOOR(p_retailprice * 1280 * p_size / 60) AS BIGINT) * (file_id % 3) AS used_pages,
  substr('cdef', CAST(file_id % 4 AS INT) + 1, 1) AS volume_mount_point,
  CASE WHEN file_id % 4 = 3 THEN '' ELSE concat('Vol', file_id % 4) END AS logical_volume_name,
  (file_id % 4 + 1) * 4000000000000 AS total_bytes, (file_id % 4 + 1) * 1000000000000 AS available_bytes,
  concat('D:', chr(92), 'data', chr(92), 'f', file_id, '.mdf') AS physical_name
FROM (SELECT p_partkey AS file_id, CAST(FLOOR(p_partkey / 8) AS BIGINT) AS database_id, p_name, p_type,
             p_retailprice, p_size FROM {part}) x
"""

VIEWS["v_snapshot"] = """
SELECT o_custkey AS source_database_id, o_orderkey AS database_id, o_orderdate AS create_date FROM {orders}
"""

VIEWS["v_snapfile"] = """
SELECT l_orderkey AS database_id, l_linenumber AS file_id,
  CAST(FLOOR(l_extendedprice) AS BIGINT) AS size_pages,
  CAST(FLOOR(l_quantity) AS BIGINT) * 1048576 AS size_on_disk_bytes
FROM {lineitem}
"""

VIEWS["v_rowgroup"] = """
SELECT l_suppkey AS object_id, concat('T', l_suppkey) AS object_name, 'dbo' AS schema_name,
  concat('CCI_', l_suppkey) AS index_name, l_suppkey % 5 <> 0 AS is_partitioned,
  CAST(year(l_shipdate) - 1994 AS INT) AS partition_number, l_shipdate AS created_time,
  CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'COMPRESSED' END AS state_desc,
  CASE l_returnflag WHEN 'A' THEN 'INDEX_BUILD' WHEN 'N' THEN 'TUPLE_MOVER' ELSE NULL END AS transition_desc,
  CASE WHEN l_discount >= 0.08 THEN CAST(FLOOR(l_quantity) AS BIGINT) ELSE 0 END AS deleted_rows
FROM {lineitem}
"""

VIEWS["v_index_prev"] = """
SELECT l_suppkey % 25 AS database_id, l_partkey AS object_id, l_linenumber AS partition_number,
  count(*) AS row_cnt, CAST(sum(CAST(FLOOR(l_quantity) AS BIGINT)) * 20 AS BIGINT) AS page_count,
  CASE WHEN l_partkey % 10 = 0 THEN 'PAGE' ELSE 'NONE' END AS data_compression
FROM {lineitem} WHERE l_shipdate < CAST('2001-01-01 00:00:00' AS {ts})
GROUP BY l_suppkey % 25, l_partkey, l_linenumber
"""

VIEWS["v_index_cur"] = """
SELECT l_suppkey % 25 AS database_id, concat('DB', l_suppkey % 25) AS database_name,
  l_partkey AS object_id, concat('T', l_partkey) AS object_name, 'dbo' AS schema_name,
  concat('IX_', l_partkey) AS index_name, l_linenumber AS partition_number,
  count(*) AS row_cnt, CAST(sum(CAST(FLOOR(l_quantity) AS BIGINT)) * 20 AS BIGINT) AS page_count,
  CASE WHEN l_partkey % 10 = 0 THEN 'PAGE' ELSE 'NONE' END AS data_compression,
  max(l_discount) * 400 AS frag_pct,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END) AS BIGINT) AS modification_counter,
  l_partkey % 7 + 1 AS index_type, l_partkey % 3 <> 0 AS allow_page_locks,
  l_partkey % 11 = 0 AS on_read_only_group, l_partkey % 13 = 0 AS is_image_text,
  l_partkey % 4 = 0 AS is_new_lob, l_partkey % 17 = 0 AS is_file_stream,
  l_partkey % 7 + 1 IN (5, 6) AS is_column_store, l_partkey % 23 = 0 AS is_memory_optimized,
  l_partkey % 29 = 0 AS resumable, l_partkey % 5 = 0 AS is_incremental,
  l_partkey % 19 = 0 AS no_recompute, l_partkey % 37 = 0 AS is_computed, l_partkey % 41 = 0 AS is_timestamp
FROM {lineitem}
GROUP BY l_suppkey % 25, l_partkey, l_linenumber
"""

VIEWS["v_index_now"] = """
SELECT l_suppkey % 25 AS database_id, l_partkey AS object_id, l_linenumber AS partition_number,
  count(*) AS row_cnt, CAST(sum(CAST(FLOOR(l_quantity) AS BIGINT)) * 20 AS BIGINT) AS page_count,
  CASE WHEN l_partkey % 10 = 0 THEN 'PAGE' ELSE 'NONE' END AS data_compression
FROM {lineitem} WHERE l_shipdate >= CAST('1996-01-01 00:00:00' AS {ts})
GROUP BY l_suppkey % 25, l_partkey, l_linenumber
"""

# Every seventh cost is not known; unknown costs come first in the order.
VIEWS["v_index_cost"] = """
SELECT l_suppkey % 25 AS database_id, l_partkey AS object_id, l_linenumber AS partition_number,
  CASE WHEN l_partkey % 7 = 0 THEN NULL
       ELSE CAST(sum(CAST(FLOOR(l_quantity) AS BIGINT)) * 20 AS BIGINT) END AS page_count
FROM {lineitem}
GROUP BY l_suppkey % 25, l_partkey, l_linenumber
"""

VIEWS["v_index_page"] = """
SELECT l_suppkey % 25 AS database_id, l_partkey AS object_id, l_linenumber AS partition_number,
  l_discount * 400 AS avg_fragmentation_in_percent, CAST(FLOOR(l_quantity) AS BIGINT) * 20 AS page_count,
  CASE WHEN l_returnflag = 'R' THEN 'LOB_DATA' ELSE 'IN_ROW_DATA' END AS alloc_unit_type_desc,
  CASE WHEN l_tax >= 0.07 THEN 1 ELSE 0 END AS index_level
FROM {lineitem}
"""

VIEWS["v_object"] = """
SELECT s_suppkey AS object_id, 'dbo' AS schema_name, s_name AS object_name,
  CASE s_suppkey % 9 WHEN 0 THEN 'V' WHEN 1 THEN 'P' ELSE 'U' END AS object_type,
  s_suppkey % 8 = 0 AS is_ms_shipped, s_suppkey % 6 = 0 AS is_memory_optimized
FROM {supplier}
"""

VIEWS["v_index"] = """
SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) AS object_id, p_partkey % 20 AS index_id,
  concat('IX_', p_partkey) AS index_name, p_size % 8 AS index_type, p_partkey % 3 <> 0 AS allow_page_locks,
  p_partkey % 14 = 0 AS is_disabled, p_partkey % 15 = 0 AS is_hypothetical, p_size > 45 AS is_paused
FROM {part}
"""

VIEWS["v_stat"] = """
SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) AS object_id,
  p_partkey % 20 + CASE WHEN p_size > 30 THEN 100 ELSE 0 END AS stats_id,
  concat('ST_', p_partkey) AS stats_name, p_partkey % 5 = 0 AS no_recompute, p_partkey % 4 = 0 AS is_incremental
FROM {part}
"""

VIEWS["v_index_part"] = """
SELECT DISTINCT CAST(FLOOR(l_partkey / 20) AS BIGINT) AS object_id, l_partkey % 20 AS index_id,
  l_linenumber AS partition_number, l_linenumber = 2 AS is_read_only
FROM {lineitem}
"""

VIEWS["v_column"] = """
SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) AS object_id, p_partkey % 20 + 1 AS column_id,
  CASE p_size % 10 WHEN 0 THEN 'text' WHEN 1 THEN 'xml' WHEN 2 THEN 'varchar' WHEN 3 THEN 'timestamp'
       ELSE 'int' END AS type_name,
  CASE WHEN p_size % 20 = 2 THEN -1 ELSE 50 END AS max_length, p_partkey % 40 = 7 AS is_assembly_type,
  p_partkey % 60 = 9 AS is_filestream, p_partkey % 12 = 5 AS is_computed
FROM {part}
"""

VIEWS["v_index_column"] = """
SELECT DISTINCT CAST(FLOOR(l_partkey / 20) AS BIGINT) AS object_id, l_partkey % 20 AS index_id,
  (l_partkey + l_linenumber) % 20 + 1 AS column_id, l_linenumber % 3 AS key_ordinal,
  CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS partition_ordinal
FROM {lineitem}
"""

VIEWS["v_database"] = """
SELECT c_custkey AS database_id, concat(n_name, '_', c_custkey) AS name, n_regionkey, n_nationkey,
  CASE WHEN c_custkey % 4 = 0 THEN 'S' ELSE 'U' END AS database_type,
  CASE c_custkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model_desc,
  CASE WHEN c_custkey % 6 = 5 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc,
  CASE WHEN c_custkey % 17 = 0 THEN 'SINGLE_USER' ELSE 'MULTI_USER' END AS user_access_desc,
  c_custkey % 19 <> 0 AND c_custkey % 34 <> 0 AS is_accessible,
  c_custkey % 9 = 0 AS is_read_only, c_custkey % 13 = 0 AS is_in_standby,
  100 + 10 * (c_custkey % 6) AS compatibility_level, c_custkey % 21 = 0 AS is_auto_close_on,
  CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE NULL END AS source_database_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS last_log_backup_lsn,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey * 10 END AS differential_base_lsn,
  1000 AS allocated_extent_pages, c_custkey % 1000 AS modified_extent_pages,
  CASE WHEN c_custkey % 16 = 3 THEN NULL ELSE CAST(FLOOR(c_acctbal) AS BIGINT) END AS log_since_backup_mb,
  CASE WHEN c_custkey % 16 = 4 THEN NULL ELSE CAST('2001-07-31 22:00:00' AS {ts})
       + INTERVAL '1' SECOND * CAST(c_custkey * 7 % 7200 AS INT) END AS last_log_backup_time,
  CASE WHEN n_regionkey < 2 THEN concat('AG', n_regionkey) ELSE NULL END AS availability_group,
  CASE WHEN n_regionkey >= 2 THEN NULL WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'SECONDARY'
       ELSE 'PRIMARY' END AS availability_group_role,
  CASE WHEN n_regionkey >= 2 THEN NULL ELSE c_custkey % 2 = 0 END AS is_preferred_replica,
  CASE c_custkey % 12 WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'SECONDARY' ELSE NULL END AS log_shipping_role,
  concat('SRV', n_nationkey) AS server_name,
  CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE concat('INST', n_nationkey) END AS instance_name,
  'CLU' AS cluster_name, md5(CAST(c_custkey % 5 AS STRING)) AS owner_sid
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

VIEWS["v_backup"] = """
SELECT o_custkey AS database_id, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'I' ELSE 'L' END AS type,
  o_orderdate AS backup_start_date, o_orderkey % 20 = 0 AS is_damaged, o_orderkey AS database_backup_lsn,
  o_orderkey % 6 = 0 AS is_snapshot, o_custkey * 10 + o_orderkey % 3 AS checkpoint_lsn,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS verify_output
FROM {orders}
"""

VIEWS["v_login"] = """
SELECT c_custkey AS principal_id, md5(CAST(c_custkey AS STRING)) AS sid,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_mktsegment, chr(92), c_name) END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'U' WHEN 2 THEN 'G' ELSE 'R' END AS type,
  c_nationkey < 9 AS in_server_role
FROM {customer}
"""

VIEWS["v_dbuser"] = """
SELECT c_custkey AS principal_id, md5(CAST(c_custkey * 2 AS STRING)) AS sid, c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'U' ELSE 'G' END AS type,
  CASE c_custkey % 5 WHEN 0 THEN 'sales' WHEN 1 THEN NULL ELSE 'dbo' END AS default_schema_name,
  CAST(FLOOR(c_custkey / 4) AS BIGINT) AS database_id,
  concat('DB', CAST(FLOOR(c_custkey / 4) AS BIGINT)) AS database_name, c_acctbal > 5000 AS in_db_role
FROM {customer}
"""

VIEWS["v_permission"] = """
SELECT doc_id AS grantee_principal_id, 'CO' AS type,
  CASE WHEN quality = 1 THEN 'G' WHEN toxic = 1 THEN 'D' ELSE 'W' END AS state
FROM {labels}
"""

VIEWS["v_command_log"] = """
SELECT event_id AS id, concat('DB', user_id) AS database_name,
  CASE event_type WHEN 'view' THEN 'DBCC_CHECKDB' WHEN 'click' THEN 'ALTER_INDEX'
       WHEN 'purchase' THEN 'BACKUP_DATABASE' ELSE 'UPDATE_STATISTICS' END AS command_type,
  ts AS start_time,
  CASE WHEN event_id % 17 = 0 THEN NULL
       ELSE ts + INTERVAL '1' SECOND * CAST(FLOOR(value * 100) AS INT) END AS end_time,
  CASE WHEN event_id % 17 = 0 OR event_id % 23 = 0 THEN NULL WHEN event_id % 11 <> 0 THEN 0
       WHEN event_id % 2 = 0 THEN 1222 ELSE 50000 END AS error_number
FROM {events}
"""

VIEWS["v_activity"] = """
SELECT event_id, ts, user_id AS session_id, concat('DB', user_id % 25) AS database_name,
  event_type = 'error' AS is_waiting, event_type IN ('click', 'view') AS is_blocked
FROM {events}
"""

VIEWS["v_schedule"] = """
SELECT concat('job-', s_suppkey) AS job_name, CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 8 END AS freq_type,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 126 ELSE 1 END AS freq_interval,
  CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS freq_subday_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 25 + 1 END AS freq_subday_interval,
  s_suppkey % 24 * 10000 AS active_start_time
FROM {supplier}
"""

VIEWS["v_server"] = """
SELECT s_suppkey AS server_id, s_name AS server_name,
  CASE s_nationkey % 5 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Managed' WHEN 2 THEN 'RDS' ELSE 'Windows' END AS platform
FROM {supplier}
"""

VIEWS["v_job_offer"] = """
SELECT concat('job-', n_name) AS job_name, CASE WHEN n_nationkey % 8 = 0 THEN 'CmdExec' ELSE 'TSQL' END AS subsystem,
  CASE n_regionkey WHEN 0 THEN 'Linux' WHEN 1 THEN 'Managed' WHEN 2 THEN 'RDS' ELSE 'Windows' END AS platform
FROM {nation}
"""

VIEWS["v_queue"] = """
SELECT concat('Q', o_orderkey) AS database_name, o_orderkey AS database_order,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS database_start_time,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' SECOND * 3600 ELSE NULL END AS database_end_time,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 9 = 0 THEN o_custkey + 2 ELSE o_custkey + 1 END AS session_id,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS request_id,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS request_start_time
FROM {orders}
"""

# Requests are polled on the hour, sessions every two hours, seven minutes earlier.
VIEWS["v_request_poll"] = """
SELECT concat('S', o_custkey % 7) AS server_id,
  CAST('2024-01-01 00:00:00' AS {ts}) + INTERVAL '1' HOUR * CAST(o_orderkey % 9 AS INT) AS snapshot_ts,
  o_orderkey AS request_id, o_custkey % 97 AS session_id, concat('DB', o_custkey % 25) AS database_name,
  CASE o_orderstatus WHEN 'F' THEN 'BACKUP DATABASE' WHEN 'O' THEN 'SELECT' ELSE 'RESTORE LOG' END AS command
FROM {orders}
"""

VIEWS["v_session_poll"] = """
SELECT DISTINCT concat('S', l_suppkey % 7) AS server_id,
  CAST('2024-01-01 00:53:00' AS {ts}) + INTERVAL '1' HOUR * CAST(l_linenumber * 2 AS INT) AS snapshot_ts,
  l_suppkey % 97 AS session_id, concat('L', l_suppkey % 97, '-', l_linenumber) AS login_name,
  l_linenumber % 3 AS open_transaction_count
FROM {lineitem} WHERE (l_suppkey + l_linenumber) % 5 <> 0
"""

# Items of the selection lists of five servers, some thousands at scale.
VIEWS["v_list_item"] = """
SELECT c_custkey % 5 AS server_id, c_custkey AS position, CASE c_custkey % 9
    WHEN 0 THEN concat(upper(n_name), '_', c_custkey + 20) WHEN 1 THEN concat(' ', substr(n_name, 1, 3), '%', c_custkey % 100)
    WHEN 2 THEN concat('%_', c_custkey) WHEN 3 THEN concat('%', lower(substr(n_name, 2, 4)), '%', c_custkey % 10, '%')
    WHEN 4 THEN concat('-%9', c_custkey % 100) WHEN 5 THEN concat('[', n_name, '_', c_custkey, ']')
    WHEN 6 THEN concat('-', n_name, '_', c_custkey) WHEN 7 THEN concat('%', c_custkey % 1000, '%')
    ELSE CASE WHEN c_custkey % 5 = 3 THEN '-SYSTEM_DATABASES' ELSE concat('A_', n_name) END END AS item
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# Three servers that number their sessions alike, with every column of the activity report.
_SERVER_SESSION = "({0} + 1) % 3 AS server_id, CAST(FLOOR(({0} + 1) / 3) AS BIGINT) AS session_id"

VIEWS["v_wide_session"] = f"""
SELECT {_SERVER_SESSION.format("c_custkey")}, c_name AS login_name,
  CASE WHEN c_custkey % 4 = 0 THEN concat('ORIG-', c_custkey) ELSE NULL END AS original_login_name,
  concat('HOST', c_nationkey) AS host_name, concat('app-', c_nationkey) AS program_name, c_mktsegment AS status,
  c_custkey % 10 <> 0 AS is_user_process, CAST(c_custkey % 7 AS INT) AS isolation_level,
  CAST(c_nationkey % 3 AS INT) AS open_transaction_count, CAST(c_custkey % 500 AS INT) AS memory_usage,
  CAST('2024-01-01 00:00:00' AS {{ts}}) + INTERVAL '1' SECOND * CAST(c_custkey AS INT) AS login_time,
  CAST(c_custkey % 9 AS INT) AS group_id, concat('10.0.', c_nationkey, '.', c_custkey % 250) AS client_net_address,
  CASE WHEN c_custkey % 3 = 0 THEN 'Shared memory' ELSE 'TCP' END AS net_transport, 'SQL' AS auth_scheme
FROM {{customer}}
"""

VIEWS["v_wide_request"] = f"""
SELECT {_SERVER_SESSION.format("o_custkey")}, o_orderkey AS request_id, o_orderpriority AS status,
  CASE o_orderstatus WHEN 'F' THEN 'BACKUP DATABASE' WHEN 'O' THEN 'SELECT' ELSE 'RESTORE LOG' END AS command,
  concat('DB', o_custkey % 25) AS database_name,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(FLOOR(o_custkey / 6) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS blocking_session_id,
  CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS total_elapsed_ms, CAST(FLOOR(o_totalprice * 10) AS BIGINT) AS cpu_ms,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LCK_M_S' ELSE 'PAGEIOLATCH_SH' END AS wait_type,
  CAST(FLOOR(o_totalprice * 7) AS BIGINT) AS wait_time, concat('LAST', o_orderkey % 5) AS last_wait_type,
  concat('PAGE: 5:1:', o_orderkey) AS wait_resource, CAST(o_orderkey % 10000 AS DOUBLE) / 100 AS percent_complete,
  o_orderkey % 9973 AS reads, o_orderkey % 31 AS writes, o_orderkey % 100003 AS logical_reads,
  CAST(o_orderkey % 7 AS INT) AS isolation_level, o_orderdate AS start_time
FROM {{orders}}
"""

VIEWS["v_wide_grant"] = f"""
SELECT {_SERVER_SESSION.format("o_custkey")}, o_orderkey AS request_id, o_orderkey % 7919 AS requested_memory_kb,
  o_orderkey % 7907 AS granted_memory_kb, o_orderkey % 7901 AS required_memory_kb, o_orderkey % 7883 AS used_memory_kb,
  o_orderkey % 7879 AS max_used_memory_kb, o_orderkey % 7877 AS ideal_memory_kb, o_totalprice AS query_cost,
  o_orderdate AS request_time, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS grant_time
FROM {{orders}} WHERE o_orderkey % 3 <> 0
"""

VIEWS["v_wide_task"] = f"""
SELECT DISTINCT {_SERVER_SESSION.format("o_custkey")}, o_orderkey AS request_id, CAST(l_linenumber AS INT) AS exec_context_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'SUSPENDED' ELSE 'RUNNING' END AS task_state,
  CAST(o_orderkey % 13 + l_linenumber AS INT) AS context_switches_count, CAST(l_linenumber % 4 AS INT) AS scheduler_id,
  CAST(o_orderkey % 3 AS INT) AS pending_io_count, o_orderkey % 4096 AS pending_io_byte_count,
  CAST(o_orderkey % 64 AS INT) AS pending_io_byte_average
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

VIEWS["v_wide_wait"] = f"""
SELECT DISTINCT {_SERVER_SESSION.format("o_custkey")}, CAST(l_linenumber AS INT) AS exec_context_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'PAGELATCH_SH' WHEN 1 THEN 'CXPACKET' ELSE 'LCK_M_X' END AS wait_type,
  concat('5:1:', CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 8088 ELSE 3 END) AS resource_description,
  CAST(FLOOR(o_custkey / 9) AS BIGINT) AS blocking_session_id
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """The views, and the raw tables, of one data folder."""

    #: Server columns of the views.
    scope: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def each(self, df: DataFrame, view: str = "") -> DataFrame:
        """Rows as every server has them."""
        return df

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(
            _NAME.sub(
                lambda m: "TIMESTAMP_NTZ" if m[1] == "ts" else f"parquet.`{self.path(m[1])}`", text
            )
        )

    def sql_stream(self, view: str, stream: DataFrame) -> DataFrame:
        """A one-table view over a stream of that table instead of its files."""
        text = _NAME.sub(lambda m: "TIMESTAMP_NTZ" if m[1] == "ts" else "{stream}", VIEWS[view])
        return self.spark.sql(text, stream=stream)

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[view])


# Rows that the second server of ``Fleet`` lacks; its ids are those of the first.
SECOND_SERVER = {
    "v_database": "database_id % 3 <> 0",
    "v_backup": "database_backup_lsn % 4 <> 1",
    "v_file": "file_id % 5 <> 2",
    "v_login": "principal_id % 3 <> 1",
    "v_dbuser": "principal_id % 4 <> 1",
    "v_permission": "grantee_principal_id % 3 <> 0",
    "v_job": "job_number % 3 <> 0",
    "v_queue": "database_order % 4 <> 0",
    "v_request": "request_id % 5 <> 0",
    "v_wait": "request_id % 3 <> 0",
    "v_wait_name": "object_id % 4 <> 0",
    "v_partition": "hobt_id % 4 <> 0",
    "v_index_cur": "object_id % 3 <> 0",
}


class Fleet(Inputs):
    """The views of two servers that number everything alike, the second one with fewer rows."""

    scope = ("server_id",)

    def each(self, df: DataFrame, view: str = "") -> DataFrame:
        first = df.withColumn("server_id", F.lit("A"))
        second = df.where(SECOND_SERVER.get(view, "true")).withColumn("server_id", F.lit("B"))
        return first.unionByName(second)

    def __getattr__(self, name: str) -> DataFrame:
        return self.each(super().__getattr__(name), f"v_{name}")


def on_two_servers(sql: str) -> str:
    """An oracle over one server's views, run by itself on each server of ``Fleet``."""
    views = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    second = sql
    for v in views:
        second = re.sub(rf"\b{v}\b", f"{v}_second", second)
    fewer = ", ".join(f"{v}_second AS (SELECT * FROM {v} WHERE {SECOND_SERVER.get(v, 'true')})" for v in views)
    return f"""WITH {fewer} SELECT 'A' AS server_id, a.* FROM ({sql}) a
      UNION ALL SELECT 'B' AS server_id, b.* FROM ({second}) b"""


def oracle_view(name: str) -> str:
    text = _NAME.sub(lambda m: "TIMESTAMP" if m[1] == "ts" else m[1], VIEWS[name])
    return f"{name} AS ({text.strip()})"
