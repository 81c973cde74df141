"""Schemas of the snapshot tables a collector delivers, with the column names that the operators use.

Every table also carries the fleet columns: which server, which poll.  ``FLEET_KEYS`` is the ``scope`` of
operators over several servers.
"""

from __future__ import annotations

FLEET_KEYS = ("server_id", "snapshot_ts", "snapshot_date")
FLEET = "server_id string, snapshot_ts timestamp_ntz, snapshot_date date"

_KINDS = {
    "session": """session_id long, login_name string, original_login_name string, host_name string,
        program_name string, status string, is_user_process boolean, isolation_level int,
        open_transaction_count int, memory_usage int, group_id int, login_time timestamp_ntz,
        lock_timeout int""",
    "request": """session_id long, request_id long, command string, status string, sql_handle string,
        statement_start_offset int, statement_end_offset int, blocking_session_id long,
        database_id long, database_name string, total_elapsed_ms long, cpu_ms long, wait_type string, wait_time long,
        last_wait_type string, wait_resource string, percent_complete double, reads long,
        writes long, logical_reads long, start_time timestamp_ntz, open_transaction_count int,
        estimated_completion_ms long, isolation_level int""",
    "connection": """session_id long, client_net_address string, net_transport string,
        auth_scheme string, connect_time timestamp_ntz""",
    "batch_text": "sql_handle string, text string",
    "task": """session_id long, request_id long, exec_context_id int, task_state string,
        context_switches_count int, scheduler_id int, pending_io_count int,
        pending_io_byte_count long, pending_io_byte_average int""",
    "wait": """session_id long, exec_context_id int, wait_type string, resource_description string,
        blocking_session_id long""",
    "grant": """session_id long, request_id long, requested_memory_kb long, granted_memory_kb long,
        required_memory_kb long, used_memory_kb long, max_used_memory_kb long, ideal_memory_kb long,
        query_cost double, request_time timestamp_ntz, grant_time timestamp_ntz""",
    "group": "group_id int, name string",
    "job": "job_id string, name string, owner_sid string",
    "job_step": """job_id string, step_id int, subsystem string, command string,
        database_name string""",
    "schedule": """job_id string, freq_type int, freq_interval int, freq_subday_type int,
        freq_subday_interval int, active_start_date date, active_end_date date,
        active_start_time int, active_end_time int""",
    "database": """database_id long, name string, source_database_id long, create_date timestamp_ntz,
        owner_sid string, recovery_model_desc string, state_desc string, user_access_desc string,
        is_read_only boolean, is_in_standby boolean, is_accessible boolean, compatibility_level int,
        is_auto_close_on boolean, is_auto_shrink_on boolean, is_broker_enabled boolean,
        differential_base_lsn decimal(25,0), last_log_backup_lsn decimal(25,0),
        allocated_extent_pages long, modified_extent_pages long, log_since_backup_mb long,
        last_log_backup_time timestamp_ntz""",
    "file": """database_id long, file_id int, database_name string, file_name string, type_desc string,
        physical_name string, size_pages long, used_pages long, group_name string""",
    "file_volume": """database_id long, file_id int, database_name string, file_name string,
        type_desc string, physical_name string, volume_mount_point string, logical_volume_name string,
        total_bytes long, available_bytes long""",
    "file_stats": "database_id long, file_id int, size_pages long, size_on_disk_bytes long",
    "log_space": "database_name string, log_size_mb double, log_used_percent double, status int",
    "rowgroup": """database_id long, object_id long, object_name string, schema_name string, index_id int,
        index_name string, is_partitioned boolean, partition_number int, state_desc string,
        transition_desc string, deleted_rows long, created_time timestamp_ntz""",
    "index_stats": """database_id long, object_id long, index_id int, partition_number int, rows long,
        data_compression string, page_count long, compressed_page_count long,
        avg_fragmentation_in_percent double, alloc_unit_type_desc string, index_level int""",
    "index_catalog": """database_id long, schema_id int, schema_name string, object_id long,
        object_name string, object_type string, is_memory_optimized boolean, index_id int,
        index_name string, index_type int, allow_page_locks boolean, is_image_text boolean,
        is_new_lob boolean, is_file_stream boolean, is_column_store boolean, is_computed boolean,
        is_timestamp boolean, on_read_only_group boolean, resumable boolean, stats_id int,
        stats_name string, no_recompute boolean, is_incremental boolean, partition_id long,
        partition_number int, partition_count int""",
    "stat_properties": "database_id long, object_id long, stats_id int, rows long, modification_counter long",
    "backup": """database_id long, database_name string, type string, backup_start_date timestamp_ntz,
        is_damaged boolean, is_snapshot boolean, checkpoint_lsn decimal(25,0),
        database_backup_lsn decimal(25,0), verify_output int""",
    "principal": """principal_id long, name string, sid string, type string,
        default_schema_name string, database_id long, database_name string""",
    "role_member": "database_id long, role_principal_id long, member_principal_id long",
    "permission": "database_id long, grantee_principal_id long, type string, state string",
    "command_log": """id long, database_name string, schema_name string, object_name string,
        object_type string, index_name string, index_type int, statistics_name string,
        partition_number int, extended_info struct<page_count:long,fragmentation:double>,
        command string, command_type string, start_time timestamp_ntz, end_time timestamp_ntz,
        error_number int, error_message string""",
    "queue": """queue_id int, database_name string, database_order int,
        database_start_time timestamp_ntz, database_end_time timestamp_ntz, session_id long,
        request_id long, request_start_time timestamp_ntz""",
}

SCHEMAS: dict[str, str] = {
    kind: f"{FLEET}, {' '.join(ddl.split())}" for kind, ddl in _KINDS.items()
}
