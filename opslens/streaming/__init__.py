from opslens.streaming.polls import (  # noqa: F401
    activity_windows,
    blocked_episodes,
    pair_commands,
    read_stream,
    retention_on_trigger,
    run_to_table,
)
