from opslens.sources.manifest import close_polls, newest_polls, read_newest, write_polls  # noqa: F401
from opslens.sources.schemas import FLEET_KEYS, SCHEMAS  # noqa: F401
from opslens.sources.sinks import log_finish, log_start, sink_append  # noqa: F401
from opslens.sources.snapshots import for_each_partition_of, read_snapshot, scan_all  # noqa: F401
from opslens.sources.workdir import reliable_checkpoint, work_dir  # noqa: F401
