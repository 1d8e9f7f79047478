from .growing import GrowingTable, accumulate
from .jobs import anonymize_stream, rate_breach_stream, rollup_stream, run_available, run_windows, shared_path, table_stream
from .lockout import lockout_stream, run_locks

__all__ = ["GrowingTable", "accumulate", "anonymize_stream", "lockout_stream", "rate_breach_stream", "rollup_stream",
           "run_available", "run_locks", "run_windows", "shared_path", "table_stream"]
