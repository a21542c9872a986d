"""Batch operators over keyed, timed rows and replay tables."""

from windowstate.operators.counts import (closed_windows, emitted_pairs, open_windows, state_size,
                                          tumbling_count, with_closed_flag)
from windowstate.operators.firelog import Replay, batch_log, fire_log, live_at, pre_aggregate, replay
from windowstate.operators.lookups import align_requests, lookup, partition_audit, state_view
from windowstate.operators.retention import current_fires, retained_view
from windowstate.operators.scale import first_mark_after, running_max
from windowstate.operators.statetable import lookup_table, read_state_table, write_state_table

__all__ = [
    "Replay", "align_requests", "batch_log", "closed_windows", "current_fires", "emitted_pairs",
    "fire_log", "first_mark_after", "live_at", "lookup", "lookup_table", "open_windows", "partition_audit",
    "pre_aggregate", "read_state_table", "replay", "retained_view", "running_max", "state_size", "state_view", "tumbling_count",
    "with_closed_flag", "write_state_table",
]
