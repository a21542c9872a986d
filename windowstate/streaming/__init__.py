"""Structured Streaming: built-in windowed count (drop mode), the keyed operator on Spark's state (late rows fire again),
foreachBatch re-fire, state reads, answers, replay."""

from windowstate.streaming.answers import start_answers
from windowstate.streaming.filereplay import ReplayRun, new_run, replay
from windowstate.streaming.keyed import keyed_windows, read_windows, retained_windows, rocksdb_state
from windowstate.streaming.refire import (LookupWriter, RefireWriter, read_batches, read_fire_log, read_live,
                                         read_retained)
from windowstate.streaming.state import read_count_changes, read_count_state, state_from_changes, state_inventory
from windowstate.streaming.windowed import (EmitLog, ProgressLog, ProgressTable, observed, start_count, windowed_count,
                                            with_arrival_time, with_event_time, with_ingestion_time)

__all__ = [
    "EmitLog", "LookupWriter", "ProgressLog", "ProgressTable", "RefireWriter", "ReplayRun", "keyed_windows", "new_run",
    "observed", "read_batches", "read_count_changes", "read_count_state", "read_fire_log", "read_live", "read_retained",
    "read_windows", "replay", "retained_windows", "rocksdb_state", "start_answers", "start_count", "state_from_changes",
    "state_inventory", "windowed_count", "with_arrival_time", "with_event_time", "with_ingestion_time",
]
