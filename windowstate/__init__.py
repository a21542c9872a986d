"""windowstate: queryable tumbling-window counts, built on Spark DataFrames and Structured Streaming.

Layers:
  functions/  column expressions (text codecs, window alignment, key partition hash, request parsing)
  operators/  batch operators over replay tables (tumbling count, close/emit, fire log, retention, lookups)
  sources/    key sources and sinks (table/stream decode, generated key sequence, text/kafka sinks)
  streaming/  Structured Streaming jobs (built-in windowed count, re-fire writer, state reader, replay)
  plans/      the registered query catalogue and its DuckDB oracle SQL
"""

from windowstate.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
