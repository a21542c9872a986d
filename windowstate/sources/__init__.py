"""Key sources (tables, streams, generated sequences) and sinks."""

from windowstate.sources.keys import decode_keys, kafka_key_stream, key_sequence, key_sequence_stream
from windowstate.sources.sinks import kafka_sink, pairs_frame, read_text_sink, start_text_sink, text_keys_frame
from windowstate.sources.tables import arrival_rows, read_table, timed_keys

__all__ = [
    "arrival_rows", "decode_keys", "kafka_key_stream", "kafka_sink", "key_sequence", "key_sequence_stream",
    "pairs_frame", "read_table", "read_text_sink", "start_text_sink", "text_keys_frame", "timed_keys",
]
