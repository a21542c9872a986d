"""Column expressions. All are JVM-side (no Python UDFs) so they stay inside whole-stage codegen."""

from windowstate.functions.align import window_end, window_start
from windowstate.functions.codec import answer_text, long_text, pair_text, parse_long, with_one
from windowstate.functions.keyhash import key_fold, key_partition, murmur_mix
from windowstate.functions.requests import parse_request
from windowstate.functions.timecols import epoch_ms, ms_timestamp

__all__ = [
    "answer_text", "epoch_ms", "key_fold", "key_partition", "long_text", "ms_timestamp", "murmur_mix",
    "pair_text", "parse_long", "parse_request", "window_end", "window_start", "with_one",
]
