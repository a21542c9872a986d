"""Parameters of the registered queries."""

HOUR_MS = 3_600_000          # window size of the table queries
DAY_MS = 86_400_000          # window size of the line item queries
N_PARTITIONS = 4             # routing partitions (the reference test's parallelism)
N_BUCKETS = 8                # buckets of the state table that lookups reuse
MISROUTED_PARTITIONS = 3     # partition count of a misrouted store for the audit query
REPLAY_BATCH = 6             # replay batch, of ten, at which live / retained state is read
REPLAY_AT_MS = 6_500         # processing time of the retained-state read
CLEANUP_MS = 2_500           # cleanup delay of retained windows
SHORT_AT_MS = 6_000          # retained read with a short delay
SHORT_CLEANUP_MS = 500
NOW_MS = 1_706_745_600_000   # "now" of key-only text requests (2024-02-01T00:00:00Z)
MISSING_KEY_OFFSET = 100_000  # requests for keys that never occur
SEQ_PARALLELISM = 4
EPOCH_2024_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z; shifts times to straddle the epoch
