"""Limits that requests and metadata are held to."""

COMMIT_ATTEMPTS = 128
BATCH_BYTES = 16 << 20
REQUEST_RECORDS = 100_000
HEADERS_PER_RECORD = 1024
HEADERS_PER_REQUEST = 32_768
PAGE_FANOUT = 64
INDEX_LEVELS = 10
RETRY_WINDOW = 5
NAME_BYTES = 249
PARTITIONS_PER_TOPIC = 1024
MEMBERS_PER_GROUP = 1024
PROTOCOLS_PER_MEMBER = 32
TIMEOUT_MS = 300_000
GROUPS = 10_000
PROTOCOL_BYTES = 1 << 20
MEMBER_BYTES = 1 << 20
GROUP_BYTES = 16 << 20
GROUP_OFFSETS = 10_000
METADATA_BYTES = 4096
MAINTENANCE_OBJECTS = 100_000
SEQUENCE_RANGE = 1 << 31
