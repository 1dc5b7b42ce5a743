"""Fixed values of the data model, and the schemas of its tables."""

from __future__ import annotations

# Hash algorithms as (id, name, digest bytes, block bytes).
HASH_ALGORITHMS = (
    (0, "sha1", 20, 64),
    (1, "sha256", 32, 64),
    (2, "sha384", 48, 128),
    (3, "sha3-256", 32, 136),
    (4, "sha3-384", 48, 104),
    (5, "sha3-512", 64, 72),
    (6, "shake128", 32, 168),
    (7, "shake256", 64, 136),
)
# Object types.
OBJECT_TYPES = ((1, "blob"), (2, "tree"), (3, "commit"), (4, "tag"), (6, "ofs-delta"), (7, "ref-delta"))
OFFSET_DELTA, REFERENCE_DELTA = 6, 7
# Error codes and their texts.
ERRORS = (
    (0, "ok"), (-1, "generic error"), (-2, "out of memory"), (-3, "invalid argument"), (-4, "not found"), (-5, "already exists"),
    (-6, "I/O error"), (-7, "busy"), (-8, "try again"), (-9, "overflow"), (-10, "unsupported"),
)
# File modes.
MODE_FILE, MODE_EXECUTABLE, MODE_TREE = 0o100644, 0o100755, 0o40000
# Ids of a missing side, and of the version of the data model.
NO_OID = "0" * 64
VERSION = "0.1.0"
# Defaults of remotes.
BACKOFF_BASE_MS, BACKOFF_CAP_MS, BACKOFF_DOUBLINGS, BACKOFF_JITTER = 100, 30_000, 10, 0.2
MOST_RETRIES, BUDGET_A_MINUTE = 3, 20
FAILURES_TO_OPEN, SUCCESSES_TO_CLOSE, OPEN_MS = 5, 2, 30_000
MOST_RUNNING, MOST_QUEUED, SHED_PERCENT = 64, 256, 90
# Codes of errors that may pass by themselves.
RETRYABLE = (-8, -7, -6)

SIGNATURE = "struct<name:string,email:string,when:bigint,offset:int>"
SCHEMAS = {
    "objects": "oid string, algo tinyint, type string, size bigint, data binary, source string",
    "tree_entries": "tree_oid string, pos int, mode int, name string, oid string",
    "commits": f"oid string, tree string, parents array<string>, author {SIGNATURE}, committer {SIGNATURE}, message string, encoding string, gpg_signature string",
    "refs": "name string, oid string, target string",
    "reflog": "ref string, old_oid string, new_oid string, name string, email string, when bigint, tz string, message string",
    "index_entries": "path string, stage int, oid string, mode int, size bigint",
    "worktree": "path string, mode int, size bigint, data binary",
    "pack_idx": "pack string, oid string, crc32 bigint, offset bigint",
    "commit_edges": "child string, parent string, nth int",
}
