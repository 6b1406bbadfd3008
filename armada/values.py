"""Fixed values that results depend on."""

# Named ports.
PORTS = {
    "http": 8088,
    "https": 9443,
    "protocol": 9088,
    "balance": 6243,
    "metrics": 8081,
}

# Node states and health.
CONNECTED = "CONNECTED"

# Response codes with a meaning of their own.
ANONYMOUS_CODE = 409
STANDALONE_CODES = (404, 409)

# Defaults for absent fields.
SPEC_DEFAULTS = {"replicas": 1, "graceful_shutdown": "30s", "pull_policy": "IfNotPresent"}
GIT_DEFAULTS = {"branch": "main", "depth": 1, "wait": "20s"}
GIT_FOLDER_DEFAULT = "/"

# Names derived from the position of a git-sync entry.
SYNC_PREFIX = "git-sync"
VOLUME_PREFIX = "content-from-git"
LINK_NAME = "current"
SYNC_ROOT = "/tmp/git"

# Argument names a user may not set.
RESERVED_ARGS = (
    "--git-config",
    "--repo",
    "--ref",
    "--depth",
    "--period",
    "--link",
    "--root",
    "--one-time=true",
    "--one-time=false",
)

# Patterns and limits of the specification schema.
QUANTITY_PATTERN = (
    r"^(\+|-)?(([0-9]+(\.[0-9]*)?)|(\.[0-9]+))"
    r"(([KMGTPE]i)|[numkMGTPE]|([eE](\+|-)?(([0-9]+(\.[0-9]*)?)|(\.[0-9]+))))?$"
)
REASON_PATTERN = r"^[A-Za-z]([A-Za-z0-9_,:]*[A-Za-z0-9_])?$"
REASON_MAX_LENGTH = 1024
TYPE_PATTERN = (
    r"^([a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*/)?"
    r"(([A-Za-z0-9][-A-Za-z0-9_.]*)?[A-Za-z0-9])$"
)
TYPE_MAX_LENGTH = 316
MESSAGE_MAX_LENGTH = 32768
LOG_LEVELS = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE")
CONDITION_STATES = ("True", "False", "Unknown")

# Supported algorithms, without the prefix the product puts before them.
ALGORITHMS = ("PBKDF2_AES_GCM_256", "ARGON2_AES_GCM_256")

# Authentication providers, first match wins.
AUTH_TYPES = ("oidc", "ldap", "static")

# Probe thresholds (consecutive failures).
LIVENESS_FAILURES = 30
STARTUP_FAILURES = 120

# Polling and deadlines, in seconds.
POLL_SECONDS = 10
DEADLINE_SECONDS = 120

# Upkeep of events and history.
RETENTION_DAYS = {"node": 14, "component": 3}
ARCHIVE_RATIO = 0.5
HISTORY_POINTS = 14400
ATTRIBUTE_LENGTH = 65536
ROLLOVER_TIME = "10 minutes"
ROLLOVER_BYTES = 100 * 1024 * 1024
SNAPSHOT_EVERY = "1 minute"
EVENT_FIELDS = ("EventType", "FlowFileUUID", "Filename", "ProcessorID", "Relationship")
