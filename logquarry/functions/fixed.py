"""Fixed values.

Everything in this module is a value that results depend on: word lists, patterns, lookup tables, markers,
limits and message texts. They are kept here together, as plain text, and used nowhere as logic.
"""

# --- Fixed values: syslog framing -------------------------------------------------------------------------
STRUCTURED_MARKER = " - - - - "
PRI_PREFIX = r"^<(\d{1,3})>\s*"
PRI_AT_START = r"^<(\d{1,3})>"
VERSIONED_PRI = r"^<(\d+)>\d+\s"
RAW_LIMIT = 2048

# --- Fixed values: firewall CSV ---------------------------------------------------------------------------
FIREWALL_WORDS = ["TRAFFIC", "THREAT", "SYSTEM"]
FIREWALL_MIN_PARTS = 16
PROTOCOLS = ["tcp", "udp", "icmp", "icmpv6", "ipv6-tcp", "ipv6-udp", "sctp"]
TRAFFIC_BLOCKED = ["deny", "drop", "reset-client", "reset-server", "reset-both", "deny-all", "block", "block-ip"]
THREAT_BLOCKED = ["block", "drop", "sinkhole", "deny", "reset-client", "reset-server", "reset-both"]
BLOCKED_KEY_VALUE = r"(?i)\baction\s+(block|drop|deny|sinkhole|reset-(?:client|server|both))\b"
PAYLOAD_START = r"(?<![0-9])(\d+,\d{4}/\d{2}/\d{2}\s)"
IPV4_SHAPE = r"^(?:\d{1,3}\.){3}\d{1,3}$"

# --- Fixed values: addresses in free text -----------------------------------------------------------------
IPV4_TOKEN = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
IPV6_TOKEN = r"(?<![:.\w])(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}(?![:.\w])"
MAC_TOKEN = r"[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}"

# IPv4 blocks that are not public (private, loopback, link-local, documentation, benchmark, multicast, reserved)
NON_PUBLIC_BLOCKS = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
]
PUBLIC_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]

# IPv6 blocks that are not public, and blocks inside them that are
NON_PUBLIC_BLOCKS_6 = [
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
    "ff00::/8",
]
PUBLIC_EXCEPTIONS_6 = [
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
]
IPV6_MAPPED = "00000000000000000000ffff"
IPV6_V4_TAIL = r"^(.*:)((?:\d{1,3}\.){3}\d{1,3})$"
IPV6_SHAPE = r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]*$"
IPV6_GROUP = r"^[0-9a-fA-F]{1,4}$"

# --- Fixed values: severity words -------------------------------------------------------------------------
SEVERITY_BY_NUMBER = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]
LEVEL_WORD = r"(?i)\b(emerg(?:ency)?|alert|crit(?:ical)?|err(?:or)?|warn(?:ing)?|notice|info|debug)\b"
JSON_LEVEL = r"""(?i)["']level["']\s*:\s*["'](\w+)["']"""
FAILURE_PHRASE = (
    r"(?i)\b(fail(?:ed|ure)?|denied|timeout|refused|unreachable|segfault|oom|authentication failure|"
    r"permission denied|connection reset|i/o error|kernel panic)\b"
)
FAILURE_LEVEL_WORD = r"(?i)\b(err(?:or)?|crit(?:ical)?|alert|emerg(?:ency)?|fatal|panic)\b"
LOW_LEVEL_MARK = (
    r"(?i)(?:\[(?:debug|info|trace)\]|\b(?:debug|trace)\b|\binfo\b|\binformational\b|"
    r"level=(?:debug|info|trace)\b|severity=(?:debug|info|trace)\b|\.(?:DEBUG|INFO|TRACE)\b|"
    r":\s*(?:debug|info|trace)\s*[-:])"
)
SEVERITY_ALIASES = {
    "warn": "warning",
    "err": "error",
    "crit": "critical",
    "emerg": "emergency",
    "fatal": "critical",
    "panic": "critical",
    "major": "error",
}
SEVERITY_RANK = {
    "debug": 0,
    "info": 1,
    "notice": 2,
    "warning": 3,
    "error": 4,
    "critical": 5,
    "alert": 6,
    "emergency": 7,
    "unknown": 1,
}
SEVERITY_FLOORS = ["warning", "error", "critical"]

# --- Fixed values: event importance -----------------------------------------------------------------------
IMPORTANCE_BLOCKED = ["deny", "drop", "block", "reset-both", "reset-client", "reset-server"]
IMPORTANCE_CRITICAL_WORDS = ["critical", "fatal", "emerg"]
IMPORTANCE_ERROR_WORDS = ["error", "fail", "denied", "blocked"]
IMPORTANCE_WARNING_WORDS = ["warn"]
IMPORTANCE_RANK = {"info": 0, "warning": 1, "error": 2, "critical": 3}

# --- Fixed values: line layouts ---------------------------------------------------------------------------
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
BSD_TIME = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
LINE_REST = r"\s+(\S+)\s+(?:([\w./@-]+)(?:\[(\d+)\])?:\s+)?(.*)$"
BRACKETED_DATE = r"\[sms\.(\d{4}-\d{2}-\d{2})\](?:\s*-\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\[)?"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SKIPPED_LOG_NAMES = ["wtmp", "btmp", "lastlog", "faillog", "README.logs"]
COMPRESSED_SUFFIXES = [".gz", ".bz2", ".xz", ".zst", ".lz4", ".zip"]

# Facility folders below a log root that belong to the local host, not to a remote sender
LOCAL_FACILITY_DIRS = [
    "anaconda", "apache2", "apt", "audit", "auth", "chrony", "cups", "dist-upgrade", "gdm", "gdm3",
    "glusterfs", "hosts", "httpd", "installer", "kerberos", "landscape", "letsencrypt", "libvirt",
    "lighttpd", "lxc", "mail", "meldung", "mysql", "nginx", "openvpn", "php", "postfix", "postgres",
    "postgresql", "private", "qemu-ga", "redis", "rhsm", "samba", "speech-dispatcher", "sssd",
    "supervisor", "sysstat", "tuned", "unattended-upgrades", "wicked", "wpa_supplicant", "xen", "yast", "zypp",
]
LOCALHOST_GROUP = "localhost"

# --- Fixed values: cloud events ---------------------------------------------------------------------------
CLOUD_PAGE_KEYS = ["results", "events", "logs", "entries", "items", "data"]
CLOUD_TITLE_KEYS = ["type", "event", "name", "reason", "category", "action", "event_type"]
CLOUD_BODY_KEYS = [
    "message", "text", "description", "detail", "note", "device_name", "client_mac", "ap",
]
CLOUD_HOST_KEYS = ["site_name", "site_id", "ap_name", "device_name"]
CLOUD_TIME_KEYS = ["timestamp", "created_time", "time", "ts", "last_seen", "start"]
CLOUD_ID_KEYS = ["id", "event_id", "_id", "uuid"]
CLOUD_ACTION_KEYS = ["action", "severity"]

# --- Fixed values: model replies, summaries and trends ----------------------------------------------------
VERDICT_LEVELS = ["info", "low", "medium", "high", "critical"]
CONFIDENCE_LEVELS = ["low", "medium", "high"]
AUTO_SKIP_MODEL = "(auto-skip)"
FENCED_BLOCK = r"(?is)```(?:json)?\s*(.*?)\s*```"
NON_JSON_SUMMARY = "Model returned non-JSON; inspect raw response."
NO_SUMMARY = "(no summary)"
NO_HEADLINE = "(no headline)"
EXPLANATION_SUMMARY = "Log entry explanation"
ANOMALY_TITLE = "Note"
FINDING_TITLE = "Finding"
SKIPPED_BEFORE = "Auto-skipped "
SKIPPED_AFTER = " blocked/denied log"
PROMPT_HEAD = " lines. JSON only.\n"
JOB_FAILED = "analysis failed"
SNIPPETS_DAILY = "PER_ANALYSIS_SNIPPETS (oldest→newest in window; summaries truncated):"
SNIPPETS_WEEKLY = "PER_ANALYSIS_SNIPPETS:"
RECENT_RUNS = "RECENT_DAILY_META_RUNS (newest first):"
TREND_CHANGES = {"ok_total": "completed analyses", "elevated_total": "high/critical bucket", "anomalies_total": "reported anomalies"}
TREND_SAME = "Last {} looks similar to the prior one (same ballpark of analyses and flags)."
TREND_BEFORE = "Versus the prior {}: "
BASELINE_EMPTY = "empty"
BASELINE_STEADY = "steady"
ELLIPSIS = "…"
DAILY_TASK = (
    "TASK: Cross-batch review. Find drift, clusters, or storylines single batches miss. "
    "Ignore vendor boilerplate unless it forms a pattern."
)
WEEKLY_TASK = (
    "TASK: Week-scale posture — sustained issues, noisy subsystems, model blind spots, or calibration hints. "
    "Stay grounded in the evidence lines above."
)
NO_DAILY_RUNS = "(none yet — still give weekly guidance from aggregates + snippets.)"
BASELINE_STEPS = [(3, "seed"), (7, "young"), (14, "warming")]
WINDOWS_LEVEL_TO_SEVERITY = {1: 2, 2: 3, 3: 4, 4: 5, 5: 6}
