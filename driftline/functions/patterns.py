"""Fixed values of the log language: patterns, word lists and limits that results depend on.

They are stated as they must be, in Java's syntax; repeats that could backtrack without bound are possessive.
"""

MAX_LINE_BYTES = 6000
THRESHOLD = 0.3
BEFORE_GAP, BEFORE, AFTER = 12, 3, 3

DATE = "(?i)^(sunday|monday|tuesday|wednesday|thursday|friday|saturday|january|february|march|april|may|june|july|august|september|october|november|december|months?|weeds?|days?|hours?|minutes?)\\z"
ERROR_WORD = "(?i)^(error|fatal|failure|failed|warning|err|fail|warn|denied|assert|assertion|non-zero|exception|traceback)\\z"
HASH = "(?i)^(hash|sha|md)[0-9]*[:~]|\\.?[a-zA-Z0-9_+/-]{64}"
HEX_LIKE = "^(?::*+[\\[\\]0-9a-fA-FxZ,][\\[\\]0-9a-fA-FxZ,:.\\-]*+|latest|none|rabbitmq-cluster-id-.*)+\\z"
HEX_LIKE_LINEAR = "^(:*[\\[\\]0-9a-fA-FxZ,]+[:.\\-]*|(latest|none)|rabbitmq-cluster-id-.*)+$"
CONSONANT = "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]"
VOWEL = "[aeiouyAEIOUY]"
COOKIE = "^(gAAAA|AAAA|tx[a-z]|tap|req-|AUTH_)"
UUID_TAIL = "^[a-zA-Z0-9].*-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-\\z"
URL = "(?i)^(https|http|ftp|ssh)://"
REFS = "^(refs/|repos/)|^\\w{7}\\.\\.\\w{7}\\z"
BASE64 = "^[A-Za-z0-9+/=]+\\z"
UNIT = "^[a-z]+_[a-z]+\\[[0-9]+\\]:\\z"
ODD = "[<>{}%$,*]"
NUMBER = "[0-9]+\\.[0-9]+|[0-9]+"
SPLIT = "(?:[ \\t]|\\\\[nr])+"
KEY_IDS = ("id", "key", "ref", "region", "token", "secret", "password", "pipeline")
NOISE = (
    "GET / HTTP/1.1",
    "\\* [a-zA-Z]+: [a-zA-Z0-9\\.-]*\\z|Trying other mirror.",
    "ovs-ofctl .* (dump-ports|dump-flows|show)\\b",
    "(ip|eb)tables .* -L\\b",
    "^\\^[+*-] [a-z0-9\\.>-]{5,} [0-9]",
    "dnsmasq(\\[[0-9]+\\])?: (query|forwarded|reply|cached|config)",
    "^[a-f0-9s/]+>[0-9]+ ",
    "^\\+\\+ echo [^ ]+\\z",
    "^net.ipv[46].(conf|neigh).tap",
    "^[\" \\t]*net.interface.tap",
    "[ '\",]*\\|.{17}\\|[ '\",]*\\z",
)
ERROR_LINE = (
    "ERROR [0-9]{4}",
    "<title>503 Service Unavailable</title>",
    " ERROR\\z",
    "\\|   \"msg\": \"",
    ": FAILED!",
    "\\| FAILED \\|",
    "\\| (fatal|failed|error): ",
    " The error appears to be in ",
    " failed: [1-9][0-9]*[ \\t]",
    "stderr: 'error:",
    "\\|WARN\\|",
    "\\[EC [0-9]+\\]",
    " \\[Error\\] ",
    "[0-9Z][ \\t]+ERROR[ \\t]+[a-zA-Z]",
    "^FAIL: ",
    "^(ERROR|FAILED): ",
    "\\.\\.\\. FAILED\\z",
    "^<(failure|error) message=",
    "^E       ",
    "%\\] FAILED ",
    "\\] ERROR: ",
    "\"level\":\"ERROR\"",
    "[ \\t]{2,}(Failed|Error|CrashLoopBackOff)[ \\t]{2,}[0-9]",
    "Warning[ \\t]+Failed[ \\t]+",
    "\\bE[0-9]{4}\\b",
    "msg=\"error",
    "msg=\"an error",
    "\"level\":\"error\"",
    "\\blevel=error\\b",
)
EXCLUDED_PATHS = (
    ".ico$", ".png$", ".clf$", ".tar.bzip2$", ".subunit$", ".sqlite$", ".db$", ".bin$", ".rpm$", ".pcap.log.txt$", ".pkl$", ".jar$", ".pyc$",
    ".py$", ".sh$", ".eot$", ".otf$", ".woff$", ".woff2$", ".ttf$", ".yaml$", ".ini$", ".conf$", "job-output.json$", "zuul-manifest.json$", ".html$",
    "sos_commands/.*/(lsof|ps|journalctl|ls)_", "sos_commands/scsi", "cacerts$", "local/creds$", "/authkey$", "mysql/tc.log.txt$", "log/.tmp$",
    "lib/systemd/systemd-coredump$", "os-diff/os-diff$", "object.builder$", "account.builder$", "container.builder$", "crio/pods/crictl_inspectp_",
    "crio/containers/crictl_inspect_", "/etc/", "/proc/", "/sys/", "/usr/lib/", "/var/lib/selinux/", "/venv/", "/\\.[a-zA-Z0-9]",
)
IRRELEVANT_DIRS = ("util", "tasks", "manager", "current", "logs", "init")
UID_IN_PATH = "[0-9a-zA-Z]{63,128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
