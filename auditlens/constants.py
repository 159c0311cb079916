"""Fixed values that decide results. They are part of the data contract, not tuning."""

# Fields of one process-audit record, all text.
AUDIT_FIELDS = (
    "ccmdline",
    "cexe",
    "cname",
    "cpid",
    "pcmdline",
    "pexe",
    "pname",
    "ppid",
)

# Class labels and the signed form used by one-class detectors.
NORMAL = 0
ABNORMAL = 1

# Header line of a labelled command file.
LABELLED_HEADER = "cmdline,label"

# White space as Python's str.split() and str.strip() see it.
WHITESPACE = (
    " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[ \t\n\x{b}\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Repetitive command patterns, tried in this order, and rows kept of each.
REPETITIVE_PATTERNS = (
    ("grep", r"^grep -w [0-9]+"),
    ("readlink", r"^readlink /proc/[0-9]+/exe"),
    ("top", r"^top -p [0-9]+ -bn 1"),
    ("jstat", r"^(/[\p{L}\p{N}_]+)+/jstat -gc [0-9]+"),
    ("cp", r"^cp -rf /opt/webserver/"),
)
PATTERN_CAP = 500

# Commands always known as normal (final data set, nearest-distance detector).
DATASET_SEEDS = ("readlink", "grep -w", "top", "jstat")
DETECTOR_SEEDS = ("readlink", "grep", "top", "jstat")

# Tokens that glue a normal and an abnormal command together.
INJECTION_TOKENS = ("|", "||", "&&", ";")

# Cheat-sheet rows holding commands, (first, last) inclusive, None = open.
CHEAT_SHEET_RANGES = ((1, 91), (116, None))

# Lexical counters as (column, counted text, divisor).
LEXICAL_COUNTERS = (
    ("single_quotes", "'", 2),
    ("double_quotes", '"', 2),
    ("redirects", ">", 1),
    ("semicolons", ";", 1),
    ("dollars", "$", 1),
    ("percents", "%", 1),
    ("pipes", "|", 1),
    ("parentheses", "(", 1),
    ("braces", "{", 1),
    ("defines", "-D", 1),
    ("yum", " yum ", 1),
    ("echo", " echo ", 1),
    ("cat", " cat ", 1),
    ("ls", " ls ", 1),
    ("sudo", " sudo ", 1),
    ("chmod", " chmod ", 1),
    ("etc", "etc", 1),
    ("passwd", "passwd", 1),
    ("shell_script", ".sh", 1),
)

# Headings that introduce usage examples on a documentation page.
EXAMPLE_TITLES = ("实例", "例子")

# Threshold grids as (first, last, count).
NEAREST_BOUNDS = (0.2, 0.7, 21)
CENTROID_BOUNDS = (0.8, 1.2, 300)
