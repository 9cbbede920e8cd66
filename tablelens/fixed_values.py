"""Word lists, patterns, formats, thresholds and message texts that define the results."""

# --- text that means "no value" (compared after trim + lower case)
SENTINEL_WORDS = (
    "n/a", "na", "none", "null", "nil", "nan",
    "unknown", "undefined", "-", "--", "?", "missing",
    "not available", "not applicable", "n.a.",
)

# --- text that means true or false (compared after trim + lower case)
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")

# --- column names that mark an identifier (searched in the trimmed, lower-case name)
IDENTIFIER_NAME_PATTERNS = (
    "^id$", "_id$", "^uuid", "^index$", "^row_?num",
    "^key$", "^record_?id", "^pk$",
)

# --- value patterns
CURRENCY_SHAPE = r"^\s*[€$£¥₹]?\s*[\d,]+\.?\d*\s*[€$£¥₹]?\s*$"
CURRENCY_NOISE = r"€$£¥₹,\s"
CURRENCY_NOISE_CHARS = "€$£¥₹, \t\n\x0b\f\r"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DUPLICATE_NAME_SUFFIX = r"\.\d+$"
PLAIN_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"

# --- date text: (format, shape, rewrite to ISO), in order of preference; shapes have no month or day out of range, as failing casts are slow
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
DATE_FORMATS = (
    ("yyyy-MM-dd[ HH:mm:ss]", rf"^\d{{4}}-{_MONTH}-{_DAY}([ T]\d{{1,2}}:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?)?$", None),
    ("dd/MM/yyyy", rf"^{_DAY}/{_MONTH}/(\d{{4}})$", "$3-$2-$1"),
    ("MM/dd/yyyy", rf"^{_MONTH}/{_DAY}/(\d{{4}})$", "$3-$1-$2"),
    ("dd-MM-yyyy", rf"^{_DAY}-{_MONTH}-(\d{{4}})$", "$3-$2-$1"),
    ("yyyyMMdd", r"^(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "$1-$2-$3"),
    ("yyyy/MM/dd", rf"^(\d{{4}})/{_MONTH}/{_DAY}$", "$1-$2-$3"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"^(\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?) ?(Z|[+-]\d{2}:?\d{2})$", "$1"),
    ("MM/dd/yyyy HH:mm[:ss]", rf"^{_MONTH}/{_DAY}/(\d{{4}}) (\d{{1,2}}:\d{{2}}(:\d{{2}})?)$", "$3-$1-$2 $4"),
)

# dates alone that exist in the calendar: what parsing them by shape and casting would accept, as one pattern
_LEAP = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"


def _existing(year_first: bool, month_first: bool, mark: str, zero: str) -> str:
    def order(year: str, month: str, day: str) -> str:
        both = f"{month}{mark}{day}" if month_first else f"{day}{mark}{month}"
        return f"{year}{mark}{both}" if year_first else f"{both}{mark}{year}"

    one = [order(r"\d{4}", f"(?:{zero}[1-9]|1[0-2])", f"(?:{zero}[1-9]|1\\d|2[0-8])"),
           order(r"\d{4}", f"(?:{zero}[13-9]|1[0-2])", "(?:29|30)"),
           order(r"\d{4}", f"(?:{zero}[13578]|1[02])", "31"), order(_LEAP, f"{zero}2", "29")]
    return f"^(?:{'|'.join(one)})(?:\\r\\n|[\\r\\n])?\\z"


EXISTING_DATES = {
    "dd/MM/yyyy": _existing(False, False, "/", "0?"), "MM/dd/yyyy": _existing(False, True, "/", "0?"),
    "dd-MM-yyyy": _existing(False, False, "-", "0?"), "yyyyMMdd": _existing(True, True, "", "0"),
    "yyyy/MM/dd": _existing(True, True, "/", "0?"),
}

# --- specs
CHART_TYPES = ("bar", "line", "scatter", "histogram", "heatmap", "box")
AGGREGATIONS = ("COUNT", "AVG", "SUM", "MEDIAN", "MIN", "MAX", "NONE")
SORT_ORDERS = ("asc", "desc", "none")
FORBIDDEN_SQL_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE")
REQUIRED_SQL_SOURCE = "FROM CLEANED_DATA"
SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "identifier")

# --- report rows: rule -> (severity, issue)
ISSUES = {
    "duplicate_column": ("info", "duplicate column removed"),
    "all_null": ("drop", "all-null column removed"),
    "constant": ("drop", "constant column removed"),
    "sentinel": ("info", "sentinel null strings → NULL in view"),
    "currency": ("info", "currency symbols stripped, cast to DOUBLE in view"),
    "number": ("info", "numeric strings cast to DOUBLE in view"),
    "mixed": ("warn", "mixed types detected (numeric + text)"),
    "date": ("info", "datetime strings cast to TIMESTAMP in view"),
    "mixed_dates": ("warn", "inconsistent date formats detected"),
    "high_missing": ("warn", "high missing values"),
    "outliers": ("warn", "extreme outliers detected"),
    "duplicate_rows": ("warn", "duplicate rows detected"),
}

# --- report sentences: (severity, fragment of the issue, subject when the detail has a figure, subject otherwise, text)
# A subject of None means the sentence starts with its text.
SENTENCES = (
    ("drop", "all-null", None, None, "No data found. Removed from analysis."),
    ("drop", "constant", None, None, "Every row had the same value. Removed from analysis."),
    ("info", "currency", None, None, "Currency symbols removed. Values converted to numbers."),
    ("info", "sentinel null", "{number} values", "Some values", ' like "N/A" or "unknown" treated as empty.'),
    ("info", "numeric strings", None, None, "Numbers were stored as text. Converted to numeric."),
    ("info", "datetime", None, None, "Date text converted to proper date format."),
    ("info", "duplicate column removed", None, None, "Duplicate column removed."),
    ("warn", "outlier", "{number} value(s)", "Some values", " are unusually high or low. Shown as-is in charts."),
    ("warn", "mixed types", None, None, "Contains both numbers and text. Used as text only."),
    ("warn", "inconsistent date", None, None, "Date formats are not consistent. Time charts may not work."),
    ("warn", "duplicate rows", "{number} duplicate rows", "Duplicate rows", " found in the data. Kept as-is."),
    ("warn", "high missing", "{percent} of values", "Many values", " are empty. Charts may be incomplete."),
)
NO_CHANGES_TEXT = "Your data looks clean. No changes were needed."
CHANGES_HEADER = "While preparing your data, the following changes were made:\n"
NO_ISSUES_CONTEXT = "Data quality: no issues found. All columns are clean."
CONTEXT_HEADER = "Data quality context (use when deciding which charts to generate):"
SEVERITY_LABELS = {"drop": "DROPPED", "warn": "WARNING"}
BUCKETS = (("drop", "Removed"), ("warn", "Note"), ("info", "Fixed"))
EMPTY_RESULT_TEXT = "No data returned."
