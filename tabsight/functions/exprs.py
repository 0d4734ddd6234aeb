"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour
# ---------------------------------------------------------------------------
# Date-like string patterns (anchored at the start of the trimmed value).
DATE_PATTERNS = [
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}",
    r"^(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}",
]
# Share of non-null values that must look like dates, then share that must parse.
DATE_MATCH_SHARE = 0.7
DATE_PARSE_SHARE = 0.8
# Exact column names tried first as a target, in priority order (profile preview).
TARGET_PRIORITY_PROFILE = [
    "y", "target", "label", "class", "churn", "status", "outcome",
    "default", "sales", "price", "revenue", "demand", "median_house_value", "deposit",
]
# Substrings that mark a column as a likely target (profile preview).
TARGET_SUBSTRINGS = ["target", "label", "outcome", "churn", "is_"]
# Exact column names tried as a target by the task decision, in priority order.
TARGET_PRIORITY_TASK = [
    "y", "target", "label", "class", "churn", "deposit", "sales", "price", "revenue",
    "median_house_value", "demand", "status",
]
# Targets that make a dated table a forecasting task.
FORECAST_TARGETS = ["sales", "demand", "volume", "revenue"]
# Column names that are row identifiers when all values are distinct.
ID_EXACT_NAMES = ["index", "instant", "row_id", "row_number"]
# Post-outcome keywords and the prefixes of legitimate history features.
POST_OUTCOME_KEYWORDS = [
    "casual", "registered", "duration", "post_event", "post_call",
    "after_outcome", "future_val", "future_outcome", "post_sale", "post_conversion",
]
HISTORY_PREFIXES = ["lag_", "roll_", "rolling_", "cal_", "hist_"]
HISTORY_STEMS = ["lag", "roll", "cal"]
# Goal-text intent words.
GOAL_FORECAST = ["forecast", "time series", "future sales", "demand", "predict next", "horizon"]
GOAL_CLASSIFY = ["classify", "classification", "churn", "subscribe", "fraud", "default", "categorical", "binary"]
GOAL_REGRESSION = ["regression", "price", "predict price", "continuous", "amount", "revenue", "cost", "value"]
GOAL_EDA = ["eda", "explore", "profile", "overview", "visualize", "summary only"]
GOAL_MARKETING = ["conversion", "marketing", "campaign", "deposit", "subscribe", "subscription", "prospect", "lead"]

# Shapes of date strings: groups year/month/day (in the named order), then an optional time of day with fraction and zone.
_TIME = r"(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME
YEAR_LAST = r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4}|\d{2})" + _TIME
MONTH_NAME = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})" + _TIME
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric and not boolean (booleans profile as categorical)."""
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def as_double(name: str) -> Column:
    """Numeric value as double with NaN folded into NULL (one missing value, as pandas)."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def is_missing(name: str, dt: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def canonical_string(name: str, dt: T.DataType) -> Column:
    """Hashable text key of a value; nested values go through JSON, NaN becomes NULL."""
    c = F.col(name)
    if isinstance(dt, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c.cast("string"))
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den, ``default`` when the denominator is zero or NULL."""
    return F.when((den.isNull()) | (den == 0), F.lit(default)).otherwise(num.cast("double") / den.cast("double"))


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness G1 from the population skewness; 0 when n <= 2."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from the population excess kurtosis; 0 when n <= 3."""
    n = n.cast("double")
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; NULL (not an ANSI division error) when either
    side has zero variance."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    den = F.stddev_samp(xx) * F.stddev_samp(yy)
    return F.when(den > 0, F.try_divide(F.covar_samp(xx, yy), den))


def count_below(values: list[float], x: Column, inclusive: bool = False) -> Column:
    """Number of the (literal) ``values`` strictly below x (or at/below with ``inclusive``) as a sum of
    comparisons: stays inside whole-stage codegen, unlike a lambda over an array."""
    out = F.lit(0)
    for v in values:
        cond = (F.lit(float(v)) <= x) if inclusive else (F.lit(float(v)) < x)
        out = out + F.coalesce(cond.cast("int"), F.lit(0))
    return out


def date_like(c: Column) -> Column:
    """True when the trimmed string starts like a date (any of DATE_PATTERNS)."""
    t = F.trim(c)
    out = None
    for p in DATE_PATTERNS:
        m = t.rlike(p)
        out = m if out is None else (out | m)
    return out


def parse_datetime(c: Column) -> Column:
    """Date string -> timestamp by its shape, NULL when it is none.

    Year first with ``-``, ``/`` or ``.``; year last, month before day with ``/`` (day before month if the first number can't
    be a month) and day before month with ``-`` or ``.``; English month names, short or full.  A time of day may
    follow, with fraction and with Z or an offset."""
    t = F.trim(c.cast("string"))

    def part(shape: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, shape, i), F.lit("")).cast("int")

    def stamp(shape: str, year: Column, month: Column, day: Column, after: int) -> Column:
        second = F.concat(F.regexp_extract(t, shape, after + 2), F.regexp_extract(t, shape, after + 3))
        zone = F.regexp_extract(t, shape, after + 4)
        clock = [year, month, day, F.coalesce(part(shape, after), F.lit(0)), F.coalesce(part(shape, after + 1), F.lit(0)),
                 F.coalesce(F.nullif(second, F.lit("")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))]
        iso = F.when(zone == "Z", "+00:00").when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
        return F.when(zone == "", F.try_make_timestamp(*clock)).otherwise(F.try_make_timestamp(*clock, F.when(zone != "", iso).otherwise("+00:00")))
    first, second, sep, last = part(YEAR_LAST, 1), part(YEAR_LAST, 3), F.regexp_extract(t, YEAR_LAST, 2), part(YEAR_LAST, 4)
    month_first = (sep == "/") & (first <= 12)
    century = F.when(last < 69, last + 2000).when(last < 100, last + 1900).otherwise(last)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(t, MONTH_NAME, 1))).cast("int")
    return (F.when(t.rlike(YEAR_FIRST), stamp(YEAR_FIRST, part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3), 4))
             .when(t.rlike(YEAR_LAST), stamp(YEAR_LAST, century, F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first), 5))
             .when(t.rlike(MONTH_NAME), stamp(MONTH_NAME, part(MONTH_NAME, 3), month, part(MONTH_NAME, 2), 4)))


def iso_format(c: Column) -> Column:
    """ISO 8601 text of a timestamp (seconds resolution, 'T' separator)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def hash_rank_key(c: Column) -> Column:
    """Deterministic 32-bit order key from md5 of the text value.

    Independent of partitioning and reproducible in other SQL engines
    (first 8 hex digits of md5 read as an unsigned integer).
    """
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(c, w) > 0)
    return out


def post_outcome(name: Column) -> Column:
    """Whether a column's name is, or holds, a word for what is known after the outcome only; inside a longer name the word
    doesn't count beside a stem of history features."""
    n = F.lower(name)
    return n.isin(POST_OUTCOME_KEYWORDS) | (contains_any(n, POST_OUTCOME_KEYWORDS) & ~contains_any(n, HISTORY_STEMS))


def id_like_name(lower_name: str) -> bool:
    """Name test for identifier columns (substring rule, as specified)."""
    return "id" in lower_name or "key" in lower_name or lower_name == "index"


def clean_filename(c: Column) -> Column:
    """Characters outside [A-Za-z0-9_.-] become '_'."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9_.\-]", "_")
