"""Column expressions: parsing, typing, buckets, labels, hashes. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- buckets and bounds


def bucketize(value: Column, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """The label of the right-closed bucket (edges[i], edges[i+1]] that holds the value; null outside, for null and NaN."""
    out = None
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        above = value >= F.lit(float(low)) if include_lowest and i == 0 else value > F.lit(float(low))
        inside = above & (value <= F.lit(float(high))) & ~F.isnan(value.cast("double"))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value held within bounds; null stays null (greatest and least skip nulls)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio(above: Column, below: Column, default: float | None = None) -> Column:
    """above / below; the default where below is 0 or either is null."""
    out = F.try_divide(above.cast("double"), below.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


# --- parsing

# Currency signs and codes that numbers may carry, and words for true and false.
CURRENCY = r"[$€£¥%]|USD|EUR|GBP|JPY"
TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")
# Time formats, in the order tried.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy")
TIME_SHAPES = (
    r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d$",
    r"^\d\d/\d\d/\d{4}$", r"^\d{4}/\d\d/\d\d$", r"^\d\d-[A-Z][a-z]{2}-\d{4}$",
)
# Shapes of likely dates.
DATE_SHAPES = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$")


def parse_number(text: Column, style: str = "mixed") -> Column:
    """A double from text with currency signs, percent, (negative) brackets and separators; null if it isn't a finite number.

    style `us`: commas separate thousands. `eu`: dots do, the comma is the decimal sign. `mixed`: with both signs commas are
    dropped if the last dot follows them, else the dots stay and the comma goes (1.234,56 is 1.23456); one lone comma is the
    decimal sign (1,234 is 1.234); several lone commas are no number.
    """
    trimmed = F.trim(text)
    bracketed = trimmed.rlike(r"^\(.*\)$")
    bare = F.trim(F.regexp_replace(F.when(bracketed, F.regexp_replace(trimmed, r"^\(|\)$", "")).otherwise(trimmed), CURRENCY, ""))
    if style == "us":
        plain = F.regexp_replace(bare, ",", "")
    elif style == "eu":
        plain = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    else:
        plain = F.when(bare.contains(",") & bare.contains("."), F.regexp_replace(bare, ",", "")).otherwise(F.regexp_replace(bare, ",", "."))
    number = F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), plain).try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.when(bracketed, -finite).otherwise(finite)


def parse_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE), F.lit(True)).when(word.isin(*FALSE), F.lit(False))


def parse_timestamp(text: Column) -> Column:
    """A timestamp by the first format that fits, else from whole seconds since 1970 below 2**31 - 1."""
    value = F.trim(text)
    tried = [F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(form))) for shape, form in zip(TIME_SHAPES, TIME_FORMATS, strict=True)]
    seconds = F.when(value.rlike(r"^\+?\d{1,10}$"), value).try_cast("bigint")
    return F.coalesce(*tried, F.when((seconds > 0) & (seconds < 2147483647), F.timestamp_seconds(seconds)))


def normalize_text(text: Column) -> Column:
    """Trimmed, lower case, white-space runs as one space, control characters dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"[\x00-\x1f\x7f]", "")


def coerce_value(text: Column, style: str = "mixed") -> Column:
    """The tagged value of a text: numeric, else boolean, else timestamp, else string; missing for null and ''."""
    missing = text.isNull() | (text == "")
    number, truth, when = parse_number(text, style), parse_boolean(text), parse_timestamp(text)
    kind = F.when(missing, "missing").when(number.isNotNull(), "numeric").when(truth.isNotNull(), "boolean").when(when.isNotNull(), "timestamp").otherwise("string")
    return F.struct(
        kind.alias("type"), F.when(kind == "string", normalize_text(text)).alias("string_val"), F.when(kind == "numeric", number).alias("numeric_val"),
        F.when(kind == "boolean", truth).alias("boolean_val"), F.when(kind == "timestamp", when).alias("timestamp_val"), missing.alias("is_missing"),
    )


def likely_date(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("|".join(DATE_SHAPES)), F.lit(False))


# --- time

#: Seconds of the grains; a month has 30 days and a year 365.
GRAINS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "quarter": 90 * 86400, "year": 365 * 86400}


def truncated(ts: Column, grain: str) -> Column:
    """The start of the hour, day, Monday's week or month."""
    return F.date_trunc(grain, ts)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double, of timestamps with or without a zone (the latter taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def age_days(since: Column, as_of: Column) -> Column:
    """Whole days of 24 hours from since to as_of."""
    return F.floor((epoch(as_of) - epoch(since)) / 86400)


# --- sets, keys, hashes


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all of two arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def category_key(value: Column) -> Column:
    """A number as a category: whole ones without a point, others with six significant digits and no trailing zeros."""
    digits = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+$", "$1")
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("bigint").cast("string")).otherwise(F.regexp_replace(digits, r"\.$", ""))


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, nulls as ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def family_id(*keys: str) -> str:
    """The id of a test family."""
    return "family_" + "|".join(keys)


def poly_hash(text: Column, base: int = 31, seed: int = 0, modulus: int = 1 << 31) -> Column:
    """Polynomial hash of the code points; djb2 has base 33 and seed 5381. The modulus bounds it, as sums may not wrap here."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(seed).cast("bigint"), lambda acc, c: (acc * base + F.ascii(c)) % F.lit(modulus))


def lookup_label(value: Column, labels: Mapping, default=None) -> Column:
    """A label by value from a small map."""
    out = None
    for k, v in labels.items():
        out = F.when(value == F.lit(k), F.lit(v)) if out is None else out.when(value == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


# --- labels

# Least absolute values of moderate, strong and very strong signals, by test.
SIGNALS = {"mutual_information": (0.1, 0.3, 0.5), "welch_t": (0.2, 0.5, 0.8), "chi_square": (0.1, 0.3, 0.5), "spearman": (0.1, 0.3, 0.5), "cross_correlation": (0.2, 0.4, 0.7), "pearson": (0.1, 0.3, 0.5)}


def signal_label(effect: Column, test: str = "pearson") -> Column:
    moderate, strong, very = SIGNALS[test]
    size = F.abs(effect)
    return F.when(size >= very, "very_strong").when(size >= strong, "strong").when(size >= moderate, "moderate").otherwise("weak")


def verdict(q: Column, n: Column) -> Column:
    """The verdict of a screened pair by q-value and sample size."""
    return (
        F.when(n < 50, "INSUFFICIENT_DATA").when(q.isNull(), "NOT_RUN").when((q <= 0.01) & (n >= 200), "STRONG")
        .when((q <= 0.05) & (n >= 100), "MODERATE").when(q <= 0.05, "WEAK").otherwise("FAIL")
    )


def confidence_level(p: Column, effect: Column) -> Column:
    size = F.abs(effect)
    return F.when((p < 0.001) & (size > 0.5), "very_high").when((p < 0.01) & (size > 0.3), "high").when((p < 0.05) & (size > 0.1), "moderate").otherwise("low")


# Cohen's small, medium and large effects by measure.
PRACTICAL = {"correlation": (0.1, 0.3, 0.5), "cohen_d": (0.2, 0.5, 0.8), "cramers_v": (0.1, 0.3, 0.5)}


def practical_significance(effect: Column, measure: str) -> Column:
    small, medium, large = PRACTICAL[measure]
    size = F.abs(effect)
    return F.when(size >= large, "large").when(size >= medium, "medium").when(size >= small, "small").otherwise("negligible")
