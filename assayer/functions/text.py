"""Scalar functions, all built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".swift": "swift",
    ".kt": "kotlin",
    ".json": "json",
}
# Suffixes of the files that are analysed.
CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".cpp", ".c", ".rb", ".php", ".json")
# Fixed value: the address of a repository, with its owner and name.
REPOSITORY = r"^https?://github\.com/([^/]+)/([^/]+)"


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """A constant dimension table as a map expression; unknown and null keys take the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def lines_of(content: Column) -> Column:
    """Lines as split at line feeds: carriage returns stay, an empty text is one line."""
    return F.split(content, "\n")


def line_count(content: Column) -> Column:
    return F.size(lines_of(content)).cast("long")


def suffix(path: Column) -> Column:
    """The last suffix of the last path part, with its dot; empty for names without one."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^/.]+)$", 1)


def language_of(path: Column) -> Column:
    return lookup(F.lower(suffix(path)), LANGUAGES, "unknown")


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_version(version: Column) -> Column:
    """Digits and dots of a version range, whatever they stood for."""
    return F.regexp_replace(version, r"[^\p{Nd}.]", "")


def is_repository_url(url: Column) -> Column:
    return url.rlike(REPOSITORY)


def repository_of(url: Column, faithful: bool = True) -> Column:
    """``owner/name``; ``.git`` goes wherever it stands, or, not faithful, at the end alone."""
    part = lambda k: F.regexp_extract(url, REPOSITORY, k)
    name = F.replace(part(2), F.lit(".git"), F.lit("")) if faithful else F.regexp_replace(part(2), r"\.git$", "")
    return F.when(is_repository_url(url), F.concat_ws("/", part(1), name))


def archive_name(filename: Column) -> Column:
    return F.replace(filename, F.lit(".zip"), F.lit(""))


def random_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def utc_timestamp(value: Column) -> Column:
    """ISO text as a timestamp, null where it is none; text without a zone is UTC, whatever the session's zone."""
    text = value.cast("string")
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def expires_at(created: Column, days: int = 7) -> Column:
    """The end of a session that starts at ``created``."""
    return created + F.make_dt_interval(F.lit(days))


def local_date(time: Column) -> Column:
    """Month/day/year without leading zeros, as a US browser writes it."""
    return F.date_format(time, "M/d/yyyy")


def local_time(time: Column) -> Column:
    return F.date_format(time, "h:mm:ss a")


def local_datetime(time: Column) -> Column:
    return F.concat_ws(", ", local_date(time), local_time(time))


def fixed(value: Column, digits: int) -> Column:
    """Text with so many digits after the point; ties of the shortest decimal form go up."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def grouped(value: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(value, 0)


def megabytes(size: Column, faithful: bool = True) -> Column:
    """Whole bytes in MB with two digits, null for null; ties go up as in a browser, or, not faithful, to the even digit."""
    mb = size / F.lit(1024.0) / F.lit(1024.0)
    # The part after the point has at most 20 binary digits here, so a hundred times it is exact and a tie is seen as one.
    digits = mb if faithful else F.floor(mb) + F.rint((mb - F.floor(mb)) * 100) / 100
    return F.concat(F.when(mb.isNotNull(), fixed(digits, 2)), F.lit(" MB"))


def progress(value: Column) -> Column:
    """A bar's length from 0 to 100; null is 0."""
    return F.least(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(100.0))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def or_default(value: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def first_word(name: Column) -> Column:
    return F.get(F.split(name, " "), F.lit(0))


def contains_ignoring_case(column: Column, needle: str) -> Column:
    """False for null; an empty needle is in every text."""
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def half_even(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """A ratio of integers, not negative, rounded half to even without a double in between."""
    scaled = numerator * 10**digits
    rest = scaled % denominator
    quotient = ((scaled - rest) / denominator).cast("long")
    up = (2 * rest > denominator) | ((2 * rest == denominator) & (quotient % 2 == 1))
    return (quotient + F.when(up, 1).otherwise(0)) / F.lit(float(10**digits))



def string_map(json: Column, path: str) -> Column:
    """The entries of a JSON object whose values are strings; an empty map where there is no object.

    Numbers, lists, objects, booleans and nulls are values of other types and are left out.
    """
    found = F.from_json(F.get_json_object(json, path), "map<string,variant>")
    text = F.map_filter(found, lambda _, v: F.schema_of_variant(v) == "STRING")
    typed = F.transform_values(text, lambda _, v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(typed, F.create_map().cast("map<string,string>"))
