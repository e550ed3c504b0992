"""Column expressions that read one raw text cell. Built-ins only, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesight import vocab

GROUPED = r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$"
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
INTEGRAL = r"^[-+]?[0-9]+(\.0*)?$"
RANGE = r"^[0-9A-Za-z.]+ *(~| to ) *[0-9A-Za-z.]+$"
UNIT = r"^[-+]?[0-9.]+ ?[A-Za-z]+$"
MULTI = r"[,;|]"
PERCENT = r"^[-+]?[0-9.]+ ?%$"
CURRENCY = r"^[-+]?[$€£]"
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$"
URL = r"^https?://"
CODE = r"^[A-Za-z]+[#_-]?[0-9]+$"
COUNTRY = r"^[A-Z]{2}$"
WORDS = r"^[A-Za-z][A-Za-z ]*$"
PROSE = r"[A-Za-z]+ [A-Za-z]+"
EXPORT_INDEX = r"(?i)^(unnamed: ?[0-9]+|index)$"

# Text shape a date must have before a format is tried, with the Spark pattern for it.
DATE_FORMATS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"),
    (r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
)
DATETIME_FORMATS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
)


_SPACES = " \t\n\x0b\f\r"


def trimmed(c: Column) -> Column:
    """Strip every kind of leading and trailing whitespace (plain ``trim`` would leave newlines)."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def missing_token(c: Column) -> Column:
    """The placeholder a cell spells, lower-cased, or null."""
    token = F.lower(trimmed(c))
    return F.when(token.isin(*vocab.MISSING_TOKENS), token)


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)), F.lit("")).isin("", *vocab.MISSING_TOKENS)


def bare_number(c: Column) -> Column:
    """Cell text without currency signs, grouping commas and whitespace."""
    return F.translate(c, "$€£," + _SPACES, "")


def read_number(c: Column) -> Column:
    """Cell text as a plain number would be written: commas count as thousands groups only, blanks inside never."""
    text = trimmed(F.translate(c, "$€£", ""))
    return F.when(text.rlike(GROUPED), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)


def as_double(c: Column) -> Column:
    text = read_number(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def as_date(c: Column) -> Column:
    text = trimmed(c)
    tries = [F.when(text.rlike(shape), F.try_to_date(text, fmt)) for shape, fmt in DATE_FORMATS]
    return F.coalesce(*tries)


def as_datetime(c: Column) -> Column:
    text = trimmed(c)
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
        for shape, fmt in DATETIME_FORMATS
    ]
    return F.coalesce(*tries, as_date(c).cast("timestamp_ntz"))


def as_boolean(c: Column) -> Column:
    token = F.lower(trimmed(c))
    return F.when(token.isin(*vocab.TRUE_TOKENS), F.lit(True)).when(
        token.isin(*vocab.FALSE_TOKENS), F.lit(False)
    )


def family_id(stem: Column) -> Column:
    """Snake-case a column stem, splitting at letter/digit and lower/upper boundaries."""
    split = F.regexp_replace(stem, r"([A-Za-z])([0-9])", "$1_$2")
    split = F.regexp_replace(split, r"([0-9])([A-Za-z])", "$1_$2")
    split = F.regexp_replace(split, r"([a-z])([A-Z])", "$1_$2")
    split = F.regexp_replace(F.lower(split), r"[^a-z0-9]+", "_")
    return F.regexp_replace(split, r"^_+|_+$", "")


def piped_labels(c: Column) -> Column:
    """Pipe-delimited label text to an array of trimmed non-blank labels."""
    return F.filter(F.transform(F.split(c, r"\|"), trimmed), lambda x: x != "")


def fill_template(prefix: Column, value: Column) -> Column:
    return F.concat_ws(":", prefix, value)


def json_number(raw: Column) -> Column:
    """The number held by a JSON text, or null when it is a boolean, string or absent."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    numeric = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def is_json(raw: Column) -> Column:
    """True when the whole text is one JSON value.

    The parser stops after the first value and would accept trailing text, so the text is parsed as
    the first item of an array whose last item is known.
    """
    mark = "end of document"
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{mark}"]'))), "$", "array<variant>")
    last = lambda x: F.try_variant_get(F.get(x, F.lit(1)), "$", "string")
    # named once by the lambda, so that the text is parsed once
    return F.coalesce(F.exists(F.array(items), lambda x: (F.size(x) == 2) & (last(x) == mark)), F.lit(False))


def json_error(raw: Column, field: str) -> Column:
    """Why a JSON object text cannot be used, or null when it can."""
    return (
        F.when(raw.isNull(), F.lit(f"{field} must be a string."))
        .when(trimmed(raw) == "", F.lit(f"{field} is empty."))
        .when(~is_json(raw), F.lit(f"{field} is not valid JSON"))
        .when(~trimmed(raw).startswith("{"), F.lit(f"{field} root must be an object."))
    )
