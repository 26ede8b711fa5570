"""The eight column types, and coercion of JSON values to them as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire type and Spark type.
SPARK_TYPES = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "JSON": "string",
}
PREVIEW = 60
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
# Texts of plain values, of which the type says all: of these no shape is asked for.
_PLAIN = {"INTEGER": r"^-?\d{1,9}\z", "BIGINT": r"^-?\d{1,18}\z", "DOUBLE": r"^-?\d{1,15}(\.\d{1,15})?([eE]-?\d{1,2})?\z", "BOOLEAN": r"^(true|false)\z", "VARCHAR": r"^[^\[{]"}
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def spark_type(kind: str) -> str:
    if kind not in SPARK_TYPES:
        raise ValueError(f"{kind[:60]!r} is no column type; the types are {', '.join(SPARK_TYPES)}")
    return SPARK_TYPES[kind]


def coerced(value: Column, kind: str, name: str) -> Column:
    """The variant `value` as a column of the type; absent and null become NULL, a value that doesn't fit stops the query
    with an error that names the column and shows the value's first characters."""
    spark_type(kind)
    shape = F.schema_of_variant(value)
    text = F.variant_get(value, "$", "string")
    nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    absent = value.isNull() | (shape == "VOID")
    if kind == "JSON":
        return F.when(~absent, F.to_json(value))
    is_text, is_bool = shape == "STRING", shape == "BOOLEAN"
    is_number = ~nested & ~is_text & ~is_bool & ~absent
    number = F.when(is_number | (is_text & text.rlike(_NUMBER)), F.trim(text).try_cast("double"))
    whole = F.trim(text).try_cast("decimal(38,10)")
    fits: Column
    made: Column
    if kind == "VARCHAR":
        fits, made = ~nested, text
    elif kind in ("INTEGER", "BIGINT"):
        low, high = (-(2**31), 2**31 - 1) if kind == "INTEGER" else (-(2**63), 2**63 - 1)
        fits = number.isNotNull() & (whole == F.floor(whole)) & whole.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
        made = F.trim(text).try_cast("decimal(38,10)").try_cast(SPARK_TYPES[kind])
    elif kind == "DOUBLE":
        fits = number.isNotNull() & ~F.isnan(number) & (F.abs(number) <= F.lit(1.7976931348623157e308))
        made = number
    elif kind == "BOOLEAN":
        fits = is_bool | (is_text & text.isin("true", "false")) | (is_number & number.isin(0.0, 1.0))
        made = F.when(text.isin("true", "1"), True).otherwise(False)
    else:
        stamp = F.when(is_number, F.timestamp_millis(number.try_cast("bigint"))).otherwise(F.when(is_text & text.rlike(_ISO), text.try_cast("timestamp")))
        fits, made = stamp.isNotNull(), F.to_utc_timestamp(stamp, F.current_timezone()).cast("timestamp_ntz")
        if kind == "DATE":
            made = made.cast("date")
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: "), F.substring(F.to_json(value), 1, PREVIEW), F.lit(f" is no {kind}")))
    out = F.when(absent, F.lit(None)).when(F.coalesce(fits, F.lit(False)), made).otherwise(wrong).cast(SPARK_TYPES[kind])
    if kind in _PLAIN:
        return F.when(text.rlike(_PLAIN[kind]), text if kind == "VARCHAR" else text.try_cast(SPARK_TYPES[kind])).otherwise(out)
    return out
