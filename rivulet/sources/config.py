"""Per-source settings: a JSON object with optional keys; anything wrong in it means all defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"userAgent": "string", "requestTimeoutSec": "int", "maxItems": "int", "feedHasFullContent": "boolean"}
_SCHEMA = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ",_corrupt_record:string>"
STRUCT = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"


def decode(raw: Column) -> Column:
    """The settings as a struct of nullable fields. Unknown keys are ignored; one bad value resets all of them."""
    parsed = F.from_json(raw, _SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    bad = parsed.isNull() | parsed["_corrupt_record"].isNotNull() | ~F.trim(raw).startswith("{")
    return F.struct(*[F.when(~bad, parsed[k]).alias(k) for k in FIELDS]).cast(STRUCT)


def encode(config: Column) -> Column:
    """JSON text of a struct of settings; fields without a value are left out."""
    return F.to_json(config)


def with_config(sources: DataFrame, column: str = "config") -> DataFrame:
    return sources.withColumn(column, decode(F.coalesce(F.col(column), F.lit("{}"))))
