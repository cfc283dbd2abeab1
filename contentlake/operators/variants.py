"""Values of any kind: ops whose values are booleans, texts, numbers or null, and scopes as documents, as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.operators.sync import KEY, clock


def typed(ops: DataFrame, json: str = "json") -> DataFrame:
    """Ops with ``val``, the value that a column of JSON texts spells; what isn't JSON is null, as a missing value."""
    return ops.withColumn("val", F.try_parse_json(json)).drop(json)


def resolve(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The winning write of each key, whatever its kind; values aren't compared, only clocks are."""
    return ops.groupBy(*key).agg(F.max_by("val", clock()).alias("val"), F.max(clock()).alias("w")).select(*key, "val", "w.lamport", "w.device_id", (-F.col("w.col3")).alias("seq"))


def kind(value: Column) -> Column:
    """boolean, text, number or null."""
    of = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), "null").when(of == "BOOLEAN", "boolean").when(of == "STRING", "text").otherwise("number")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def scope_folders(clients: DataFrame) -> DataFrame:
    """(device_id, days, starred, folder_id): a row for each folder of each client's scope (``spec``, a VARIANT); days and starred
    are null where the scope doesn't name them or they are of another kind."""
    rows = clients.select("device_id", "spec", F.try_variant_get("spec", "$.days", "int").alias("days"), F.try_variant_get("spec", "$.starred", "boolean").alias("starred"))
    text = "SELECT c.device_id, c.days, c.starred, CAST(f.value AS STRING) AS folder_id FROM {rows} c, LATERAL variant_explode(variant_get(c.spec, '$.folders', 'variant')) f"
    return clients.sparkSession.sql(text, rows=rows)
