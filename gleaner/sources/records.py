"""Record files in their three shapes: {"records": [...]}, one object or array, or an object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _objects(c: Column, schema: str) -> Column:
    return F.filter(F.from_json(c, f"array<{schema}>"), lambda r: r.isNotNull())


def parse_records(files: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Rows of `schema` (a struct<...>) from whole texts; lines that are no objects are passed over."""
    t = F.ltrim(F.col(text))
    wrapped = F.get_json_object(t, "$.records")
    is_object, is_array = F.json_object_keys(t).isNotNull(), F.json_array_length(t).isNotNull()
    per_line = F.transform(F.filter(F.split(t, "\n"), lambda x: F.json_object_keys(x).isNotNull()), lambda x: F.from_json(x, schema))
    one = F.array(F.from_json(t, schema))
    many_lines = F.size(F.filter(F.split(F.trim(t), "\n"), lambda x: F.json_object_keys(x).isNotNull())) > 1
    rows = F.when(is_array, _objects(t, schema)).when(many_lines, per_line).when(F.json_array_length(wrapped).isNotNull(), _objects(wrapped, schema))
    rows = rows.when(is_object, one).otherwise(per_line)
    return files.select(F.explode(rows).alias("r")).select("r.*")
