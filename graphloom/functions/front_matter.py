"""Front-matter fields.

Front matter is YAML, which has no built-in Spark parser. It is short and only a
small part of each document, so a Pandas UDF parses it batch by batch; malformed
input yields NULL fields.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("full_link", T.StringType()),
    T.StructField("short_description", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("weight", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
_TEXT_FIELDS = ["title", "id", "full_link", "short_description", "description"]


def _fields(text: str | None) -> dict[str, Any]:
    import yaml

    # The libyaml loader reads the same language several times faster.
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    row: dict[str, Any] = dict.fromkeys(FIELDS.fieldNames())
    try:
        parsed = yaml.load(text, Loader=loader) if text else None
    except yaml.YAMLError:
        parsed = None
    if not isinstance(parsed, dict):
        return row
    for name in _TEXT_FIELDS:
        value = parsed.get(name)
        row[name] = None if value is None else str(value)
    weight = parsed.get("weight")
    row["weight"] = weight if isinstance(weight, int) and abs(weight) < 2**31 else None
    tags = parsed.get("tags")
    row["tags"] = [str(t) for t in tags] if isinstance(tags, list) else None
    return row


@F.pandas_udf(FIELDS)
def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_fields(t) for t in texts], columns=FIELDS.fieldNames()).astype(object)


def front_matter_fields(front_matter: Column) -> Column:
    """Struct (title, id, full_link, short_description, description, weight, tags)."""
    return _parse(front_matter)
