"""Normal form of tools' JSON schemas, over a column of their JSON texts.

Schemas nest as deep as they like, which an expression can't follow; they are few, and the JSON reader already visits
their objects from the inside out, so a hook for one object does all of it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that come first in a normalized schema, in this order.
FIRST_KEYS = ("type", "description", "enum", "default", "items", "properties", "required")
_PLACE = {key: place for place, key in enumerate(FIRST_KEYS)}


def _object(fields: list[tuple[str, object]]) -> dict:
    """One object, whose inner ones are in normal form: its fields less the noise, in order."""
    kept = [(k, v) for k, v in fields if k != "title" and (k != "default" or v is not None)]
    for key, choices in kept:
        if key == "anyOf" and isinstance(choices, list):
            real = [c for c in choices if c != {"type": "null"}]
            if len(real) == 1 and isinstance(real[0], dict):
                kept = list((real[0] | {k: v for k, v in kept if k != "anyOf"}).items())
    return dict(sorted(kept, key=lambda field: _PLACE.get(field[0], len(_PLACE))))


def normalize_schema(schema: Column) -> Column:
    """JSON text of a schema (JSON text) without titles and null defaults, a choice of one type or null as that type.

    Known keys come first, the others as they come. Text that is no JSON, and null, give null.
    """

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return json.dumps(json.loads(text, object_pairs_hook=_object), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return texts.map(one)

    return normal(schema)
