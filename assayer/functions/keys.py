"""Keys from contents: hashes that are the same wherever they are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON writes it."""
    packed = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def item_key(input_text: Column, gold: Column, prediction: Column) -> Column:
    """16 hex digits of the SHA-256 of the three as a JSON object with sorted names."""
    text = F.concat(F.lit('{"gold": '), json_text(gold), F.lit(', "input": '), json_text(input_text), F.lit(', "prediction": '), json_text(prediction), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON list."""
    written = [F.when(p.isNull(), "null").otherwise(p.cast("string")) if i else p.cast("string") for i, p in enumerate(parts)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *written), F.lit("]")), 256)


def ordering_hash(seed: int, namespace: str | Column, key: Column) -> Column:
    """What a seeded order goes by."""
    space = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), space, key.cast("string")), 256)


def item_id(own: Column, input_text: Column, prefix: str = "item-") -> Column:
    """The item's own id, or one from its input."""
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.concat(F.lit(prefix), F.substring(F.sha2(F.coalesce(input_text, F.lit("")), 256), 1, 16)))


def choice_number(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that picks one of several."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")
