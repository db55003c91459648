"""Nested records: a walk over the schema that builds one projection, for structs, arrays, maps and variants at any depth."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.text import fingerprint

# Keys whose texts a log keeps only as fingerprints.
TEXT_KEYS = ("resume_text", "jd_text", "text", "raw_text", "content", "prompt", "user_prompt", "completion", "response_text")
# Keys that are never stored, and ids that may be.
FORBIDDEN = (
    "passport|national[ _-]?id|identity[ _-]?(card|number|no)|id[ _-]?(card|number|no)|nric|mykad|aadhaar|ssn|social[ _-]?security|residence[ _-]?permit|"
    "tax[ _-]?(id|identification)|licen[cs]e[ _-]?(number|no)"
)
SAFE = "(student|matric(ulation)?|enrol?ment|application|candidate|reference)[ _-]?(id|no|number)"
# Keys of a profile that hold no words of the applicant.
NOT_PRIVATE = ("resume_id", "jd_id", "title", "purpose", "notes")


def key_forbidden(key: Column) -> Column:
    flat = F.trim(F.regexp_replace(key, r"[_\-.]+", " "))
    return ~flat.rlike("(?i)" + SAFE) & flat.rlike("(?i)" + FORBIDDEN)


def name_forbidden(key: str) -> bool:
    """The same of a field's name."""
    flat = re.sub(r"[_\-.]+", " ", key).strip()
    return not re.search(SAFE, flat, re.I) and re.search(FORBIDDEN, flat, re.I) is not None


def _kept(col: Column, value: Column) -> Column:
    return F.when(col.isNotNull(), value)


def _marked(text: Column) -> Column:
    """A fingerprint as JSON, for values whose type has to stay text."""
    return F.to_json(fingerprint(text))


def scrub(col: Column, kind: T.DataType, name: str = "") -> Column:
    """``col`` with every text under a text-like key replaced by its fingerprint.

    A struct's field becomes a struct of chars and hash; in a map, whose values share a type, its JSON. Texts that are elements of
    a list stay, whatever the list's key, as do nulls. Keys compare without case.
    """
    if isinstance(kind, T.StringType):
        return _kept(col, fingerprint(col)) if name.lower() in TEXT_KEYS else col
    if isinstance(kind, T.StructType):
        return _kept(col, F.struct(*[scrub(col.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: scrub(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(col, lambda k, v: F.when(F.lower(k).isin(*TEXT_KEYS) & v.isNotNull(), _marked(v)).otherwise(v))
        return F.transform_values(col, lambda _, v: scrub(v, kind.valueType))
    if isinstance(kind, T.VariantType):
        return F.parse_json(scrub_json(F.to_json(col)))
    return col


def strip(col: Column, kind: T.DataType) -> Column:
    """``col`` without the fields and entries, at any depth, whose key may not be stored."""
    if isinstance(kind, T.StructType):
        left = [strip(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields if not name_forbidden(f.name)]
        return _kept(col, F.struct(*left)) if left else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: strip(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        allowed = F.map_filter(col, lambda k, _: ~key_forbidden(k))
        return F.transform_values(allowed, lambda _, v: strip(v, kind.valueType))
    if isinstance(kind, T.VariantType):
        return F.parse_json(strip_json(F.to_json(col)))
    return col


def strings(col: Column, kind: T.DataType, skip: tuple[str, ...] = ()) -> Column:
    """All texts of ``col`` at any depth, in order, without those under the keys of ``skip``."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(col.isNotNull(), F.array(col)).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [strings(col.getField(f.name), f.dataType, skip) for f in kind.fields if f.name not in skip]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(col, lambda x: strings(x, kind.elementType, skip))), none)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        own = F.filter(F.map_entries(col), lambda e: ~e["key"].isin(*skip)) if skip else F.map_entries(col)
        return F.coalesce(F.flatten(F.transform(own, lambda e: strings(e["value"], kind.valueType, skip))), none)
    return none


def _walk(value, key: str, change):
    if isinstance(value, dict):
        changed = ((k, change(k, v)) for k, v in value.items())
        return {k: _walk(v, k, change) for k, v in changed if v is not _GONE}
    return [_walk(v, key, change) for v in value] if isinstance(value, list) else value


_GONE = object()


def _scrubbed(k: str, v):
    if isinstance(v, str) and k.lower() in TEXT_KEYS:
        return {"chars": len(v), "sha256_8": hashlib.sha256(v.encode()).hexdigest()[:8]}
    return v


def _stripped(k: str, v):
    return _GONE if name_forbidden(k) else v


@F.pandas_udf(T.StringType())
def scrub_json(text: pd.Series) -> pd.Series:
    """JSON of any shape, scrubbed; the keys of such records are known only row by row."""
    return text.map(lambda t: None if t is None else json.dumps(_walk(json.loads(t), "", _scrubbed), ensure_ascii=False))


@F.pandas_udf(T.StringType())
def strip_json(text: pd.Series) -> pd.Series:
    """JSON of any shape without the keys that may not be stored."""
    return text.map(lambda t: None if t is None else json.dumps(_walk(json.loads(t), "", _stripped), ensure_ascii=False))
