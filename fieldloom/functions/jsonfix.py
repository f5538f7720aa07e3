"""Tolerant reading of JSON that a language model wrote."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.names import col

#: Endings that may close a cut-off array.
CLOSERS = ("]", "}]", "\"}]", "}}]", "\"}}]", "null}]")


def _records(value) -> list[dict] | None:
    """The objects of a parsed value: of a list, of an object's first list, or the object itself."""
    if isinstance(value, dict):
        inner = next((v for v in value.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)), None)
        value = [value] if inner is None else inner
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else None


def _parsed(text: str):
    try:
        return _records(json.loads(text))
    except (ValueError, RecursionError):
        return None


def repair_records(raw: str | None) -> list[str]:
    """The objects in a reply, each as JSON: reasoning, fences and prose removed, a cut-off tail closed."""
    text = re.sub(r"<think>.*?(</think>|$)", "", raw or "", flags=re.S)
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    text = (fenced[1] if fenced else text).strip()
    starts = [i for i in (text.find("["), text.find("{")) if i >= 0]
    if not starts:
        return []
    body = text[min(starts) :]
    tries = [body]
    last = max(body.rfind("]"), body.rfind("}"))
    if last > 0:
        tries.append(body[: last + 1])
    tries += [body.rstrip().rstrip(",") + c for c in CLOSERS]
    if last > 0 and body.startswith("["):
        tries.append(body[: body.rfind("}") + 1] + "]")
    for attempt in tries:
        found = _parsed(attempt)
        if found is not None:
            return [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found]
    # what is whole among the pieces
    pieces = [_parsed(m[0]) for m in re.finditer(r"\{[^{}]*\}", body)]
    return [json.dumps(x, ensure_ascii=False, sort_keys=True) for p in pieces if p for x in p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repair(raw: pd.Series) -> pd.Series:
    return raw.map(repair_records)


def json_records(c: Column | str) -> Column:
    """array<string> of the objects in a reply; empty where there are none."""
    return _repair(col(c))
