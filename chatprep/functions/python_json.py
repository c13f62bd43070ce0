"""JSON text as Python writes it: sorted keys, ``, `` and ``: `` between parts, ASCII only.

Python's own reader and writer do it, in Arrow batches: a fold of column functions over a
text's signs took nine times as long.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _written(content: bytes | None) -> str | None:
    if content is None:
        return None
    text = content.decode(errors="replace")
    try:
        value = json.loads(text)
        if "\\ud" in text or "\\uD" in text:
            # Python keeps half a pair of surrogates, which no text of Spark's can hold.
            json.dumps(value, ensure_ascii=False).encode()
        return json.dumps(value, sort_keys=True)
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(StringType())
def _python_json(texts: pa.Array) -> pa.Array:
    return pa.array(map(_written, texts.to_pylist()), pa.string())


def python_json(text: Column) -> Column:
    """``json.dumps(json.loads(text), sort_keys=True)``; null for null, and for what Python refuses.

    The last of repeated keys counts, ``NaN`` and the infinities are values. Used twice over
    one column, it runs once.
    """
    return _python_json(text.cast("string").cast("binary"))


def python_args_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the text as Python writes it."""
    return F.substring(F.sha2(python_json(text), 256), 1, 16)
