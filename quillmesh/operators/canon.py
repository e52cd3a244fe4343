"""Canonical text: what the rules look at, with the source range of each character.

Format characters go, each remaining character is normalised by itself (NFKC), and obfuscated marks ([at], (dot)) become the characters they
stand for. Usual texts are their own canonical form and never leave the JVM; only the others pass a vectorised function.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import patterns as P

CANONICAL = T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def is_usual(text: Column) -> Column:
    """Whether the canonical form is the text itself."""
    return ~(text.rlike(P.UNUSUAL) | text.rlike(P.MARKED))


def canonical(text: str | None) -> tuple[str, list[int], list[int]]:
    """Canonical text and, for each of its characters, where its source starts and ends."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for i, c in enumerate(text or ""):
        if unicodedata.category(c) != "Cf":
            for n in unicodedata.normalize("NFKC", c):
                chars.append(n)
                starts.append(i)
                ends.append(i + 1)
    for name, sign in P.MARKERS:
        now = "".join(chars)
        # From the last match back, so that places before it stay valid.
        for m in reversed(list(re.finditer(rf"\s*(?:\[\s*{name}\s*\]|\(\s*{name}\s*\))\s*", now, re.IGNORECASE))):
            s, e = m.span()
            chars[s:e], starts[s:e], ends[s:e] = [sign], [min(starts[s:e])], [max(ends[s:e])]
    return "".join(chars), starts, ends


@F.pandas_udf(CANONICAL)
def canonical_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical(t) for t in texts], columns=["text", "starts", "ends"])
