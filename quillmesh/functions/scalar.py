"""Scalar functions over columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P

Z95 = 1.959963984540054


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{P.SPACE}]+", ""), f"[{P.SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{P.SPACE}]")


def sub(text: Column, start: Column, end: Column) -> Column:
    """Code points start..end (end exclusive)."""
    return F.substring(text, start + 1, end - start)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    kinds = [chr(zero + i) for zero in DIGIT_ZEROS for i in range(10)]
    return F.translate(digits(text), "".join(kinds), "0123456789" * len(DIGIT_ZEROS))


def _zeros() -> list[int]:
    import sys
    import unicodedata

    return [p for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Nd" and unicodedata.decimal(chr(p)) == 0]


#: The zero of each script's digits.
DIGIT_ZEROS = _zeros()


def is_card(value: Column) -> Column:
    """13 to 19 digits with a valid checksum."""
    own = F.when(value.rlike(r"[\p{Nd}&&[^0-9]]"), ascii_digits(value)).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    return F.length(own).between(13, 19) & F.call_function("luhn_check", own)


def is_phone(value: Column) -> Column:
    return F.length(digits(value)) >= 10


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded half even to 4 places, null for whole 0."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole.cast("double"), 4))


def wilson(successes: Column, total: Column, low: bool) -> Column:
    """A limit of the Wilson interval at 95 %, null for total 0."""
    n, p = total.cast("double"), successes.cast("double") / total.cast("double")
    z2 = Z95 * Z95
    centre = p + z2 / (2 * n)
    margin = F.lit(Z95) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    value = (centre - margin if low else centre + margin) / (1 + z2 / n)
    return F.when(total > 0, F.bround(F.greatest(F.lit(0.0), value) if low else F.least(F.lit(1.0), value), 4))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC of a string column under a fixed key."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def source_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def derived_nonce(salt: str, key: Column) -> Column:
    """32 hexadecimal digits that depend on a secret salt and the row's key."""
    return F.upper(F.left(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), F.lit(32)))


def snake_code(name: Column) -> Column:
    """ClassName to class_name."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))
