"""Content hashes, HMAC signatures and derived ids."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def derive_key(secret: str, salt: bytes) -> bytes:
    """Signing key, derived once on the driver."""
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, 100_000, dklen=32)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 as plain expressions. The key pads are literals of the plan: use
    :func:`hmac_sha256_private` where others can read plans."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hmac_sha256_private(message: Column, key: bytes) -> Column:
    """Same value, with the key inside the Python closure instead of the plan."""

    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else _hmac.new(key, t.encode(), hashlib.sha256).hexdigest()
        )

    return sign(message)


def canonical_json(*columns: str) -> Column:
    """JSON with fields in name order; null fields are kept."""
    return F.to_json(
        F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}
    )


def analysis_id(document_id: Column, template_hash: Column, analyzed_at: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id, template_hash, analyzed_at), 256)


def joined_id(ids: Column) -> Column:
    """Id of a row's own list of ids, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(ids), ":"), 256)


def id_set_digest(ids: Column) -> Column:
    """Id of all ids of a group, whatever their order, as an aggregate of any size."""
    return multiset_digest(F.sha2(ids, 256))


def row_digest(columns: list[str]) -> Column:
    """Hash of one row. Every value is length-prefixed, so values cannot run into each other."""
    parts = []
    for name in sorted(columns):
        text = F.col(f"`{name}`").cast("string")
        parts.append(
            F.coalesce(
                F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")
            )
        )
    return F.sha2(F.concat_ws("|", *parts), 256)


def multiset_digest(row_hash: Column) -> Column:
    """Order-independent hash of a whole column of row hashes, as an aggregate.

    The four 64-bit words of each hash are summed, which combines map-side and never holds the
    rows of a group together; the root is the hash of the sums and the row count.
    """
    words = [
        F.coalesce(
            F.sum(F.conv(F.substring(row_hash, 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")),
            F.lit(0),
        ).cast("string")
        for i in range(4)
    ]
    return F.sha2(F.concat_ws("|", *words, F.count(row_hash).cast("string")), 256)
