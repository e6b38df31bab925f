"""Hashes, commitments, Merkle roots and canonical JSON."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorana.workdir import Scratch

#: The tags that keep hashes of different things apart.
DS_KEEP, DS_NODE, DS_COMMIT, DS_MANIFEST = "KEEP", "NODE", "COMMIT", "MANIFEST"


def prefixed(*values: Column) -> Column:
    """Binary values, each after its length as four bytes, so that no two lists share an encoding."""
    raw = [v.cast("binary") for v in values]
    return F.concat(*[x for v in raw for x in (F.unhex(F.lpad(F.hex(F.octet_length(v)), 8, "0")), v)])


def number(n: Column) -> Column:
    """A non-negative whole number as eight bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def sha256(value: Column) -> Column:
    """The digest as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def keep_leaf(doc_id: Column, idx: Column, start: Column, end: Column, data: Column) -> Column:
    return sha256(prefixed(F.lit(DS_KEEP), doc_id, number(idx), number(start), number(end), data))


def commitment(doc_id: Column, idx: Column, start: Column, end: Column, kind: Column, original: Column, nonce: Column) -> Column:
    return sha256(prefixed(F.lit(DS_COMMIT), doc_id, number(idx), number(start), number(end), kind, original, nonce))


def manifest_leaf(doc_id: Column) -> Column:
    return sha256(prefixed(F.lit(DS_MANIFEST), doc_id))


def merkle_node(left: Column, right: Column) -> Column:
    return sha256(prefixed(F.lit(DS_NODE), left, right))


def merkle_root_of(leaves: Column) -> Column:
    """The root over an array of leaves of one row: pairs level by level, the last of an odd level twice.

    For leaves that fit a row; a table of leaves takes ``merkle_roots``. No leaves: a node of two empty values.
    """
    empty = F.lit(b"")

    def level(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(acc) - 1) / 2).cast("int")), lambda i: merkle_node(F.get(acc, 2 * i), F.coalesce(F.get(acc, 2 * i + 1), F.get(acc, 2 * i))))
        return F.when(F.size(acc) > 1, pairs).otherwise(acc)

    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int"), F.lit(1)))
    return F.when(F.size(leaves) > 0, F.get(F.aggregate(levels, leaves, level), F.lit(0))).otherwise(merkle_node(empty, empty))


def merkle_roots(leaves: DataFrame, keys: list[str], position: str, leaf: str, node: Callable[[Column, Column], Column] = merkle_node) -> DataFrame:
    """(keys, root) over a table of leaves with positions 0, 1, ... per key.

    Each round pairs positions 2i and 2i + 1, a partial aggregate over the whole table, so a tree of
    any size takes as many rounds as it has levels and no task holds more than its pairs.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    level = leaves.select(*keys, F.col(position).cast("long").alias("_p"), F.col(leaf).alias("_h"))
    rounds = 0
    top = level.agg(F.max("_p")).first()[0]
    while top:
        side = F.col("_p") % 2 == 0
        paired = level.groupBy(*keys, F.floor(F.col("_p") / 2).alias("_q")).agg(F.max(F.when(side, F.col("_h"))).alias("_l"), F.max(F.when(~side, F.col("_h"))).alias("_r"))
        size = level.groupBy(*keys).agg(F.max("_p").alias("_last")) if keys else level.agg(F.max("_p").alias("_last"))
        paired = paired.join(size, keys) if keys else paired.crossJoin(F.broadcast(size))
        joined = F.when(F.col("_last") > 0, node(F.col("_l"), F.coalesce("_r", "_l"))).otherwise(F.col("_l"))
        level = paired.select(*keys, F.col("_q").alias("_p"), joined.alias("_h"))
        rounds += 1
        if rounds % 6 == 0:
            level = scratch.write(level, f"level{rounds}")
        top //= 2
    return level.select(*keys, F.col("_h").alias("root"))


def _canonical(value: object) -> bytes:
    def norm(x: object) -> object:
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            return {norm(k): norm(v) for k, v in x.items()}
        return [norm(v) for v in x] if isinstance(x, list) else x

    return json.dumps(norm(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text in canonical form: sorted keys, no blanks, NFC; null for what is not JSON or not finite."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else _canonical(json.loads(x)).decode()
        except ValueError:
            return None

    return s.map(one)


def self_hash(document: Column, field: str) -> Column:
    """The digest of a JSON object without its own digest field."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            value = json.loads(x)
            value.pop(field, None)
            return hashlib.sha256(_canonical(value)).hexdigest()

        return s.map(one)

    return digest(document)


def reference_id(kind: Column, division: Column, label: Column) -> Column:
    """kind:division:digest of the three, for labels without control characters."""
    return F.concat_ws(":", kind, division, F.substr(F.sha2(F.to_json(F.array(kind, division, label)), 256), F.lit(1), F.lit(24)))


def hmac_sha256(key: bytes, value: Column) -> Column:
    """A keyed digest. The key travels with the function and never stands in a plan."""

    @F.pandas_udf("binary")
    def mac(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, bytes(x), hashlib.sha256).digest())

    return mac(value.cast("binary"))


def pseudonym(key: bytes, kind: Column, canonical: Column) -> Column:
    """Ten base32 characters that stand for one original of one class."""

    @F.pandas_udf("string")
    def name(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base64.b32encode(hmac.new(key, bytes(x), hashlib.sha256).digest()).decode()[:10])

    return name(prefixed(kind, canonical))


def sealed(value: Column, key: Column, bound_to: Column) -> Column:
    """AES-GCM with a random vector; ``bound_to`` is authenticated, not stored."""
    return F.call_function("aes_encrypt", value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound_to)


def opened(sealed_value: Column, key: Column, bound_to: Column) -> Column:
    """The value of ``sealed``; null if key, value or ``bound_to`` do not fit."""
    return F.call_function("try_aes_decrypt", sealed_value, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)
