"""Definitions derived from a matrix, releases of files, and marks that tell recipients apart."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.codes import prefixed, reference_id
from quorana.functions.text import MARK_END, MARK_SEQUENCE, MARK_SUFFIX, carriers, encode_tag

LEAST_CARRIERS = 3


def definitions(divisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(reference_id, kind, division_key, label): one definition per division and per distinct (kind, division, label)."""
    own = divisions.select(F.lit("division").alias("kind"), "division_key", F.col("division_key").alias("label")).distinct()
    rest = tasks.select("kind", "division_key", "label").distinct()
    both = own.unionByName(rest)
    return both.withColumn("reference_id", reference_id(F.col("kind"), F.col("division_key"), F.col("label")))


def described(files: DataFrame) -> DataFrame:
    """(path, size, media_type, sha256) of rows (path, content)."""
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    media = F.when(kind == "json", "application/json").when(kind.isin("yaml", "yml"), "application/yaml").when(kind == "csv", "text/csv").when(kind == "md", "text/markdown").when(kind == "txt", "text/plain").otherwise("application/octet-stream")
    return files.select("path", F.octet_length("content").alias("size"), media.alias("media_type"), F.sha2("content", 256).alias("sha256"))


def release_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, larger or smaller than told, or different."""
    there = described(files).select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = manifest.join(there, "path", "left")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_sha") != F.col("sha256"), "digest")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def overriding(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """The rows of both; where a key stands in both, the later ones."""
    return first.join(later.select(key).distinct(), key, "left_anti").unionByName(later)


def mark_tag(salt: bytes, package: str, recipient: str) -> int:
    """The 32-bit tag of one package for one recipient."""
    lp = lambda s: len(s.encode()).to_bytes(4, "big") + s.encode()
    return int.from_bytes(hmac.new(salt, lp(package) + lp(recipient), hashlib.sha256).digest()[:4], "big")


def marked(content: Column, atom_id: Column, salt: bytes, tag: int) -> Column:
    """A text with the mark before a blank that the salt chooses, at its end without blanks; and inside its first token, if it has one."""

    @F.pandas_udf("long")
    def chosen(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int.from_bytes(hmac.new(salt, x.encode(), hashlib.sha256).digest()[:4], "big"))

    symbols = encode_tag(F.lit(tag))
    blanks = F.size(F.split(content, " ", -1)) - 1
    which = F.when(blanks > 0, chosen(atom_id) % blanks).otherwise(0)
    head = F.array_join(F.slice(F.split(content, " ", -1), F.lit(1), (which + 1).cast("int")), " ")
    tail = F.substr(content, F.length(head) + 1)
    mark = F.concat(F.lit(MARK_SEQUENCE), symbols, F.lit(MARK_END))
    in_text = F.when(blanks > 0, F.concat(head, mark, tail)).otherwise(F.concat(content, mark))
    token = F.regexp_extract(in_text, "⟦[A-Z_]+:[^⟦⟧]*⟧", 0)
    with_suffix = F.concat(F.substr(token, F.lit(1), F.length(token) - 1), F.lit(MARK_SUFFIX), symbols, F.lit(MARK_END), F.lit("⟧"))
    at = F.call_function("locate", token, in_text)
    return F.when(token == "", in_text).otherwise(F.concat(F.substr(in_text, F.lit(1), at - 1), with_suffix, F.substr(in_text, at + F.length(token))))


def detected(texts: DataFrame, text: str, order: str, least: int = LEAST_CARRIERS) -> DataFrame:
    """(tag, n_carriers, n_methods, winner): the tags found in all texts; the most frequent one wins from ``least`` carriers on, of equals the one met first by ``order``."""
    met = texts.select(F.col(order).alias("_o"), F.posexplode(carriers(F.col(text))).alias("_k", "c")).select(F.col("c.tag").alias("tag"), F.col("c.method").alias("method"), F.struct("_o", "_k").alias("at"))
    found = met.groupBy("tag").agg(F.count("*").alias("n_carriers"), F.countDistinct("method").alias("n_methods"), F.min("at").alias("first"))
    top = found.agg(F.min(F.struct((-F.col("n_carriers")).alias("n"), "first", "tag")).alias("t")).select(F.col("t.tag").alias("_top"))
    joined = found.join(F.broadcast(top))  # one row
    return joined.select("tag", "n_carriers", "n_methods", ((F.col("tag") == F.col("_top")) & (F.col("n_carriers") >= least)).alias("winner"))


def bound(*values: Column) -> Column:
    """What several values hash to together."""
    return F.sha2(prefixed(*values), 256)
