"""Identity and version keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_cik(c: Column) -> Column:
    return F.lpad(c.cast("long").cast("string"), 10, "0")


def bare_accession(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def cache_key(raw: Column, prompt_version: Column, schema_version: Column, model: Column, params_json: Column) -> Column:
    """SHA-256 over the five parts with bars between, 64 hex digits."""
    return F.sha2(F.concat_ws("|", raw, prompt_version, schema_version, model, params_json), 256)


def materialization_version(chunker: Column, context_prompt: Column, embedder: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", chunker, context_prompt, embedder), 256), 1, 8)


def table_name(base: Column, version: Column) -> Column:
    return F.concat_ws("__", base, version)


def split_table_name(name: Column) -> Column:
    """struct(base, version), split at the last double underscore; version null without one."""
    base = F.regexp_extract(name, r"^(.+)__(.+)$", 1)
    return F.struct(F.when(base == "", name).otherwise(base).alias("base"), F.nullif(F.regexp_extract(name, r"^(.+)__(.+)$", 2), F.lit("")).alias("version"))


def version_token(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with names sorted (values ASCII, none null)."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def transcript_id(ticker: Column, year: Column, quarter: Column) -> Column:
    return F.concat(F.upper(ticker), F.lit("-"), year.cast("string"), F.lit("Q"), quarter.cast("string"))


def parent_id(doc: Column, start: Column, end: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("::"), start.cast("string"), F.lit("-"), end.cast("string"))
