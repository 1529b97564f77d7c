"""Outcome chains and small parsers as column expressions: what a response, a payload, a document or a call came to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import estimated_tokens


def http_outcome(status: Column, body_bytes: Column) -> Column:
    """rate_limited, server_error, client_error, empty or ok of a response."""
    return F.when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").when(status.between(400, 499), "client_error").when(F.coalesce(body_bytes, F.lit(0)) == 0, "empty").otherwise("ok")


def worth_retrying(outcome: Column) -> Column:
    """A wrong request stays wrong; the rest may pass."""
    return outcome.isin("rate_limited", "server_error", "empty")


def json_outcome(json: Column) -> Column:
    """missing, malformed, object or not_object."""
    v = F.try_parse_json(json)
    return F.when(json.isNull(), "missing").when(v.isNull(), "malformed").when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "object").otherwise("not_object")


def token_route(text: Column, has_chunks: Column, limit: int = 100_000) -> Column:
    """single_shot below ``limit`` tokens; from there on retrieval, or an error where there are no chunks to retrieve."""
    return F.when(estimated_tokens(text) >= limit, F.when(has_chunks, "retrieval").otherwise("error")).otherwise("single_shot")


def context_outcome(text: Column, stopped: Column, limit: int = 100) -> Column:
    """Why a generated context is dropped: empty, bad_stop (``stopped`` is false), over_cap; or keep."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(~stopped, "bad_stop").when(estimated_tokens(text) > limit, "over_cap").otherwise("keep")


def acceptance_time(raw: Column) -> Column:
    """A timestamp: with its own offset where it has one, else New York's."""
    zoned = F.rlike(raw, F.lit(r"(Z|[+-]\d\d:\d\d)$"))
    return F.when(zoned, F.to_timestamp(raw)).otherwise(F.to_utc_timestamp(F.to_timestamp_ntz(raw).cast("timestamp"), "America/New_York"))


def retry_after(raw: Column, now: Column, most: float = 300.0) -> Column:
    """Seconds that a header asks for, as a number or an HTTP date, within 0 and ``most``; null where it is neither."""
    at = F.try_to_timestamp(F.regexp_replace(raw, r"^\w+, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(raw.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(most), seconds)))


def usage(fields: dict[str, Column]) -> Column:
    """A map of the usage fields that are known."""
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def joined_text(blocks: Column, kind: str, wanted: Column) -> Column:
    """The texts of the blocks that are ``wanted``, by spaces; null without any. ``kind``: the blocks' field to compare."""
    said = F.filter(blocks, lambda x: x[kind] == wanted)
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda x: x["text"]), " "))


def checked_haircut(h: Column) -> Column:
    """A share in [0, 1], or an error."""
    return F.when((h >= 0) & (h <= 1), h).otherwise(F.raise_error(F.lit("haircut outside [0, 1]")).cast("double"))


def transcript_outcome(held: Column, registered: Column, found: Column, failed: Column) -> Column:
    """cached if the ledger holds it as ok, else unregistered, error, ok or no_coverage, as the source answered."""
    return F.when(F.coalesce(held, F.lit(False)), "cached").when(~F.coalesce(registered, F.lit(False)), "unregistered").when(failed, "error").when(found, "ok").otherwise("no_coverage")
