"""Citation spans: where quotes occur, whether spans hold them, strict payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import flexible_occurrences, quote_words

#: Up to so many rows of (seed, quote) or (document, quote) are broadcast; beyond it, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
SEED_WORDS = 3


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _seed(words: Column, at: Column, n: Column) -> Column:
    return F.xxhash64(n, F.array_join(F.slice(words, at, n), " "))


def candidates(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that may match: documents that hold a quote's second to fourth word (or second, of quotes under five
    words) in a row. A quote's inner words are whole words of any text that it occurs in. Quotes under three words have none and meet
    every document that contains their longest word."""
    words = quote_words(F.col("quote"))
    n = F.when(F.size("w") >= SEED_WORDS + 2, SEED_WORDS).when(F.size("w") >= 3, 1).otherwise(0)
    seeded = quotes.select("item_id", words.alias("w")).where(F.size("w") > 0).withColumn("n", n)
    sizes = [r[0] for r in seeded.select("n").distinct().collect()]
    own = docs.select("doc_id", quote_words(F.col("text")).alias("w"))
    met = None
    long = [k for k in sizes if k]
    if long:
        seeds = seeded.where("n > 0").select("item_id", _seed(F.col("w"), F.lit(2), F.col("n")).alias("seed"))
        at = F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))).alias("at")
        posted = own.select("doc_id", "w", at).select("doc_id", F.explode(F.array(*[_seed(F.col("w"), F.col("at"), F.lit(k)) for k in long])).alias("seed"))
        met = posted.join(_small(seeds), "seed").select("doc_id", "item_id").distinct()
    if 0 in sizes:
        longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
        short = seeded.where("n = 0").select("item_id", longest.alias("word"))
        more = docs.select("doc_id", "text").join(_small(short), F.contains("text", F.col("word"))).select("doc_id", "item_id").distinct()
        met = more if met is None else met.unionByName(more)
    return met if met is not None else docs.select("doc_id").crossJoin(quotes.select("item_id")).limit(0)


def occurrence_table(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, quote, doc_id, text, ordinal, start, stop) of every occurrence of ``quotes`` (item_id, quote) in any document, white space
    in a quote standing for any in the text. Documents and quotes meet by hashes of inner words, then each pair is matched. Blank
    quotes occur nowhere."""
    pairs = candidates(docs, quotes).join(_small(quotes.select("item_id", "quote")), "item_id").withColumnRenamed("doc_id", "__doc")
    met = docs.select("doc_id", "text").join(_small(pairs), F.col("doc_id").eqNullSafe(F.col("__doc")))
    rows = met.select("item_id", "quote", "doc_id", "text", F.posexplode(flexible_occurrences(F.col("text"), F.col("quote"))).alias("ordinal", "span"))
    return rows.select("item_id", "quote", "doc_id", "text", "ordinal", "span.start", "span.stop")


def resolve_quotes(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, ordinal, quote, outcome, start, stop, snapped) of each claim (doc_id, ordinal, quote) on its own document.

    Where a quote is claimed as often as it occurs, the n-th claim takes the n-th occurrence, and ``snapped`` is the text's own spelling
    of it; otherwise all its claims are not_found, insufficient (fewer occurrences) or ambiguous (more), without spans. Null and blank
    quotes: empty. No document: not_found. Claims of one ordinal are kept apart by nothing: ordinals are distinct in a document."""
    grouped = claims.groupBy("doc_id", "quote").agg(F.array_sort(F.collect_list("ordinal")).alias("asked"))
    found = grouped.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("spans", flexible_occurrences(F.col("text"), F.col("quote")))
    n, m = F.size("spans"), F.size("asked")
    outcome = F.when(F.size(quote_words(F.col("quote"))) == 0, "empty").when(n == 0, "not_found").when(n < m, "insufficient").when(n > m, "ambiguous").otherwise("ok")
    each = found.withColumn("outcome", outcome).select("doc_id", "quote", "text", "outcome", "spans", F.posexplode("asked").alias("i", "ordinal"))
    span = F.when(F.col("outcome") == "ok", F.get("spans", F.col("i")))
    return each.withColumn("s", span).select("doc_id", "ordinal", "quote", "outcome", "s.start", "s.stop", F.substring("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("snapped"))


def grounded(text: Column, start: Column, stop: Column, quote: Column) -> Column:
    return F.substring(text, start + 1, stop - start) == quote


def first_failure(text: Column, claims: Column, path: str) -> Column:
    """Path of the first claim, in order, whose span doesn't hold its quote; null if all do."""
    bad = F.filter(F.transform(claims, lambda c, i: F.when(~grounded(text, c["start"], c["stop"], c["quote"]), i)), lambda i: i.isNotNull())
    return F.when(F.size(bad) > 0, F.concat(F.lit(f"{path}."), F.get(bad, 0)))


def pair_spans(claims: DataFrame, found: DataFrame) -> DataFrame:
    """The n-th citation of a quote takes its n-th occurrence where both are as many; others get an outcome and no span.

    ``claims``: (doc_id, item_id, quote, ordinal)."""
    n_found = found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    n_asked = claims.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_asked"))
    both = claims.join(n_asked, ["doc_id", "item_id"]).join(n_found, ["doc_id", "item_id"], "left")
    n = F.coalesce(F.col("n_found"), F.lit(0))
    outcome = F.when(n == 0, "not_found").when(n < F.col("n_asked"), "insufficient").when(n > F.col("n_asked"), "ambiguous").otherwise("ok")
    spans = found.select("doc_id", "item_id", "ordinal", "start", "stop")
    got = both.withColumn("outcome", outcome).join(spans, ["doc_id", "item_id", "ordinal"], "left")
    ok = F.col("outcome") == "ok"
    return got.select("doc_id", "item_id", "ordinal", "outcome", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("stop")).alias("stop"))


def strict_outcome(json: Column, fields: dict[str, str]) -> Column:
    """ok, malformed, unknown_key, missing_key or bad_type for an object that must have exactly ``fields``."""
    names = F.array(*[F.lit(k) for k in fields])
    own = F.json_object_keys(json)
    typed = None
    for k, kind in fields.items():
        good = F.try_variant_get(F.try_parse_json(json), f"$.{k}", kind).isNotNull()
        typed = good if typed is None else typed & good
    return F.when(own.isNull(), "malformed").when(F.size(F.array_except(own, names)) > 0, "unknown_key").when(F.size(F.array_except(names, own)) > 0, "missing_key").when(~typed, "bad_type").otherwise("ok")
