"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of tokens; the masked-out positions are ignored, so a substitution there doesn't break the
match. Hashes of every window of every document meet the hashes of the benchmark's windows; around each meeting the two texts are
aligned and compared token by token, and the overlap counts if enough tokens agree, whichever differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.filters import without
from docquarry.session import materialize


@dataclass(frozen=True)
class SeedParams:
    """``window`` tokens around a hit are compared (fewer where the item is shorter), of which ``agree`` percent must be equal.

    ``broadcast_seeds``: up to so many benchmark windows (about 32 bytes each) are broadcast; beyond it, seeds are joined by shuffle."""

    masks: tuple[str, ...] = ("11011101011", "10110011111")
    window: int = 20
    agree: int = 80
    broadcast_seeds: int = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _masks(p: SeedParams, short: list[int]) -> list[str]:
    """The masks, and for items shorter than a mask, one full mask of each such length (fewer of them than a mask has places)."""
    return [*p.masks, *("1" * n for n in sorted(short))]


def _seeds(df: DataFrame, masks: list[str], short_only: Column | None = None) -> DataFrame:
    """From rows with ``wh`` (token hashes) to rows with ``at`` and ``seed``; expressions only, one row a window and mask."""
    df = df.withColumn("at", F.explode(F.when(F.size("wh") > 0, F.sequence(F.lit(0), F.size("wh") - 1)).otherwise(F.array().cast("array<int>"))))

    def one(k: int, mask: str) -> Column:
        fits = F.col("at") + len(mask) <= F.size("wh")
        if short_only is not None and k >= len(masks) - _n_short(masks):
            fits &= F.size("wh") == len(mask)
        return F.when(fits, F.xxhash64(F.lit(k), *[F.get("wh", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]))

    return df.withColumn("seed", F.explode(F.array(*[one(k, m) for k, m in enumerate(masks)]))).where(F.col("seed").isNotNull())


def _n_short(masks: list[str]) -> int:
    return sum("0" not in m for m in masks)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", p: SeedParams = SeedParams()) -> DataFrame:
    """(key, item, hits, overlap): pairs with at least one verified hit, how many, and the best share of agreeing tokens.

    Null and empty texts have no windows. An item shorter than the masks is sought as a whole, contiguously. Rows that repeat a key and
    its text are one document; other texts of a key add their hits to its pairs, and so do those of the null key, which is a key of its
    own. Items repeated under one id likewise. Empty tables: no rows. Other columns are not read. However large the benchmark is, the
    rows are the same: seeds beyond ``broadcast_seeds`` are joined by shuffle."""
    items = benchmark.select(F.col(item).alias("item"), _hashes(tokens(F.col(item_text))).alias("bh")).where(F.size("bh") > 0)
    items = items.withColumn("ih", F.xxhash64("bh")).dropDuplicates(["item", "ih"])
    longest = max(len(m) for m in p.masks)
    short = [r[0] for r in items.where(F.size("bh") < longest).select(F.size("bh")).distinct().collect()]
    masks = _masks(p, short)
    seeds = _seeds(items.withColumnRenamed("bh", "wh"), masks, F.lit(True)).select("seed", "item", "ih", F.col("at").alias("j"))
    small = seeds.limit(p.broadcast_seeds + 1).count() <= p.broadcast_seeds
    own = docs.select(F.col(key).alias("k"), _hashes(tokens(F.col(text))).alias("wh")).withColumn("dh", F.xxhash64("wh"))
    named = items.select(F.col("item").alias("item2"), F.col("ih").alias("ih2"), "bh")
    whole = F.col("item").eqNullSafe(F.col("item2")) & (F.col("ih") == F.col("ih2"))
    if small:
        hits = _seeds(own, masks).join(F.broadcast(seeds), "seed").join(F.broadcast(named), whole)
    else:
        met = _seeds(own, masks).select("k", "dh", "at", "seed").join(seeds, "seed")
        once = own.select(F.col("k").alias("k2"), F.col("dh").alias("dh2"), "wh").dropDuplicates(["k2", "dh2"])
        hits = met.join(once, F.col("k").eqNullSafe(F.col("k2")) & (F.col("dh") == F.col("dh2"))).join(named, whole)
    width = F.least(F.size("bh"), F.lit(p.window))
    lead = F.least(F.greatest(F.col("j") - (p.window - longest) // 2, F.lit(0)), F.size("bh") - width)
    same = F.size(F.filter(F.sequence(F.lit(0), width - 1), lambda t: F.get("wh", F.col("at") - F.col("j") + lead + t) == F.get("bh", lead + t)))
    scored = hits.select("k", "item", "dh", "ih", "at", "j", "seed", same.alias("same"), width.alias("width")).where(F.col("same") * 100 >= F.col("width") * p.agree)
    found = scored.groupBy("k", "item").agg(F.count_distinct("dh", "ih", "at", "j", "seed").alias("hits"), F.max(F.col("same") / F.col("width")).alias("overlap"))
    return found.select(F.col("k").alias(key), F.col("item").alias(item), "hits", "overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", p: SeedParams = SeedParams(), **columns: str) -> DataFrame:
    """``docs`` without those that overlap a benchmark item; their own columns. Rows with a null key stay."""
    bad = materialize(overlaps(docs, benchmark, key, p=p, **columns).select(key).distinct(), "leaked")
    return without(docs, bad, key)


def oracle(p: SeedParams = SeedParams()) -> str:
    """The same in SQL, by comparing the selected tokens themselves (without the case of items shorter than the masks)."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    longest = max(len(m) for m in p.masks)

    def seeds(src: str, ident: str) -> str:
        return " union all ".join(
            f"select {ident}, pos, {k} as mask, list_aggregate([{', '.join(f'w[pos + {i + 1}]' for i, c in enumerate(m) if c == '1')}], 'string_agg', ' ') as seed from (select {ident}, w, unnest(range(0, len(w) - {len(m) - 1})) as pos from {src})"
            for k, m in enumerate(p.masks)
        )

    return f"""
with d as (select doc_id, {words} as w from documents), b as (select item_id, {words} as w from benchmark),
ds as ({seeds('d', 'doc_id')}), bs as ({seeds('b', 'item_id')}),
met as (select doc_id, item_id, ds.pos as i, bs.pos as j from ds join bs using (mask, seed)),
lined as (select doc_id, item_id, i, j, d.w as dw, b.w as bw, least(len(b.w), {p.window}) as width from met join d using (doc_id) join b using (item_id)),
led as (select *, least(greatest(j - {(p.window - longest) // 2}, 0), len(bw) - width) as lead from lined),
scored as (select doc_id, item_id, width, len(list_filter(range(0, width), lambda t: i - j + lead + t >= 0 and dw[greatest(i - j + lead + t, -1) + 1] = bw[lead + t + 1])) as same from led)
select doc_id, item_id, count(*) as hits, max(same::double / width) as overlap from scored where same * 100 >= width * {p.agree} group by doc_id, item_id"""
