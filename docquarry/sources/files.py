"""Scans and landed-file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "source string, entity_id string, doc_id string, form_type string, event_datetime timestamp, fetched_at timestamp, content_sha256 string, path string, status string"
)


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty table with its schema where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw files: path, bytes, digest, size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("content_sha256"), "length")


def unnest_listing(listing: DataFrame, forms: list[str], json: str = "j") -> DataFrame:
    """Parallel arrays to rows; unequal lengths are an error; other forms and blank entries are dropped."""
    parsed = F.from_json(json, "forms array<string>, accessions array<string>, documents array<string>")
    got = listing.withColumn("p", parsed).select("cik", "p.*")
    equal = (F.size("forms") == F.size("accessions")) & (F.size("forms") == F.size("documents"))
    got = got.where(F.assert_true(equal, F.lit("parallel arrays differ in length")).isNull())
    rows = got.select("cik", F.inline(F.arrays_zip(F.col("forms").alias("form"), F.col("accessions").alias("accession"), F.col("documents").alias("document"))))
    return rows.where(F.col("form").isin(forms) & (F.trim("accession") != "") & (F.trim("document") != ""))


def scan_listings(spark: SparkSession, path: str) -> DataFrame:
    """Landed listings, one JSON document a file: cik from the document, and its arrays as JSON for ``unnest_listing``."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.get_json_object("value", "$.cik").cast("long").alias("cik"), F.get_json_object("value", "$.filings").alias("j"))


def exhibits(pages: DataFrame, json: str = "j") -> DataFrame:
    """(accession, name, size): the markup files of each filing's directory listing; sizes that aren't numbers count as 0."""
    items = F.from_json(F.get_json_object(json, "$.directory.item"), "array<struct<name:string,size:string>>")
    rows = pages.select("accession", F.inline(items))
    size = F.coalesce(F.try_to_number("size", F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))
    return rows.where(F.rlike("name", F.lit(r"(?i)\.html?$"))).select("accession", "name", size.alias("size"))


def audio_outcome(content, least: int):
    """ok, too_small (under ``least`` bytes) or not_audio of a downloaded file's bytes."""
    from docquarry.functions.text import looks_like_audio

    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) < least, "too_small").when(~looks_like_audio(F.substring(content, 1, 16)), "not_audio").otherwise("ok")


def flatten_facts(facts: DataFrame, json: str = "j") -> DataFrame:
    """Nested fact JSON (tag, unit, observations) to one row an observation."""
    tags = facts.select("cik", F.explode(F.from_json(json, "map<string,map<string,array<struct<end:string,val:double>>>>")).alias("tag", "units"))
    units = tags.select("cik", "tag", F.explode("units").alias("unit", "rows"))
    return units.select("cik", "tag", "unit", F.inline("rows")).withColumnsRenamed({"end": "period_end", "val": "value"})


def load_dimension(df: DataFrame, key: str) -> DataFrame:
    """A small dimension whose key must be unique and the table not empty: checked when it is read, on the driver."""
    if df.isEmpty():
        raise ValueError("the dimension is empty")
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated keys: {[r[0] for r in twice]}")
    return df


def scan_features(spark: SparkSession, path: str, timestamp: str = "as_of_ts", created: str = "event_datetime") -> DataFrame:
    """Feature rows at ``path``; both time columns must be there, as timestamps."""
    df = spark.read.parquet(path)
    wrong = [c for c in (timestamp, created) if c not in df.columns or df.schema[c].dataType.simpleString() != "timestamp"]
    if wrong:
        raise TypeError(f"not timestamps: {', '.join(wrong)}")
    return df
