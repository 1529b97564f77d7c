"""Tables and small frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same constant rows for DuckDB."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"(values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) as v({names})"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as a ledger: status by id, form by language."""
    status = F.when(F.col("doc_id") % 7 == 0, "error").when(F.col("doc_id") % 11 == 0, "no_coverage").otherwise("ok")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("form_type"), status.alias("status"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))


LEDGER_SQL = "(select source, doc_id, lang as form_type, case when doc_id % 7 = 0 then 'error' when doc_id % 11 = 0 then 'no_coverage' else 'ok' end as status, sha256(text) as content_sha256 from documents)"
