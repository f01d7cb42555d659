"""Document, log and sheet files: readers with fixed schemas and writers that do not overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_VERSION = 1

TOKEN = "struct<text:string,lang:string,cls:string,conf:double,start_ms:bigint,end_ms:bigint>"
MANIFEST = (
    "manifest_version int, provenance string, "
    "speakers array<struct<speaker_id:string,consent:boolean,gender:string>>, "
    "sessions array<struct<session_id:string,speaker_id:string,recorded_on:date,device:string,environment:string>>, "
    f"utterances array<struct<utterance_id:string,speaker_id:string,session_id:string,prompt_id:string,transcript:string,excluded_reason:string,tokens:array<{TOKEN}>>>"
)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document per corpus to four tables; NULL tokens (untagged) stay apart from an empty list."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    known = F.col("manifest_version") == MANIFEST_VERSION
    doc = doc.filter(F.when(known, F.lit(True)).otherwise(F.raise_error("unknown manifest version").cast("boolean")))
    utts = doc.select(F.inline("utterances"))
    return {
        "speakers": doc.select(F.inline("speakers")), "sessions": doc.select(F.inline("sessions")),
        "utterances": utts.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens"))).drop("tokens"),
        "tokens": utts.filter(F.col("tokens").isNotNull()).select("utterance_id", F.posexplode("tokens").alias("pos", "t")).select("utterance_id", "pos", "t.*"),
    }


def write_utterances(utterances: DataFrame, tokens: DataFrame, path: str) -> None:
    """Nest tokens back into their utterance and write JSON by speaker: one row per utterance, never one giant document."""
    fields = [c for c in tokens.columns if c not in ("utterance_id", "pos")]
    nested = tokens.groupBy("utterance_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("t")))).alias("_t"))
    out = utterances.join(nested, "utterance_id", "left").withColumn("tokens", F.transform("_t", lambda x: x["t"])).drop("_t")
    out.write.mode("errorifexists").partitionBy("speaker_id").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, broken lines). A torn last line shows up among the broken ones, for the caller to accept or refuse."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).persist()
    return df.filter("_corrupt is null").drop("_corrupt"), df.select("_corrupt").filter("_corrupt is not null")


GOLD = "utterance_id string, idx int, token string, lang string, cls string, note string"


def read_gold(spark: SparkSession, path: str, languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Annotation sheet (tab separated, ``#`` comments) as (rows, rows with an unknown label); blanks become NULL."""
    raw = spark.read.schema(GOLD).csv(path, sep="\t", comment="#", header=True, enforceSchema=False, quote="")
    clean = raw.select("utterance_id", "idx", "token", *[F.nullif(F.upper(F.trim(c)), F.lit("")).alias(c) for c in ("lang", "cls")], F.nullif(F.trim("note"), F.lit("")).alias("note"))
    known = F.col("lang").isNull() | F.col("lang").isin(languages)
    return clean.filter(known), clean.filter(~known)


def read_sheet(spark: SparkSession, path: str, environments: list[str]) -> DataFrame:
    """Speaker sheet: trimmed cells, rows without an id dropped, default session, unknown environment NULL."""
    raw = spark.read.csv(path, header=True)
    cells = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns]).filter("speaker_id is not null")
    return cells.withColumn("session_id", F.coalesce("session_id", F.lit("S1"))).withColumn("environment", F.when(F.col("environment").isin(environments), F.col("environment")))


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Results of every run stacked, each row with the run it came from."""
    return spark.read.json(pattern, multiLine=True).withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vector table by source; refuses to overwrite."""
    vectors.write.mode("errorifexists").partitionBy("source").parquet(path)
