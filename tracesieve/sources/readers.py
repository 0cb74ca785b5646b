"""Readers with explicit schemas; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_raw string, message_norm string, category string, source string, group_id string"
MUTATION = ("mutant_id string, program_id string, mutation_type string, target_cat string, category string, message_raw string, "
            "message_first_line string, exit_code int")
PENDING = "ts string, message string, raw_message string, category string, confidence double, status string"
GOLD = "id string, message_raw string, source string, proposed_label string, final_label string"
RAW_LOG = "log_id string, lang string, compiler_output string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. Lenient: blank, corrupt and non-object lines are dropped; strict: the job fails."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    named = [c for c in df.columns if c != "_corrupt"]
    return df.where(F.col("_corrupt").isNull()).select(*named)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with header; rows without a final label are left out."""
    df = spark.read.schema(GOLD).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.where(F.trim("final_label") != "").withColumn("final_label", F.trim("final_label"))


def read_training_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {message | raw_message, category, ast_node}; an empty message counts as missing."""
    df = spark.read.schema("message string, raw_message string, category string, ast_node string").option("multiLine", True).json(path)
    msg = F.coalesce(F.nullif("message", F.lit("")), F.nullif("raw_message", F.lit("")))
    return df.select(msg.alias("message"), "category", F.coalesce("ast_node", F.lit("")).alias("ast_node")) \
        .where("message IS NOT NULL AND category IS NOT NULL AND category <> ''")


def read_raw_logs(spark: SparkSession, path: str, languages: tuple[str, ...] = ("C++",)) -> DataFrame:
    """Columnar logs: two columns, language and emptiness filters reach the scan; files keep their order."""
    df = spark.read.schema(RAW_LOG).parquet(path)
    return df.where(F.col("lang").isin(*languages) & (F.trim("compiler_output") != "")) \
        .select("log_id", "compiler_output", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("ordinal"))


def read_corpus(spark: SparkSession, path: str, glob: str = "*.cpp") -> DataFrame:
    """Source files with labels from their names: (path, text, is_bad, is_good, cwe)."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    p = F.col("_metadata.file_path")
    return df.select(p.alias("path"), F.col("value").alias("text"), p.rlike(r"_bad\.\w+$").alias("is_bad"), p.rlike(r"_good\.\w+$").alias("is_good"),
                     F.nullif(F.regexp_extract(p, r"/(CWE\d+)_[^/]*/[^/]*$", 1), F.lit("")).alias("cwe"))


def read_checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, sha256) of files up to the binary cell limit of 2 GB."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


# fixed value: largest accepted model file
MAX_MODEL_BYTES = 200 * 1024 * 1024


def verify_models(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """(name, problem) per file: outside the root, too large, not in the manifest, or a wrong
    checksum or size; the first rule decides and NULL means verified."""
    m = manifest.select("name", F.lower("sha256").alias("__sha"), F.col("size").alias("__size"))
    j = files.join(m, "name", "left")
    problem: Column = (
        F.when(~F.regexp_replace("path", "^file:/*", "/").startswith(root.rstrip("/") + "/"), "model_outside_data_dir")
        .when(F.col("size") > MAX_MODEL_BYTES, "model_too_large").when(F.col("__sha").isNull(), "model_manifest_missing")
        .when((F.lower("sha256") != F.col("__sha")) | F.coalesce(F.col("size") != F.col("__size"), F.lit(True)), "model_hash_mismatch"))
    return j.select("name", problem.alias("problem"))
