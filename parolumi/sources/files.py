"""Readers of the files that evaluation data come in."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

import pandas as pd


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_documents(spark: SparkSession, path: str, schema: StructType | str, optional: bool = False) -> DataFrame:
    """Whole JSON arrays or objects, one row per element; an absent optional path is empty."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files with one object a line, keys of folders as columns."""
    return spark.read.schema(schema).json(path)


def transcript_tree(spark: SparkSession, root: str) -> DataFrame:
    """(model, variant, category, video_id, text) of <model>.<variant>/<category>/<id>.txt; model
    names may hold full stops, the variant is what follows the last one."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    part = lambda i: F.regexp_extract(path, r"([^/]+)\.([^./]+)/([^/]+)/([^/]+)\.txt$", i)
    return raw.select(part(1).alias("model"), part(2).alias("variant"), part(3).alias("category"), part(4).alias("video_id"), F.col("value").alias("text"))


def directory_dimension(spark: SparkSession, root: str, pattern: str, order: list[str]) -> DataFrame:
    """(stem, folder) of files by name alone; of several folders the first in ``order`` wins."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    both = listed.select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 2).alias("stem"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 1).alias("folder"))
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("folder"))
    return both.where(rank > 0).groupBy("stem").agg(F.min_by("folder", rank).alias("folder"))


def sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_path, body) of JSON sidecars, unparsed."""
    return spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))


_LEXEME = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<open>[\[{(])|(?P<close>[\]})])|(?P<set>=)""", re.DOTALL)


def assigned(script: str | None) -> str | None:
    """The value of a script's last assignment: what follows the last '=' outside strings
    and brackets, without the closing semicolon; without one the text itself."""
    if script is None:
        return None
    lexemes = list(_LEXEME.finditer(script))
    level = accumulate((x.lastgroup == "open") - (x.lastgroup == "close") for x in lexemes)
    after = max((x.end() for x, deep in zip(lexemes, level) if x.lastgroup == "set" and not deep), default=0)
    return re.sub(r"[\s;]+$", "", script[after:]).lstrip()


@pandas_udf(StringType())
def script_value(scripts: pd.Series) -> pd.Series:
    return scripts.map(assigned, na_action="ignore")


def embedded_json(html: Column, start: str, end: str) -> Column:
    """The shortest JSON array between two marks of a page, or null."""
    return F.nullif(F.regexp_extract(html, f"(?s){start}(\\[.*?\\]){end}", 1), F.lit(""))


def envelope(spark: SparkSession, path: str, name: str, record: str) -> DataFrame:
    """(id, record fields) of a map of records, bare or under ``name``."""
    raw = spark.read.option("wholetext", True).text(path)
    both = F.coalesce(F.from_json("value", f"{name} map<string,{record}>")[name], F.from_json("value", f"map<string,{record}>"))
    return raw.select(F.explode(both).alias("id", "r")).select("id", "r.*")


def silences(log: DataFrame, line: str = "value") -> DataFrame:
    """Middles of silences from a detector's log lines."""
    x = log.select(F.regexp_extract(line, r"silence_start: (-?[0-9.]+)", 1).alias("s"), F.regexp_extract(line, r"silence_end: (-?[0-9.]+)", 1).alias("e"))
    return x.where("s <> '' or e <> ''").select(F.expr("try_cast(nullif(s, '') as double)").alias("start_s"), F.expr("try_cast(nullif(e, '') as double)").alias("end_s"))
