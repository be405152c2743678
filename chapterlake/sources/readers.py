"""Scans of captured pages and URL lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from . import charsets


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parquet pages; a missing status is 200, a missing final url the url."""
    df = spark.read.parquet(path)
    for name, value in (("status_code", F.lit(200)), ("final_url", F.col("url"))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs, one a line; comments and empty lines go. Adds valid."""
    lines = spark.read.text(path).select(text.strip(F.col("value")).alias("url")).filter("url <> '' and not startswith(url, '#')")
    return lines.withColumn("valid", F.coalesce(urls.valid_url(F.col("url")), F.lit(False)) & (F.length("url") <= 2048))


#: Bytes of bodies that are decoded at once (one body may be more).
PORTION = 1 << 20


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of about PORTION bytes of bodies: what a task holds beside
    the batch does not grow with the bodies of its rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // PORTION
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    return (batch.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:]) if hi > lo)


def decode_pages(raw: DataFrame) -> DataFrame:
    """Pages (page_id, body binary, content_type) as (page_id, encoding, html):
    the declared charset where it decodes, else the guessed one (charsets.py),
    else UTF-8 with replacements. Null bodies are null html. UTF-8 without NUL
    bytes stays in the JVM; other bodies go through Arrow batches."""
    declared = F.lower(F.nullif(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1), F.lit("")))
    marked = raw.select("page_id", "body", declared.alias("charset"))
    plain = F.col("body").isNull() | ((F.col("charset").isNull() | F.col("charset").isin("utf-8", "utf8")) & F.is_valid_utf8(F.col("body").cast("string")) & (F.col("charset").isNotNull() | ~text.odd_bytes(F.col("body"))))
    marked = marked.withColumn("plain", plain)

    def decode(batches):
        for batch in (part for whole in batches for part in _portions(whole)):
            known, texts = [], []
            for body, charset in zip(batch.column("body"), batch.column("charset").to_pylist()):
                body, found = body.as_py(), None
                if charset:
                    try:
                        found = charset, body.decode(charset)
                    except (LookupError, UnicodeDecodeError):
                        pass
                found = found or charsets.guess(body) or ("utf-8", body.decode("utf-8", "replace"))
                known.append(found[0])
                texts.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(known, pa.string()), pa.array(texts, pa.string())], ["page_id", "encoding", "html"])

    kind = raw.schema["page_id"].dataType.simpleString()
    other = marked.filter(~F.col("plain")).select("page_id", "body", "charset").mapInArrow(decode, f"page_id {kind}, encoding string, html string")
    return marked.filter("plain").select("page_id", F.lit("utf-8").alias("encoding"), F.col("body").cast("string").alias("html")).unionByName(other)


CONFIG = """config_id string, site string, domain string, version int, status string, validated string, url_patterns array<string>,
selectors struct<clean: array<string>, book: map<string,string>, chapter: map<string,string>>,
request_policy struct<timeout_seconds: double, max_retries: int, rate_limit_seconds: double>, field_scores map<string,double>"""


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Site configs, one a file: JSON, or YAML (.yaml, .yml), which needs the
    yaml package on the executors. Absent fields are null; a path with another
    suffix raises ValueError. A path without suffix is a folder of JSON files."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""
    if suffix in ("yaml", "yml"):
        as_json = spark.read.text(path, wholetext=True).mapInArrow(_yaml_to_json, "value string")
        return as_json.select(F.from_json("value", CONFIG).alias("c")).select("c.*")
    if suffix not in ("", "json"):
        raise ValueError(f"unsupported config format: .{suffix}")
    return spark.read.schema(CONFIG).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def _yaml_to_json(batches):
    import json

    import yaml

    for batch in batches:
        texts = [json.dumps(yaml.safe_load(t), default=str) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


def url_summary(listed: DataFrame) -> DataFrame:
    """Requested, valid and failed URLs of a list."""
    return listed.agg(F.count(F.lit(1)).alias("requested"), F.count_if("valid").alias("created"), F.count_if(~F.col("valid")).alias("failed"))
