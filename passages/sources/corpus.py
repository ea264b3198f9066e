"""Sources and sinks: scanning, admission, imports, replacing, index tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from passages.functions import addresses
from passages.operators.sizes import few
from passages.sources.guard import guarded_sql
from passages.sources.storage import remove, shared_dir

__all__ = ["admit_documents", "admit_urls", "check_golden_set", "guarded_sql", "import_golden_set", "read_index", "replace_by_source", "route", "scan_corpus", "sitemap_select", "write_index"]

# File types that are taken in.
SUPPORTED = ("pdf", "txt", "md", "json", "docx", "xlsx", "html", "htm")
MAX_BYTES = 25 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def route(files: DataFrame) -> DataFrame:
    """Adds extension and reject_reason by the name's last extension."""
    rows = files.withColumn("extension", extension(F.col("name")))
    return rows.withColumn("reject_reason", F.when(~F.col("extension").isin(*SUPPORTED), F.concat(F.lit("unsupported type: "), F.col("extension"))))


def scan_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files below a folder: those of a supported type, with their bytes, and the others with a reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = route(files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", "length", "content"))
    return rows.where("reject_reason IS NULL").drop("reject_reason"), rows.where("reject_reason IS NOT NULL").drop("content")


def admit_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds reject_reason: unsupported type, empty, or too large."""
    rows = route(files)
    reason = F.coalesce("reject_reason", F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large"))
    return rows.withColumn("reject_reason", reason)


def admit_urls(urls: DataFrame) -> DataFrame:
    """Adds reject_reason to rows with url: scheme, host, and literal addresses that are not public, in whatever spelling. Names are not resolved, but localhost is known.

    A bracketed host that is no address is refused as well.
    """
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    local = (host == "localhost") | host.endswith(".localhost")
    malformed = host.startswith("[") & addresses.ipv6(F.regexp_extract(host, r"^\[(.*)\]$", 1)).isNull()
    reason = F.when(~scheme.isin("http", "https"), "scheme").when(host == "", "no host").when(malformed, "malformed address").when(local | addresses.not_public(host), "private address")
    return urls.withColumn("reject_reason", reason)


def sitemap_select(urls: DataFrame, limit: int, preview: int = 20) -> DataFrame:
    """Per site: how many distinct pages there are, how many would be taken, and the first of them. The order is by URL."""
    rows = urls.select("site", F.regexp_replace("url", "/+$", "").alias("url")).distinct()
    order = Window.partitionBy("site").orderBy("url")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= preview)
    totals = rows.groupBy("site").agg(F.count("*").alias("total_found"))
    previews = first.groupBy("site").agg(F.array_join(F.sort_array(F.collect_list("url")), ",").alias("preview"))
    return totals.join(previews, "site").select("site", "total_found", F.least("total_found", F.lit(limit)).cast("long").alias("would_import"), "preview")


def check_golden_set(rows: DataFrame) -> DataFrame:
    """Items (row_no, question, expected_sources, tags): list columns split and trimmed, rows without a question marked."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    reason = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": no question")))
    return rows.select("row_no", F.trim("question").alias("question"), listed("expected_sources").alias("expected_sources"), listed("tags").alias("tags"), reason.alias("error"))


def import_golden_set(spark: SparkSession, path: str, limit: int = 1000) -> tuple[DataFrame, list[str]]:
    """Accepted items of a CSV file with a header or a JSON file (a list, or an object with items), and the first 20 errors."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = spark.read.json(path, multiLine=True)
        rows = rows.select(F.explode("items").alias("i")).select("i.*") if rows.columns == ["items"] else rows
    for name in ("question", "expected_sources", "tags"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
        elif dict(rows.dtypes)[name].startswith("array"):
            rows = rows.withColumn(name, F.array_join(name, ","))
    taken = rows.limit(limit + 1).collect()  # the limit of one import
    if len(taken) > limit:
        raise ValueError(f"more than {limit} rows")
    numbered = spark.createDataFrame([(i, r["question"], r["expected_sources"], r["tags"]) for i, r in enumerate(taken, 1)], "row_no long, question string, expected_sources string, tags string")
    items = check_golden_set(numbered)
    errors = [r["error"] for r in items.where("error IS NOT NULL").orderBy("row_no").limit(20).collect()]
    return items.where("error IS NULL").drop("error"), errors


def replace_by_source(existing: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Existing rows, with all rows of the sources that new holds replaced: running it twice changes nothing."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


#: Postings of a folder that an index is laid out for, and of one file at most.
BUCKET_ROWS, FILE_ROWS = 4_000_000, 1_000_000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_index(postings: DataFrame, path: str, buckets: int | None = None, partition: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """Writes postings (term, chunk_id, ...), those of a term in one of the index's folders, within the folders of partition (such as org_id) if given.

    The number of folders follows from that of the postings, if not given, and is stored with the index. A folder that holds more than
    file_rows, such as one with a very frequent term, is dealt out to several tasks and files by chunk; no file holds more.
    """
    spark = postings.sparkSession
    # worked out once: the counts and the files below read them three times
    once = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    postings.write.parquet(once)
    postings = spark.read.schema(postings.schema).parquet(once)
    if buckets is None:
        buckets = max(1, -(-postings.count() // BUCKET_ROWS))
    keys = [*([partition] if partition else []), "bucket"]
    rows = postings.withColumn("bucket", _bucket(buckets))
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_parts")).where("_parts > 1")
    large = few(parts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_parts"))
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(large[f"_{k}"]) for k in keys])
    dealt = rows.join(large, on, "left").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.coalesce("_parts", F.lit(1)))).drop("_parts", *[f"_{k}" for k in keys])
    dealt.repartition(*keys, "_part").drop("_part").write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(*keys).parquet(path)
    # folders whose name starts with an underscore are no data to Spark's readers
    schema = dealt.drop("_part").schema.json()
    spark.createDataFrame([(buckets, schema)], "buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")
    remove(spark, once)


def read_index(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """The postings of an index; of the folders of some terms' (term) alone, if given: Spark leaves the others unread."""
    layout = spark.read.parquet(f"{path}/_index").first()
    rows = spark.read.schema(StructType.fromJson(json.loads(layout["schema"]))).parquet(path)
    if terms is not None:
        rows = rows.where(F.col("bucket").isin([r["b"] for r in terms.select(_bucket(layout["buckets"]).alias("b")).distinct().collect()]))  # at most as many as buckets
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.drop("bucket")
