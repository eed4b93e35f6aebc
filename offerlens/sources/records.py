"""Landed reference files: record arrays, keyed maps, product pages, sitemaps, archives, documents."""
from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from offerlens.functions.text import first_group, strip
from offerlens.schemas import STORE_PRODUCT, struct_of


def _whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file as rows; a missing or unreadable file gives no rows and a warning."""
    try:
        return (
            spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
            .json(path)
        )
    except AnalysisException as e:
        warnings.warn(f"could not load {path}: {e}", stacklevel=2)
        return spark.createDataFrame([], schema)


def keyed_map_rows(
    files: DataFrame, key: str, value_type: str, root: str | None = None
) -> DataFrame:
    """JSON objects (column ``value``) as rows (key, value); ``root`` names an inner object to read
    instead. Malformed documents give no rows."""
    body = F.get_json_object("value", f"$.{root}") if root else F.col("value")
    return files.select(F.explode(F.from_json(body, f"MAP<STRING, {value_type}>")).alias(key, "value"))


def read_keyed_map(
    spark: SparkSession, path: str, key: str, value_type: str, root: str | None = None
) -> DataFrame:
    """The same for a file; a missing file gives no rows and a warning."""
    try:
        files = _whole_files(spark, path)
    except AnalysisException as e:
        warnings.warn(f"could not load {path}: {e}", stacklevel=2)
        files = spark.createDataFrame([], "file_name STRING, value STRING")
    return keyed_map_rows(files, key, value_type, root)


def read_handle_map(spark: SparkSession, path: str) -> DataFrame:
    """seller -> entity -> handle, as rows."""
    outer = read_keyed_map(spark, path, "seller_id", "MAP<STRING,STRING>")
    return outer.select("seller_id", F.explode("value").alias("entity_id", "handle"))


def products_in(files: DataFrame) -> DataFrame:
    """Product documents ({"product": ...}) and listing pages ({"products": [...]}) alike."""
    product = struct_of(STORE_PRODUCT).simpleString()
    page = f"product: {product}, products: ARRAY<{product}>"
    docs = files.select("file_name", F.from_json("value", f"STRUCT<{page}>").alias("d"))
    single = F.filter(F.array("d.product"), lambda x: x.isNotNull())
    listed = F.coalesce("d.products", F.array().cast(f"ARRAY<{product}>"))
    return docs.select(
        "file_name", F.posexplode(F.concat(single, listed)).alias("page_pos", "p")
    ).select("file_name", "page_pos", "p.*")


def read_store_products(spark: SparkSession, path: str) -> DataFrame:
    return products_in(_whole_files(spark, path, "*.json"))


def sitemap_products(entries: DataFrame) -> DataFrame:
    """Sitemap entries (loc, title) that point at a product -> handle, title, url."""
    pattern = "/products/([^/?#]+)"
    return entries.filter(F.col("loc").rlike(pattern)).select(
        first_group(F.col("loc"), pattern).alias("handle"),
        F.coalesce(strip(F.col("title")), F.lit("")).alias("title"),
        F.col("loc").alias("url"),
    )


def read_product_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """XML url entries; the title is that of the entry's image."""
    schema = "loc STRING, `image:image` STRUCT<`image:title`: STRING>"
    entries = spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
    return sitemap_products(
        entries.select("loc", F.col("`image:image`.`image:title`").alias("title"))
    )


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """Locations in a sitemap index that list products."""
    entries = spark.read.format("xml").option("rowTag", "sitemap").schema("loc STRING").load(path)
    return entries.filter(F.lower("loc").contains("product"))


def archive_rows(rows: DataFrame) -> DataFrame:
    """Index rows [timestamp, original, statuscode] -> snapshots that answered 200."""
    stamp, original, status = (F.get("row", i) for i in range(3))
    return rows.filter(status == "200").select(
        stamp.alias("stamp"),
        original.alias("url"),
        F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).alias("snapshot_ts"),
        F.substring(stamp, 1, 6).alias("yyyymm"),
    )


def read_archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Archive index answers: arrays of rows, the first one a header."""
    files = _whole_files(spark, path, "*.json")
    rows = files.select(F.from_json("value", "ARRAY<ARRAY<STRING>>").alias("rows")).filter(
        F.size("rows") > 1
    )
    return archive_rows(rows.select(F.explode(F.slice("rows", 2, F.size("rows"))).alias("row")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Numbered markdown guides, one row per file."""
    return _whole_files(spark, path, "[0-9][0-9]-*.md")
