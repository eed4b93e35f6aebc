"""Table shapes and the column names operators are keyed by."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Cols:
    """Names of the key columns, so one operator fits any entity x seller x time price table."""

    entity: str = "entity_id"
    seller: str = "seller_id"
    tier: str = "tier"
    price: str = "price"
    was_price: str = "was_price"
    ts: str = "obs_ts"
    date: str = "obs_date"
    ord: str = "ord"
    in_stock: str = "in_stock"

    @property
    def pair(self) -> list[str]:
        return [self.entity, self.seller]


COLS = Cols()

SIZE_STRUCT = (
    "price DOUBLE, was_price DOUBLE, available BOOLEAN, raw_size STRING, variant_id STRING"
)

# One stored observation line. A size value is a struct or a bare number, so it is kept as text.
OBSERVATION_LINE = (
    "retailer_id STRING, retailer_name STRING, timestamp STRING, url STRING, "
    "sizes MAP<STRING,STRING>, in_stock BOOLEAN"
)

VARIANT = (
    "STRUCT<id: STRING, title: STRING, price: STRING, compare_at_price: STRING, "
    "available: BOOLEAN, option1: STRING>"
)
STORE_PRODUCT = f"title STRING, handle STRING, body_html STRING, variants ARRAY<{VARIANT}>"

SELLER = (
    "id STRING, name STRING, url STRING, scraper_type STRING, "
    "affiliate STRUCT<network: STRING, commission: STRING, cookie_days: INT, "
    "link_template: STRING, notes: STRING>, "
    "shipping STRUCT<free_threshold: DOUBLE, flat_rate: DOUBLE, free_all: BOOLEAN, notes: STRING>, "
    "trust_builder BOOLEAN, active BOOLEAN, priority INT, inactive_reason STRING, notes STRING"
)

CATALOG = (
    "id STRING, common_name STRING, botanical_name STRING, aliases ARRAY<STRING>, "
    "category STRING, zones ARRAY<INT>, sun STRING, mature_size STRING, bloom_time STRING, "
    "type STRING, size_tiers MAP<STRING,ARRAY<STRING>>, price_range STRING, image STRING, "
    "image_credit STRING, "
    "planting_seasons MAP<STRING,STRUCT<spring: STRING, fall: STRING, summer: STRING>>, "
    "price_seasonality STRUCT<monthly_index: ARRAY<INT>, best_buy: STRING, worst_buy: STRING, "
    "note: STRING, tip: STRING>, active BOOLEAN"
)

FEEDBACK = (
    "id STRING, category STRING, title STRING, body STRING, submitted_at STRING, status STRING, "
    "upvotes INT, response STRUCT<author: STRING, body: STRING, responded_at: STRING>"
)

PROMO = (
    "retailer_id STRING, retailer_name STRING, timestamp STRING, "
    "codes ARRAY<STRING>, banners ARRAY<STRING>"
)

LINK_STATE = (
    "seller_id STRING, entity_id STRING, old_handle STRING, status STRING, "
    "candidate_handle STRING, redirect_url STRING, attempts INT, "
    "last_discovery_attempt TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "common_name STRING, botanical_name STRING, candidate_title STRING, match_score DOUBLE, "
    "reason STRING"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
