"""Link state, recovery and source parsing."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gate import matching as GM
from gate import tables as G
from gate.base import Gate
from offerlens.operators import compare as A
from offerlens.operators import state as S
from offerlens.operators import store_products as SP
from offerlens.sources import observations as O
from offerlens.sources import records as R
from offerlens.session import checkpoint_dir

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql

KINDS = ["broken", "broken", "broken", "attempt", "attempt", "attempt", "redirect", "discovery", "verdict", "failed", "applied"]


def link_events(spark, d, events=None):
    """Events as link events; the user is the link."""
    e = G.table(spark, d, "events") if events is None else events
    i, none = F.col("event_id"), F.lit(None).cast("string")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), ((i * 7 + F.floor("value").cast("long")) % 11).cast("int"))
    odd = i % 2 == 1
    kind = F.when(kind == "failed", F.when(odd, "confirm_failed").otherwise("unrecoverable")).otherwise(kind)
    h = lambda p: F.concat(F.lit(p), i.cast("string"))
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("seller_id"), F.col("user_id").cast("string").alias("entity_id"),
        i.alias("event_ord"), F.col("ts").cast("timestamp").alias("event_ts"), kind.alias("event"),
        h("old").alias("old_handle"), h("new").alias("new_handle"), h("to").alias("redirect_url"),
        F.when(odd, "confirmed").otherwise("rejected").alias("verdict"), h("why").alias("reason"),
        F.when(kind == "discovery", h("name")).alias("common_name"), none.alias("botanical_name"),
        F.when(kind == "discovery", h("title")).alias("candidate_title"), F.when(kind == "discovery", F.lit(0.7)).alias("match_score"))


STATE_SQL = """RECURSIVE ev0 AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS i, ts, event_id % 2 = 1 AS odd,
    (['broken','broken','broken','attempt','attempt','attempt','redirect','discovery','verdict','failed','applied'])[(event_id * 7 + CAST(FLOOR(value) AS BIGINT)) % 11 + 1] AS k
  FROM events),
ev AS (SELECT entity_id, i, ts, odd, CASE WHEN k <> 'failed' THEN k WHEN odd THEN 'confirm_failed' ELSE 'unrecoverable' END AS k,
  ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY i) AS n FROM ev0),
st AS (
  SELECT DISTINCT entity_id, 0::BIGINT AS n, FALSE AS alive, NULL::VARCHAR AS old_handle, NULL::VARCHAR AS status, NULL::VARCHAR AS candidate_handle, NULL::VARCHAR AS title,
    0 AS attempts, NULL::TIMESTAMP AS attempted, NULL::TIMESTAMP AS created, NULL::TIMESTAMP AS updated, NULL::VARCHAR AS reason FROM ev
  UNION ALL
  SELECT entity_id, n2, CASE WHEN k = 'applied' THEN FALSE ELSE alive OR full_write END,
    CASE WHEN k = 'applied' THEN NULL WHEN eff OR k = 'redirect' THEN 'old' || i WHEN k = 'discovery' THEN COALESCE(old_handle, '') ELSE old_handle END,
    CASE WHEN k = 'applied' THEN NULL WHEN eff THEN 'broken' WHEN k = 'redirect' THEN 'redirect_candidate' WHEN k = 'discovery' THEN 'discovery_candidate'
      WHEN NOT alive OR k IN ('broken', 'attempt') THEN status WHEN k = 'verdict' THEN CASE WHEN odd THEN 'confirmed' ELSE 'rejected' END
      WHEN k = 'confirm_failed' THEN 'confirmation_failed' ELSE 'unrecoverable' END,
    CASE WHEN k = 'applied' OR eff THEN NULL WHEN k IN ('redirect', 'discovery') THEN 'new' || i ELSE candidate_handle END,
    CASE WHEN k = 'applied' OR eff OR k = 'redirect' THEN NULL WHEN k = 'discovery' THEN 'title' || i ELSE title END,
    CASE WHEN k IN ('applied', 'redirect') THEN 0 WHEN k = 'discovery' OR (k = 'attempt' AND alive) THEN attempts + 1 ELSE attempts END,
    CASE WHEN k IN ('applied', 'redirect') THEN NULL WHEN k = 'discovery' OR (k = 'attempt' AND alive) THEN ts ELSE attempted END,
    CASE WHEN k = 'applied' THEN NULL WHEN full_write THEN COALESCE(created, ts) ELSE created END,
    CASE WHEN k = 'applied' THEN NULL WHEN full_write THEN ts WHEN NOT alive OR k = 'broken' THEN updated ELSE ts END,
    CASE WHEN k = 'applied' OR full_write THEN NULL WHEN NOT alive OR k IN ('broken', 'attempt') THEN reason
      WHEN k = 'confirm_failed' THEN 'Confirmed handle still returns 404' ELSE 'why' || i END
  FROM (SELECT s.*, e.n AS n2, e.i, e.ts, e.odd, e.k,
      e.k = 'broken' AND NOT (s.alive AND s.status IN ('redirect_candidate', 'discovery_candidate', 'confirmed')) AS eff,
      e.k IN ('redirect', 'discovery') OR (e.k = 'broken' AND NOT (s.alive AND s.status IN ('redirect_candidate', 'discovery_candidate', 'confirmed'))) AS full_write
    FROM st s JOIN ev e ON e.entity_id = s.entity_id AND e.n = s.n + 1)),
last_n AS (SELECT entity_id, MAX(n) AS n FROM st GROUP BY 1),
links AS (SELECT st.*, CAST(CAST(entity_id AS BIGINT) % 10 AS VARCHAR) AS seller_id FROM st JOIN last_n USING (entity_id, n) WHERE alive)"""
SHOWN = """seller_id, entity_id, old_handle, status, candidate_handle, title AS candidate_title, attempts,
 STRFTIME(attempted, '%Y-%m-%d %H:%M:%S') AS attempted, STRFTIME(created, '%Y-%m-%d %H:%M:%S') AS created, STRFTIME(updated, '%Y-%m-%d %H:%M:%S') AS updated, reason"""


def shown(state):
    stamp = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return state.select(
        "seller_id", "entity_id", "old_handle", "status", "candidate_handle", "candidate_title", "attempts",
        stamp("last_discovery_attempt", "attempted"), stamp("created_at", "created"), stamp("updated_at", "updated"), "reason")


NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@gate("link_state", f"WITH {STATE_SQL} SELECT {SHOWN} FROM links")
def link_state(spark, d):
    return shown(S.link_state(link_events(spark, d)))


@gate("link_state_resumed", f"WITH {STATE_SQL} SELECT {SHOWN} FROM links")
def link_state_resumed(spark, d):
    """The same in two steps: the first half of the month, then the rest on top of that state."""
    e, cut = link_events(spark, d), F.col("event_ts") < "2024-01-16"
    return shown(S.link_state(e.filter(~cut), S.link_state(e.filter(cut))))


@gate("actionable", f"""WITH {STATE_SQL} SELECT seller_id, entity_id, attempts FROM links
WHERE status = 'broken' AND attempts < 7 AND (attempted IS NULL OR attempted <= TIMESTAMP '{NOW}' - INTERVAL 20 HOUR)""")
def actionable(spark, d):
    return S.actionable(S.link_state(link_events(spark, d)), now()).select("seller_id", "entity_id", "attempts")


@gate("expire", f"""WITH {STATE_SQL} SELECT seller_id, entity_id, CASE WHEN status = 'broken' AND attempts >= 2 THEN 'unrecoverable' ELSE status END AS status,
 CASE WHEN status = 'broken' AND attempts >= 2 THEN 'No candidate found after 2 attempts' ELSE reason END AS reason,
 STRFTIME(CASE WHEN status = 'broken' AND attempts >= 2 THEN TIMESTAMP '{NOW}' ELSE updated END, '%Y-%m-%d %H:%M:%S') AS updated FROM links""")
def expire(spark, d):
    return S.expire(S.link_state(link_events(spark, d)), now(), limit=2).select(
        "seller_id", "entity_id", "status", "reason", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


for _name, _fn, _in in [
    ("pending_links", S.pending, "'redirect_candidate', 'discovery_candidate'"), ("confirmed_links", S.confirmed, "'confirmed'"),
    ("reportable_links", S.reportable, "'unrecoverable', 'rejected', 'confirmation_failed'")]:
    gate(_name, f"WITH {STATE_SQL} SELECT seller_id, entity_id, status FROM links WHERE status IN ({_in})")(
        lambda spark, d, fn=_fn: fn(S.link_state(link_events(spark, d))).select("seller_id", "entity_id", "status"))


@gate("attention_report", f"""WITH {STATE_SQL} SELECT status, seller_id, entity_id, entity_id AS item, old_handle,
 CASE WHEN status = 'unrecoverable' THEN attempts END AS attempts, CASE WHEN status <> 'unrecoverable' THEN COALESCE(candidate_handle, 'N/A') END AS candidate_handle,
 COALESCE(reason, '') AS reason FROM links WHERE status IN ('unrecoverable', 'rejected', 'confirmation_failed')""")
def attention_report(spark, d):
    state = S.link_state(link_events(spark, d)).withColumn("common_name", F.lit(""))
    return S.attention_report(state)[0]


@gate("attention_counts", f"WITH {STATE_SQL} SELECT status, COUNT(*) AS links FROM links WHERE status IN ('unrecoverable', 'rejected', 'confirmation_failed') GROUP BY 1")
def attention_counts(spark, d):
    return S.attention_report(S.link_state(link_events(spark, d)))[1]


def recovery_inputs(spark, d):
    p = GM.products(spark, d)
    names = G.table(spark, d, "part").select("p_name", F.col("p_partkey").alias("product_ord"))
    dash = F.replace("p_name", F.lit(" "), F.lit("-"))
    state = (
        p.join(names, "product_ord").groupBy("seller_id", F.concat(dash, F.lit("-tree")).alias("entity_id"))
        .agg(F.min_by("handle", "product_ord").alias("old_handle"), F.min("product_ord").alias("k"))
        .select("seller_id", "entity_id", "old_handle", F.lit("broken").alias("status"), (F.col("k") % 9).cast("int").alias("attempts"),
                F.when(F.col("k") % 2 == 0, F.lit("2024-01-30 04:00:00").cast("timestamp")).alias("last_discovery_attempt"),
                now().alias("updated_at"), F.lit(None).cast("string").alias("reason")))
    sellers = G.sellers(spark, d).select("seller_id", F.when(F.col("seller_id").cast("int") < 6, "shopify").otherwise("custom").alias("scraper_type"))
    snapshot = state.select("seller_id", "entity_id", F.lit("1gal").alias("tier"), F.col("attempts").cast("double").alias("price"))
    prices = p.groupBy("seller_id", "handle").agg(F.create_map(F.lit("1 Gallon"), F.min("product_ord").cast("double")).alias("variant_prices"))
    known = GM.entities(spark, d).filter(~F.col("entity_id").startswith("red"))
    return state, now(), known, sellers, p, snapshot, prices


RECOVERY_SQL = f"""{GM.PAIR_SQL},
broken AS (
  SELECT CAST(p_partkey % 10 AS VARCHAR) AS seller_id, REPLACE(p_name, ' ', '-') || '-tree' AS entity_id,
         ARG_MIN(handle, p_partkey) AS old_handle, MIN(p_partkey) AS k
  FROM part JOIN prods ON p_partkey = product_ord GROUP BY 1, 2),
due AS (SELECT * FROM broken WHERE k % 9 < 7 AND CAST(seller_id AS INT) < 6),
again AS (
  SELECT b.seller_id, b.entity_id, p.handle, GREATEST(p.s1, p.s2) AS raw,
    ROW_NUMBER() OVER (PARTITION BY b.entity_id, b.seller_id ORDER BY GREATEST(p.s1, p.s2) DESC, p.product_ord) AS rn
  FROM due b JOIN pairs p ON p.entity_id = b.entity_id AND p.seller_id = b.seller_id AND p.handle <> b.old_handle
  WHERE NOT STARTS_WITH(b.entity_id, 'red')),
found AS (SELECT * FROM again WHERE rn = 1 AND raw >= 0.6)"""


@gate("recovery_pass_events", f"""WITH {RECOVERY_SQL}
SELECT d.seller_id, d.entity_id, CASE WHEN f.handle IS NULL THEN 'attempt' ELSE 'discovery' END AS event, f.handle AS new_handle, ROUND_EVEN(raw, 2) AS match_score
FROM due d LEFT JOIN found f USING (seller_id, entity_id)""")
def recovery_pass_events(spark, d):
    return S.recovery_pass(*recovery_inputs(spark, d))[1].select("seller_id", "entity_id", "event", "new_handle", "match_score")


@gate("recovery_pass_summary", f"""WITH {RECOVERY_SQL} SELECT (SELECT COUNT(*) FROM due) AS entries_processed, (SELECT COUNT(*) FROM found) AS candidates_found,
 COUNT_IF(k % 9 >= 7) AS marked_unrecoverable, COUNT_IF(k % 9 < 7 AND CAST(seller_id AS INT) >= 6) AS skipped FROM broken""")
def recovery_pass_summary(spark, d):
    return S.recovery_pass(*recovery_inputs(spark, d))[2]


def _validated(spark, d):
    key = F.col("p_partkey")
    p = G.table(spark, d, "part")
    state = p.select(
        (key % 12).cast("string").alias("seller_id"), key.alias("entity_id"), F.when(key % 5 == 0, "broken").otherwise("confirmed").alias("status"),
        F.when(key % 4 > 0, F.concat(F.lit("h"), key.cast("string"))).otherwise("").alias("candidate_handle"))
    probes = p.filter("p_size > 4").select(
        (key % 12).cast("string").alias("seller_id"), key.alias("entity_id"), F.when(key % 3 == 0, 404).otherwise(200).alias("status_code"), (key % 7 > 0).alias("has_product"))
    return S.apply_validated(state, G.sellers(spark, d), probes, now())


VALID = "SELECT CAST(p_partkey % 12 AS VARCHAR) AS seller_id, p_partkey AS entity_id, p_partkey % 3 > 0 AND p_partkey % 7 > 0 AS good FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 4 > 0 AND p_partkey % 12 < 10 AND p_size > 4"


@gate("apply_validated_handles", f"SELECT seller_id, entity_id, 'h' || entity_id AS handle FROM ({VALID}) WHERE good")
def apply_handles(spark, d):
    return _validated(spark, d)[0]


@gate("apply_validated_events", f"SELECT seller_id, entity_id, CASE WHEN good THEN 'applied' ELSE 'confirm_failed' END AS event FROM ({VALID})")
def apply_events(spark, d):
    return _validated(spark, d)[1].drop("event_ts")


def observation_lines(spark, d):
    """Stored lines, written by Spark from the offers: sizes are objects, or bare numbers where the
    line number is odd. Every entity divisible by 13 has a broken line besides."""
    o = G.offers(spark, d)
    obj = F.to_json(F.struct("price", "was_price", "available", F.col("raw_tier").alias("raw_size"), "variant_id"))
    size = F.when(F.col("pos") % 2 == 1, F.col("price").cast("string")).otherwise(obj)
    entry = F.concat(F.lit('"'), "raw_tier", F.lit('":'), size)
    lines = o.groupBy("entity_id", "seller_id", "ord", "obs_date").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x.e), ",").alias("sizes"))
    text = F.concat(
        F.lit('{"retailer_id":"'), "seller_id", F.lit('","timestamp":"'), F.col("obs_date").cast("string"),
        F.lit('T23:30:00-05:00","url":"u","sizes":{'), "sizes", F.lit("}}"))
    good = lines.select(F.col("entity_id").cast("string").alias("entity_id"), F.concat(F.lit("f"), F.col("entity_id") % 100).alias("file"), "ord", text.alias("value"))
    bad = lines.filter(F.col("entity_id") % 13 == 0).select(
        F.col("entity_id").cast("string").alias("entity_id"), F.concat(F.lit("f"), F.col("entity_id") % 100).alias("file"), "ord",
        F.when(F.col("ord") % 2 == 0, '{"retailer_id": "1", ').otherwise("   ").alias("value"))
    return good.unionByName(bad)


@gate("read_observations", f"""WITH {G.OFFERS_SQL} SELECT CAST(entity_id AS VARCHAR) AS entity_id, seller_id, STRFTIME(obs_date, '%Y-%m-%d') AS obs_date, raw_tier, price,
 CASE WHEN pos % 2 = 0 THEN was_price END AS was_price, CASE WHEN pos % 2 = 0 THEN available END AS available, CASE WHEN pos % 2 = 0 THEN variant_id END AS variant_id FROM offers""")
def read_observations(spark, d):
    return O.explode_sizes(O.parse_lines(observation_lines(spark, d))).select(
        "entity_id", "seller_id", F.col("obs_date").cast("string").alias("obs_date"), "raw_tier", "price", "was_price", "available", "variant_id")


@gate("read_observations_strict", SQL["read_observations"])
def read_observations_strict(spark, d):
    """Lines that are all sound, read in the mode that fails on a bad one."""
    lines = observation_lines(spark, d)
    sound = lines.filter(F.col("value").rlike(r"\}\s*$"))
    return O.explode_sizes(O.parse_lines(sound, on_bad="fail")).select(
        "entity_id", "seller_id", F.col("obs_date").cast("string").alias("obs_date"), "raw_tier", "price", "was_price", "available", "variant_id")


@gate("record_files", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 = 1 END AS active FROM supplier")
def record_files(spark, d):
    """Suppliers written as JSON array files, one per nation, and read back as records."""
    key, path = F.col("s_suppkey"), _scratch(spark, "records")
    record = F.struct(key.cast("string").alias("id"), F.col("s_name").alias("name"), F.when(key % 3 > 0, key % 3 == 1).alias("active"))
    arrays = G.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return R.read_records(spark, path, "id STRING, name STRING, active BOOLEAN").select("id", "name", "active")


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@gate("append_then_latest", f"""WITH {G.OFFERS_SQL}, newest AS (SELECT entity_id, seller_id, MAX((obs_date >= DATE '1996-01-01', ord)) AS at FROM offers GROUP BY 1, 2)
SELECT o.entity_id, o.seller_id, raw_tier, price FROM offers o JOIN newest n ON n.entity_id = o.entity_id AND n.seller_id = o.seller_id
  AND n.at = (obs_date >= DATE '1996-01-01', ord)""")
def append_then_latest(spark, d):
    """History appended in two parts, with positions that start anew in each, read back and folded."""
    path, o = _scratch(spark, "history"), G.offers(spark, d)
    late = F.col("obs_date") >= "1996-01-01"
    for part in (o.filter(~late), o.filter(late)):
        first = part.agg(F.min("ord")).scalar()
        O.append_observations(part.withColumn("ord", F.col("ord") - first), path)
    return A.latest_offers(O.read_history(spark, path)).select("entity_id", "seller_id", "raw_tier", "price")


@gate("snapshot_versions", f"WITH {G.OFFERS_SQL} SELECT entity_id, seller_id, raw_tier AS tier, MAX(price) AS price FROM offers GROUP BY 1, 2, 3")
def snapshot_versions(spark, d):
    """A snapshot written twice and read back."""
    path = _scratch(spark, "snapshot")
    key = ["entity_id", "seller_id", F.col("raw_tier").alias("tier")]
    for fold in (F.min, F.max):
        O.write_snapshot(G.offers(spark, d).groupBy(*key).agg(fold("price").alias("price")), path)
    return O.read_snapshot(spark, path)


PURGE_SQL = f"""{G.OFFERS_SQL}, obs AS (SELECT DISTINCT entity_id, seller_id, ord FROM offers)"""


@gate("purge_seller_stats", f"WITH {PURGE_SQL} SELECT COUNT(*) AS rows_removed, COUNT(DISTINCT entity_id % 100) AS files_modified FROM obs WHERE seller_id = '7'")
def purge_stats(spark, d):
    return O.purge_lines(observation_lines(spark, d), "7")[1]


@gate("purge_seller_kept", f"""WITH {PURGE_SQL} SELECT 'f' || entity_id % 100 AS file, COUNT_IF(seller_id <> '7') + COUNT_IF(entity_id % 13 = 0) AS lines FROM obs GROUP BY 1""")
def purge_kept(spark, d):
    return O.purge_lines(observation_lines(spark, d), "7")[0].groupBy("file").agg(F.count("*").alias("lines"))


@gate("keyed_map", "SELECT 'p' || p_partkey AS entity_id, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 9 > 0")
def keyed_map(spark, d):
    key = F.col("p_partkey")
    doc = F.concat(F.lit('{"entries":{"p'), key.cast("string"), F.lit('":{"name":"'), "p_name", F.lit('","size":'), F.col("p_size").cast("string"),
                   F.when(key % 9 > 0, "}}}").otherwise("}"))
    files = G.table(spark, d, "part").select(F.lit("f").alias("file_name"), doc.alias("value"))
    return R.keyed_map_rows(files, "entity_id", "STRUCT<name: STRING, size: BIGINT>", "entries").select("entity_id", "value.name", "value.size")


@gate("store_product_documents", """SELECT 'h' || p_partkey AS handle, p_name AS title, CAST(p_retailprice AS VARCHAR) AS price FROM part
UNION ALL SELECT 'x' || p_partkey, p_type, '1' FROM part WHERE p_partkey % 2 = 0""")
def store_product_documents(spark, d):
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit('{"title":"'), "p_name", F.lit('","handle":"h'), k, F.lit('","variants":[{"id":1,"title":"Quart","price":"'), F.col("p_retailprice").cast("string"), F.lit('"}]}'))
    two = F.concat(F.lit('{"title":"'), "p_type", F.lit('","handle":"x'), k, F.lit('","variants":[{"id":2,"price":"1"}]}'))
    doc = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"products":['), one, F.lit(","), two, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"product":'), one, F.lit("}")))
    files = G.table(spark, d, "part").select(F.lit("f").alias("file_name"), doc.alias("value"))
    return R.products_in(files).select("handle", "title", F.get("variants", 0).price.alias("price"))
