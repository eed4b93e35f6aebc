"""Matches of names with listings that are kept up to date, one change of listings or names at a time.

Four tables under one folder: the listings, the names, an inverted index (word -> listings) and the best listing of every
name. A change matches the changed listings with all names, which needs no other listing, and looks up only those names
anew that are changed themselves or whose best listing is. These probe the index with their rarest words, as in
``matching``: a bucket of the index without such a word is not read.

What is removed stays as a row that is not live, so a bucket is never left unwritten; ``compact`` writes the tables
without such rows. The index is merged first, then matches, names, listings, so a change that was cut off is applied by
sending it again.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlens.functions import fixed_values as FV
from offerlens.operators import matching as M
from offerlens.operators import state as S
from offerlens.session import cut_lineage
from offerlens.sources.kept import BUCKETS, KeptTable

PRODUCT = "product_ord LONG, title STRING, handle STRING, live BOOLEAN"
NAME = "entity_id STRING, name STRING, botanical STRING, live BOOLEAN"
POSTING = "word STRING, product_ord LONG, live BOOLEAN"
MATCH = "entity_id STRING, score DOUBLE, product_ord LONG"


def _fields(df: DataFrame, schema: str) -> DataFrame:
    kinds = StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])


def postings(products: DataFrame) -> DataFrame:
    """(word, product_ord): a listing's words by kind of text, and the text itself where it has none."""
    rows = M.match_listings(products, [])
    words = F.transform("p_words", lambda w: F.concat_ws(":", "kind", w))
    text = F.when((F.size("p_words") == 0) & (F.col("p_text") != ""), F.array(F.concat_ws("=", "kind", "p_text")))
    return rows.select(F.col("p_ord").alias("product_ord"), F.explode(F.coalesce(text, words)).alias("word")).distinct()


@dataclass(frozen=True)
class KeptMatches:
    """``best_matches`` of all names and listings so far. One writer at a time."""

    spark: SparkSession
    path: str
    threshold: float = FV.MATCH_THRESHOLD
    buckets: int = BUCKETS

    def _table(self, name: str, *key: str) -> KeptTable:
        return KeptTable(self.spark, f"{self.path}/{name}", list(key), self.buckets)

    @property
    def products(self) -> KeptTable:
        return self._table("products", "product_ord")

    @property
    def names(self) -> KeptTable:
        return self._table("names", "entity_id")

    @property
    def index(self) -> KeptTable:
        return self._table("index", "word")

    @property
    def matches(self) -> KeptTable:
        return self._table("matches", "entity_id")

    def _now(self, table: KeptTable, schema: str, change: DataFrame) -> DataFrame:
        """A table as it will be after ``change``: live rows only."""
        old = table.read() if table.exists() else self.spark.createDataFrame([], schema)
        return S.replace_by_key(old, change, table.key).filter("live")

    def _probes(self, names: DataFrame) -> DataFrame:
        """(word) that lead to every listing which can match one of the names: rarest words of names, texts of wordless ones."""
        rows = M.match_names(names, [])
        key = ["kind", "e_key", "e_weight"]
        sets = rows.withColumn("e_key", M._key(F.col("e_words"))).filter("e_key != ''")
        wanted = M._wanted(sets, key, self.threshold).withColumn("word", F.concat_ws(":", "kind", "word"))
        wanted = cut_lineage(wanted)
        held = self.index.near(wanted.select("word").distinct(), StructType.fromDDL(POSTING)).filter("live")
        frequency = held.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
        place = F.row_number().over(Window.partitionBy(*key).orderBy("df", "word"))
        rare = (
            wanted.join(frequency, "word", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", place)
            .filter(F.col("place") <= F.col("n") - F.col("needed") + 1).filter("df > 0").select("word")
        )
        wordless = rows.filter((F.size("e_words") == 0) & (F.col("e_text") != ""))
        return rare.unionByName(wordless.select(F.concat_ws("=", "kind", "e_text").alias("word"))).distinct()

    def change(
        self, products: DataFrame | None = None, gone: DataFrame | None = None, names: DataFrame | None = None,
        names_gone: DataFrame | None = None,
    ) -> None:
        """Apply new and altered listings and names (whole rows, once each) and ids of those that are gone.

        products: product_ord, title, handle; gone: product_ord; names: entity_id, name, botanical; names_gone: entity_id.
        """
        goods = self._change(PRODUCT, products, gone)
        people = self._change(NAME, names, names_gone)
        touched = goods.select("product_ord")
        before = self.products.near(touched, StructType.fromDDL(PRODUCT)).filter("live").join(touched, "product_ord", "left_semi")
        old = postings(before).withColumn("live", F.lit(False))
        new = postings(goods.filter("live")).withColumn("live", F.lit(True))
        fresh = old.join(new, ["word", "product_ord"], "left_anti").unionByName(new)
        self.index.merge(_fields(cut_lineage(fresh), POSTING), lambda was, add: S.replace_by_key(was, add, ["word", "product_ord"]))

        all_names = self._now(self.names, NAME, people)
        kept = self.matches.read() if self.matches.exists() else self.spark.createDataFrame([], MATCH)
        lost = kept.join(touched, "product_ord", "left_semi").select("entity_id")
        again = cut_lineage(lost.unionByName(people.select("entity_id")).distinct())
        anew = cut_lineage(all_names.join(again, "entity_id", "left_semi"))
        probes = cut_lineage(self._probes(anew))
        found = self.index.near(probes, StructType.fromDDL(POSTING)).filter("live").join(probes, "word", "left_semi")
        found = cut_lineage(found.select("product_ord").distinct())
        near = S.replace_by_key(self.products.near(found, StructType.fromDDL(PRODUCT)), goods, ["product_ord"]).filter("live")
        searched = self._best(anew, near.join(found, "product_ord", "left_semi"))
        offered = self._best(all_names.join(again, "entity_id", "left_anti"), goods.filter("live"))
        none = again.join(searched, "entity_id", "left_anti").select(
            "entity_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("product_ord"))
        known = kept.join(offered, "entity_id", "left_semi")
        better = F.max(F.struct("score", (-F.col("product_ord")).alias("less"))).alias("m")
        best = known.unionByName(offered).filter("score IS NOT NULL").groupBy("entity_id").agg(better)
        best = best.select("entity_id", "m.score", (-F.col("m.less")).alias("product_ord"))
        changed = best.join(kept, ["entity_id", "score", "product_ord"], "left_anti")
        result = cut_lineage(_fields(searched.unionByName(none).unionByName(changed), MATCH))
        self.matches.merge(result, lambda was, add: S.replace_by_key(was, add, ["entity_id"]))
        self.names.merge(people, lambda was, add: S.replace_by_key(was, add, ["entity_id"]))
        self.products.merge(goods, lambda was, add: S.replace_by_key(was, add, ["product_ord"]))

    def _change(self, schema: str, rows: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        new = empty if rows is None else _fields(rows.withColumn("live", F.lit(True)), schema)
        if gone is not None:
            new = new.unionByName(gone.withColumn("live", F.lit(False)), allowMissingColumns=True)
        return cut_lineage(_fields(new, schema))

    def _best(self, names: DataFrame, products: DataFrame) -> DataFrame:
        best = M.best_pairs(M.match_names(names, []), M.match_listings(products, []), self.threshold, [])
        return best.select(F.col("e_id").alias("entity_id"), "score", F.col("p_ord").alias("product_ord"))

    def best_matches(self) -> DataFrame:
        """What ``matching.best_matches`` gives for all live names and listings."""
        best = self.matches.read().filter("score IS NOT NULL").select(
            F.col("entity_id").alias("e_id"), "score", F.col("product_ord").alias("p_ord"))
        return M.with_listing(best, self.products.read().filter("live").drop("live"), [])

    def compact(self) -> None:
        """Write the tables without rows that are gone."""
        for table in (self.index, self.matches, self.names, self.products):
            if table.exists():
                rows = table.read()
                table.rebuild(cut_lineage(rows.filter("live" if "live" in rows.columns else "score IS NOT NULL")))
