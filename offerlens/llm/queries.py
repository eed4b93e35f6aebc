"""Registered queries of this subpackage and the SQL they are checked against."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from offerlens.llm import (
    bpe, conversations, decontamination, embeddings, licenses, line_dedup, minhash, mixing, quality, sharding, token_counts, toxicity,
    vector_codes,
)
from offerlens.llm.tables import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by three-word shingles, linked from similarity 0.85."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.withColumnRenamed("id", "doc_id")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its source as site and its language there as path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label linked from cosine 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template blocks in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine."""
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 equal shards by document id, and where they are once there are 17."""
    out = sharding.shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1, ... takes of every document, and the output shards of its copies."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and how many and which follow a template that recurs across documents."""
    out = line_dedup.summary(table(spark, sf_dir, "documents"), min_tokens=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with totals, truncated totals and shares for every length."""
    counted = token_counts.lengths(table(spark, sf_dir, "documents").select("text"))
    return token_counts.suffix_sums(token_counts.histogram(counted))


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids and back."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"], and_decode=True, reread=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as four bytes each, by four rounds of exact integer clustering."""
    out, book = vector_codes.quantize(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                      F.lit(vector_codes.codebooks_sha256(book)).alias("codebooks_sha256"))


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations, and the least edits that mend their turns."""
    rows = table(spark, sf_dir, "conversations")
    digests = conversations.digest(conversations.repair(conversations.damage(rows)))
    return conversations.summarize(rows, digests)


SQL["op7_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS p
        FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS p FROM d, lens,
       LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN win USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op1_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM w,
      LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v WHERE r.root < u.b),
m AS (SELECT v, min(root) AS root FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id,
       coalesce(root, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = doc_id
"""

SQL["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS root FROM embeddings UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v WHERE r.root < u.b),
m AS (SELECT v, min(root) AS root FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM u GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN m ON m.v = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _license_sql() -> str:
    """Every block of every template's length that starts at one of its words, without any filter."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.TEMPLATES.items())
    phrases = " UNION ALL ".join(
        f"SELECT row, i - 1 AS place, {quoted(label)} AS label FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE "
        + " AND ".join(f"w[i + {j}] = {quoted(x)}" for j, x in enumerate(phrase.split())) for phrase, label in licenses.PHRASES.items())
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, w FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents)),
t AS (SELECT label, len(t) AS length, list_distinct(t) AS t FROM (SELECT label, {words('body')} AS t FROM (VALUES {rows}) v(label, body))),
k AS (SELECT row, label, length, len(t) AS n, x.word, i FROM (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM w) x
      JOIN (SELECT label, length, t, unnest(t) AS word FROM t) y ON x.word = y.word),
b AS (SELECT row, label, n, count(DISTINCT word) OVER (PARTITION BY row, label ORDER BY i RANGE BETWEEN CURRENT ROW AND length - 1 FOLLOWING) AS shared FROM k),
m AS (SELECT row, label, max(shared) / n AS share FROM b WHERE shared >= ceil({licenses.LEAST} * n - 1e-9) GROUP BY row, label, n),
p AS ({phrases}),
pb AS (SELECT row, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
al AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM m UNION ALL SELECT row, label FROM p) GROUP BY 1),
sc AS (SELECT row, max(share) AS share FROM m GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(pb.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(pb.labels, '') AS base_labels,
       coalesce(al.labels, '') AS labels, greatest(coalesce(share, 0), CASE WHEN pb.n > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN pb USING (row) LEFT JOIN al USING (row) LEFT JOIN sc USING (row)
"""


SQL["op4_licenses"] = _license_sql()


def _vector_codes_sql(rounds: int = 4) -> str:
    """Every part against every entry, round by round."""
    dist = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.row, p.part, arg_min(c.entry, ({dist}, c.entry)) AS entry, min({dist}) AS error
  FROM p JOIN c{r} c ON c.part = p.part GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT p.part, a.entry, i, floor(sum(p.x[i]) / count(*)) AS m FROM p JOIN a{r} a ON a.row = p.row AND a.part = p.part,
      LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.entry = c.entry)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, list_slice(e, part * (len(e) // 4) + 1, (part + 1) * (len(e) // 4)) AS x
  FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= 256),
{", ".join(steps)},
b AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
o AS (SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (row), b
"""


SQL["op12_vector_codes"] = _vector_codes_sql()

SQL["op13_conversations"] = r"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
d1 AS (SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS lot FROM d0),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d1, LATERAL (SELECT unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END))) WHERE lot <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ended, left(role, 1) AS x FROM d),
f AS MATERIALIZED (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS px, CASE WHEN ended = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins AS (SELECT * FROM (VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']),
    (1, 2, 3, ['user:', 'assistant:']), (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']),
    (3, 2, 3, ['user:', 'assistant:'])) v(p, k, m, said)),
edits AS (SELECT unnest(['K', 'R', 'D']) AS e),
st AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, ''::VARCHAR AS audit, []::VARCHAR[] AS done FROM f
  UNION ALL
  SELECT conv_id, i, q, cost, audit, done FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT s.conv_id, f.i, s.cost + 2 * k + CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
        s.audit || repeat('I', k) || e AS audit,
        CASE e WHEN 'D' THEN m WHEN 'R' THEN CASE m WHEN 2 THEN 3 ELSE 2 END
          ELSE CASE WHEN x = 's' AND m = 0 THEN 1 WHEN x = 'u' AND m <> 2 THEN 2 WHEN x = 'a' AND m = 2 THEN 3 END END AS q,
        s.done || said || CASE e WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE m WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] ELSE [] END AS done
      FROM st s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN ins ON ins.p = s.q, edits
      WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate')) WHERE q IS NOT NULL) WHERE best = 1),
n AS (SELECT conv_id, max(i) AS n, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
z AS (SELECT n.*, s.cost + 2 * k AS cost, s.audit || repeat('I', k) AS audit, s.done || said AS done,
    row_number() OVER (PARTITION BY n.conv_id ORDER BY s.cost + 2 * k, s.audit || repeat('I', k)) AS best
  FROM n JOIN st s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n JOIN ins ON ins.p = s.q AND ins.m IN (0, 3)),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(done, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id AND best = 1
"""
