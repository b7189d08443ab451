"""Queries of the problems tagged llm: 1, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesseral.llm import packing, surrogates, survivors, tokens
from tesseral.session import cut_lineage
from tesseral.sources.readers import table


def p1_found(spark, d):
    best = survivors.charges(table(spark, d, "payments")).where("n_rows > 1")
    return best.select(F.col("order_id").cast("int").alias("order_id"), F.col("payment_id").cast("int").alias("payment_id")).distinct()


def p1_survivors(spark, d):
    best = survivors.charges(table(spark, d, "payments"))
    return best.select("order_id", (F.col("cents") / 100).alias("amount"), "payment_id", "status", "paid_ts", "method", "n_rows")


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p7_roundtrip(spark, d):
    """Each document's number of ids, and whether decoding them gives the text again."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    ids = tokens.encode(docs, text="_text")
    both = docs.join(tokens.decode(ids), "doc_id").join(ids.select("doc_id", F.size("ids").alias("n_ids")), "doc_id")
    return both.select("doc_id", "n_ids", (F.col("text") == F.col("_text")).alias("same"))


def p7_decoded(spark, d):
    """A digest of each text as the id-to-piece join gives it back."""
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return back.select("doc_id", F.md5("text").alias("digest"))


def _placed(spark, d):
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p8_containers(spark, d):
    return _placed(spark, d)


def p8_fill(spark, d):
    return packing.fill(_placed(spark, d), table(spark, d, "pack_sizes"))


def p8_invariants(spark, d):
    """By capacity: documents placed, tokens that lie nowhere or twice, containers too full, documents split that needn't be, and whether under 1 % is unused."""
    sizes = cut_lineage(tokens.count_tokens(table(spark, d, "documents")))
    packs = table(spark, d, "pack_sizes").select(F.col("pack_id").cast("long").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    placed = cut_lineage(packing.pack(sizes, table(spark, d, "pack_sizes")))
    parts = placed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"))
    whole = parts.join(sizes, "doc_id").join(F.broadcast(packs), "pack_id").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.abs(F.col("got") - F.col("n_tokens")) + F.abs(F.col("last") - F.col("n_tokens"))).alias("tokens_astray"),
        F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("needless_splits"),
    )
    used = placed.where("container is not null").groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(packs), "pack_id")
    full = used.groupBy("pack_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("too_full"), (1 - F.sum("used") / F.sum("capacity") < 0.01).alias("under_1_percent"))
    return whole.join(full, "pack_id").select(F.col("pack_id").cast("int").alias("pack_id"), "docs", "tokens_astray", "needless_splits", "too_full", "under_1_percent")


def _mentions(spark, d):
    acts = table(spark, d, "concerts").select(F.col("artist").alias("name"))
    towns = table(spark, d, "customers").select(F.col("city").alias("name"))
    return surrogates.pseudonymised(table(spark, d, "documents"), table(spark, d, "customers"), acts.union(towns).distinct())


def p9_found(spark, d):
    return _mentions(spark, d).select("doc_id", "kind", "start_pos", "end_pos")


def p9_surrogates(spark, d):
    return _mentions(spark, d).select("doc_id", "kind", "start_pos", "end_pos", "replacement")


def p9_redacted(spark, d):
    return surrogates.redacted(table(spark, d, "documents"), _mentions(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p7_ids, p7_roundtrip, p7_decoded, p8_containers, p8_fill, p8_invariants, p9_found, p9_surrogates, p9_redacted)}

ORACLE = {
    "p1_found": """WITH r AS (SELECT *, round(amount, 2) AS a, lower(regexp_replace(coalesce(status, ''), '[^a-zA-Z]', '', 'g')) AS s FROM payments
  WHERE order_id IS NOT NULL AND amount IS NOT NULL),
q AS (SELECT *, count(*) OVER (PARTITION BY order_id, a) AS n, row_number() OVER (PARTITION BY order_id, a ORDER BY
  CASE s WHEN 'settled' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, paid_ts DESC NULLS LAST,
  (paid_ts IS NULL)::INT + (method IS NULL)::INT + (status IS NULL)::INT, payment_id DESC NULLS LAST) AS rn FROM r)
SELECT DISTINCT order_id, payment_id FROM q WHERE n > 1 AND rn = 1""",
    # every choice of charge, time and method of a group's rows, the best feasible one by trust
    "p1_survivors": """WITH r AS (SELECT order_id::BIGINT AS order_id, round(round(amount, 2) * 100)::BIGINT AS cents, payment_id::BIGINT AS payment_id, paid_ts AS raw, CASE WHEN paid_ts <> TIMESTAMP '1970-01-01' THEN paid_ts END AS time, method, status,
    lower(regexp_replace(coalesce(status, ''), '[^\\p{L}]', '', 'g')) AS letters FROM payments WHERE order_id IS NOT NULL AND amount IS NOT NULL),
k AS (SELECT *, CASE letters WHEN 'settled' THEN 3 WHEN 'pending' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END AS rank FROM r),
h AS (SELECT order_id, cents, payment_id AS id, letters, count(*) OVER (PARTITION BY order_id, cents) AS n_rows FROM k QUALIFY row_number() OVER (PARTITION BY order_id, cents
  ORDER BY rank DESC, raw DESC NULLS LAST, (raw IS NULL)::INT + (method IS NULL)::INT + (status IS NULL)::INT, payment_id DESC NULLS LAST, letters DESC) = 1),
o AS (SELECT k.*, k.payment_id IS NOT DISTINCT FROM h.id AS own FROM k JOIN h USING (order_id, cents)),
g AS (SELECT h.*, (SELECT arg_max(time, (rank, time)) FROM o WHERE o.order_id = h.order_id AND o.cents = h.cents AND own AND time IS NOT NULL) AS own_time,
  (SELECT arg_max(method, (rank, coalesce(raw, TIMESTAMP '0001-01-01'), method)) FROM o WHERE o.order_id = h.order_id AND o.cents = h.cents AND own AND method IS NOT NULL) AS own_method FROM h),
t AS (SELECT DISTINCT order_id, cents, own, rank, time, method, 1 AS some FROM o WHERE time IS NOT NULL UNION ALL SELECT order_id, cents, NULL, NULL, NULL, NULL, 0 FROM h),
m AS (SELECT DISTINCT order_id, cents, own, rank, raw, method AS name, 1 AS some FROM o WHERE method IS NOT NULL UNION ALL SELECT order_id, cents, NULL, NULL, NULL, NULL, 0 FROM h),
c AS (SELECT g.*, t.time, m.name FROM g JOIN t USING (order_id, cents) JOIN m USING (order_id, cents) CROSS JOIN (VALUES (1), (0)) AS x(charge)
  WHERE (charge = 0 OR (own_time IS NULL OR t.time = own_time) AND (own_method IS NULL OR m.name = own_method)) AND (t.method IS NULL OR m.name = t.method)
  QUALIFY row_number() OVER (PARTITION BY order_id, cents ORDER BY charge DESC, t.some DESC, t.own DESC, t.rank DESC, t.time DESC, m.some DESC, m.own DESC, m.rank DESC, m.raw DESC NULLS LAST, m.name DESC) = 1)
SELECT order_id, cents / 100.0::DOUBLE AS amount, id AS payment_id, letters AS status, time AS paid_ts, name AS method, n_rows FROM c""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_invariants": "SELECT pack_id, (SELECT count(*) FROM documents) AS docs, 0::BIGINT AS tokens_astray, 0::BIGINT AS needless_splits, 0::BIGINT AS too_full, true AS under_1_percent FROM pack_sizes",
}
