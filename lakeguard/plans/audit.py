"""Queries of the financial-control tests and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.functions.storage import cut
from lakeguard.operators import audit as A
from lakeguard.plans.steps import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as invoices; some numbers have no order or no receipt."""
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("invoice"), F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 10_000_000_000).otherwise(0)).alias("po"), F.col("l_extendedprice").alias("amount"), (F.col("l_suppkey") % 40).alias("entered"), (F.col("l_partkey") % 40).alias("approved"))


INVOICES = "(SELECT l_orderkey * 10 + l_linenumber AS invoice, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey + CASE WHEN l_partkey % 50 = 0 THEN 10000000000 ELSE 0 END END AS po, l_extendedprice AS amount, l_suppkey % 40 AS entered, l_partkey % 40 AS approved FROM lineitem)"
ORDERS = "(SELECT o_orderkey AS po FROM orders)"
RECEIPTS = "(SELECT o_orderkey AS po FROM orders WHERE o_orderstatus <> 'O')"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("po"))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("po"))


@query("jn3_two_way_match", f"SELECT invoice, po, amount FROM {INVOICES} WHERE po IS NULL OR po NOT IN (SELECT po FROM {ORDERS})")
def two_way(spark: SparkSession, sf: str) -> DataFrame:
    return A.two_way_match(invoices(spark, sf), orders(spark, sf), "po").select("invoice", "po", "amount")


@query("jn4_three_way_match", f"SELECT invoice, po, amount FROM {INVOICES} WHERE po IN (SELECT po FROM {ORDERS}) AND po NOT IN (SELECT po FROM {RECEIPTS})")
def three_way(spark: SparkSession, sf: str) -> DataFrame:
    return A.three_way_match(invoices(spark, sf), orders(spark, sf), receipts(spark, sf), "po").select("invoice", "po", "amount")


@query("jn5_expectation_join", "SELECT o_orderkey, o_totalprice, round(m, 4) AS expected FROM orders LEFT JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) USING (o_orderpriority)")
def expectation(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders")
    means = df.filter("o_orderdate < timestamp_ntz'1996-01-01'").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("expected"))
    return df.join(means, "o_orderpriority", "left").select("o_orderkey", "o_totalprice", "expected")


@query("jn6_pending_review", "SELECT o_orderkey AS finding_id FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    findings = t(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("finding_id"))
    decided = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("finding_id")).distinct()
    return findings.join(decided, "finding_id", "left_anti")


MATERIAL = "(SELECT CASE WHEN x > 0 THEN greatest(10000, x * 0.01) ELSE 50000 END AS overall FROM (SELECT sum(abs(CAST(o_totalprice AS DECIMAL(28,6)))) AS x FROM orders))"


@query("ag10_materiality", f"SELECT CAST(overall AS DOUBLE) AS overall, CAST(overall * 0.75 AS DOUBLE) AS performance FROM {MATERIAL}")
def material(spark: SparkSession, sf: str) -> DataFrame:
    return A.materiality(t(spark, sf, "orders"), "o_totalprice").select(F.col("overall").cast("double"), F.col("performance").cast("double"))


BENFORD = """(SELECT d AS digit, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 10)) AS d) LEFT JOIN
 (SELECT CAST(regexp_extract(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), '[1-9]') AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1) USING (d))"""


@query("ag11_benford", f"SELECT CAST(digit AS INTEGER) AS digit, n, round(n / sum(n) OVER (), 6) AS observed, round(log10(1 + 1 / digit), 6) AS expected, round(avg(abs(p - e)) OVER (), 6) AS mad, avg(abs(p - e)) OVER () > 0.015 AS flagged FROM (SELECT *, n / sum(n) OVER () AS p, log10(1 + 1 / digit) AS e FROM {BENFORD})")
def benford(spark: SparkSession, sf: str) -> DataFrame:
    df = A.benford(t(spark, sf, "lineitem"), "l_extendedprice")
    return df.select("digit", "n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "mad")], "flagged")


@query("ag16_risk_counts", "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM orders GROUP BY 1")
def risk_counts(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    return t(spark, sf, "orders").groupBy(level.alias("risk_level")).agg(F.count("*").alias("n"))


@query("ag17_dataset_fingerprint")
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return A.fingerprint(t(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


@query("wf7_duplicate_payment", "SELECT l_orderkey, l_linenumber, occurrence FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_quantity, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS occurrence FROM lineitem) WHERE occurrence > 1")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.duplicate_payments(df, ["l_quantity", "l_suppkey"], "seq").select("l_orderkey", "l_linenumber", "occurrence")


#: Every 499th order is booked three thousand times too high.
BOOKS = "(SELECT o_orderkey, o_orderpriority, o_orderdate, o_totalprice * CASE WHEN o_orderkey % 499 = 0 THEN 3000.0::DOUBLE ELSE 1.0::DOUBLE END AS o_totalprice FROM orders)"


@query(
    "fa1_analytical",
    f"""SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice, CASE WHEN o_totalprice > overall * 0.75 THEN 'above_performance' ELSE 'unexpected' END AS reason
    FROM {BOOKS} JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m FROM {BOOKS} WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) USING (o_orderpriority), {MATERIAL.replace("FROM orders", f"FROM {BOOKS}")}
    WHERE o_totalprice > overall * 0.75 OR abs(o_totalprice - m) > overall""",
)
def analytical(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice") * F.when(F.col("o_orderkey") % 499 == 0, 3000.0).otherwise(1.0))
    return A.analytical(df, df.filter("o_orderdate < timestamp_ntz'1996-01-01'"), "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "fa2_internal_control",
    f"""SELECT 'two_way_match' AS technique, 'high' AS risk_level, CAST(invoice AS VARCHAR) AS subject, amount FROM {INVOICES} WHERE po IS NULL OR po NOT IN (SELECT po FROM {ORDERS})
    UNION ALL SELECT 'three_way_match', 'medium', CAST(invoice AS VARCHAR), amount FROM {INVOICES} WHERE po IN (SELECT po FROM {ORDERS}) AND po NOT IN (SELECT po FROM {RECEIPTS})
    UNION ALL SELECT 'segregation_of_duties', 'high', CAST(invoice AS VARCHAR), amount FROM {INVOICES} WHERE entered = approved
    UNION ALL SELECT 'approval_limit', 'high', CAST(invoice AS VARCHAR), amount FROM {INVOICES} WHERE amount > 50000""",
)
def internal_control(spark: SparkSession, sf: str) -> DataFrame:
    inv = invoices(spark, sf)
    subject, amount = F.col("invoice"), F.col("amount")
    parts = [
        A.finding(A.two_way_match(inv, orders(spark, sf), "po"), "two_way_match", "high", subject, amount),
        A.finding(A.three_way_match(inv, orders(spark, sf), receipts(spark, sf), "po"), "three_way_match", "medium", subject, amount),
        A.finding(inv.filter("entered = approved"), "segregation_of_duties", "high", subject, amount),
        A.finding(inv.filter("amount > 50000"), "approval_limit", "high", subject, amount),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FRAUD = f"""SELECT 'duplicate_payment' AS technique, 'high' AS risk_level, CAST(invoice AS VARCHAR) AS subject, amount FROM (SELECT *, row_number() OVER (PARTITION BY amount, po ORDER BY invoice) AS k FROM {INVOICES}) WHERE k > 1
    UNION ALL SELECT 'round_dollar', 'low', CAST(invoice AS VARCHAR), amount FROM {INVOICES} WHERE amount > 0 AND amount % 1000 = 0
    UNION ALL SELECT 'benford', 'medium', CAST(digit AS VARCHAR), CAST(n AS DOUBLE) FROM (SELECT *, avg(abs(p - e)) OVER () AS mad FROM (SELECT *, n / sum(n) OVER () AS p, log10(1 + 1 / digit) AS e FROM {BENFORD})) WHERE mad > 0.015"""


@query("fa3_fraud", FRAUD)
def fraud(spark: SparkSession, sf: str) -> DataFrame:
    inv = invoices(spark, sf)
    a = A.finding(A.duplicate_payments(inv, ["amount", "po"], "invoice"), "duplicate_payment", "high", F.col("invoice"), F.col("amount"))
    b = A.finding(inv.filter("amount > 0 AND amount % 1000 = 0"), "round_dollar", "low", F.col("invoice"), F.col("amount"))
    c = A.finding(A.benford(inv, "amount").filter("flagged"), "benford", "medium", F.col("digit"), F.col("n"))
    return a.unionByName(b).unionByName(c)


@query("fa4_full_audit")
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = internal_control(spark, sf).unionByName(fraud(spark, sf)).unionByName(A.finding(analytical(spark, sf), "analytical", "medium", F.col("o_orderkey"), F.col("o_totalprice")))
    return found.withColumn("finding_id", F.sha2(F.to_json(F.struct("technique", "subject", "amount")), 256))


@query("fa9_population_forensics")
def forensics(spark: SparkSession, sf: str) -> DataFrame:
    return A.population(t(spark, sf, "lineitem"), "l_quantity").withColumn("metric", F.round("metric", 6))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("tenant"), "o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("payload"))
    return A.append(df, "tenant", ["o_orderkey"], "payload")


@query("fa5_ledger_append")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf)


@query("wf8_chain_verify", "SELECT tenant, seq, CASE seq % 200 WHEN 5 THEN 'record_hash' WHEN 6 THEN 'prev_hash' ELSE 'gap' END AS problem FROM (SELECT o_orderpriority AS tenant, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS seq FROM orders) WHERE seq % 200 IN (5, 6, 101)")
def chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Of each tenant's records some are forged, and some are gone."""
    bent = ledger(spark, sf).withColumn("payload", F.when(F.col("seq") % 200 == 5, F.lit("forged")).otherwise(F.col("payload")))
    return A.verify_chain(bent.filter("seq % 200 <> 100"))


@query("fa6_merkle_root")
def merkle(spark: SparkSession, sf: str) -> DataFrame:
    return A.merkle_root(ledger(spark, sf).withColumn("i", F.col("seq") - 1), "tenant", "i", "record_hash")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """(tenant, i, record_hash) of the ledger, kept in all tasks alike: what proofs need of it."""
    rows = ledger(spark, sf).select("tenant", (F.col("seq") - 1).alias("i"), "record_hash")
    return cut(A.spread(rows, "tenant", F.shiftright("i", 10)))


@query("fa7_inclusion_proof")
def proof(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf)
    wanted = rows.filter("i % 500 = 0").select(F.col("tenant").alias("key"), F.col("i").alias("leaf"))
    return A.inclusion_proof(rows, "tenant", "i", "record_hash", wanted)


@query("fa7_proof_verify", "SELECT o_orderpriority AS key, i AS leaf, i % 100 <> 50 AS valid FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 50 = 0")
def proof_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of every fiftieth record, every second one with a forged sibling."""
    rows = _records(spark, sf)
    leaves = rows.filter("i % 50 = 0").select(F.col("tenant").alias("key"), F.col("i").alias("leaf"), F.col("record_hash").alias("value"))
    proofs = A.inclusion_proof(rows, "tenant", "i", "record_hash", leaves)
    bent = proofs.withColumn("sibling", F.when((F.col("leaf") % 100 == 50) & (F.col("level") == 1), F.sha2(F.lit("forged"), 256)).otherwise(F.col("sibling")))
    return A.verify_proofs(bent, leaves, A.merkle_root(rows, "tenant", "i", "record_hash"))


@query("fa8_subject_history", "SELECT o_custkey AS subject, o_orderkey AS record, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earliest FROM orders")
def history(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("record"), F.row_number().over(w).cast("long").alias("k"), F.first("o_orderkey").over(w).alias("earliest"))


@query(
    "fa10_bulk_verify",
    "SELECT k AS artifact, CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'P' THEN 'unsigned' WHEN o_orderkey % 11 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM (SELECT l_orderkey + l_linenumber % 2 AS k FROM lineitem GROUP BY 1) LEFT JOIN orders ON k = o_orderkey",
)
def bulk_verify(spark: SparkSession, sf: str) -> DataFrame:
    asked = t(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("artifact")).distinct()
    body = F.to_json(F.struct("o_custkey", "o_orderkey"))
    stored = t(spark, sf, "orders").select(F.col("o_orderkey").alias("artifact"), body.alias("body"), F.when(F.col("o_orderstatus") != "P", F.sha2(F.when(F.col("o_orderkey") % 11 == 0, F.lit("tampered")).otherwise(body), 256)).alias("stored_hash"))
    status = F.when(F.col("body").isNull(), "not_found").when(F.col("stored_hash").isNull(), "unsigned").when(F.sha2("body", 256) != F.col("stored_hash"), "hash_mismatch").otherwise("ok")
    return asked.join(stored, "artifact", "left").select("artifact", status.alias("status"))
