"""Financial-control tests and the tamper-evident ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeguard.functions.numbers import first_digit, money
from lakeguard.functions.storage import cut

#: Least materiality, the one without amounts, its share of the total, and performance materiality's share.  Fixed values.
FLOOR, DEFAULT, SHARE, PERFORMANCE = 10_000, 50_000, "0.01", "0.75"
#: Benford: rows needed, and the mean absolute deviation that is reported.  Fixed values.
BENFORD_ROWS, BENFORD_MAD = 50, 0.015


def materiality(ledger: DataFrame, amount: str) -> DataFrame:
    """One row: total, overall and performance materiality, as exact decimals."""
    total = F.sum(F.abs(money(F.col(amount))))
    overall = F.when(total > 0, F.greatest(F.lit(FLOOR).cast("decimal(38,6)"), (total * F.lit(SHARE).cast("decimal(3,2)")).cast("decimal(38,6)"))).otherwise(F.lit(DEFAULT).cast("decimal(38,6)"))
    return ledger.agg(total.alias("total"), overall.alias("overall")).withColumn("performance", (F.col("overall") * F.lit(PERFORMANCE).cast("decimal(3,2)")).cast("decimal(38,6)"))


def benford(df: DataFrame, amount: str) -> DataFrame:
    """A row for each digit 1 to 9: n, observed and expected share, and the column's mean absolute deviation."""
    spark = df.sparkSession
    digits = df.select(first_digit(F.col(amount)).alias("digit")).filter("digit IS NOT NULL").groupBy("digit").agg(F.count("*").alias("n"))
    all_digits = spark.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    joined = all_digits.join(digits, "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy()  # nine rows
    shares = joined.withColumn("observed", F.col("n") / F.sum("n").over(whole)).withColumn("expected", F.log10(1 + 1 / F.col("digit")))
    return shares.withColumn("mad", F.avg(F.abs(F.col("observed") - F.col("expected"))).over(whole)).withColumn("flagged", (F.sum("n").over(whole) >= BENFORD_ROWS) & (F.col("mad") > BENFORD_MAD))


def finding(df: DataFrame, technique: str, risk: str | Column, subject: Column, amount: Column) -> DataFrame:
    level = F.lit(risk) if isinstance(risk, str) else risk
    return df.select(F.lit(technique).alias("technique"), level.alias("risk_level"), subject.cast("string").alias("subject"), amount.cast("double").alias("amount"))


def two_way_match(invoices: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Invoices without a purchase order; a null number matches a null one."""
    known = orders.select(F.col(key).alias("_k")).distinct()
    return invoices.join(known, F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def three_way_match(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Invoices that have a purchase order and no receipt."""
    ordered = orders.select(F.col(key).alias("_k")).distinct()
    received = receipts.select(F.col(key).alias("_r")).distinct()
    return invoices.join(ordered, F.col(key).eqNullSafe(F.col("_k")), "left_semi").join(received, F.col(key).eqNullSafe(F.col("_r")), "left_anti")


def analytical(ledger: DataFrame, history: DataFrame, key: str, account: str, amount: str) -> DataFrame:
    """Entries above performance materiality, else those that are further from their account's mean than materiality."""
    means = history.groupBy(account).agg(F.avg(amount).alias("_mean"))
    limits = materiality(ledger, amount)
    joined = ledger.join(means, account, "left").join(F.broadcast(limits))
    large = F.abs(F.col(amount)) > F.col("performance").cast("double")
    far = F.abs(F.col(amount) - F.col("_mean")) > F.col("overall").cast("double")
    reason = F.when(large, "above_performance").when(far, "unexpected")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, account, amount, "reason")


def duplicate_payments(ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later rows with the same keys, in an order; nulls are alike."""
    return ledger.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).filter("occurrence > 1")


def population(df: DataFrame, value: str) -> DataFrame:
    """Findings on one numeric column: Benford, duplicates, outliers beyond three sigmas, round numbers."""
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("k"))
    repeated = counts.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("dup"), F.count_if(F.col("k") > 1).alias("values"), F.sum(F.when((F.col("v") != 0) & (F.col("v") % 100 == 0), F.col("k")).otherwise(0)).alias("round"))
    stats = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    outliers = df.join(F.broadcast(stats)).agg(F.count_if(F.abs(v - F.col("m")) > 3 * F.col("s")).alias("out"))
    mad = benford(df, value).agg(F.max("mad").alias("mad"), F.sum("n").alias("bn"))
    one = repeated.join(F.broadcast(outliers)).join(F.broadcast(mad))
    rows = F.array(
        F.struct(F.lit("benford").alias("technique"), F.when(F.col("mad") > 0.015, "high").when(F.col("mad") > 0.012, "medium").alias("risk_level"), F.col("mad").alias("metric")),
        F.struct(F.lit("duplicates").alias("technique"), F.when((F.col("dup") > 0.4 * F.col("n")) & (F.col("values") >= 3), "medium").alias("risk_level"), (F.col("dup") / F.col("n")).alias("metric")),
        F.struct(F.lit("outliers").alias("technique"), F.when((F.col("n") >= 8) & (F.col("out") > 0), "medium").alias("risk_level"), F.col("out").cast("double").alias("metric")),
        F.struct(F.lit("round_numbers").alias("technique"), F.when((F.col("round") > 0.25 * F.col("n")) & (F.col("round") >= 5), "low").alias("risk_level"), (F.col("round") / F.col("n")).alias("metric")),
    )
    return one.select(F.explode(rows).alias("f")).select("f.*").filter("risk_level IS NOT NULL")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that proves the exact population: count and sums of slices of the rows' hashes, whatever the order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    sums = [F.sum(F.conv(F.substring(F.col("h"), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), *sums).select("n", F.sha2(F.concat_ws("-", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


# ------------------------------------------------------------ ledger
def record_hash(payload: str, prev: str, seq: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(seq).cast("string"), F.col(prev), F.col(payload)), 256)


GENESIS = "0" * 64


def append(records: DataFrame, tenant: str, order: list[str], payload: str) -> DataFrame:
    """Chains each tenant's records: seq, prev_hash, record_hash.

    A chain is sequential within a tenant: its records come to one task in their
    order, in batches, so memory does not grow with the tenant.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.select(F.col(tenant).cast("string").alias("tenant"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(payload).alias("payload"))
    ordered = ordered.repartition(n, "tenant").sortWithinPartitions("tenant", *[f"_o{i}" for i in range(len(order))]).select("tenant", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, seq, prev = None, 0, GENESIS
        for b in batches:
            out = []
            for who, what in zip(b["tenant"], b["payload"], strict=True):
                if who != tenant:
                    tenant, seq, prev = who, 0, GENESIS
                seq += 1
                digest = hashlib.sha256(f"{seq}|{prev}|{what}".encode()).hexdigest()
                out.append((who, seq, what, prev, digest))
                prev = digest
            yield pd.DataFrame(out, columns=["tenant", "seq", "payload", "prev_hash", "record_hash"])

    return ordered.mapInPandas(run, "tenant string, seq long, payload string, prev_hash string, record_hash string")


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Broken records: one whose predecessor is missing or there twice, a hash that is not the record's, or a previous hash that is not the predecessor's recomputed one."""
    made = ledger.withColumn("_own", record_hash("payload", "prev_hash", "seq"))
    # met by tenant and number, so that a tenant's chain spreads over all tasks
    before = made.groupBy("tenant", (F.col("seq") + 1).alias("seq")).agg(F.max("_own").alias("_before"), F.count("*").alias("_k"))
    checked = made.join(before, ["tenant", "seq"], "left")
    problem = F.when((F.col("seq") != 1) & (F.coalesce("_k", F.lit(0)) != 1), "gap").when(F.col("record_hash") != F.col("_own"), "record_hash").when(F.col("prev_hash") != F.coalesce("_before", F.lit(GENESIS)), "prev_hash")
    return checked.withColumn("problem", problem).filter("problem IS NOT NULL").select("tenant", "seq", "problem")


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """The same rows dealt over all tasks, such as those of chains, each of which is in one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by)


def merkle_levels(leaves: DataFrame, key: str, index: str, value: str) -> list[DataFrame]:
    """Levels (key, idx, h) from the leaves' hashes up to one root for each key; an odd last node moves up as it is.

    Each is half as large as the one below; the leaves and every fourth level are
    kept, so that no branch computes the chain again.
    """
    level = leaves.select(F.col(key).alias("key"), F.col(index).cast("long").alias("idx"), F.sha2(F.concat(F.unhex(F.lit("00")), F.col(value).cast("binary")), 256).alias("h"))
    # a chain leaves all rows of a key in one task: neighbours are dealt in runs, which keep most pairs of the lower levels together
    level = cut(spread(level, "key", F.shiftright("idx", 10)))
    out = [level]
    n = level.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        up = level.groupBy("key", F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("h"))).alias("r"))
        level = up.select("key", "idx", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)).alias("h"))
        if len(out) % 4 == 0:
            level = cut(level)
        out.append(level)
        n = (n + 1) // 2
    return out


def merkle_root(leaves: DataFrame, key: str, index: str, value: str) -> DataFrame:
    return merkle_levels(leaves, key, index, value)[-1].select("key", F.col("h").alias("root"))


def inclusion_proof(leaves: DataFrame, key: str, index: str, value: str, wanted: DataFrame) -> DataFrame:
    """(key, leaf, level, side, sibling) for ``wanted(key, leaf)``: the hashes that lead from a leaf to the root."""
    levels = merkle_levels(leaves, key, index, value)
    asked = wanted.select("key", F.col("leaf").cast("long").alias("leaf"))
    out = None
    for i, (here, _) in enumerate(pairwise(levels)):
        at = asked.withColumn("_at", F.expr(f"shiftright(leaf, {i})").bitwiseXOR(F.lit(1).cast("long")))
        part = at.join(here.select("key", F.col("idx").alias("_at"), "h"), ["key", "_at"]).select("key", "leaf", F.lit(i).alias("level"), F.when(F.col("_at") % 2 == 0, "left").otherwise("right").alias("side"), F.col("h").alias("sibling"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else asked.select("key", "leaf", F.lit(0).alias("level"), F.lit("").alias("side"), F.lit("").alias("sibling")).limit(0)


def verify_proofs(proofs: DataFrame, leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, leaf, valid) of ``leaves(key, leaf, value)``: whether the proof's hashes lead from the leaf to the root of ``roots(key, root)``.

    A leaf without a proof is valid only as the root itself; a key without a root has none.
    """
    # a step for each level of the tree
    steps = proofs.groupBy("key", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "side", "sibling"))).alias("steps"))
    both = leaves.join(steps, ["key", "leaf"], "left").join(roots, "key", "left")
    start = F.sha2(F.concat(F.unhex(F.lit("00")), F.col("value").cast("binary")), 256)
    none = F.array().cast("array<struct<level:int,side:string,sibling:string>>")

    def up(h: Column, step: Column) -> Column:
        left, right = F.when(step["side"] == "left", step["sibling"]).otherwise(h), F.when(step["side"] == "left", h).otherwise(step["sibling"])
        return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)

    return both.select("key", "leaf", F.coalesce(F.aggregate(F.coalesce("steps", none), start, up) == F.col("root"), F.lit(False)).alias("valid"))
