"""Sources, sinks, catalogs and made tables."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.functions.storage import cut

#: What the values of a headerless column look like, in the order of the tests.  Fixed values.
_LOOKS = (("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), ("phone", r"^\+?[\d\s().-]{7,}$"), ("date", r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}"))


def read_csv(spark: SparkSession, path: str, sample: int = 20) -> DataFrame:
    """CSV with inferred types; a file whose first line looks like data gets names from up to ``sample`` values."""
    head = spark.read.csv(path).limit(2).collect()
    if not head:
        return spark.read.csv(path)
    numeric = re.compile(r"^-?\d+(\.\d+)?$")
    first = [x or "" for x in head[0]]
    if not any(numeric.match(x) or "@" in x for x in first):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = spark.read.option("inferSchema", True).csv(path)
    rows = df.limit(sample).collect()
    names: list[str] = []
    for i in range(len(df.columns)):
        values = [str(r[i]) for r in rows if r[i] is not None]
        name = next((n for n, p in _LOOKS if values and all(re.search(p, v) for v in values) and not all(numeric.match(v) for v in values)), None)
        if name is None:
            whole = values and all(re.match(r"^-?\d+$", v) for v in values)
            name = "id" if whole and "id" not in names else "id" if whole else "amount" if values and all(numeric.match(v) for v in values) else "first_name" if values and all(v[:1].isupper() and v.isalpha() for v in values) else "value"
        names.append(name if name not in names else f"{name}_{i}")
    return df.toDF(*names)


def read_file(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_file(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_table(df: DataFrame, name: str, if_exists: str = "replace") -> None:
    df.write.mode({"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]).saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str], column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> DataFrame:
    """A table or query over JDBC with its types, read in ranges of a column if there is one."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str], if_exists: str = "append") -> None:
    df.write.mode({"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]).format("jdbc").option("url", url).option("dbtable", table).options(**properties).save()


def read_external(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """Any format whose connector is on the class path."""
    return spark.read.format(fmt).options(**options).load()


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    raw = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")), "value")


def parse_messages(df: DataFrame, value: str) -> DataFrame:
    """Adds _json (objects as a map of strings), _value (other JSON) and _raw (what is no JSON)."""
    v = F.col(value)
    parsed = F.try_parse_json(v)
    is_object = v.rlike(r"^\s*\{") & parsed.isNotNull()
    return df.withColumns({"_json": F.when(is_object, F.from_json(v, "map<string,string>")), "_value": F.when(parsed.isNotNull() & ~is_object, v), "_raw": F.when(parsed.isNull(), v)})


def register(spark: SparkSession, files: Mapping[str, str], prefix: str = "") -> list[str]:
    """Each file as a temporary view; formats by the ends of their names."""
    names = []
    for name, path in files.items():
        fmt = path.rpartition(".")[2].lower()
        df = read_csv(spark, path) if fmt == "csv" else read_file(spark, path, fmt)
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """A batch in a partition of its own: it replaces itself if it comes again, readers see all of it or none."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """All batches by column name; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def schema_catalog(df: DataFrame, name: str, samples: int = 5) -> DataFrame:
    """A row for each column: table, name, type, nullable, ordinal and a few values."""
    few = df.limit(samples)
    parts = [F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.lit(i).alias("ordinal"), F.collect_list(F.col(f"`{f.name}`").cast("string")).alias("samples")) for i, f in enumerate(df.schema)]
    return few.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def normalize_netsuite(raw: DataFrame, tenant: str) -> DataFrame:
    """Ledger entries of NetSuite lines; a date that cannot be read is null and flagged."""
    key = F.sha2(F.concat_ws("-", F.lit(tenant), F.col("internalId").cast("string"), F.col("tranType")), 256)
    amount = (F.coalesce(F.col("debit").cast("decimal(18,2)"), F.lit(0)) - F.coalesce(F.col("credit").cast("decimal(18,2)"), F.lit(0))).cast("decimal(18,2)")
    posted = F.try_to_timestamp("tranDate")
    return raw.select(key.alias("erc"), F.lit("netsuite").alias("system_origin"), amount.alias("amount"), "currency", F.col("accountNumber").alias("account_code"), posted.alias("posted_at"), posted.isNull().alias("date_missing"), F.create_map(F.lit("memo"), F.col("memo"), F.lit("type"), F.col("tranType")).alias("metadata"))


def normalize_workday(raw: DataFrame, tenant: str) -> DataFrame:
    key = F.sha2(F.concat_ws("-", F.lit(tenant), F.col("WorkdayID").cast("string"), F.lit("workday")), 256)
    posted = F.try_to_timestamp("AccountingDate")
    return raw.select(key.alias("erc"), F.lit("workday").alias("system_origin"), F.col("BaseAmount").cast("decimal(18,2)").alias("amount"), F.col("CurrencyCode").alias("currency"), F.col("LedgerAccount").alias("account_code"), posted.alias("posted_at"), posted.isNull().alias("date_missing"), F.create_map(F.lit("cost_center"), F.col("CostCenterID").cast("string")).alias("metadata"))


def browse(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, type, ordinal) of tables in a catalog; a row for each column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, f.dataType.simpleString(), i) for name, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table string, column string, type string, ordinal int")


def query_batch(spark: SparkSession, frames: Mapping[str, DataFrame], statements: Mapping[str, str]) -> DataFrame:
    """Status and row count of each statement; one that fails does not stop the others."""
    out = []
    for name, sql in statements.items():
        try:
            used = {k: v for k, v in frames.items() if "{" + k + "}" in sql}
            out.append((name, "ok", spark.sql(sql, **used).count(), None))
        except Exception as e:  # the statement is the user's
            out.append((name, "failed", 0, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(out, "name string, status string, row_count long, error string")


#: Rows of a place, and of its neighbours, that are put together at once; and pairs to a task, about.
TILE_ROWS, TASK_PAIRS = 4_000, 10_000_000


def _near_spots(spots: DataFrame, km: float) -> DataFrame:
    """Pairs (lat, lon, lat2, lon2), both ways and with itself, of different places within a distance."""
    step = km / 111.0
    band = F.floor(F.col("lat") / step)
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(F.col("y")), F.abs(F.col("y") + 1)) + 1) * step)
    cells = F.greatest(F.lit(1), F.floor(360 / (step / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6)))).cast("int"))

    def cell(at: Column) -> Column:
        return F.floor(F.pmod(at + 180, F.lit(360.0)) / 360 * F.col("m"))

    left = spots.select("lat", "lon", F.explode(F.sequence(band - 1, band + 1)).alias("y")).withColumn("m", cells)
    left = left.withColumn("x", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(cell(F.col("lon")) + k, F.col("m")))))).drop("m")
    right = spots.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), band.alias("y")).withColumn("m", cells).withColumn("x", F.pmod(cell(F.col("lon2")), F.col("m"))).drop("m")
    h = F.pow(F.sin(F.radians(F.col("lat2") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("lat2")) * F.pow(F.sin(F.radians(F.col("lon2") - F.col("lon")) / 2), 2)
    distance = 2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return left.join(right, ["y", "x"]).filter(distance <= km).select("lat", "lon", "lat2", "lon2")


def radius_pairs(places: DataFrame, km: float) -> DataFrame:
    """Pairs (a < b) of ``places(id, lat, lon)`` within a distance: joined by cells and their neighbours, then measured.

    A band of latitude is as high as the distance.  Its cells are as wide as the
    distance at its edge and one band nearer the pole, and go round the earth; near
    the poles a band is one cell.

    Distances are measured between different places only.  Then the rows of a place
    meet those of each near one, in tiles of some TILE_ROWS a side, so that no task has
    all of a place with many rows.
    """
    known = places.filter("lat IS NOT NULL AND lon IS NOT NULL")
    spots = known.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    near = cut(_near_spots(spots, km).join(spots, ["lat", "lon"]))
    # rows that meet a place, and how many parts both sides are dealt into
    met = near.groupBy("lat2", "lon2").agg(F.sum("n").alias("_met"))
    tiles = met.join(spots.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("n").alias("_own")), ["lat2", "lon2"])
    # as many tasks as the pairs ask for: they are far more than the rows of which they are made
    pairs = tiles.agg(F.sum(F.col("_met").cast("double") * F.col("_own"))).first()[0] or 0.0
    parts = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    tiles = tiles.select("lat2", "lon2", *[F.ceil(F.col(c) / TILE_ROWS).cast("int").alias(k) for c, k in (("_met", "_i"), ("_own", "_j"))])

    def dealt(part: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(part)).cast("int")

    def each(part: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(part) - 1))

    asked = near.drop("n").join(tiles, ["lat2", "lon2"])
    left = known.join(asked, ["lat", "lon"]).select(F.col("id").alias("a"), "lat2", "lon2", dealt("_i").alias("i"), each("_j").alias("j"))
    right = known.select(F.col("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).join(tiles, ["lat2", "lon2"])
    right = right.select(F.col("id").alias("b"), "lat2", "lon2", dealt("_j").alias("j"), each("_i").alias("i"))
    keys = ["lat2", "lon2", "i", "j"]
    return left.repartition(parts, *keys).hint("merge").join(right.repartition(parts, *keys), keys).filter("a < b").select("a", "b")


def _uniform(seed: int, name: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(name)), 11) + 0.5) / float(1 << 53)


def synthesize(spark: SparkSession, rows: int, columns: Mapping[str, Mapping[str, Any]], seed: int = 0) -> DataFrame:
    """A table of typed columns, each from a hash of row, seed and name, so it does not depend on the partitions."""
    out = []
    for name, spec in columns.items():
        u, kind = _uniform(seed, name), spec["kind"]
        if kind == "sequence":
            c = F.col("id") + 1
        elif kind == "uniform":
            c = spec.get("low", 0.0) + u * (spec.get("high", 1.0) - spec.get("low", 0.0))
        elif kind in ("normal", "lognormal"):
            z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * _uniform(seed, name + "'"))
            c = spec["mean"] + spec["sd"] * z
            c = F.exp(c) if kind == "lognormal" else c
        elif kind == "bool":
            c = u < spec.get("p", 0.5)
        elif kind == "uuid":
            c = F.sha2(F.concat_ws("-", F.lit(seed), F.lit(name), "id"), 256).substr(1, 32)
        elif kind == "zipf":
            c = F.floor(F.pow(u, F.lit(-1 / (spec["a"] - 1)))).cast("long")
        else:  # category
            total, edge = sum(spec["values"].values()), 0.0
            c = F.lit(list(spec["values"])[-1])
            steps = []
            for v, w in spec["values"].items():
                edge += w / total
                steps.append((edge, v))
            for e, v in reversed(steps[:-1]):
                c = F.when(u < e, F.lit(v)).otherwise(c)
        rate = spec.get("null_rate", 0.0)
        out.append((F.when(_uniform(seed, name + "?") >= rate, c) if rate else c).alias(name))
    return spark.range(rows).select(*out)
