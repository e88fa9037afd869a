"""The driver's tables as labelled sets. Declared ranges are wide enough at every scale."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions.encode import rescale
from quorum.operators.durable import shared_folder
from quorum.schema import Dataset, DatasetMeta, nominal, real
from quorum.sources.tables import from_array_table, from_table

LINEITEM_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINEITEM_REALS = (
    real("l_quantity", 1, 50),
    real("l_extendedprice", 900, 105000),
    real("l_discount", 0, 0.1),
    real("l_tax", 0, 0.08),
)
LINEITEM_DISCRETE = (LINEITEM_REALS[0], *LINEITEM_REALS[2:])
RETURN_FLAGS = ("A", "N", "R")
LINE_STATUS = ("F", "O")
#: Declared days of shipping, from a rule; lines shipped later are undeclared.
SHIP_DAYS = tuple(str(date.fromordinal(n)) for n in range(date(1995, 1, 1).toordinal(), date(2000, 1, 1).toordinal()))
ORDER_STATUS = ("F", "O", "P")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT_SPECIFIED", "5-LOW")
LANGS = ("de", "en", "es", "fr")
LETTERS = "aeinorstuhldcmk"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EMBEDDING_SIZE = 64
ORDERS_FILES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark, sf_dir) -> Dataset:
    """Four reals; the class is the return flag."""
    df = table(spark, sf_dir, "lineitem")
    return from_table(
        df, LINEITEM_REALS, "l_returnflag", RETURN_FLAGS, LINEITEM_KEY, name="lineitem"
    )


def lineitem_flags(spark, sf_dir) -> Dataset:
    """Two nominal inputs of ``lineitem`` (flag and status) next to a real one."""
    df = table(spark, sf_dir, "lineitem")
    attributes = (
        LINEITEM_REALS[0],
        nominal("l_returnflag", RETURN_FLAGS),
        nominal("l_linenumber", [str(i) for i in range(1, 8)]),
    )
    values = {"l_linenumber": F.col("l_linenumber").cast("string")}
    return from_table(
        df, attributes, "l_linestatus", LINE_STATUS, LINEITEM_KEY, values, name="lineitem_flags"
    )


def lineitem_dominant(spark, sf_dir) -> Dataset:
    """Four reals; the class is which of rescaled quantity, discount and tax is largest."""
    df = table(spark, sf_dir, "lineitem")
    q, _, d, t = [rescale(F.col(a.name), a.range_min, a.range_max) for a in LINEITEM_REALS]
    label = F.when((q >= d) & (q >= t), 0).when(d >= t, 1).otherwise(2)
    return from_table(df, LINEITEM_REALS, label, (0, 1, 2), LINEITEM_KEY, name="lineitem_dominant")


def documents_lang(spark, sf_dir) -> Dataset:
    """Counts of fifteen letters over the whole text; the class is the language."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("t"))
    counts = {f"n_{c}": F.length("t") - F.length(F.replace("t", F.lit(c), F.lit(""))) for c in LETTERS}
    attributes = [real(name, 0, 100) for name in counts]
    return from_table(df, attributes, "lang", LANGS, ["doc_id"], counts, name="documents_lang")


def lineitem_discrete(spark, sf_dir) -> Dataset:
    """The three inputs of ``lineitem`` with few values; the class is which is largest. A tree
    over them can be worked out in SQL, since its candidate cuts are all pairs of neighbours."""
    df = table(spark, sf_dir, "lineitem")
    q, d, t = [rescale(F.col(a.name), a.range_min, a.range_max) for a in LINEITEM_DISCRETE]
    label = F.when((q >= d) & (q >= t), 0).when(d >= t, 1).otherwise(2)
    return from_table(df, LINEITEM_DISCRETE, label, (0, 1, 2), LINEITEM_KEY, name="lineitem_discrete")


def lineitem_overlap(spark, sf_dir) -> Dataset:
    """Quantity and discount, both of few values; the class is whether the rescaled price is
    at least the discount. The price hangs on the quantity but not on it alone, so that no
    linear score separates the classes and a logistic regression has an optimum."""
    df = table(spark, sf_dir, "lineitem")
    _, price, discount, _ = LINEITEM_REALS
    p, d = [rescale(F.col(a.name), a.range_min, a.range_max) for a in (price, discount)]
    label = F.when(p >= d, 1).otherwise(0)
    inputs = (LINEITEM_REALS[0], discount)
    return from_table(df, inputs, label, (0, 1), LINEITEM_KEY, name="lineitem_overlap")


def orders(spark, sf_dir) -> Dataset:
    """A real and a nominal input; the class is the order status."""
    df = table(spark, sf_dir, "orders")
    attributes = (real("o_totalprice", 1000, 500000), nominal("o_orderpriority", PRIORITIES))
    values = {"o_orderpriority": F.translate("o_orderpriority", " ", "_")}
    return from_table(
        df, attributes, "o_orderstatus", ORDER_STATUS, ["o_orderkey"], values, name="orders"
    )


def events(spark, sf_dir) -> Dataset:
    """A real input and a nominal one derived from the user; the class is the event type."""
    df = table(spark, sf_dir, "events")
    attributes = (real("value", 0, 500), nominal("user_bucket", [str(i) for i in range(50)]))
    values = {"user_bucket": (F.col("user_id") % 50).cast("string")}
    return from_table(
        df, attributes, "event_type", EVENT_TYPES, ["event_id"], values, name="events"
    )


def embeddings(spark, sf_dir) -> Dataset:
    """Sixty-four reals in one array column; ten classes."""
    df = table(spark, sf_dir, "embeddings")
    return from_array_table(
        df, "embedding", EMBEDDING_SIZE, -1.0, 1.0, "label", range(10), ["vec_id"], name="embeddings"
    )


def embeddings_wide(spark, sf_dir) -> Dataset:
    """Every vector and its mirror image: 128 reals."""
    df = table(spark, sf_dir, "embeddings")
    both = F.concat("embedding", F.transform("embedding", lambda x: -x))
    df = df.select("vec_id", "label", both.alias("both"))
    return from_array_table(
        df, "both", 2 * EMBEDDING_SIZE, -1.0, 1.0, "label", range(10), ["vec_id"], name="embeddings_wide"
    )


def orders_lines(spark, sf_dir) -> DataFrame:
    """``orders`` written as a header-declared text set: ``position``, ``row_id``, ``value``.

    The nominal lists of the header are the values the table holds.
    """
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.translate("o_orderpriority", " ", "_").alias("priority"),
        "o_orderstatus",
    )

    def domain(c: str):
        return F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_set(c)), ", "), F.lit("}"))

    declared = df.agg(domain("priority").alias("p"), domain("o_orderstatus").alias("s"))
    header = declared.select(
        F.posexplode(
            F.array(
                F.lit("@relation orders"),
                F.lit("@attribute o_totalprice real [1000, 500000]"),
                F.concat(F.lit("@attribute o_orderpriority "), "p"),
                F.concat(F.lit("@attribute o_orderstatus "), "s"),
                F.lit("@inputs o_totalprice, o_orderpriority"),
                F.lit("@outputs o_orderstatus"),
                F.lit("@data"),
            )
        ).alias("position", "value")
    ).select("position", F.lit(None).cast("long").alias("row_id"), "value")
    rows = df.select(
        F.lit(None).cast("int").alias("position"),
        F.col("o_orderkey").alias("row_id"),
        F.concat_ws(", ", "o_totalprice", "priority", "o_orderstatus").alias("value"),
    )
    return header.unionByName(rows)


def lineitem_lines(spark, sf_dir) -> DataFrame:
    """``lineitem`` as lines of few different values, ``value`` alone: most have many copies."""
    df = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("int").cast("string")
    return df.select(F.concat_ws(", ", quantity, "l_returnflag", "l_linestatus").alias("value"))


#: What these lines hold.
LINE_META = DatasetMeta((real("l_quantity", 0, 50), nominal("l_returnflag", RETURN_FLAGS)), LINE_STATUS)


def file_lines(lines: DataFrame) -> DataFrame:
    """``value`` of header lines by ``position``, then of rows by ``row_id``, for one file.

    A file is one task, but its lines are sorted by many: a global sort cuts them into ranges,
    and the one task that writes reads the sorted ranges one after another, so that no task
    holds more than a range."""
    return lines.orderBy(F.asc_nulls_last("position"), "row_id").coalesce(1).select("value")


def orders_files(spark, sf_dir) -> str:
    """``orders_lines`` written as ORDERS_FILES text files, each under the same header; their folder."""
    lines = orders_lines(spark, sf_dir)
    header = lines.filter(F.col("position").isNotNull())
    rows = lines.filter(F.col("position").isNull()).withColumn("part", (F.col("row_id") % ORDERS_FILES).cast("int"))
    path = shared_folder(spark, "orders")

    def write(part: int) -> None:
        own = header.unionByName(rows.filter(F.col("part") == part).drop("part"))
        file_lines(own).write.text(f"{path}/part={part}")

    # The files are written side by side, as the tasks of one write were.
    with ThreadPoolExecutor(ORDERS_FILES) as pool:
        list(pool.map(write, range(ORDERS_FILES)))
    # Rows without a key have no part: Spark's own name for it, and no header, as partitionBy wrote them.
    keyless = rows.filter(F.col("part").isNull())
    if not keyless.isEmpty():
        keyless.orderBy("row_id").coalesce(1).select("value").write.text(f"{path}/part=__HIVE_DEFAULT_PARTITION__")
    return path
