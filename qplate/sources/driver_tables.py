"""Map the driver's generated tables onto the plate data model.

``events`` is the measurement table: ``event_id`` is unique and ordered, so it
serves as the arrival ordinal of a well.  The mapping (identical to the SQL
view used by the DuckDB oracle):

* plate ``plate_<event_id div 384>``, position row-major inside a 16 x 24 plate
* replicate ``<user_id>.<event_id mod 4>``, sample ``<user_id>``
* zscoring group ``<user_id mod 5>``, testing group control/treated by ``(user_id div 5) mod 2``
* gene = ``event_type``; Cp = 20 + value/20, blank (NULL) when value < 1
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qplate.functions.wells import hk_type

# Fixed values of the mapping (shared with the oracle SQL).
WELLS_PER_PLATE = 384
PLATE_COLUMNS = 24
REPLICATES_PER_SAMPLE = 4
ZSCORING_GROUPS = 5
EVENT_HK_GENES = ("view",)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_wells_from_events(events: DataFrame) -> DataFrame:
    """Unannotated wells: (file_name, Pos, well_ord, Cp) - what a plate export holds."""
    e = F.col("event_id")
    slot = F.pmod(e, F.lit(WELLS_PER_PLATE))
    return events.select(
        F.concat(F.lit("plate_"), F.expr(f"event_id div {WELLS_PER_PLATE}").cast("string")).alias("file_name"),
        F.concat(F.char(F.lit(65) + F.floor(slot / PLATE_COLUMNS)),
                 (F.pmod(slot, F.lit(PLATE_COLUMNS)) + 1).cast("string")).alias("Pos"),
        e.alias("well_ord"),
        F.when(F.col("value") < 1, F.lit(None).cast("double")).otherwise(F.lit(20.0) + F.col("value") / 20).alias("Cp"),
    )


def wells_from_events(events: DataFrame, hk_genes: Iterable[str] = EVENT_HK_GENES) -> DataFrame:
    """Annotated wells (layout and metadata already attached)."""
    e, u = F.col("event_id"), F.col("user_id")
    slot = F.pmod(e, F.lit(WELLS_PER_PLATE))
    return events.select(
        F.concat(F.lit("plate_"), F.expr(f"event_id div {WELLS_PER_PLATE}").cast("string")).alias("file_name"),
        F.concat(F.char(F.lit(65) + F.floor(slot / PLATE_COLUMNS)),
                 (F.pmod(slot, F.lit(PLATE_COLUMNS)) + 1).cast("string")).alias("Pos"),
        e.alias("well_ord"),
        F.concat(u.cast("string"), F.lit("."), F.pmod(e, F.lit(REPLICATES_PER_SAMPLE)).cast("string")).alias("replicate_name"),
        u.cast("string").alias("sample_name"),
        F.pmod(u, F.lit(ZSCORING_GROUPS)).cast("string").alias("zscoring_group"),
        F.when(F.pmod(F.floor(u / 5), F.lit(2)) == 0, F.lit("control")).otherwise(F.lit("treated")).alias("testing_group"),
        F.col("event_type").alias("Gene"),
        hk_type(F.col("event_type"), hk_genes).alias("type_of_gene"),
        F.when(F.col("value") < 1, F.lit(None).cast("double")).otherwise(F.lit(20.0) + F.col("value") / 20).alias("Cp"),
    )


# ---- layout sheets and metadata derived from the dimension tables -------------------------------
# Fixed sheet texts (exercise ranges, descending ranges, trailing commas, empty and bad tokens).
GENE_ROWS = ("A,B,C,D,E,F,G,H", "I,J,K,L,M,N,O,P,", "A,,B,C,D,E,F,G,H,I,J,K,L,M,N,O,P", "P,O,N,M,L,K,J,I,H,G,F,E,D,C,B,A")
GENE_COLS = ("1-24", "24-1", "1-12,13,x,14-24", "1-6,7-12,", " 3,1-2,4-24")
REGION_ROWS, REGION_COLS, REGION_ORD_OFFSET = "A,B,C,D", "1-24", 100
SUPPLIER_PLATE_OFFSET, SUPPLIER_ORD_OFFSET = 24, 1000
LAYOUT_HK_GENES = ("NATION_1",)


def _pick(key: F.Column, options: tuple[str, ...]) -> F.Column:
    expr = F.lit(options[-1])
    for i in reversed(range(len(options) - 1)):
        expr = F.when(key == i, F.lit(options[i])).otherwise(expr)
    return expr


def gene_sheet(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """Gene layout: one block per nation on plate_<nationkey>, then overlapping region blocks (later sheet rows),
    then one block per supplier on the plates behind those of the nations, so that the sheet grows with the wells."""
    k = F.col("n_nationkey")
    n = nation.select(F.concat(F.lit("plate_"), k.cast("string")).alias("file_name"),
                      _pick(F.pmod(k, F.lit(4)), GENE_ROWS).alias("rows"),
                      _pick(F.pmod(k, F.lit(5)), GENE_COLS).alias("cols"),
                      F.col("n_name").alias("gene"), k.cast("long").alias("sheet_ord"))
    r = region.select(F.concat(F.lit("plate_"), F.col("r_regionkey").cast("string")).alias("file_name"),
                      F.lit(REGION_ROWS).alias("rows"), F.lit(REGION_COLS).alias("cols"),
                      F.col("r_name").alias("gene"),
                      (F.col("r_regionkey") + REGION_ORD_OFFSET).cast("long").alias("sheet_ord"))
    s = F.col("s_suppkey")
    p = supplier.select(F.concat(F.lit("plate_"), (s + SUPPLIER_PLATE_OFFSET).cast("string")).alias("file_name"),
                        _pick(F.pmod(s, F.lit(4)), GENE_ROWS).alias("rows"),
                        _pick(F.pmod(s, F.lit(5)), GENE_COLS).alias("cols"),
                        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("gene"),
                        (s + SUPPLIER_ORD_OFFSET).cast("long").alias("sheet_ord"))
    return n.unionByName(r).unionByName(p)


def sample_sheet(customer: DataFrame) -> DataFrame:
    """Sample layout: customer c fills row (c mod 16) of plate_(c div 16); BUILDING customers get an
    unlisted replicate suffix (their wells have no metadata)."""
    c = F.col("c_custkey")
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("x")).otherwise(F.pmod(F.col("c_nationkey"), F.lit(3)).cast("string"))
    return customer.select(F.concat(F.lit("plate_"), F.floor(c / 16).cast("string")).alias("file_name"),
                           F.char(F.lit(65) + F.pmod(c, F.lit(16))).alias("rows"), F.lit("1-24").alias("cols"),
                           F.concat(F.lit("C"), c.cast("string"), F.lit("."), suffix).alias("sample"),
                           c.cast("long").alias("sheet_ord"))


def metadata_table(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Replicate metadata from customers, plus supplier rows that repeat some keys (fan-out)."""
    cust = customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("."),
                 F.pmod(F.col("c_nationkey"), F.lit(3)).cast("string")).alias("replicate_name"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sample_name"),
        F.col("c_mktsegment").alias("zscoring_group"),
        F.when(F.col("c_acctbal") >= 5000, F.lit("high")).otherwise(F.lit("low")).alias("testing_group"))
    sup = supplier.select(
        F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.lit("."),
                 F.pmod(F.col("s_nationkey"), F.lit(3)).cast("string")).alias("replicate_name"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_name"),
        F.lit("SUPPLIER").alias("zscoring_group"), F.lit("low").alias("testing_group"))
    return cust.unionByName(sup)
