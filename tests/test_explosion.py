"""Explosions over small made-up bills: the single level is made once, whatever lies below."""

import pytest
from pyspark.sql import functions as F

from bomloom.operators import explosion


def on():
    return F.lit("2024-05-01").cast("date")


def sap(spark, makes):
    """a, made in plants W1 and W2, of b, and b of c in W1 (in force) and W2 (not); c of d."""
    bills = [("a", "W1", "1"), ("a", "W2", "2"), ("b", "W1", "3"), ("b", "W2", "4"), ("c", "W1", "5")]
    mast = spark.createDataFrame([(m, w, "2", n, "01") for m, w, n in bills], "matnr string, werks string, stlan string, stlnr string, stlal string")
    stko = spark.createDataFrame([("M", n, "01", "2020-01-01", "X" if n == "4" else None) for _, _, n in bills], "stlty string, stlnr string, stlal string, datuv string, lkenz string").withColumn("datuv", F.col("datuv").cast("date"))
    of = {"1": "b", "2": "b", "3": "c", "4": "c", "5": "d"}
    stas = spark.createDataFrame([("M", n, a, "1", d, x) for n in of for a, d, x in (("01", "2020-01-01", None), ("02", "2021-01-01", "X"))], "stlty string, stlnr string, stlal string, stlkn string, datuv string, lkenz string").withColumn("datuv", F.col("datuv").cast("date"))
    stpo = spark.createDataFrame([("M", n, "1", 1, "L", c, None, 2.0, "EA") for n, c in of.items()], "stlty string, stlnr string, stlkn string, posnr int, postp string, idnrk string, rekrs string, menge double, meins string")
    mara = spark.createDataFrame([(m, "T", "G", "01" if m == "a" else None) for m in "abcd"], "matnr string, mtart string, matkl string, zzut string")
    makt = spark.createDataFrame([(m, "EN", m.upper()) for m in "abcd"], "matnr string, spras string, maktx string")
    single = explosion.sap_single_level(mast, stko, stas, stpo, mara, makt, on())
    # Of a's two bills of W1 in the collector, both are products.
    collector = explosion.sap_collector(mara, mast.unionAll(mast.where("matnr = 'a' AND werks = 'W1'").withColumn("stlal", F.lit("02"))), makt)
    return explosion.sap_explosion(single.withColumn("mast_maktx", makes("mast_maktx")), collector)


def d365(spark, makes):
    versions = spark.createDataFrame([(f"B{m}", m, True, True, "us") for m in "abc"], "bom_id string, item_id string, is_active boolean, is_approved boolean, data_area_id string").withColumns({"valid_from_date": F.lit("2020-01-01").cast("date"), "valid_to_date": F.lit(None).cast("date")})
    lines = spark.createDataFrame([(f"B{m}", c, 1, "p", 3.0, 1.0, "EA", 0, "us") for m, c in ("ab", "bc", "cd", "ca")], "bom_id string, item_id string, line_num int, position string, bom_qty double, bom_qty_serie double, unit_id string, bom_type int, data_area_id string").withColumns({"valid_from_date": F.lit(None).cast("date"), "valid_to_date": F.lit(None).cast("date")})
    items = spark.createDataFrame([(m, m.upper(), "T", "G", "us") for m in "abcd"], "item_id string, item_name string, item_type string, item_group_id string, data_area_id string")
    single = explosion.d365_single_level(versions, lines, items, on())
    return explosion.d365_explosion(single.withColumn("parent_item_name", makes("parent_item_name")), explosion.d365_collector(items, versions, on()))


@pytest.mark.parametrize(("explode", "rows"), [(sap, 4), (d365, 4)])
def test_single_level_is_made_once(spark, explode, rows):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    explode(spark, F.udf(count)).collect()
    assert made.value == rows


def test_sap_levels_stay_in_their_plant(spark):
    got = [tuple(r) for r in sap(spark, F.col).select("matnr_collector_werks", "nodelevel", "mast_matnr", "stpo_idnrk", "idnrk_stlnr", "is_assembly", "is_active_assembly").collect()]
    w1 = [("W1", 1, "a", "b", "3", True, True), ("W1", 2, "b", "c", "5", True, True), ("W1", 3, "c", "d", "00000000", False, False)]
    assert sorted(got) == sorted([*w1, *w1, ("W2", 1, "a", "b", "4", True, False)])


def test_d365_paths_end_at_cycles(spark):
    got = {r.hierarchy_path: r.extended_qty for r in d365(spark, F.col).collect()}
    assert got == {"a > b": 3.0, "a > b > c": 9.0, "a > b > c > d": 27.0, "b > c": 3.0, "b > c > d": 9.0, "b > c > a": 9.0, "c > d": 3.0, "c > a": 3.0, "c > a > b": 9.0}
