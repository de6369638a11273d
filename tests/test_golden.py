"""Published validation figures, typed in as fixed values."""

import pytest
from pyspark.sql import functions as F

from tablelab.operators import profile, rules

# Class, TP, FP, FN, TN, precision, recall, specificity, accuracy, F1, balanced accuracy, MCC, Brier, base rate.
PUBLISHED = [
    ("Water Soluble", 7, 0, 13, 39, 1.0, 0.35, 1.0, 0.7796610169491526, 0.5185185185185185, 0.675, 0.5123475382979799, 0.22033898305084745, 0.22407354208560756),
    ("Aquatic Bioavailable", 5, 2, 9, 44, 0.7142857142857143, 0.35714285714285715, 0.9565217391304348, 0.8166666666666667, 0.4761904761904762, 0.656832298136646, 0.4132582011624763, 0.18333333333333332, 0.1788888888888889),
    ("Bioconcentration Risk", 0, 1, 2, 33, 0.0, 0.0, 0.9705882352941176, 0.9166666666666666, None, 0.4852941176470588, -0.040996003084539386, 0.08333333333333333, 0.05246913580246914),
    ("Persistence", 0, 0, 6, 54, None, 0.0, 1.0, 0.9, None, 0.5, None, 0.1, 0.09),
    ("Soil Mobility", 11, 0, 12, 33, 1.0, 0.4782608695652174, 1.0, 0.7857142857142857, 0.6470588235294118, 0.7391304347826086, 0.5922200922639821, 0.21428571428571427, 0.24202806122448983),
]
FIGURES = ("precision", "recall", "specificity", "accuracy", "f1", "balanced_accuracy", "mcc")


def scored(spark):
    rows = []
    for name, tp, fp, fn, tn, *_ in PUBLISHED:
        rows += [(name, 1, 1)] * tp + [(name, 1, 0)] * fp + [(name, 0, 1)] * fn + [(name, 0, 0)] * tn
    return spark.createDataFrame(rows, "class string, p int, t int")


def as_rules():
    return [rules.Rule(r[0], F.col("p"), F.col("t") == 1, F.col("class") == r[0]) for r in PUBLISHED]


def test_rule_figures(spark):
    got = {r["class"]: r for r in rules.rule_metrics(scored(spark), as_rules()).collect()}
    for row in PUBLISHED:
        for name, want in zip(FIGURES, row[5:12]):
            value = got[row[0]][name]
            assert value == (None if want is None else pytest.approx(want, abs=1e-12)), (row[0], name)


def test_rule_brier(spark):
    got = {r["class"]: r for r in rules.rule_brier(scored(spark), as_rules()).collect()}
    for row in PUBLISHED:
        assert got[row[0]]["brier_rule"] == pytest.approx(row[12], abs=1e-12)
        assert got[row[0]]["brier_base_rate"] == pytest.approx(row[13], abs=1e-12)


def test_property_rules_on_a_wide_row(spark):
    names = ["WaterSolubility_mgL__value", "LogKow__value", "BCF_Lkg__value", "Koc_Lkg__value", "DT50_soil_d__value", "DT50_soil_d__typical_value"]
    flags = ["cls_WaterSoluble", "cls_AquaticBioavail", "cls_BioconcRisk", "cls_Persistence", "cls_SoilMobility"]
    rows = [(1000.0, 0.95, 2000.0, 500.0, None, 61.0, "measured", 1, 1, 1, 0, 0), (None, 3.05, 5000.0, None, 60.0, 99.0, "estimated", 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, ", ".join([f"{n} double" for n in names] + ["BCF_Lkg__meas_or_est string"] + [f"{f} int" for f in flags]))
    got = {r["class"]: (r["n"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in rules.rule_metrics(df, rules.property_rules()).collect()}
    assert got == {
        "Water Soluble": (1, 1, 0, 0, 0),
        "Aquatic Bioavailable": (2, 1, 1, 0, 0),
        "Bioconcentration Risk": (1, 1, 0, 0, 0),
        "Persistence": (2, 0, 1, 1, 0),
        "Soil Mobility": (1, 0, 0, 0, 1),
    }


def test_measurement_pairs(spark):
    # Compound, laboratory value, typical value, difference, whether the note is set.
    rows = [("cadusafos", 56.7, 38.0, 18.7, False), ("phosphamidon", 9.0, 9.2, -0.2, False), ("EPN", None, 15.0, None, True), ("dialifos", None, None, None, False)]
    df = spark.createDataFrame([r[:3] for r in rows], "compound string, lab double, typical double")
    got = {r["compound"]: r for r in profile.value_pairs(df, "compound", "lab", "typical").collect()}
    for name, _, _, diff, noted in rows:
        assert got[name]["diff"] == diff and (got[name]["note"] is not None) == noted
