"""The four runs end to end on small frames."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablelab.operators import extract as ex
from tablelab import config
from tablelab.plans import analyse, benchmark, clean, label, profile
from tablelab.session import checkpointed, ensure_checkpoint_dir
from tablelab.streaming import apply as stream

CONFIG = {
    "column_handling": {"keep_columns": ["id", "smiles", "mw", "xlogp", "mw", "note"], "required_columns": ["smiles"], "smiles_column": "smiles"},
    "missing_value_handling": {"strategy": "drop_rows", "missing_threshold_columns": 0.9, "missing_threshold_rows": 0.5, "drop_rows_with_missing_required": True},
    "duplicate_handling": {"remove_duplicates": True, "duplicate_subset": ["smiles"], "keep_strategy": "last"},
    "text_cleaning": {"enabled": True, "lowercase_columns": ["note"]},
    "numeric_cleaning": {"enabled": True, "remove_negative_values_columns": ["mw"], "clip_outliers": True, "outlier_columns": ["xlogp"]},
    "chemical_validation": {"enabled": True, "remove_disconnected_structures": True},
    "data_type_enforcement": {"enabled": True, "integer_columns": ["id"], "float_columns": ["xlogp"], "string_columns": ["note"]},
    "feature_selection": {"enabled": True, "remove_constant_columns": True, "remove_highly_correlated": True},
    "filtering": {"enabled": True, "mw_range": [0, 500], "xlogp_range": [-10, 10]},
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, f"C{i // 2}", float(i * 10), float(i % 5), " Note ") for i in range(40)]
    rows += [(40, "A.B", 5.0, 1.0, "x"), (41, None, 5.0, 1.0, "y"), (42, "D", None, None, "-"), (43, "E", -1.0, 500.0, "z"), (44, "F", 900.0, 2.0, "w")]
    df = spark.createDataFrame(rows, "id long, smiles string, mw double, xlogp double, note string")
    return df.withColumn("extra", F.lit(1)).cache()


def test_clean_run_accounts_for_every_row(raw):
    result = clean.clean(raw, CONFIG, ["id"])
    report = {r["step"]: r for r in result.report().collect()}
    assert report["high_missing_rows"]["rows_before"] == 45 and report["high_missing_rows"]["removed"] == 1
    assert report["missing_required"]["removed"] == 1
    assert report["duplicates"]["removed"] == 20
    assert report["separator"]["removed"] == 1
    assert report["range_mw"]["removed"] == 1
    rows = result.df.collect()
    assert sum(r["removed"] for r in report.values()) == 45 - len(rows)
    assert {r["id"] for r in rows if r["id"] < 40} == set(range(1, 40, 2))  # the last copy
    assert all(r["note"] in ("note", "x", "y", "z", "w") for r in rows)
    kept = {r["id"]: r for r in rows}
    assert kept[43]["mw"] is None and kept[43]["xlogp"] is None
    assert "extra" not in result.df.columns


def test_clean_run_has_tables_of_what_it_met(raw):
    result = clean.clean(raw, CONFIG, ["id"])
    required = {r["column"]: r for r in result.tables["required_columns"].collect()}
    assert required["smiles"]["missing"] == 1 and required["smiles"]["with_value"] == 44
    dropped = result.tables["dropped_rows"].first()
    assert dropped["n_rows"] == 45 and dropped["dropped"] == 1
    nulled = {(r["step"], r["column"]): r["n"] for r in result.tables["nulled_values"].collect()}
    assert nulled == {("null_negatives", "mw"): 1, ("null_outliers", "xlogp"): 1}
    left = {r["column"]: r for r in result.column_statistics().collect()}
    assert set(left) == set(result.df.columns) and left["id"]["non_null"] == result.df.count()


def test_checkpointed_run_gives_the_same(raw):
    a = clean.clean(raw, CONFIG, ["id"], checkpoint=False).df.orderBy("id").collect()
    assert a == clean.clean(raw, CONFIG, ["id"], checkpoint=True).df.orderBy("id").collect()


def test_checkpoint_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == ensure_checkpoint_dir(spark)
    assert checkpointed(spark.range(3)).count() == 3


def test_checkpoint_folder_named_by_the_session():
    seen = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=seen.append, master="yarn")
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared"}, sparkContext=context)
    assert ensure_checkpoint_dir(session) == "/shared" and seen == ["/shared"]
    session.conf, context.getConf = {}, dict
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)


LABELS = {
    "feature_engineering": {"features": [{"name": "mw_half", "operation": "formula", "parameters": {"formula": "mw / 2"}}]},
    "domain_labeling": {"text_columns": ["note"], "domains": {"noted": {"keywords": ["note"]}, "off": {"enabled": False, "keywords": ["x"]}}},
    "domain_subsets": {
        "column_aliases": {"MW": ["mw"]},
        "subsets": [
            {"name": "light", "parent_domain": "noted", "logic": "and", "conditions": [{"column": "MW", "operator": "<", "value": 100}]},
            {"name": "big", "parent_domain": None, "logic": "or", "conditions": [{"column": "mw_half", "operator": ">=", "value": 150}]},
        ],
    },
}


def test_label_run(raw):
    result = label.derive_label_flag(raw, LABELS)
    assert result.label_names == ["noted"] and result.subset_names == ["light", "big"]
    reports = result.reports()
    got = {r["subset"]: (r["candidates"], r["members"]) for r in reports["subsets"].collect()}
    assert got == {"light": (40, 10), "big": (45, 11)}
    only = label.derive_label_flag(raw, LABELS, population=F.col("noted") == 1)
    assert only.df.count() == 40
    assert reports["label_coverage"].first()["unlabelled"] == 5


def test_fitted_run_keeps_the_rows_that_the_batch_keeps(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 50.0, "a"), (3, 5.0, "a.b"), (4, -1.0, "a"), (5, 6.0, "c")], "id long, x double, s string")
    settings = {
        "row_validation": {"rules": [{"column": "x", "predicate": "x > 0"}], "separator_column": "s"},
        "filtering": {"enabled": True, "ranges": {"x": [0, 10]}},
    }
    result = clean.clean(df, settings, ["id"])
    ids = lambda t: sorted(r["id"] for r in t.collect())
    assert ids(result.df) == ids(clean.apply_fitted(df, result, settings)) == [1, 5]


def test_stream_repeats_the_batch(spark, raw, tmp_path):
    settings = {**CONFIG, "duplicate_handling": {}}
    result = clean.clean(raw, settings, ["id"])
    labelled = label.derive_label_flag(result.df, LABELS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw.write.parquet(source)
    arriving = stream.read_arriving(spark, source, raw.schema)
    query = stream.write_available(stream.apply_run(arriving, result, settings, labelled), out, str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    want = labelled.df.orderBy("id").collect()
    assert spark.read.parquet(out).select(labelled.df.columns).orderBy("id").collect() == want


def document(koc="37 A5 High", water="12.5 at 25 C H4 High", typical="9"):
    return [
        "Intro", f"Koc (x) {koc}", "Solubility - In water at 20 C at", "pH 7 (mg l-1)", "", water,
        "DT50 (lab at 20 C)", "C)", "- A5", f"DT50 (typical) {typical}",
    ]


def test_documents_to_table(spark):
    lines = document()
    paged = [("d1", 1, "\n".join(lines[:3])), ("d1", 2, "\n".join(lines[3:5])), ("d1", 10, "\r\n".join(lines[5:]))]
    paged += [("d3", 1, "\n".join(document(koc="-", water="--")))]
    coded = [("d2", "\n".join(["Octanol-water partition coefficient", "P 7.1 X 10-2 Calculated", "-1.15 A5 Low", "Log P", "BCF (l) 75 Q2 Estimated"]))]
    coded += [("d4", "Log P 2.5 A5 Low\nLog P 3 H3 High\nKoc (x) none")]
    names = spark.createDataFrame([("d1", "one"), ("d2", "two"), ("d3", "three"), ("d4", "four")], "doc_id string, name string")
    template = spark.createDataFrame([(n, 1.0) for n in ("one", "two", "three", "four", "five")], "name string, Koc_Lkg__value double")
    out = benchmark.assemble(
        template, "name", spark.createDataFrame(paged, "doc_id string, page int, text string"),
        spark.createDataFrame(coded, "doc_id string, text string"), names, "LIT", "Somewhere", preserved=["three"],
    )
    rows = {r["name"]: r for r in out.table.collect()}
    assert set(rows) == {"one", "two", "three", "four", "five"}
    assert rows["one"]["Koc_Lkg__value"] == 37.0 and rows["one"]["WaterSolubility_mgL__value"] == 12.5
    assert rows["one"]["DT50_soil_d__value"] is None and rows["one"]["DT50_soil_d__typical_value"] == 9.0
    assert rows["two"]["LogKow__value"] == -1.15 and rows["two"]["LogKow__primary_citation"] == "Somewhere; QC A5"
    assert rows["two"]["BCF_Lkg__meas_or_est"] == "estimated" and rows["two"]["BCF_Lkg__species"] == "fish whole body"
    assert rows["four"]["LogKow__value"] == 2.5
    assert rows["three"]["Koc_Lkg__value"] == 1.0 and rows["five"]["Koc_Lkg__value"] == 1.0
    trail = {(r["entity"], r["endpoint"]): (r["page"], r["line"], r["format"]) for r in out.trail.collect()}
    assert trail["one", "WaterSolubility_mgL"] == (10, 1, "paged") and trail["two", "LogKow"] == (1, 3, "coded")
    pairs = {r["name"]: r for r in out.pairs.collect()}
    assert pairs["three"]["fallback"] == 9.0 and pairs["one"]["note"] is not None


def test_a_block_without_value_blocks_the_fallback(spark):
    far = ["Octanol-water", *["-"] * 9, "Log P 2.5 A5 Low"]
    docs = [("far", "\n".join(far)), ("near", "\n".join(far[:1] + far[-1:])), ("none", "Log P"), ("off", "Octanol-water")]
    found = ex.extract(spark.createDataFrame(docs, "d string, t string"), "d", "t", [ex.CODED_ENDPOINTS[1]])
    got = {r["doc_id"]: (r["value"], r["line"], r["raw"], r["nodata"]) for r in found.collect()}
    assert got == {"far": (None, 11, "Log P 2.5 A5 Low", True), "near": (2.5, 2, "Log P 2.5 A5 Low", False), "none": (None, 1, "Log P", True)}


def test_page_numbers(spark):
    df = spark.createDataFrame([("12.txt",), ("page-3.txt",), ("cover",)], "name string")
    assert [r[0] for r in df.select(ex.page_number(F.col("name"))).collect()] == [12, 3, None]


def test_page_blocks_equal_one_piece(spark, monkeypatch):
    text = document()
    pages = [("d", 7 * i, "\n".join(text[i % 10 : i % 10 + 1 + i % 3])) for i in range(60)] + [("e", 1, "")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    whole = ex.lines_with_following(df, "doc_id", "text", "page").orderBy("page", "line_no").collect()
    monkeypatch.setattr(ex, "_BLOCK", 9)
    assert whole == ex.lines_with_following(df, "doc_id", "text", "page").orderBy("page", "line_no").collect()
    flat = [(r["page"], r["line_no"], r["text"]) for r in whole]
    for i, r in enumerate(whole):
        assert [tuple(x) for x in r["following"]] == flat[i + 1 : i + 9]


def test_analysis_run(spark):
    df = spark.range(400).select(
        "id", ((F.col("id") * 37) % 101).cast("double").alias("u"), ((F.col("id") * 53) % 97).cast("double").alias("v")
    ).withColumn("y", (F.col("u") > 60).cast("int")).withColumn("n", F.lit(0))
    settings = {
        "model_settings": {"learner": "tree", "max_depth_range": [2], "min_samples_leaf_range": [5]}, "cv_folds": 2,
        "sensitivity_analysis": {"enabled": True, "bootstrap_iterations": 12, "cv_splits": 2, "fixed_model": {"maxIter": 2, "maxDepth": 2}},
    }
    out = analyse.analyse(df, ["y", "n"], ["u", "v"], ["id"], settings)
    assert list(out.models) == ["y"] and list(out.skipped) == ["n"]
    summary = out.tables["summary"].collect()
    assert len(summary) == 1 and summary[0]["grade"] in ("high", "medium", "low") and summary[0]["n_replicates"] == 12
    assert out.tables["sweep"].count() == 50
    assert out.tables["split_ranges"].filter("feature = 'u'").first()["thresholds"]
    assert out.tables["attribution"].columns == ["label", "feature", "contribution", "rank"]
    assert {r["width"] for r in out.tables["boundary"].collect()} == {0.1, 0.15, 0.2, 0.25}
    tested = out.models["y"].scored_test.count()
    counts = out.tables["outcomes"].first()
    assert sum(counts[k] for k in ("tn", "fp", "fn", "tp")) == tested == out.tables["outcome_points"].count()
    assert out.tables["uncertainty"].agg(F.sum("n")).first()[0] == tested
    status = out.tables["status"].first()
    assert status["outside"] + status["passed"] + status["failed"] == df.count()
    assert {r["feature"] for r in out.tables["value_ranges"].collect()} <= {"u", "v"}
    assert out.tables["split_counts"].filter("feature = 'u'").first()["splits"] >= 1


def test_profiles(raw):
    tables = profile.profile_table(raw, ["mw", "xlogp", "absent"], {"pca_analysis": {"n_components": 2}})
    assert {r["column"] for r in tables["feature_statistics"].collect()} == {"mw", "xlogp"}
    assert tables["histograms"].agg(F.sum("n")).first()[0] == 44 + 44
    assert tables["pca_variance"].count() == 2
    labelled = label.derive_label_flag(raw, LABELS).df
    tables = profile.profile_labels(labelled, ["mw", "xlogp"], ["noted", "big"])
    assert {r["label"] for r in tables["by_label"].collect()} == {"overall", "noted", "big"}
    assert tables["normalised"].count() == 90


def test_unknown_configuration_keys():
    found = config.unknown_keys({"filtering": {"enabled": True, "mw_rnage": [0, 1]}, "wrong": {}})
    assert found == ["filtering.mw_rnage", "wrong"]
    assert not config.unknown_keys({**CONFIG, **LABELS})
