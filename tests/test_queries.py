"""The driver contract: names, oracles, and a spread of registered queries against their oracle."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, oracle

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["S5_read_qc_sections", "P16_pick_by_key", "J5_lookup_last", "A4_stage_summary", "A20_directory_audit",
           "A26_replicate_structure", "W4_stage_loss", "U2_set_report", "ST7_diff_test", "ST8_enrich_prerank",
           "ST10_binned_trend", "ST15_qc_forest", "W1_avg_rank_spread", "W6_bh_adjust_spread", "A4_stage_summary_spread", "T1_ingest_results", "ST12_box_stats", "E9_headline", "E12_pending", "T2_live_endpoint_summary",
           "J10_dense_sums", "ST10_binned_trend_wide", "E12_skip_ledger", "E1_loso_samples", "A10_read_survival", "ST13_mutual_information"]


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


def test_contract():
    names = entry.queries()
    assert len(names) >= 110 and set(entry.oracle_sql()) <= set(names)
    reference = {n for n in names if not n.startswith("op") and n != "pipeline"}
    assert reference <= set(entry.oracle_sql())


def test_queries_without_a_dependency_of_the_training_data_operators(monkeypatch):
    """What cannot be imported leaves the other queries alone."""
    import sys
    for name in [m for m in sys.modules if m.startswith("shearmark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = entry.queries()
    assert len(names) >= 130 and not any(n.startswith("op") for n in names)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_files_of_the_qc_query_do_not_grow_with_its_reports(spark, tmp_path, monkeypatch):
    from shearmark.analogue import registry
    monkeypatch.setattr(registry, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    got = entry.queries()["S5_read_qc_sections"](spark, FOLDER)
    assert got.select("report").distinct().count() == 20
    assert len(list(tmp_path.rglob("part-*"))) <= 3 * 4  # projects x shuffle partitions


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_oracle(spark, con, name):
    problem, n, _, _ = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and n > 0
