"""Cleaning, joins, set operations and summaries: edge rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shearmark.functions import scalars as S
from shearmark.operators import cleaning as P
from shearmark.operators import collections as U
from shearmark.operators import joins as J
from shearmark.operators import summaries as A
from shearmark.plans import classify, cost


def test_active_samples(spark):
    df = spark.createDataFrame([("p", "a", "1", None), ("p", "b", "2", ""), ("p", "c", "1", "bad"), ("p", "d", "0", None),
                                ("p", "e", "x", None), ("q", "f", "1", None)],
                               "BioProject string, SRR_ID string, `group` string, exclude string")
    assert rows(P.active_samples(df), "SRR_ID") == [("a",), ("b",), ("f",)]
    assert rows(P.active_samples(df, "q"), "SRR_ID") == [("f",)]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 5 ",), ("NA",), ("nan",), (None,)], "x string")
    assert [r.x for r in P.coerce_double(df, ["x"]).collect()] == [1.5, 5.0, None, None, None]
    assert spark.range(1).select(S.percent(F.lit("98.88%")).alias("p")).first().p == 98.88


@pytest.mark.parametrize("name,path,want", [
    ("SRR12_1_fastqc", None, "SRR12"), ("SRR7_fastqc", None, "SRR7"), ("x.txt", "a/SRR9/x.txt", "SRR9"), ("x", "a/x", None)])
def test_sample_id(spark, name, path, want):
    col = S.sample_id(F.lit(name), F.lit(path) if path else None)
    assert spark.range(1).select(col.alias("s")).first().s == want


def test_ne_keeps_unknown_and_benefit_counts_it(spark):
    df = spark.createDataFrame([("U",), ("A",), (None,)], "t_star string")
    assert rows(P.keep_ne_or_null(df, "t_star", "U")) == [("A",), (None,)]
    assert sorted((str(r.t_star), r.benefits_from_trimming) for r in P.benefit_label(df).collect()) == [
        ("A", 1), ("None", 1), ("U", 0)]


def test_cost_and_rates_survive_zero(spark):
    df = spark.createDataFrame([(3600.0, 2.0, 1024.0), (10.0, 1.0, 0.0)], "duration_sec double, cores_used double, fastq_mb double")
    assert [(r.core_hours, r.core_hours_per_gb) for r in P.cost_columns(df).collect()] == [(2.0, 2.0), (pytest.approx(10 / 3600), None)]
    f = spark.sql("select timestamp'2024-01-01 00:00:00' started_at, timestamp'2024-01-01 00:00:02.5' finished_at, '5000000' bytes_downloaded")
    r = P.transfer_rate(f).first()
    assert (r.duration_sec, r.mb_downloaded, r.mb_per_sec) == (2.5, 5.0, 2.0)


def test_stage_summary_keeps_null_mode(spark):
    raw = spark.createDataFrame([("s1", "fastqc", None, "10"), ("s2", "fastqc", None, "n/a"), ("s3", "align", "P5", "20")],
                                "SRR_ID string, category string, mode string, duration_sec string")
    raw = raw.selectExpr("*", "1.0d cores_used", "1024.0d fastq_mb", "2.0d mb_per_sec")
    got = {(r.category, r.mode): r.n_records for r in cost.cost_summary(raw).collect()}
    assert got == {("fastqc", None): 2, ("align", "P5"): 1}


def test_paired_ratio_needs_both(spark):
    df = spark.createDataFrame([("a", "x", 4.0), ("a", "x", 8.0), ("a", "y", 3.0), ("b", "x", 1.0), ("c", "y", 1.0)],
                               "s string, m string, v double")
    r = A.paired_ratio(df, "s", "m", "v", "x", "y").first()
    assert (r.n_pairs, r.median_ratio, r.mean_ratio) == (1, 2.0, 2.0)


def test_lookup_last_wins_and_u_is_full(spark):
    trim = spark.createDataFrame([("s", "P5", 90.0, 1), ("s", "P5", 80.0, 2)], "SRR_ID string, mode string, surviving_pct double, n int")
    want = spark.createDataFrame([("s", "P5", "P5"), ("s", "untrimmed", "U"), ("s", "P20", "P20")], "SRR_ID string, mode string, t_star string")
    got = {r.t_star: r.preferred_surviving_pct for r in J.preferred_survival(want, trim, "n").collect()}
    assert got == {"P5": 80.0, "U": 100.0, "P20": None}


def test_tasks_of_a_lookup_grow_with_its_keys(spark, monkeypatch):
    from shearmark import runtime
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    df = spark.range(200).withColumnRenamed("id", "k")
    got = J.lookup_last(df, df.selectExpr("k", "k * 2 as v", "k as n"), ["k"], "v", "n")
    assert got.rdd.getNumPartitions() >= 20 and {(r.k, r.v) for r in got.collect()} == {(i, 2 * i) for i in range(200)}


def test_lookup_diff_keeps_failed_lookup(spark):
    a = spark.createDataFrame([("x", 3), ("y", 4), ("z", 5)], "k string, a int")
    b = spark.createDataFrame([("x", 3), ("y", 1)], "k string, b int")
    assert rows(J.lookup_diff(a, b, ["k"], "a", "b"), "k", "diff") == [("y", 3), ("z", None)]
    assert rows(J.reconcile(a, b, ["k"], "a", "b"), "k", "delta") == [("y", 3), ("z", 5)]


def test_dense_counts_fill_zero(spark):
    counts = spark.createDataFrame([("p", "a", "U", "g1", 3), ("p", "b", "U", "g2", 4)],
                                   "project string, srr string, mode string, gene string, count long")
    got = rows(J.dense_counts(counts, counts.select("project", "gene"), counts), "srr", "gene", "count")
    assert got == [("a", "g1", 3), ("a", "g2", 0), ("b", "g1", 0), ("b", "g2", 4)]


def test_append_new_keeps_existing(spark):
    old = spark.createDataFrame([("s", "U", 1)], "s string, m string, v int")
    new = spark.createDataFrame([("s", "U", 9), ("s", "A", 2)], "s string, m string, v int")
    assert rows(U.append_new(old, new, ["s", "m"])) == [("s", "A", 2), ("s", "U", 1)]
    assert rows(U.set_report(old, new, ["m"])) == [("A", "right"), ("U", "both")]


def test_method_without_rows_shows_zero(spark):
    df = spark.createDataFrame([("s", "A", 0.5, 0.1)], "SRR_ID string, method string, rho_gene double, jaccard_deg double")
    got = A.gene_summary(df).collect()
    assert [r.method for r in got] == ["U", "A", "P5", "P10", "P20", "P35"] and [r.n for r in got] == [0, 1, 0, 0, 0, 0]


def test_status_counts_drop_unknown(spark):
    df = spark.createDataFrame([("done", "ok"), ("done", "ok"), ("todo", None)], "status string, run_status string")
    assert rows(A.status_counts(df)) == [("done", "ok", 2)]


def test_replicate_structure_reasons(spark):
    data = [("inc", "a")] * 2 + [("inc", "b")] * 3 + [("inc", "c")] + [("one", "a")] * 4 + [("none", "a")]
    data += [("lack", "a")] * 3 + [("lack", "b")]
    got = {r.project: (r.eligible_srrs, r.included, r.reason) for r in A.replicate_structure(
        spark.createDataFrame(data, "project string, condition string")).collect()}
    assert got == {"inc": (5, "Yes", None), "one": (0, "No", "Only 1 class exists (DESeq2 requires >= 2 to compare)"),
                   "none": (0, "No", "Only 1 class exists, and it has no replicates"),
                   "lack": (0, "No", "Has 2 classes, but only 1 have replicates")}


def test_classify_and_headline(spark):
    conc = [("p", "s1", "U", 0.8), ("p", "s1", "A", 0.9), ("p", "s1", "P5", 0.9), ("p", "s1", "P35", 0.2), ("p", "s1", "P10", None),
            ("p", "s2", "U", 0.8), ("p", "s2", "A", 0.81)]
    cls = classify.classify_trimming(spark.createDataFrame(conc, "project string, SRR_ID string, method string, rho_pathway double"))
    got = {r.SRR_ID: r for r in cls.collect()}
    assert got["s1"].t_star == "A" and got["s1"].P35_class == "harmful" and got["s1"].P10_class is None
    assert got["s2"].t_star == "U" and got["s2"].A_class == "neutral"
    trim = spark.createDataFrame([("s1", "adapter_only", 95.0, 1)], "SRR_ID string, mode string, surviving_pct double, n int")
    h = classify.headline(cls, trim, "n").first()
    assert (h.total_samples, h.samples_preferring_untrimmed, h.samples_preferring_trimmed) == (2, 1, 1)
    assert h.median_outlier_pathway_delta == pytest.approx(0.1) and h.median_outlier_read_loss_pct == 5.0


def test_directory_audit(spark):
    paths = spark.createDataFrame([("d/flattened_a/p1/SRR1_x.tsv",), ("d/flattened_a/p1/SRR1_y.tsv",), ("d/flattened_a/p2/SRR2/z",),
                                   ("d/flattened_a/p3/SRR3.txt",), ("d/other/p1/SRR9.txt",)], "path string")
    cohort = spark.createDataFrame([("p1",)], "project string")
    r = A.directory_audit(paths, cohort).collect()
    assert len(r) == 1 and (r[0].projects_total, r[0].unique_srrs_total, r[0].unique_srrs_in_cohort) == (3, 3, 1)
    assert sorted(map(tuple, A.outside_projects(paths, cohort).collect())) == [("flattened_a", "p2"), ("flattened_a", "p3")]
