"""Readers, sinks and streams on real files."""

import gzip

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shearmark.schemas import CONCORDANCE, TRIM_STATS
from shearmark.sources import readers as R
from shearmark.sources import writers as W
from shearmark.streaming import ingest

LINE = "{}\tchr1\t1\t9\t+\t9\t{}\n"


def put(path, text, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if packed:
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)


def test_feature_counts(spark, tmp_path):
    head = "# Program\nGeneid\tChr\tStart\tEnd\tStrand\tLength\tx.bam\n"
    put(tmp_path / "PRJ1/untrmd_SRR1_fC.txt.gz", head + LINE.format("g1", 3) + LINE.format("g2", 0), True)
    put(tmp_path / "PRJ1/SRR1_trimmomatic_adapter_fC.txt.gz", head + LINE.format("g1", 2), True)
    put(tmp_path / "PRJ2/SRR2_trimmomatic_P35_fC.txt", head + "short\trow\n" + LINE.format("g9", 7))
    assert rows(R.read_feature_counts(spark, str(tmp_path))) == [
        ("PRJ1", "SRR1", "A", "g1", 2), ("PRJ1", "SRR1", "U", "g1", 3), ("PRJ1", "SRR1", "U", "g2", 0),
        ("PRJ2", "SRR2", "P35", "g9", 7)]


def test_qc_sections(spark, tmp_path):
    body = "##FastQC\n>>Basic Statistics\tpass\nx\t9\n>>END_MODULE\n>>Per base sequence quality\tpass\n#Base\tMean\n" \
           "1\t30.5\t1\n2\tbad\t1\n\n3\t32.0\n>>END_MODULE\n>>Per tile\tpass\n1\t99\n>>END_MODULE\n"
    put(tmp_path / "PRJ1/SRR5_1_fastqc/fastqc_data.txt", body)
    put(tmp_path / "PRJ1/SRR5_2_fastqc/fastqc_data.txt", body.replace("32.0", "36.0"))
    put(tmp_path / "PRJ1/SRR6_fastqc/fastqc_data.txt", "##FastQC\n>>Other\tpass\n1\t2\n>>END_MODULE\n")
    put(tmp_path / "PRJ1/SRR8_fastqc/fastqc_data.txt", ">>Per base sequence quality\tpass\n1\t20.0")
    got = R.read_qc_sections(spark, str(tmp_path))
    assert rows(got, "project_id", "SRR_ID", "report", "mean_q") == [
        ("PRJ1", "SRR5", "SRR5_1_fastqc", 30.5), ("PRJ1", "SRR5", "SRR5_1_fastqc", 32.0), ("PRJ1", "SRR5", "SRR5_2_fastqc", 30.5),
        ("PRJ1", "SRR5", "SRR5_2_fastqc", 36.0), ("PRJ1", "SRR8", "SRR8_fastqc", 20.0)]
    from shearmark.plans.quality import quality_table, terminal_quality
    terminal = terminal_quality(got)
    assert rows(terminal, "SRR_ID", "terminal_q_mean") == [("SRR5", 32.25), ("SRR8", 20.0)]
    q = spark.createDataFrame([("PRJ1", "SRR5", 35.0, 1.0), ("PRJ1", "SRR9", 34.0, 4.0)],
                              "project_id string, SRR_ID string, Q_mean double, tail_quality_decay double")
    assert rows(quality_table(q, terminal), "SRR_ID", "terminal_q_mean") == [("SRR5", 32.25), ("SRR9", 30.0)]


def test_packed_qc_reports(spark, tmp_path):
    """Many reports in one file that is read in splits of a few lines, against a plain parser."""
    body, want = [], []
    for i in range(24):
        body += ["##FastQC\t0.11", ">>Basic Statistics\tpass", "#Measure\tValue", f"Filename\tSRR{i}_{1 + i % 2}.fastq.gz", ">>END_MODULE"]
        if i % 5:
            body += [">>Per base sequence quality\tpass", "#Base\tMean"]
            values = [(k, 20 + (i * 7 + k * 3) % 17) for k in range(1, 2 + i % 9)]
            body += [f"{k}\t{v}.5" for k, v in values] + ([">>END_MODULE"] if i % 7 else [])
            want += [("packed", f"SRR{i}", f"SRR{i}_{1 + i % 2}_fastqc", k, v + 0.5) for k, v in values]
        body += [">>Other\tpass", "1\t99.0", ">>END_MODULE"]
        if i % 11 == 0:
            body += [">>Per base sequence quality\tagain", "1\t1.0", ">>END_MODULE"] if i % 5 else []
    put(tmp_path / "packed/all.txt", "\n".join(body))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("197", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = R.read_qc_sections(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted((r.project_id, r.SRR_ID, r.report, r.pos, r.mean_q) for r in got) == sorted(want)


def test_small_readers(spark, tmp_path):
    put(tmp_path / "sets.gmt", "S1\t\tg1\tg2\nS2\tdesc\tg3")
    assert rows(R.read_gene_sets(spark, str(tmp_path / "sets.gmt"))) == [
        ("S1", "na", "g1"), ("S1", "na", "g2"), ("S2", "desc", "g3")]
    put(tmp_path / "f.tsv", "PRJ1\t12\n\t9\nPRJ2\t40")
    assert rows(R.read_headerless(spark, str(tmp_path / "f.tsv"), ["p", "n"])) == [("PRJ1", 12), ("PRJ2", 40)]
    put(tmp_path / "ids/PRJ1_SRR_IDs.txt", "SRR1\n  SRR2 \n\nERR3\n")
    assert rows(R.id_list_sizes(R.read_id_lists(spark, str(tmp_path / "ids")))) == [("PRJ1", 2)]
    put(tmp_path / "meta/PRJ9.csv", 'Run,condition,condition_raw,condition_role,class_field,metadata_status\nSRR1,a,"A, x",class,f,ok\n')
    assert rows(R.read_project_metadata(spark, str(tmp_path / "meta")), "project", "Run", "condition_raw") == [("PRJ9", "SRR1", "A, x")]
    put(tmp_path / "t/PRJ1/SRR1_timings.tsv", "stage\tstart_epoch\tend_epoch\tduration_sec\ntrim_adapter_only\t0\t0\t5\npipeline_total\t0\t0\t9\n")
    assert rows(R.read_stage_timings(spark, str(tmp_path / "t")), "srr", "category", "mode", "duration_sec") == [
        ("SRR1", "trim", "adapter_only", 5), ("SRR1", None, None, 9)]
    put(tmp_path / "s.tsv", "project_id\tsrr_id\tmode\tlayout\tinput_reads\tsurviving\tsurviving_pct\tdropped\tdropped_pct\n"
                            "P\tSRR1\tP5\tPE\t10\t9\t90.00\t1\t10.00\n")
    assert R.read_table(spark, str(tmp_path / "s.tsv"), TRIM_STATS).first().surviving_pct == 90.0


def concordance(spark, *data):
    return spark.createDataFrame([(*r, None, 0.5, None, 1.0) for r in data], CONCORDANCE)


def test_result_sink(spark, tmp_path):
    df = concordance(spark, ("PRJ2", "s", "U", 0.1234567), ("PRJ1", "s", "A", float("nan")))
    out = str(tmp_path / "out")
    W.write_results(df, out)
    text = {p.parent.name: p.read_text().splitlines() for p in (tmp_path / "out").glob("*/part-*")}
    assert text["in_project=PRJ1"] == [
        "project\tSRR_ID\tmethod\trho_gene\tjaccard_deg\trho_pathway\tjaccard_pathway\tdir_concordance",
        "PRJ1\ts\tA\tNA\tNA\t0.500000\tNA\t1.000000"]
    back = W.combine_results(spark, out, out=str(tmp_path / "all")).collect()
    assert rows(W.read_results(spark, str(tmp_path / "all"))) == rows(W.combine_results(spark, out))
    assert [(r.project, r.rho_gene) for r in back] == [("PRJ1", None), ("PRJ2", 0.123457)]


def test_text_of_doubles_is_that_of_the_format(spark):
    """Ties, signs of zero and numbers beyond the decimals."""
    values = [0.0, -0.0, 5e-7, -5e-7, -4e-7, -1e-6, 0.1234565, -2.0000005, 1e11, 99999999999.99999, -1e20, 1e300, float("inf"), -float("inf")]
    df = spark.createDataFrame([(v,) for v in [*values, *[i / 2e6 for i in range(-300, 300)]]], "x double")
    got = W.as_text(df.select("x", F.format_string("%.6f", "x").alias("want")))
    assert got.filter("not x <=> want").count() == 0
    assert rows(W.as_text(spark.createDataFrame([(float("nan"),), (None,)], "x double"))) == [(None,), (None,)]


def test_ingest_first_row_of_a_key_wins(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("src", "out", "ckpt"))

    def drop(df, name):
        W.write_results(df, f"{src}/{name}")

    drop(concordance(spark, ("p", "s", "U", 0.1), ("p", "s", "A", 0.2)), "one")
    ingest.ingest_results(spark, src, out, ckpt)
    drop(concordance(spark, ("p", "s", "U", 0.9), ("p", "s", "P5", 0.3)), "two")
    ingest.ingest_results(spark, src, out, ckpt)
    ingest.ingest_results(spark, src, out, ckpt)
    assert rows(ingest.ingested(spark, out), "project", "method", "rho_gene", "batch") == [
        ("p", "A", 0.2, 0), ("p", "P5", 0.3, 1), ("p", "U", 0.1, 0)]
    (tmp_path / "src/other").mkdir()
    (tmp_path / "src/other/x.tsv").write_text("SRR_ID\tproject\n1\t2\n")
    with pytest.raises(Exception, match="header"):
        ingest.ingest_results(spark, src, out, ckpt)


def test_live_summary_emits_closed_windows(spark, tmp_path):
    data = [(f"s{i}", "ncbi", "success" if i % 2 else "failed", f"2024-01-01 0{i // 6}:{i % 6}0:00") for i in range(14)]
    df = spark.createDataFrame(data, "srr_id string, endpoint string, status string, at string").select(
        "srr_id", "endpoint", "status", F.to_timestamp("at").alias("started_at"),
        (F.to_timestamp("at") + F.expr("interval 2 seconds")).alias("finished_at"), F.lit(4000000).alias("bytes_downloaded"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.live_digit_counts(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = ingest.live_endpoint_summary(spark.read.parquet(str(tmp_path / "out")), df).collect()
    assert sorted((r.window_start.hour, r.attempts, r.successes, r.median_mb_per_sec, r.closed) for r in got) == [
        (0, 6, 3, 2.0, True), (1, 6, 3, 2.0, True), (2, 2, 1, 2.0, False)]


def test_live_state_is_bounded_and_medians_exact(spark, tmp_path):
    """Thousands of different rates in a window: the counts hold some dozen digits, the median is that of all rates."""
    df = spark.range(6000).select(
        F.concat(F.lit("SRR"), "id").alias("srr_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("endpoint"),
        F.when(F.col("id") % 5 == 0, "failed").otherwise("success").alias("status"),
        F.timestamp_seconds(F.col("id") % 7200).alias("started_at"), F.timestamp_seconds(F.col("id") % 7200 + 4).alias("finished_at"),
        F.when(F.col("id") % 11 != 0, 5_000_000 + (F.col("id") * 7919) % 1_000_003).alias("bytes_downloaded"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.live_digit_counts(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    counts = spark.read.parquet(str(tmp_path / "out"))
    assert counts.count() < 2 * 2 * 2 * 30  # windows, endpoints, statuses, digits
    for leaf in (1, 4096):
        got = {(r.window_start.hour, r.endpoint): (r.attempts, r.median_mb_per_sec) for r in
               ingest.live_endpoint_summary(counts, df, leaf=leaf).collect()}
        want = {}
        for r in df.collect():
            want.setdefault((r.started_at.hour, r.endpoint), []).append(r.bytes_downloaded)
        assert got.keys() == want.keys()
        for k, values in want.items():
            known = sorted(v / 1e6 / 4 for v in values if v is not None)
            middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
            assert got[k] == (len(values), pytest.approx(middle, rel=1e-12))


def test_ingest_takes_the_earlier_line_of_a_file(spark, tmp_path):
    """Inside one file the earlier line stays, whatever its values, also where the file is read in splits."""
    from shearmark.schemas import CONCORDANCE
    names = CONCORDANCE.fieldNames()
    lines = ["\t".join(names)]
    for i in range(120):
        for value in ("NA", "0.5") if i % 2 else ("0.9", "NA", "0.1"):
            lines.append("\t".join(["P", f"S{i}", "U", *[value] * (len(names) - 3)]))
    lines += ["\t".join(["P", f"S{i}", "U", *["0.0"] * (len(names) - 3)]) for i in range(120)]
    put(tmp_path / "src/one.tsv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        ingest.ingest_results(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        got = {r.SRR_ID: r.rho_gene for r in ingest.ingested(spark, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"S{i}": None if i % 2 else 0.9 for i in range(120)}
