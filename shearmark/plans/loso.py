"""Leave-one-sample-out concordance, whole-project concordance and resumable runs.

The expanded form (targets x samples x genes) is never built.  Per (project,
gene) the sums of scaled counts and of their squares are kept for each method
and condition; a target's own terms are subtracted from them (reference) or
swapped for its terms under another method (candidate).  Work is targets x
genes, in one plan for all tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import median_of
from ..operators.cleaning import active_samples, neutral_fill
from ..operators.counts import diff_test, gene_universe, leave_one_out, library_factors, wald
from ..operators.enrich import enrich_prerank
from ..operators.ordering import bh_adjust, top_abs
from ..operators.stats import direction_concordance, jaccard, spearman, vote
from ..runtime import dealt, grid_join, join_groups, settle
from ..schemas import (BASELINE, CONCORDANCE_METRICS, DEG_FDR, DEG_LOG2FC, GENE_VOTE_Z, METHODS, MIN_SAMPLES,
                       PATHWAY_NES, REFERENCE_METHODS, TOP_PATHWAYS, VOTE_FRACTION, method_order)

TARGET = ["project", "srr"]
TEST = [*TARGET, "stage", "method"]


def scaled_files(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """(project, srr, mode, size_factor, condition) of every usable count file.

    Size factors are library totals over the project's mean untrimmed total.  A
    sample takes part when its untrimmed file exists; a file without a single
    count cannot be scaled and counts as missing.
    """
    files = library_factors(counts, ["project"], depth_mode=BASELINE).filter(F.col("size_factor") > 0)
    base = files.filter(F.col("mode") == BASELINE).select(*TARGET)
    return settle(files.join(samples.join(base, TARGET), TARGET), "files")


def loso_samples(annotation: DataFrame) -> DataFrame:
    """(project, srr, condition) of the samples of an annotation table that are not excluded and have a positive group."""
    return active_samples(annotation).select(F.col("BioProject").alias("project"), F.col("SRR_ID").alias("srr"), "condition")


def contexts(files: DataFrame) -> DataFrame:
    """Every test to run: per target four references and up to six candidates, see ``planned``."""
    return planned(files).filter("reason is null").drop("reason", "n_samples")


def planned(files: DataFrame) -> DataFrame:
    """Every test, with the reason why it cannot be run (null if it can) and its number of samples.

    Every available sample with a condition is a target.  The two conditions of a test are chosen from what is left in
    it: control and treatment, else the first two by name (``level0``, ``level1``); all its samples count towards
    MIN_SAMPLES.  Holds the sample numbers and sums of 1/size factor of both, ``role`` (the target's place among them,
    null if it is of another condition) and ``take`` / ``give``: whether the target's own terms leave the method totals,
    and whether its terms under ``method`` come in.
    """
    available = files.filter(F.col("mode") == BASELINE).select(*TARGET, "condition")
    targets = settle(leave_one_out(available).select(*TARGET, "condition", "leave").filter(F.col("condition").isNotNull()), "targets")
    mine = settle(files.filter(F.col("condition").isNotNull())
                  .select(*TARGET, "mode", "condition", (F.lit(1.0) / F.col("size_factor")).alias("inv")), "inverse")
    sums = mine.groupBy("project", "mode", "condition").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("inv").alias("r"))
    sums = settle(sums.groupBy("project", "mode").agg(F.collect_list(F.struct("condition", "n", "r")).alias("totals")), "file_sums")

    plan = [("reference", m, m) for m in REFERENCE_METHODS] + [("candidate", m, BASELINE) for m in METHODS]
    tests = targets.withColumn("t", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.lit(m).alias("method"), F.lit(b).alias("base")) for s, m, b in plan])))
    tests = tests.select(*TARGET, "condition", "leave", "t.*")
    own = lambda mode, name: mine.select(*TARGET, F.col("mode").alias(mode), F.col("inv").alias(name))
    tests = (tests.join(own("base", "inv_base"), [*TARGET, "base"], "left")
             .join(own("method", "inv_method"), [*TARGET, "method"], "left"))
    tests = join_groups(tests, sums.withColumnRenamed("mode", "base"), ["project", "base"])
    candidate, zero, one = F.col("stage") == "candidate", F.lit(0.0), F.lit(1.0)
    out = tests.withColumns({"take": F.col("leave") & F.col("inv_base").isNotNull(),
                             "give": candidate & F.col("inv_method").isNotNull()})
    same = F.get(F.filter("totals", lambda e: e["condition"] == F.col("condition")), F.lit(0))
    mine_left = F.struct("condition", *[
        (F.coalesce(same[k], zero) - F.when(F.col("take"), taken).otherwise(zero) + F.when(F.col("give"), given).otherwise(zero)).alias(k)
        for k, taken, given in (("n", one, one), ("r", F.col("inv_base"), F.col("inv_method")))])
    others = F.filter("totals", lambda e: e["condition"] != F.col("condition"))
    out = out.withColumn("left", F.filter(F.concat(others, F.array(mine_left)), lambda e: e["n"] > 0.5))
    names = F.array_sort(F.transform("left", lambda e: e["condition"]))
    usual = F.array_contains(names, "control") & F.array_contains(names, "treatment")
    out = out.withColumns({f"level{r}": F.when(usual, F.lit(name)).otherwise(F.get(names, F.lit(r)))
                           for r, name in ((0, "control"), (1, "treatment"))})
    out = out.withColumn("n_samples", F.aggregate("left", zero, lambda total, e: total + e["n"]).cast("long"))
    reason = (F.when(candidate & ~F.col("give"), "no count file").when(F.col("level1").isNull(), "one condition")
              .when(~candidate & (F.col("n_samples") < MIN_SAMPLES), "too few samples"))
    entry = lambda name: F.get(F.filter("left", lambda e: e["condition"] == F.col(name)), F.lit(0))
    level = [entry("level0"), entry("level1")]
    role = F.when(F.col("condition") == F.col("level0"), 0).when(F.col("condition") == F.col("level1"), 1)
    return out.select(
        *TEST, reason.alias("reason"), "n_samples", "base", role.alias("role"), "level0", "level1", "take", "give",
        *[level[r][k].alias(f"{k}{r}") for k in ("n", "r") for r in (0, 1)])


def loso_skips(counts: DataFrame, samples: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Ledger of the tests that ``loso`` does not run: (project, srr, stage, method, reason, n_samples).

    A target without any reference is one row of stage ``target``; ``pending`` drops it.  Other targets have a row of stage
    ``candidate`` for each method that cannot be judged and of ``reference_method`` for each that does not vote.
    """
    tests = planned(scaled_files(counts, samples))
    if targets is not None:
        tests = tests.join(targets.select(*TARGET).distinct(), TARGET, "left_semi")
    tests = settle(tests.select(*TEST, "reason", "n_samples"), "planned")
    reference = F.col("stage") == "reference"
    per = tests.filter(reference).groupBy(*TARGET).agg(
        F.count_if(F.col("reason").isNull()).alias("_run"), F.min_by(F.struct("reason", "n_samples"), method_order(F.col("method"))).alias("_r"))
    gone = settle(per.filter("_run = 0"), "dropped_targets")
    dropped = gone.select(*TARGET, F.lit("target").alias("stage"), F.lit(None).cast("string").alias("method"), "_r.*")
    rest = tests.filter("reason is not null").join(gone.select(*TARGET), TARGET, "left_anti")
    return dropped.unionByName(rest.withColumn("stage", F.when(reference, "reference_method").otherwise(F.col("stage"))))


def _slot(cols: list[Column], key: Column) -> Column:
    """The entry of ``cols`` that belongs to the method in ``key``."""
    return F.get(F.array(*cols), method_order(key))


def loso_tests(counts: DataFrame, files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """log2fc, stat, p-value and adjusted p-value of every (test, gene).

    ``targets`` (project, srr) restricts the tests that are run, not the samples they rest on.
    """
    tests = contexts(files)
    keyed = files.filter(F.col("condition").isNotNull()).select(*TARGET, "mode", "condition", "size_factor")
    if targets is not None:
        tests = tests.join(targets.select(*TARGET).distinct(), TARGET, "left_semi")
    scaled = counts.join(keyed, [*TARGET, "mode"]).withColumn("q", F.col("count") / F.col("size_factor"))
    zero = F.lit(0.0)
    own = scaled.groupBy(*TARGET, "gene").agg(*[
        F.coalesce(F.max(F.when(F.col("mode") == m, F.col("q"))), zero).alias(f"own_{m}") for m in METHODS])
    sums = scaled.groupBy("project", "gene", "condition").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mode") == m, v)), zero) for m in REFERENCE_METHODS]).alias(k)
        for k, v in (("s", F.col("q")), ("q", F.col("q") * F.col("q")), ("k", (F.col("q") > 0).cast("double")))])
    sums = sums.groupBy("project", "gene").agg(
        F.map_from_entries(F.collect_list(F.struct("condition", F.struct("s", "q", "k")))).alias("totals"))
    genes = sums.join(gene_universe(counts), ["project", "gene"])
    # One row per target carrying its handful of tests.
    packed = tests.groupBy(*TARGET).agg(F.collect_list(F.struct(
        "stage", "method", "base", "role", "level0", "level1", "take", "give", "n0", "n1", "r0", "r1")).alias("tests"))
    wide = (grid_join(genes, packed, ["project"], "gene", "srr").join(own, [*TARGET, "gene"], "left")
            .withColumn("t", F.explode("tests")))
    wide = wide.withColumns({f"totals{r}": F.try_element_at("totals", F.col(f"t.level{r}")) for r in (0, 1)})
    minus = F.when(F.col("t.take"), _slot([F.col(f"own_{m}") for m in METHODS], F.col("t.base")))
    plus = F.when(F.col("t.give"), _slot([F.col(f"own_{m}") for m in METHODS], F.col("t.method")))
    moved = wide.select(
        *TARGET, "gene", "t.role", "t.stage", "t.method", "t.n0", "t.n1", "t.r0", "t.r1",
        F.coalesce(minus, zero).alias("minus"), F.coalesce(plus, zero).alias("plus"),
        *[F.coalesce(F.get(F.col(f"totals{r}.{k}"), method_order(F.col("t.base"))), zero).alias(f"{k}{r}")
          for k in ("s", "q", "k") for r in (0, 1)])
    sign = {r: F.col("role") == r for r in (0, 1)}
    change = {}
    for r in (0, 1):
        one, two = F.col("plus") - F.col("minus"), F.col("plus") * F.col("plus") - F.col("minus") * F.col("minus")
        change[f"s{r}"] = F.greatest(F.col(f"s{r}") + F.when(sign[r], one).otherwise(zero), zero)
        change[f"q{r}"] = F.greatest(F.col(f"q{r}") + F.when(sign[r], two).otherwise(zero), zero)
        given = (F.col("plus") > 0).cast("double") - (F.col("minus") > 0).cast("double")
        change[f"k{r}"] = F.col(f"k{r}") + F.when(sign[r], given).otherwise(zero)
    # Subtraction leaves rounding dust where no sample with a count is left: make it an exact zero.
    dust = {f"{v}{r}": F.when(F.col(f"k{r}") < 0.5, zero).otherwise(F.col(f"{v}{r}")) for v in ("s", "q") for r in (0, 1)}
    moved = moved.withColumns(change).withColumns(dust)
    fit = wald(moved.drop("role", "minus", "plus", "k0", "k1")).withColumn("pvalue", F.coalesce("pvalue", F.lit(1.0)))
    # A window spans one test's genes.
    return neutral_fill(bh_adjust(fit, TEST, "pvalue", bounded=True))


def _consensus(df: DataFrame, by: list[str], key: str, col: str, thr: float, n_methods: DataFrame,
               frac: float) -> DataFrame:
    """Median and vote over the reference methods in one aggregate."""
    sign = F.when(F.abs(F.col(col)) > thr, F.signum(F.col(col)).cast("int"))
    per_method = [F.max(F.when(F.col("method") == m, F.col(col))) for m in REFERENCE_METHODS]
    return join_groups(df, n_methods, by).groupBy(*by, key).agg(
        F.coalesce(median_of(per_method), F.lit(0.0)).alias(f"ref_{col}"),
        vote(sign, method_order(F.col("method")), F.max("n_methods"), frac).alias("voted"))


def concordance(cand: DataFrame, cand_nes: DataFrame, ref: DataFrame, ref_nes: DataFrame, by: list[str],
                on: list[str], fdr: float = DEG_FDR, lfc: float = DEG_LOG2FC, nes: float = PATHWAY_NES,
                top: int = TOP_PATHWAYS) -> DataFrame:
    """The five agreement measures of each candidate test (``by``) with its reference (``on``).

    ``ref`` holds (on, gene, ref_stat, voted); ``ref_nes`` (on, pathway,
    ref_nes, voted).  A test without enrichment keeps null pathway correlation
    and direction, and an empty significant-pathway set.
    """
    tests = settle(cand.select(*by).distinct(), "tests")
    rho_gene = spearman(cand.join(ref, [*on, "gene"]), by, "stat", "ref_stat", bounded=True, out="rho_gene")
    rho_path = spearman(cand_nes.join(ref_nes, [*on, "pathway"]), by, "nes", "ref_nes", bounded=True,
                        out="rho_pathway")

    def voted(table: DataFrame, key: str) -> DataFrame:
        return tests.join(table.filter("voted").select(*on, key), on).select(*by, key)

    genes = cand.filter((F.col("padj") < fdr) & (F.abs("log2fc") > lfc))
    paths = cand_nes.filter(F.abs("nes") > nes)
    deg = jaccard(voted(ref, "gene"), genes, by, "gene", tests, "jaccard_deg")
    path = jaccard(voted(ref_nes, "pathway"), paths, by, "pathway", tests, "jaccard_pathway")
    signs = top_abs(ref_nes, on, "ref_nes", top).filter(F.col("ref_nes") != 0).select(
        *on, "pathway", F.signum("ref_nes").cast("int").alias("ref_sign"))
    direction = direction_concordance(cand_nes, signs, by, on, "pathway", "nes")
    out = tests
    for part in (rho_gene.drop("n_pairs"), deg, rho_path.drop("n_pairs"), path, direction):
        out = out.join(part, by, "left")
    return out.select(*by, *CONCORDANCE_METRICS)


def loso(counts: DataFrame, samples: DataFrame, sets: DataFrame, n_perm: int = 100, seed: int = 42,
         fdr: float = DEG_FDR, lfc: float = DEG_LOG2FC, gene_z: float = GENE_VOTE_Z, nes: float = PATHWAY_NES,
         frac: float = VOTE_FRACTION, top: int = TOP_PATHWAYS, targets: DataFrame | None = None) -> DataFrame:
    """Concordance record per (project, srr, method) of the leave-one-sample-out evaluation.

    With ``targets`` (project, srr), as given by ``pending``, only their records are computed; they equal those of a
    full run.
    """
    counts = settle(counts, "counts")
    files = scaled_files(counts, samples)
    tests = settle(loso_tests(counts, files, targets), "loso_tests")
    scores = settle(enrich_prerank(tests, sets, TEST, n_perm, seed).filter(F.col("nes").isNotNull()), "loso_nes")
    reference, candidate = F.col("stage") == "reference", F.col("stage") == "candidate"
    ref_de, ref_nes = tests.filter(reference), scores.filter(reference)
    methods = lambda df: settle(df.groupBy(*TARGET).agg(
        F.count_distinct("method").alias("n_methods")), "n_methods")
    ref = settle(_consensus(ref_de, TARGET, "gene", "stat", gene_z, methods(ref_de), frac), "ref_genes")
    ref_paths = settle(_consensus(ref_nes, TARGET, "pathway", "nes", nes, methods(ref_nes), frac), "ref_paths")
    have_ref = ref.select(*TARGET).distinct()
    cand = tests.filter(candidate).drop("stage").join(have_ref, TARGET, "left_semi")
    return concordance(cand, scores.filter(candidate).drop("stage"), ref, ref_paths,
                       [*TARGET, "method"], TARGET, fdr, lfc, nes, top)


def whole_project(counts: DataFrame, samples: DataFrame, sets: DataFrame, n_perm: int = 100, seed: int = 42,
                  fdr: float = DEG_FDR, lfc: float = DEG_LOG2FC, nes: float = PATHWAY_NES,
                  top: int = TOP_PATHWAYS, how: str = "library") -> DataFrame:
    """Concordance of each trimmed mode's whole-project result with the untrimmed one; ``how`` names the size factors."""
    by = ["project", "mode"]
    counts = settle(counts, "counts")
    design = samples.join(counts.select("project", "srr", "mode").distinct(), ["project", "srr"])
    tests = settle(diff_test(counts, design, by, how), "project_tests")
    scores = settle(enrich_prerank(tests, sets, by, n_perm, seed).filter(F.col("nes").isNotNull()), "project_nes")
    base = F.col("mode") == BASELINE
    ref = tests.filter(base).select("project", "gene", F.col("stat").alias("ref_stat"),
                                    ((F.col("padj") < fdr) & (F.abs("log2fc") > lfc)).alias("voted"))
    ref_nes = scores.filter(base).select("project", "pathway", F.col("nes").alias("ref_nes"),
                                         (F.abs("nes") > nes).alias("voted"))
    return concordance(tests.filter(~base), scores.filter(~base), ref, ref_nes, by, ["project"],
                       fdr, lfc, nes, top)


def pending(samples: DataFrame, done: DataFrame, skips: DataFrame, n_methods: int = len(METHODS)) -> DataFrame:
    """Targets still to run: not dropped by a skip, and fewer methods done or skipped than there are.

    ``samples`` (project, srr); ``done`` (project, srr, method); ``skips``
    (project, srr, stage, method), where a target or reference skip drops the
    whole target and a candidate skip only its method.
    """
    samples = settle(samples, "samples")
    rows, gone = samples.count(), 1 << len(METHODS)

    bit, stage = F.coalesce(*[F.when(F.col("method") == m, F.lit(1 << i)) for i, m in enumerate(METHODS)]), F.col("stage")
    marks = done.select(*TARGET, bit.alias("_bit")).unionByName(skips.select(
        *TARGET, F.when(stage.isin("target", "reference"), F.lit(gone)).when(stage == "candidate", bit).alias("_bit")))
    # one number a target: a set of methods and whether it is dropped
    closed = dealt(marks.filter("_bit is not null"), TARGET, rows).groupBy(*TARGET).agg(F.bit_or("_bit").alias("_bits")).filter(
        (F.col("_bits") >= gone) | (F.bit_count("_bits") >= n_methods)).select(*TARGET)
    return dealt(samples, TARGET, rows).join(closed, TARGET, "left_anti")
