"""Statistical operators on small hand-made frames."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from shearmark.functions.scalars import erfc
from shearmark.operators import counts as C
from shearmark.operators import enrich as G
from shearmark.operators import stats as S
from shearmark.operators import summaries as A
from shearmark.runtime import settle
from shearmark.schemas import METHODS, method_order


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_spearman(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    data = [("a", a, b) for a, b in zip(x, y)] + [("a", None, 1.0), ("a", float("nan"), 2.0)]
    data += [("few", float(i), float(i)) for i in range(9)] + [("flat", 1.0, float(i)) for i in range(12)]
    df = spark.createDataFrame([(g, a if a is None else float(a), float(b)) for g, a, b in data], "g string, x double, y double")
    got = {r.g: (r.n_pairs, r.rho) for r in S.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"][0] == 40 and got["a"][1] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert got["few"] == (9, None) and got["flat"] == (12, None)


def test_correlation_of_a_constant_spread_over_partitions_is_null(spark):
    """Partial means of 0.1, 3310980.5 and the like do not merge to the same number."""
    df = spark.range(0, 5000, 1, 7).selectExpr("3310980.5D + id div 5000 as x", "0.1D as y", "cast(id as double) as z")
    got = df.agg(*[S.pearson(a, b).alias(a + b) for a, b in ("xy", "xz", "zy", "zz")]).first()
    assert (got.xy, got.xz, got.zy) == (None, None, None) and got.zz == pytest.approx(1)


def test_jaccard_empty_sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("one", 1)], "g string, k int")
    b = spark.createDataFrame([("x", 2), ("x", 3)], "g string, k int")
    ctx = spark.createDataFrame([("x",), ("one",), ("none",)], "g string")
    got = dict(rows(S.jaccard(a, b, ["g"], "k", ctx)))
    assert got == {"x": pytest.approx(1 / 3), "one": 0.0, "none": 1.0}
    assert dict(rows(S.jaccard(b, a, ["g"], "k", ctx))) == got


def test_sign_vote_first_significant_rules(spark):
    def methods(key, *values):
        return [("p", key, m, v) for m, v in zip(METHODS, values) if v is not None]
    data = methods("minority first", -3.0, 3.0, 3.0, 3.0) + methods("three agree", 3.0, 2.5, 0.1, 2.0)
    data += methods("two of four", 3.0, 3.0, 0.0, 0.0) + methods("weak first", 0.1, 3.0, 3.0, 3.0)
    data += methods("missing", None, 3.0, 3.0, None)
    df = spark.createDataFrame(data, "g string, k string, method string, z double")
    out = rows(S.sign_vote(df, ["g"], "k", "z", 1.96, method_order(F.col("method"))), "k")
    assert out == [("three agree",), ("weak first",)]


def test_direction_concordance_only_shared(spark):
    cand = spark.createDataFrame([("s", "U", "p1", 1.0), ("s", "U", "p2", -1.0), ("s", "A", "p9", 1.0)],
                                 "srr string, method string, pathway string, nes double")
    top = spark.createDataFrame([("s", "p1", 1), ("s", "p2", 1), ("s", "p3", -1)], "srr string, pathway string, ref_sign int")
    out = S.direction_concordance(cand, top, ["srr", "method"], ["srr"], "pathway", "nes")
    assert rows(out) == [("s", "U", 0.5)]


def test_binned_trend_edges_and_empty_bins(spark):
    df = spark.createDataFrame([("m", x, y) for x, y in
                                [(30.0, 1.0), (31.0, 3.0), (31.5, 5.0), (34.2, 7.0), (None, 9.0)]], "g string, x double, y double")
    got = {r.bin: (r.y, r.n, r.mid) for r in S.binned_trend(df, "x", "y", ["g"]).collect()}
    assert got == {1: (2.0, 2, pytest.approx(30.4995)), 2: (5.0, 1, 31.5), 3: (None, 0, 32.5), 4: (None, 0, 33.5),
                   5: (7.0, 1, 34.5)}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(30, 4, 200), rng.normal(28, 5, 200)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    edges = np.linspace(min(a.min(), b.min()) - 0.5, max(a.max(), b.max()) + 0.5, 30)
    out = S.histogram(df, ["a", "b"]).collect()
    for name, v in (("a", a), ("b", b)):
        mine = [r.n for r in sorted(out, key=lambda r: r.bin) if r.variable == name]
        assert mine == list(np.histogram(v, edges)[0])


def test_box_stats_outlier(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 5, 100)], "g string, y double")
    r = A.box_stats(df, ["g"], "y").collect()[0]
    assert (r.q1, r["median"], r.q3, r.whisker_lo, r.whisker_hi, r.outliers) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)


def test_profile_similarity_counts_absent_genes(spark):
    rng = np.random.default_rng(5)
    genes = [f"g{i}" for i in range(30)]
    u = {g: int(v) for g, v in zip(genes, rng.integers(0, 6, 30))}
    a = {g: int(rng.integers(0, v + 1)) for g, v in u.items()}
    data = [("p", "s", m, g, n) for m, t in (("U", u), ("A", a)) for g, n in t.items() if n]
    data += [("p", "other", "U", g, 1) for g in genes]
    df = spark.createDataFrame(data, "project string, srr string, mode string, gene string, count long")
    got = S.profile_similarity(df, [("U", "A")]).filter("srr = 's'").collect()[0]
    x, y = np.array([u[g] for g in genes], float), np.array([a[g] for g in genes], float)
    p, q = x / x.sum(), y / y.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jsd = (np.nansum(p * np.log(p / m)) + np.nansum(q * np.log(q / m))) / 2
    assert got.pear == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got.spear == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert got.cos == pytest.approx(x @ y / math.sqrt((x @ x) * (y @ y)))
    assert got.jsd == pytest.approx(jsd) and 0 <= got.jsd <= math.log(2)


def test_mutual_information_of_the_label_itself(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(64)], "noise double, same double, y int")
    got = dict(rows(S.mutual_information(df, ["noise", "same"], "y", 4)))
    assert got["same"] == pytest.approx(math.log(2)) and abs(got["noise"]) < 1e-9


def test_erfc(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(51)], "z double")
    for r in df.select("z", erfc(F.col("z")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.z), rel=2e-7)


def brute_test(q, inv, cond, control="control"):
    """The two-group test of one gene in plain numpy."""
    q, inv = np.asarray(q, float), np.asarray(inv, float)
    parts = [(q[m], inv[m]) for m in (np.array([c == control for c in cond]), np.array([c != control for c in cond]))]
    n = [len(v) for v, _ in parts]
    mean, r = [v.mean() for v, _ in parts], [i.mean() for _, i in parts]
    m = sum(k * v for k, v in zip(n, mean)) / sum(n)
    if m <= 0:
        return 0.0, 0.0, 1.0
    w = sum(((v - v.mean()) ** 2).sum() for v, _ in parts) / (sum(n) - 2) if sum(n) > 2 else m * inv.mean()
    a = max((w - m * inv.mean()) / m ** 2, 1e-8)
    var = [(mc * rc + a * mc ** 2) / nc / (mc + .5) ** 2 for mc, rc, nc in zip(mean, r, n)]
    beta = math.log((mean[1] + .5) / (mean[0] + .5))
    z = beta / math.sqrt(sum(var))
    return beta / math.log(2), z, math.erfc(abs(z) / math.sqrt(2))


def brute_bh(p):
    p = np.asarray(p)
    return np.array([min(1.0, min(x * len(p) / (p <= x).sum() for x in p if x >= y)) for y in p])


def brute_es(order, weight, members):
    """Extreme of the full running sum over all positions."""
    hit = np.array([g in members for g in order])
    nr, miss = weight[hit].sum(), (~hit).sum()
    steps = np.where(hit, weight / nr, -1 / miss)
    s = np.cumsum(steps)
    return s.max() if round(s.max() + s.min(), 9) >= 0 else s.min()


def brute_nes(stat, sets, n_perm):
    """NES of all sets of 15 to 500 ranked genes, or nothing under 50 ranked genes."""
    order = sorted((g for g, z in stat.items() if z != 0), key=lambda g: (-stat[g], g))
    if len(order) < 50:
        return {}
    w = np.array([abs(stat[g]) for g in order])
    out = {}
    perms = [sorted(order, key=lambda g: hashlib.md5(f"{g}|{b}|42".encode()).hexdigest()) for b in range(1, n_perm + 1)]
    for name, members in sets.items():
        found = members & set(order)
        if 15 <= len(found) <= 500:
            es = brute_es(order, w, found)
            null = [brute_es(o, w, found) for o in perms]
            same = [abs(e) for e in null if (e > 0) == (es >= 0) and e != 0]
            out[name] = (es, es / np.mean(same) if same else None)
    return out


@pytest.fixture(scope="module")
def study(spark):
    """Counts with a project that falls back (three controls), one that does not, zero genes and missing files."""
    rng = np.random.default_rng(11)
    genes = [f"g{i:02d}" for i in range(60)]
    samples, counts = [], {}
    for project, sizes in (("falls_back", (3, 4)), ("leaves_out", (4, 5)), ("one_vanishes", (1, 5))):
        for i in range(sum(sizes)):
            srr = f"S{i}"
            samples.append((project, srr, "control" if i < sizes[0] else "treatment"))
            base = {g: int(rng.poisson(4 + k % 7 + (3 if k < 12 and i >= sizes[0] else 0))) for k, g in enumerate(genes)}
            base["g59"] = 0
            for k, m in enumerate(METHODS):
                if m == "P35" and i % 4 == 1:
                    continue
                counts[project, srr, m] = {g: int(rng.binomial(v, 1 - 0.08 * k)) for g, v in base.items()}
    sets = {"top": set(genes[:16]), "fourteen": set(genes[20:34]), "fifteen": set(genes[20:35]), "all_but": set(genes[5:45])}
    rows_ = [(p, s, m, g, n) for (p, s, m), t in counts.items() for g, n in t.items() if n]
    return {
        "samples": samples, "counts": counts, "sets": sets, "genes": genes,
        "df": settle(spark.createDataFrame(rows_, "project string, srr string, mode string, gene string, count long")),
        "samples_df": spark.createDataFrame(samples, "project string, srr string, condition string"),
        "sets_df": spark.createDataFrame([(n, "na", g) for n, m in sets.items() for g in m],
                                         "set_name string, description string, gene string")}


def test_diff_test_matches_brute_force(study):
    cond = {(p, s): c for p, s, c in study["samples"]}
    df = study["df"].filter("mode = 'U'").drop("mode")
    got = {(r.project, r.gene): r for r in C.diff_test(df, study["samples_df"], ["project"]).collect()}
    for project in {p for p, _, _ in study["samples"]}:
        mine = {s: t for (p, s, m), t in study["counts"].items() if p == project and m == "U"}
        total = {s: sum(t.values()) for s, t in mine.items()}
        sf = {s: v / np.mean(list(total.values())) for s, v in total.items()}
        ids = list(mine)
        fit = {g: brute_test([mine[s][g] / sf[s] for s in ids], [1 / sf[s] for s in ids], [cond[project, s] for s in ids])
               for g in study["genes"] if any(mine[s][g] for s in ids)}
        padj = dict(zip(fit, brute_bh([v[2] for v in fit.values()])))
        for g, (l2, z, p) in fit.items():
            r = got[project, g]
            assert (r.log2fc, r.stat) == pytest.approx((l2, z)) and r.pvalue == pytest.approx(p, rel=1e-5)
            assert r.padj == pytest.approx(padj[g], rel=1e-5)


def test_size_factors_median_ratio(spark):
    data = [("p", s, g, n * k) for s, k in (("a", 1), ("b", 2), ("c", 4)) for g, n in (("x", 5), ("y", 9), ("z", 3))]
    data += [("p", "a", "only", 7), ("q", "a", "x", 10), ("q", "b", "y", 30)]
    df = spark.createDataFrame(data, "project string, srr string, gene string, count long")
    got = {(r.project, r.srr): r.size_factor for r in C.size_factors(df, ["project"]).collect()}
    assert [got["p", s] for s in "abc"] == pytest.approx([0.5, 1, 2])
    assert (got["q", "a"], got["q", "b"]) == (0.5, 1.5)  # no gene positive everywhere: library size


def test_leave_one_out_rules(study):
    got = {(r.project, r.srr): (r.leave, r.n_same, r.n_other) for r in C.leave_one_out(study["samples_df"]).collect()}
    assert got["falls_back", "S0"] == (False, 3, 4) and got["falls_back", "S5"] == (True, 3, 3)
    assert got["leaves_out", "S0"] == (True, 3, 5)
    assert got["one_vanishes", "S0"] == (True, 0, 5)  # the condition vanishes: no fallback
    assert got["one_vanishes", "S3"] == (False, 5, 1)


def test_enrichment_matches_brute_force(spark, study):
    rng = np.random.default_rng(2)
    stats = {t: {g: float(z) for g, z in zip(study["genes"], rng.normal(0, 1, 60))} for t in ("a", "b")}
    stats["a"]["g01"] = stats["a"]["g02"] = 0.0
    stats["b"]["g03"] = stats["b"]["g04"]  # a tie is broken by name
    stats["few"] = {g: (1.0 if i < 49 else 0.0) for i, g in enumerate(study["genes"])}
    df = spark.createDataFrame([(t, g, z) for t, v in stats.items() for g, z in v.items()], "t string, gene string, stat double")
    got = {(r.t, r.pathway): (r.es, r.nes) for r in G.enrich_prerank(df, study["sets_df"], ["t"], n_perm=12).collect()}
    want = {(t, n): v for t, s in stats.items() for n, v in brute_nes(s, study["sets"], 12).items()}
    assert got.keys() == want.keys() and not any(n == "fourteen" for _, n in got)
    for k, (es, nes) in want.items():
        assert got[k][0] == pytest.approx(es), k
        assert got[k][1] == (None if nes is None else pytest.approx(nes)), k


def test_es_is_one_for_the_top_of_the_list(spark):
    ranked = spark.createDataFrame([("t", f"g{i:03d}", float(100 - i)) for i in range(80)], "t string, gene string, stat double")
    sets = spark.createDataFrame([("top", "", f"g{i:03d}") for i in range(20)], "set_name string, description string, gene string")
    r = G.enrich_prerank(ranked, sets, ["t"], n_perm=5).collect()[0]
    assert r.es == pytest.approx(1.0) and r.nes > 1


def brute_loso(study, n_perm, gene_z, fdr, lfc):
    """The leave-one-out evaluation sample by sample, as a dict of the five measures."""
    def rho(a, b):
        keys = sorted(a.keys() & b.keys())
        if len(keys) < 10:
            return None
        x, y = ranks([a[k] for k in keys]), ranks([b[k] for k in keys])
        return float(np.corrcoef(x, y)[0, 1])

    def jac(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    out = {}
    for project in sorted({p for p, _, _ in study["samples"]}):
        cond = {s: c for p, s, c in study["samples"] if p == project}
        files = {(s, m): t for (p, s, m), t in study["counts"].items() if p == project}
        depth = np.mean([sum(files[s, "U"].values()) for s in cond])
        sf = {k: sum(t.values()) / depth for k, t in files.items()}
        universe = [g for g in study["genes"] if any(files[s, "U"][g] for s in cond)]

        def run(cols):
            labels = [cond[s] for s, _ in cols]
            if len(set(labels)) < 2:
                return None
            inv = [1 / sf[c] for c in cols]
            fit = {g: brute_test([files[c][g] / sf[c] for c in cols], inv, labels) for g in universe}
            return fit, dict(zip(fit, brute_bh([v[2] for v in fit.values()])))

        for target in cond:
            others = [s for s in cond if s != target]
            left = [sum(cond[s] == c for s in others) for c in {cond[s] for s in others}]
            if any(n < 3 for n in left):
                others = list(cond)
            z, nes = {}, {}
            for m in ("U", "A", "P5", "P10"):
                cols = [(s, m) for s in others if (s, m) in files]
                fit = run(cols) if len(cols) >= 4 else None
                if fit is None:
                    continue
                z[m] = {g: v[1] for g, v in fit[0].items()}
                found = {k: v[1] for k, v in brute_nes(z[m], study["sets"], n_perm).items() if v[1] is not None}
                if found:
                    nes[m] = found
            if not z:
                continue

            def consensus(table, thr):
                keys = set().union(*[t.keys() for t in table.values()]) if table else set()
                med = {k: float(np.median([t[k] for t in table.values() if k in t])) for k in keys}
                vote = set()
                for k in keys:
                    signs = [np.sign(t[k]) for t in table.values() if k in t and abs(t[k]) > thr]
                    if signs and signs.count(signs[0]) / len(table) >= 0.75:
                        vote.add(k)
                return med, vote

            ref, ref_deg = consensus(z, gene_z)
            ref_nes, ref_path = consensus(nes, 1.0)
            top = sorted(ref_nes, key=lambda k: (-abs(ref_nes[k]), k))[:20]
            for m in METHODS:
                if (target, m) not in files:
                    continue
                fit = run([(s, "U") for s in others] + [(target, m)])
                if fit is None:
                    continue
                zc = {g: v[1] for g, v in fit[0].items()}
                pc = {k: v[1] for k, v in brute_nes(zc, study["sets"], n_perm).items() if v[1] is not None}
                deg = {g for g, v in fit[0].items() if fit[1][g] < fdr and abs(v[0]) > lfc}
                shared = [k for k in top if k in pc and ref_nes[k] != 0]
                out[project, target, m] = (
                    rho(zc, ref), jac(ref_deg, deg), rho(pc, ref_nes), jac(ref_path, {k for k, v in pc.items() if abs(v) > 1}),
                    float(np.mean([np.sign(pc[k]) == np.sign(ref_nes[k]) for k in shared])) if shared else None)
    return out


def test_loso_matches_brute_force(study):
    from shearmark.plans.loso import loso
    want = brute_loso(study, 6, 1.0, 0.6, 0.2)
    got = loso(study["df"], study["samples_df"], study["sets_df"], n_perm=6, gene_z=1.0, fdr=0.6, lfc=0.2).collect()
    mine = {(r.project, r.srr, r.method): (r.rho_gene, r.jaccard_deg, r.rho_pathway, r.jaccard_pathway, r.dir_concordance)
            for r in got}
    assert mine.keys() == want.keys()
    assert ("falls_back", "S1", "P35") not in mine and ("one_vanishes", "S0", "U") not in mine
    for k, w in want.items():
        for a, b in zip(mine[k], w):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), (k, mine[k], w)


def test_pending(spark):
    from shearmark.plans.loso import pending
    targets = spark.createDataFrame([("p", s) for s in "abcde"], "project string, srr string")
    done = [("p", "a", m) for m in METHODS] + [("p", "b", m) for m in METHODS[:5]] + [("p", "c", m) for m in METHODS[:5]]
    skips = [("p", "b", "candidate", "P35"), ("p", "d", "reference", "U"), ("p", "c", "candidate", "P20")]
    out = pending(targets, spark.createDataFrame(done, "project string, srr string, method string"),
                  spark.createDataFrame(skips, "project string, srr string, stage string, method string"))
    assert rows(out, "srr") == [("c",), ("e",)]


def test_tasks_of_pending_grow_with_its_targets(spark, monkeypatch):
    from shearmark import runtime
    from shearmark.plans import loso
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    samples = spark.range(200).selectExpr("concat('P', id % 3) as project", "concat('S', id) as srr")
    done = samples.filter("project = 'P1'").crossJoin(spark.createDataFrame([(m,) for m in (*METHODS, "other")], "method string"))
    skips = samples.filter("project = 'P2'").selectExpr("*", "'reference_method' as stage", "'U' as method")
    left = loso.pending(samples, done, skips)
    assert left.rdd.getNumPartitions() >= 20 and {r.project for r in left.collect()} == {"P0", "P2"} and left.count() == 133


def test_loso_keeps_targets_of_every_condition(spark):
    from shearmark.plans.loso import loso_tests, scaled_files
    rng, genes = np.random.default_rng(5), [f"g{i:02d}" for i in range(8)]
    cond = {("even", f"S{i:02d}"): "abc"[i // 4] for i in range(12)}
    cond |= {("single", f"S{i}"): "abbbbcccc"[i] for i in range(9)}  # without S0, b is contrasted with c
    cond |= {("usual", f"S{i:02d}"): ("control", "dose", "treatment")[i // 4] for i in range(12)}
    counts = {(p, s, m, g): int(rng.poisson(20 + 5 * k)) + 1 for p, s in cond for m in METHODS for k, g in enumerate(genes)}
    df = settle(spark.createDataFrame([(*k, n) for k, n in counts.items()], "project string, srr string, mode string, gene string, count long"))
    samples = spark.createDataFrame([(p, s, c) for (p, s), c in cond.items()], "project string, srr string, condition string")
    got = {(r.project, r.srr, r.stage, r.method, r.gene): (r.log2fc, r.stat) for r in loso_tests(df, scaled_files(df, samples)).collect()}
    total = {(p, s, m): sum(counts[p, s, m, g] for g in genes) for p, s in cond for m in METHODS}
    want = {}
    for project, target in cond:
        mine = {s: c for (p, s), c in cond.items() if p == project}
        depth = np.mean([total[project, s, "U"] for s in mine])
        others = [s for s in mine if s != target]
        if any(sum(mine[s] == c for s in others) < 3 for c in {mine[s] for s in others}):
            others = list(mine)
        tests = [("reference", m, [(s, m) for s in others]) for m in ("U", "A", "P5", "P10")]
        tests += [("candidate", m, [(s, "U") for s in others] + [(target, m)]) for m in METHODS]
        for stage, method, cols in tests:
            names = sorted({mine[s] for s, _ in cols})
            low, high = ("control", "treatment") if {"control", "treatment"} <= set(names) else names[:2]
            cols = [c for c in cols if mine[c[0]] in (low, high)]
            sf = [total[project, s, m] / depth for s, m in cols]
            for g in genes:
                want[project, target, stage, method, g] = brute_test(
                    [counts[project, s, m, g] / f for (s, m), f in zip(cols, sf)], [1 / f for f in sf], [mine[s] for s, _ in cols], low)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w[:2], abs=1e-9), k


def test_dispersions_are_drawn_to_their_trend(spark):
    """Against numpy: trend by least squares on 1 / mean, prior from the residuals, weighted mean on the log scale."""
    rng = np.random.default_rng(8)
    data = []
    for t in range(3):
        n0, n1 = 3 + t, 4
        for g in range(120 if t < 2 else 2):
            m0, m1 = rng.uniform(2, 200), rng.uniform(2, 200)
            spread = (0.3 + 4 / m0) * rng.lognormal(0, 0.8)
            q0, q1 = n0 * m0 * m0 * (1 + spread), n1 * m1 * m1 * (1 + spread)
            if g % 10 == 0:
                q0, q1 = n0 * m0 * m0, n1 * m1 * m1  # nothing above the least dispersion
            data.append((t, g, float(n0), float(n1), float(n0), float(n1), n0 * m0, n1 * m1, q0, q1))
    df = spark.createDataFrame(data, "t int, g int, n0 double, n1 double, r0 double, r1 double, s0 double, s1 double, q0 double, q1 double")
    plain = settle(C.dispersions(df))
    got = {(r.t, r.g): r.alpha for r in C.shrunken(plain, ["t"]).collect()}
    for t in range(3):
        own = sorted(plain.filter(f"t = {t}").collect(), key=lambda r: r.g)
        a, m = np.array([r.alpha for r in own]), np.array([r.m for r in own])
        ok = a > 1e-8
        slope, base = np.polyfit(1 / m[ok], a[ok], 1) if ok.sum() > 2 else (0.0, a[ok].mean())
        trend = np.maximum(base + slope / m, 1e-8)
        half = (own[0].n0 + own[0].n1 - 2) / 2
        noise = sum(1 / (half + k) ** 2 for k in range(200000))
        prior = max(np.var(np.log(a[ok]) - np.log(trend[ok])) - noise, 0.25)
        w = prior / (prior + noise)
        want = np.where(ok, np.exp(w * np.log(a) + (1 - w) * np.log(trend)), trend)
        assert [got[t, r.g] for r in own] == pytest.approx(want.tolist(), rel=1e-4)


def test_nearest_information_matches_brute_force(spark):
    """Ties, constants, a label of one point, a label of fewer points than neighbours."""
    rng = np.random.default_rng(12)
    label = ["a"] * 70 + ["b"] * 40 + ["c"] * 3 + ["d"]
    shift = {"a": 0, "b": 40, "c": 90, "d": 5}
    frames = {"near": [float(shift[c] + rng.integers(-30, 30)) / 64 for c in label], "noise": [float(rng.integers(0, 4000)) / 64 for _ in label],
              "tied": [float(shift[c] // 40) for c in label], "constant": [1.0] * len(label)}
    data = [(c, *[v[i] for v in frames.values()]) for i, c in enumerate(label)] + [("a", None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "label string, " + ", ".join(f"{f} double" for f in frames))
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    got = {r.feature: r.mutual_information for r in S.nearest_information(df, list(frames), "label", 3).collect()}
    for f, values in frames.items():
        kept = [(v, c) for v, c in zip(values, label) if label.count(c) > 1]
        total = 0.0
        for i, (v, c) in enumerate(kept):
            own = sorted(abs(v - w) for j, (w, d) in enumerate(kept) if d == c and j != i)
            k = min(3, len(own))
            r = own[k - 1]
            m = sum((abs(v - w) < r) if r > 0 else v == w for w, _ in kept)
            total += psi(k) - psi(len(own) + 1) - psi(m)
        assert got[f] == pytest.approx(max(0.0, psi(len(kept)) + total / len(kept)), abs=1e-9), f


def test_folds_of_the_forest_are_fitted_two_at_a_time_with_the_same_result(spark, monkeypatch):
    import threading

    from pyspark.ml import Pipeline

    from shearmark.plans.qcmodel import qc_forest

    rows = [(f"S{i}", f"P{i % 9}", float(i % 7), float(i % 5), "U" if i % 7 > 3 else "A") for i in range(180)]
    table = spark.createDataFrame(rows, "SRR_ID string, project_id string, a double, b double, t_star string")
    forest = lambda n: sorted(map(tuple, qc_forest(table, ["a", "b"], folds=2, trees=3, parallelism=n).collect()))
    one = forest(1)
    assert len(one) == len(rows)
    both, fit = threading.Barrier(2, timeout=60), Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *args: both.wait() is not None and fit(self, *args))
    assert forest(2) == one
    assert {r[0] for r in qc_forest(table, ["a", "b"], folds=2, trees=3).collect()} == {r[0] for r in rows}
