"""Order statistics: the spread evaluation must equal the plain one and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from shearmark.operators import ordering as O
from shearmark.operators import stats as ST
from shearmark import runtime
from shearmark.runtime import grid_join, join_groups, settle


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of the rows in one group, half of those with one value; null keys and null values."""
    rng = np.random.default_rng(7)
    data = [("hot", float(v)) for v in rng.integers(0, 40, 150)] + [("hot", 7.0)] * 150
    data += [(f"g{i % 5}", float(v)) for i, v in enumerate(rng.normal(0, 3, 60))]
    data += [(None, 1.0), (None, 2.0), (None, None), ("empty", None)]
    return settle(spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id int, g string, v double"))


def by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, [])
        if r.v is not None:
            out[r.g].append(r.v)
    return out


@pytest.mark.parametrize("limit", [10**6, 5])
def test_summarise_matches_numpy(skewed, limit):
    wanted = {k: (len(v), *(np.quantile(v, p) if v else None for p in (0.25, 0.5, 0.9)))
              for k, v in by_group(skewed).items()}
    got = O.summarise(skewed, ["g"], {"a": ("v", 0.25), "b": ("v", 0.5), "c": ("v", 0.9)}, [F.count("v").alias("n")], limit)
    got = {r.g: (r.n, r.a, r.b, r.c) for r in got.collect()}
    assert got.keys() == wanted.keys()
    for k in wanted:
        assert got[k] == pytest.approx(wanted[k]), k


@pytest.mark.parametrize("limit", [10**6, 5])
def test_summarise_without_groups(skewed, limit):
    values = [v for vs in by_group(skewed).values() for v in vs]
    row = O.summarise(skewed, [], {"m": ("v", 0.5)}, [F.max("v").alias("top")], limit).collect()
    assert len(row) == 1 and row[0].m == pytest.approx(np.median(values)) and row[0].top == max(values)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_avg_rank_matches_brute_force(skewed, limit):
    df = skewed.filter("v is not null and g is not null")
    groups = by_group(df)
    for r in O.avg_rank(df, ["g"], "v", limit=limit).collect():
        vs = np.array(groups[r.g])
        assert r["rank"] == pytest.approx((vs < r.v).sum() + ((vs == r.v).sum() + 1) / 2)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_bh_adjust(skewed, limit):
    df = skewed.filter("v is not null and g is not null").withColumn("p", F.abs(F.col("v")) / 50)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.p)
    got = O.bh_adjust(df, ["g"], "p", limit=limit).collect()
    assert len(got) == df.count()
    for r in got:
        ps = np.array(groups[r.g])
        want = min(min(1.0, p * len(ps) / (ps <= p).sum()) for p in ps if p >= r.p)
        assert r.padj == pytest.approx(want) and r.padj >= r.p - 1e-12


def test_join_groups_salted_equals_broadcast(skewed):
    per = settle(skewed.groupBy("g").agg(F.count("*").alias("n")))
    assert rows(join_groups(skewed, per, ["g"], limit=0)) == rows(join_groups(skewed, per, ["g"]))
    assert join_groups(skewed, per, ["g"], limit=0).count() == skewed.count()


def test_groups_past_the_limit_are_not_broadcast_by_their_file_size(skewed):
    per = settle(skewed.groupBy("g").agg(F.count("*").alias("n")))
    plan = join_groups(skewed, per, ["g"], limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_groups_of_few_rows_are_not_copied_for_salts(skewed, monkeypatch):
    per = settle(skewed.groupBy("g").agg(F.count("*").alias("n")))
    got = join_groups(skewed, per, ["g"], limit=0, largest=skewed.count())
    assert "salt" not in got._jdf.queryExecution().toString() and rows(got) == rows(join_groups(skewed, per, ["g"]))
    seen, plain = [], O.join_groups
    monkeypatch.setattr(O, "join_groups", lambda *a, **k: seen.append(k.get("largest")) or plain(*a, **k, limit=0))
    want = {r.g: r.m for r in skewed.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = O.summarise(skewed.select("g", "v"), ["g"], {"m": ("v", 0.5)})
    assert {r.g: r.m for r in got.collect()} == pytest.approx(want) and seen and None not in seen


def test_top_and_tail_reduce_before_the_shuffle(skewed):
    plan = O.top_abs(skewed, ["g"], "v", 3, "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    top = {(r.g, r.v) for r in O.top_abs(skewed.filter("g = 'hot'"), ["g"], "v", 2, "id").collect()}
    assert max(v for _, v in top) == 39.0 or len(top) <= 2


def test_tail_mean_with_short_group(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(15)] + [("b", 1, 3.0), ("b", 2, 5.0)],
                               "g string, pos int, q double")
    assert rows(O.tail_mean(df, ["g"], "pos", "q")) == [("a", 9.5), ("b", 4.0)]


def test_rank_list_drops_zeros_and_small_groups(spark):
    df = spark.createDataFrame([("a", f"g{i:02d}", float(i - 30)) for i in range(52)]
                               + [("b", f"g{i:02d}", 1.0) for i in range(49)], "t string, gene string, stat double")
    out = O.rank_list(df, ["t"]).collect()
    assert {r.t for r in out} == {"a"} and len(out) == 51 and {r.n_genes for r in out} == {51}
    assert [r.gene for r in sorted(out, key=lambda r: r.pos)][0] == "g51"


def test_first_sign(spark):
    df = spark.createDataFrame([("x", 0, 0.5), ("x", 1, -3.0), ("x", 2, 4.0), ("y", 0, 0.1)], "k string, o int, z double")
    assert rows(O.first_sign(df, ["k"], "z", F.col("o"), 1.96)) == [("x", -1)]


class Session:
    """A session whose settings and master are given."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext = self, self
        self.master, self.folder, self.applicationId = master, folder, f"app-{master}"

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_intermediate_tables_go_to_the_shared_folder():
    assert runtime.shared_folder(Session("yarn", "hdfs:///ck/"), "t").startswith("hdfs:///ck/shearmark/t-")
    with pytest.raises(ValueError):
        runtime.shared_folder(Session("yarn"))
    a, b = runtime.shared_folder(Session("local[2]")), runtime.shared_folder(Session("local[2]"))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_grid_join_is_the_plain_join(spark):
    genes = spark.createDataFrame([("p", f"g{i}") for i in range(9)] + [("q", "g0")], "project string, gene string")
    ids = spark.createDataFrame([("p", f"s{i}") for i in range(7)] + [("r", "s0")], "project string, srr string")
    assert rows(grid_join(genes, ids, ["project"], "gene", "srr")) == rows(genes.join(ids, ["project"]))


def test_keys_with_many_rows_join_apart(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(60)], "k int, i int")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    want = rows(df.join(per, "k"))
    for limit in (0, 15, 10**6):
        assert rows(O.join_per_key(df, per, ["k"], limit=limit)) == want


@pytest.mark.parametrize("job", [lambda d, n: O.avg_rank(d, ["g"], "v", limit=n), lambda d, n: O.bh_adjust(d, ["g"], "v", limit=n)])
def test_both_sides_of_the_limit_keep_null_rows_and_columns(spark, job):
    data = [("a", 0.1, 7), ("a", 0.1, 8), ("a", None, 9), (None, 0.2, 1), (None, None, 2), (None, 0.2, 3), ("b", 0.5, 4), ("a", 0.1, 7)]
    df = spark.createDataFrame(data, "g string, v double, n int")
    plain, spread = job(df, 10**6), job(df, 1)
    assert plain.columns == spread.columns and len(rows(plain)) == len(data)
    assert rows(plain) == rows(spread)


def test_histogram_of_a_constant_column(spark):
    got = ST.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"], 5, pad=0).collect()
    assert sorted((r.bin, r.n) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_quantiles_of_hard_values(spark):
    """Many magnitudes, both signs, zeros, neighbours in the last bit, ties, infinities, NaN; every leaf size."""
    rng = np.random.default_rng(3)
    near = [1.0]
    for _ in range(40):
        near.append(float(np.nextafter(near[-1], 2)))
    groups = {"wide": [float(s * 2.0**e) for e in range(-1060, 1000, 13) for s in (1, -1)] + [0.0, -0.0, 5e-324],
              "near": near, "tied": [2.5] * 999 + [3.5], "large": rng.lognormal(0, 3, 9000).tolist(), "one": [7.0],
              "inf": [float("inf"), float("-inf"), 1.0, 2.0, 3.0], "nan": [1.0, 2.0, float("nan")]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for leaf in (1, 16, O.LEAF_VALUES):
        got = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in
               O.summarise(frame, ["g"], {f"q{i}": ("v", p) for i, p in enumerate(probs)}, leaf=leaf).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            vs = sorted(vs, key=lambda v: (v != v, v))
            for p, mine in zip(probs, got[g]):
                h = (len(vs) - 1) * p
                lo, hi = vs[int(np.floor(h))], vs[int(np.ceil(h))]
                want = lo if lo == hi or lo != lo else lo + (hi - lo) * (h - np.floor(h))
                assert mine == want or mine == pytest.approx(want, rel=1e-15) or (mine != mine and want != want), (g, p, leaf)
    assert O.summarise(frame.limit(0), [], {"m": ("v", 0.5)}, [F.count("v").alias("n")]).collect() == [(0, None)]
    assert O.summarise(frame.limit(0), ["g"], {"m": ("v", 0.5)}).count() == 0


def test_following_crosses_pieces(spark):
    values = [(g, b) for g in (None, "a", "b") for b in range(0, 300, 7 if g == "a" else 3)]
    frame = spark.createDataFrame(values, "g string, b long")
    got = {(r.g, r.b): r.n for r in O.following(frame, ["g"], "b", "n").collect()}
    want = {}
    for g in (None, "a", "b"):
        own = sorted(b for k, b in values if k == g)
        want |= {(g, a): b for a, b in zip(own, [*own[1:], None])}
    assert got == want
