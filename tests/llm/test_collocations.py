import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shearmark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, w1 string, c int, phrase string"


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        longer = [(g, c) for g, c in counts.items() if len(g) == 3 and c >= least]
        for g, a in counts.items():
            if len(g) < 2 or a < least or len(g) == 2 and any(g in (t[:2], t[1:]) and 100 * c >= 50 * a for t, c in longer):
                continue
            score, k = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "Éa", "x\x1fy", "new", "York", "city", "w1", "z" * 300, " "]
    rows = [(None, "en"), ("", None), (" \t ", "de"), ("a " * 60, None), ("a b. a b, a b! A B? a\tb; a b: a\nb a  b " * 4, "und"), ("solo", "fr")]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts += rng.choice([["New", "york", "city"], ["of", "the"], [rng.choice(words)], [rng.choice(words)]])
        rows.append((rng.choice([" ", "  ", "\t", " , "]).join(parts) + rng.choice(["", ".", "\r"]), rng.choice(["en", "en", "fr", "zz", None])))
    rows += rows[-5:]
    rows.append((" ".join(rng.choice(words) for _ in range(40000)), "en"))
    return rows


@pytest.mark.parametrize("seed, least, top, bits", [(1, 10, 2000, 1 << 29), (2, 3, 25, 1 << 19)])
def test_equals_brute_force(spark, seed, least, top, bits):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, la, "c", 1, None) for i, (t, la) in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(frame, least, top, filter_bits=bits).collect())
    want = brute(rows, least, top)
    assert len(want) > 10 and got == want


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(frame).count() == 0


@pytest.mark.parametrize("least", [1, 4])
def test_partitions_are_counts(least):
    rng = np.random.default_rng(least)
    keys, weights = rng.integers(-1, 4, (4, 500)), rng.integers(1, 3, 500)
    depth, at, sums = collocations.multikey(keys, weights, least)
    got = {tuple(keys[:d, i]): s for d, i, s in zip(depth, at, sums)}
    want = Counter()
    for i in range(500):
        for d in range(1, 5):
            want[tuple(keys[:d, i])] += weights[i]
    assert len(got) == len(depth) and got == {k: v for k, v in want.items() if v >= least}


def test_ratio_is_exact(spark):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    rows = [(3037000500, 3037000500, 3037000501), (10, 10, 10), (999999999999999, 999999999999999, 999999999999999)]
    rows += [(a, a + rng.randrange(10**6), a + rng.randrange(10**9)) for a in (rng.randrange(1, 10**13) for _ in range(50))]
    frame = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in frame.select(collocations.ratio(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * a * a // (l * r) for a, l, r in rows]
