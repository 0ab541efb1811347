import hashlib
import random
from collections import Counter

import pytest

from shearmark.llm import substrings

SCHEMA = "doc_id long, text string, t string, _null string, marks int"


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed, vocabulary, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("aébcdef") * rng.randint(1, 3) + str(rng.randrange(vocabulary))
    shared = [[word() for _ in range(rng.randint(8, 120))] for _ in range(5)]
    texts = [None, "", " \t\n", "one", "same " * 300, "ab cd " * 400, "same " * 34, " ".join(f"w{i}" for i in range(35))]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 80))]
        texts.append(rng.choice([" ", "  ", "\n", "\x0b\t"]).join(parts) + rng.choice(["", " "]))
    texts += [texts[10], texts[10], texts[20]]
    texts += [(" ".join(f"q{seed}{k}x{i}" for i in range(p)) + " ") * 5 for k, p in enumerate((3, 9, 20, 40))]  # only in themselves
    texts.append(" ".join(str(i) for i in range(30000)) + " " + " ".join(shared[0] * 3))  # very long
    return texts


@pytest.mark.parametrize("window, anchor, heavy, seed", [(35, 8, 512, 1), (35, 8, 1, 2), (6, 3, 4, 3), (3, 3, 2, 4)])
def test_equals_brute_force(spark, window, anchor, heavy, seed):
    texts = corpus(seed, 4 if window < 10 else 1000)
    frame = spark.createDataFrame([(i, t, "x", None, 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           substrings.repeated_spans(frame, window=window, anchor=anchor, heavy=heavy).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_columns_stay(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    frame = spark.createDataFrame([(1, "a  b " + passage, None, "d", 1), (1, passage + " c", "t", None, None), (None, None, "t", "d", 2),
                                   (3, "x  y", "t", "d", 3)], SCHEMA)
    out = substrings.without_repeats(frame)
    assert out.columns == frame.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(
        [(1, "a b", None, "d", 1), (1, "c", "t", None, None), (None, None, "t", "d", 2), (3, "x  y", "t", "d", 3)], key=str)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.repeated_spans(frame.filter("doc_id = 1")).filter("n_words = 42").collect()}
    assert spans == {1: [(2, 42)]}
    assert substrings.repeated_spans(frame.limit(0)).count() == 0


def test_matching_statistics():
    rng = random.Random(5)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    weights = [rng.randint(1, 2) for _ in texts]
    automaton = substrings.Automaton()
    for t, m in zip(texts, weights):
        automaton.add(t, m)
    automaton.close()
    seen = Counter()
    for t, m in zip(texts, weights):
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                seen[tuple(t[a:b])] += m
    for t in texts:
        for e, length in enumerate(automaton.statistics(t), 1):
            assert length == max(n for n in range(e + 1) if n == 0 or seen[tuple(t[e - n:e])] >= 2)
