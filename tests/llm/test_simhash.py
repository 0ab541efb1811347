import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shearmark.llm import simhash

SCHEMA = "doc_id long, text string, root string, f0 string"


def brute_print(text, words, seed=42):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42 if seed is None else seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """Smallest id reachable, by a plain search."""
    seen, out = set(), {}
    for i in sorted(prints):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            a = front.pop()
            for b in prints:
                if b not in group and bin(prints[a] ^ prints[b]).count("1") <= radius:
                    group.add(b)
                    front.append(b)
        seen |= group
        out.update((g, min(group)) for g in group)
    return out


def documents(n=160):
    rnd, rows = random.Random(5), []
    for i in range(n):
        if i % 4 and rows:
            words = random.Random(rnd.randrange(i // 4 + 1)).choices("abcdefghijklmnopqrstuvwxyz", k=200)
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(200)] = rnd.choice("xyz")
            rows.append((i, " ".join(words), "r", "f"))
        else:
            rows.append((i, " ".join(rnd.choices("abcdefgh", k=rnd.choice([0, 1, 3, 50]))), "r", "f"))
    return rows + [(1000, None, None, None), (1001, "", "", ""), (1002, " \t\n", "", ""), (1003, "A b\x0bC  d E", "", ""),
                   (1004, "a B c d\re", "", ""), (1005, "one huge " * 30000, "", "")]


@pytest.mark.parametrize("bucket_rows", [40, 4096])
def test_groups_equal_a_plain_search(spark, bucket_rows):
    rows = documents()
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows).collect()
    prints = {r[0]: brute_print(r[1], 4) for r in rows if r[0] != 1005} | {1005: int(next(
        g.fingerprint for g in got if g.doc_id == 1005), 16)}
    assert {g.doc_id: g.fingerprint for g in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {g.doc_id: g.component_id for g in got} == brute_groups(prints, 4)


@pytest.mark.parametrize("parts, radius", [(4, 19), (5, 23)])
def test_wide_prints_with_parts_find_every_link(spark, parts, radius):
    rows = documents(80)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {g.doc_id: g for g in simhash.near_groups(frame, 5, 2, parts, radius).collect()}
    prints = {i: int(g.fingerprint, 16) for i, g in got.items()}
    assert {i: g.component_id for i, g in got.items()} == brute_groups(prints, radius)


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover_every_set_of_positions(radius):
    rnd = random.Random(2)
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flipped = sum(1 << p for p in rnd.sample(range(64), radius))
        assert any(not m & flipped for m in masks)


def test_large_buckets_are_dealt_again_and_lose_nothing(spark):
    rnd, base = random.Random(3), 0x123456789ABCDEF
    prints = sorted({base} | {base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4))) for _ in range(1500)})
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "f0 long")
    edges = simhash.links(frame, bucket_rows=64).collect()
    group = defaultdict(set)
    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        group[a].add(b)
        group[b].add(a)
    front, seen = [simhash.signed(base)], {simhash.signed(base)}
    while front:
        new = group[front.pop()] - seen
        seen |= new
        front.extend(new)
    assert len(seen) == len(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (900, 901)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(40)}, 900: 900, 901: 900}


def test_empty_tables_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a b", "", "1"), (3, "a b", "", "2"), (3, "a b", "", "2")], SCHEMA)
    assert {g.component_id for g in simhash.near_groups(frame).collect()} == {3}
    assert simhash.near_groups(frame.limit(0)).count() == 0
    stays = simhash.near_deduplicated(frame)
    assert stays.columns == frame.columns and stays.count() == 1
    assert simhash.near_deduplicated(frame.limit(0)).count() == 0


def test_spark_and_python_hash_alike(spark):
    words = ["", "a", "abc d", "x" * 33, "é ü 日本"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r.h & (2**64 - 1) == xxhash.xxh64_intdigest(r.w.encode(), 42) for r in got)


def brute_kept(rows, words=5, similarity=0.8):
    """First row of each component of exact Jaccard similarity; texts without words are copies of each other only."""
    def shingles(text):
        found = (text or "").lower().split()
        return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    sets, seen, kept = [shingles(r[1]) for r in rows], set(), set()
    for i, mine in enumerate(sets):
        if i in seen:
            continue
        kept.add(rows[i][0])
        front = [i]
        seen.add(i)
        while front:
            a = sets[front.pop()]
            new = [k for k, b in enumerate(sets) if k not in seen and (a == b or len(a & b) / len(a | b) >= similarity)]
            seen.update(new)
            front.extend(new)
    return kept


def mixed_documents():
    """Texts whose similarity to their original is around 0.8 on both sides, and many short ones."""
    rnd, rows = random.Random(11), [(0, "", "r", "f"), (1, None, "r", "f")]
    for k in range(40):
        base = [f"w{rnd.randrange(9999)}" for _ in range(rnd.choice([60, 120, 300]))]
        rows.append((len(rows), " ".join(base), "r", "f"))
        for _ in range(6):
            other = list(base)
            for at in rnd.sample(range(len(base)), rnd.randrange(1, max(2, len(base) // 15))):
                other[at] = f"x{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(other), "r", "f"))
    for _ in range(200):
        rows.append((len(rows), " ".join(f"w{rnd.randrange(9999)}" for _ in range(6)), "r", "f"))
    return rows


@pytest.mark.parametrize("block_rows", [3, 256])
def test_near_dedup_drops_by_exact_similarity(spark, block_rows):
    rows = mixed_documents()
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r.doc_id for r in simhash.near_deduplicated(frame, block_rows=block_rows).collect()}
    assert got == brute_kept(rows)


def test_forest_of_similar_sets_spans_their_components():
    import numpy as np

    rnd = random.Random(4)
    for n in (2, 30, 90):
        sets = [np.unique(np.array([rnd.randrange(14) for _ in range(rnd.randrange(3, 14))], dtype=np.uint64)) for _ in range(n)]
        got, want = list(range(n)), list(range(n))
        for label, edges in ((got, simhash.similar_forest(sets, 0.8)),
                             (want, [(a, b) for a in range(n) for b in range(a) if len(np.intersect1d(sets[a], sets[b]))
                                     / len(np.union1d(sets[a], sets[b])) >= 0.8])):
            for a, b in edges:
                old, new = label[a], label[b]
                label[:] = [new if x == old else x for x in label]
        groups = lambda label: {tuple(i for i in range(n) if label[i] == x) for x in label}
        assert groups(got) == groups(want)


def test_links_of_a_dense_group_grow_with_its_rows(spark):
    rnd, base = random.Random(5), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(1200):
        other = list(base)
        other[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(base if i % 3 else other), 7, 1200 // 64))
    loners = [(2000 + i, " ".join(f"y{i}z{k}" for k in range(30)), 7, 1200 // 64) for i in range(20)]
    pair = [(3000, " ".join(f"p{k}" for k in range(60)), 7, 1200 // 64), (3001, " ".join(f"p{k}" for k in range(58)), 7, 1200 // 64)]
    members = spark.createDataFrame(rows + loners + pair, "_row long, _text string, root long, blocks long")
    links = simhash.similar_links(members, 5, 0.8, 64)
    assert links.count() < 2 * len(rows)
    got = {(r.node, r.root) for r in simhash.components(links).collect()}
    assert got == {(i, 0) for i in range(1200)} | {(3000, 3000), (3001, 3000)}


def test_links_of_a_dense_bucket_group_are_few_and_lose_nothing(spark):
    rnd, base = random.Random(9), rnd_bits(128, 1)
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(128), rnd.randrange(1, 14))) for _ in range(1200)}
                    | {base ^ sum(1 << b for b in rnd.sample(range(128), 40)) for _ in range(60)})
    lane = lambda p, i: simhash.signed(p >> 64 * i & (2**64 - 1))
    frame = spark.createDataFrame([(lane(p, 0), lane(p, 1)) for p in prints], "f0 long, f1 long")
    edges = [tuple(r) for r in simhash.links(frame, 2, 7, 32).collect()]
    assert len(edges) < 8 * len(prints)
    number, label = {(lane(p, 0), lane(p, 1)): p for p in prints}, {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a0, a1, b0, b1 in edges:
        a, b = number[a0, a1], number[b0, b1]
        assert bin(a ^ b).count("1") <= 32
        x, y = sorted((root(a), root(b)))
        label[y] = x
    assert {p: root(p) for p in prints} == brute_groups({p: p for p in prints}, 32)


def rnd_bits(bits, seed):
    return random.Random(seed).getrandbits(bits)


def test_finished_stars_need_no_round(spark, monkeypatch):
    made, settle = [], simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda df, name="table": made.append(name) or settle(df, name))
    got = dict(simhash.components(spark.createDataFrame([(0, i) for i in range(1, 50)] + [(90, 91)], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(50)}, 90: 90, 91: 90} and made == ["edges", "low"]


def test_copies_are_all_but_the_least_row_of_every_component_of_links(spark):
    rnd, rows = random.Random(6), []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(70):
            words = list(words)
            words[rnd.randrange(60)] = f"x{g}y{i}"  # a chain: far ends are not similar
            rows.append((100 * g + rnd.randrange(1, 9) * 1000 + i, " ".join(words), 7, 6))
    members = spark.createDataFrame(rows, "_row long, _text string, root long, blocks long")
    links, copies = simhash.similar_copies(members, 5, 0.8, 32)
    want = {r.node for r in simhash.components(links).collect() if r.node != r.root}
    got = [r[0] for r in copies.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tables_of_unequal_radii_miss_no_pair_within_the_radius():
    tables = simhash.first_tables(2, 7, 32)
    assert len(tables) == 5 * 31 + 2 * 15 and sum(simhash.part_radii(7, 32)) == 26
    rnd = random.Random(12)
    for _ in range(2000):
        spread = [5] * 5 + [4, 3]  # 32 bits as evenly as can be: only the last part is within its radius
        rnd.shuffle(spread)
        flipped = sum(1 << b for p, n in enumerate(spread) for b in rnd.sample(range(18 * p, 18 * p + 18), n))
        assert any(not t.mask & flipped for t in tables)


def brute_connected(number, edges):
    label = {p: p for p in number.values()}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a0, a1, b0, b1 in edges:
        x, y = sorted((root(number[a0, a1]), root(number[b0, b1])))
        label[y] = x
    return {p: root(p) for p in label}


@pytest.mark.parametrize("similarity", [0.0, 0.8])
def test_large_buckets_with_few_open_bits_are_searched_as_they_are(spark, monkeypatch, similarity):
    """Dealing them again copies every row 31 times and saves no comparison: at 2.5 million texts that filled the disk."""
    made, settle = [], simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda df, name="table": made.append(name) or settle(df, name))
    rnd, lane = random.Random(8), lambda p, i: simhash.signed(p >> 64 * i & (2**64 - 1))
    bases = [rnd.getrandbits(128) for _ in range(300)]
    prints = bases + [rnd.choice(bases[:60]) ^ sum(1 << b for b in rnd.sample(range(128), rnd.randrange(1, 33))) for _ in range(900)]
    sizes = {p: rnd.randrange(5, 400) for p in prints}
    frame = spark.createDataFrame([(lane(p, 0), lane(p, 1), n) for p, n in sizes.items()], "f0 long, f1 long, n long")
    edges = [tuple(r) for r in simhash.links(frame, 2, 7, 32, bucket_rows=2, similarity=similarity).collect()]
    assert made == ["links"]
    got = brute_connected({(lane(p, 0), lane(p, 1)): p for p in sizes}, edges)
    todo = [(a, b) for a in sizes for b in sizes if a < b and bin(a ^ b).count("1") <= 32]
    must = [(a, b) for a, b in todo if min(sizes[a], sizes[b]) >= similarity * max(sizes[a], sizes[b])]
    assert must and all(got[a] == got[b] for a, b in must)
    assert all(bin((a0 ^ b0) & (2**64 - 1)).count("1") + bin((a1 ^ b1) & (2**64 - 1)).count("1") <= 32 for a0, a1, b0, b1 in edges)
    if similarity:
        assert len(edges) < len(todo)


def test_large_buckets_that_are_dealt_again_keep_sizes(spark):
    rnd, base = random.Random(3), 0x123456789ABCDEF
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(900)})
    frame = spark.createDataFrame([(simhash.signed(p), 10 if i % 2 else 30) for i, p in enumerate(prints)], "f0 long, n long")
    unsigned = lambda x: x & (2**64 - 1)
    edges = [(0, unsigned(a), 0, unsigned(b)) for a, b in simhash.links(frame, bucket_rows=64, similarity=0.8).collect()]
    got = brute_connected({(0, p): p for p in prints}, edges)
    for odd in (0, 1):
        part = prints[odd::2]
        assert all(got[a] == got[b] for a in part for b in part if bin(a ^ b).count("1") <= 4)


@pytest.mark.parametrize("similarity", [0.0, 0.8])
def test_rows_with_neighbours_equal_a_plain_search(similarity):
    import numpy as np

    rnd = np.random.default_rng(6)
    for n, dense in ((0, 0), (1, 0), (40, 5), (700, 30), (3000, 900)):
        prints = rnd.integers(-2**63, 2**63 - 1, (n, 2), dtype=np.int64)
        sizes = rnd.integers(1, 60, n)
        prints[:dense] = prints[:1]
        prints[:dense, 0] ^= np.int64(1) << rnd.integers(0, 60, dense)
        prints[dense:dense + n // 20] = prints[n - n // 20:] ^ rnd.choice([1, 7, (1 << 33) - 1], (n // 20, 1))
        shuffled = rnd.permutation(n)
        prints, sizes = prints[shuffled], sizes[shuffled]
        near = simhash.distance(prints[:, None], prints[None]) <= 32
        near &= np.minimum(sizes[:, None], sizes) * 5 >= np.maximum(sizes[:, None], sizes) * (4 if similarity else 0)
        np.fill_diagonal(near, False)
        assert simhash.with_neighbours(prints, 32, sizes, similarity).tolist() == near.any(axis=1).tolist()
