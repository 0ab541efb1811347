"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is cut into ``parts``, each with a smaller radius; these add up to radius - parts + 1, so two fingerprints
that differ in more bits of every part differ in more than the radius.  For a part's radius r, every bit position has a code in
{0, 1}**(r + 1), and every non-zero v gives a mask: the positions whose code has odd overlap with v.  Up to r
differing positions have codes of rank r at most, so some v is orthogonal to all of them, its mask avoids them, and
the two fingerprints agree under it.  All 2**(r + 1) - 1 masks of every part together therefore miss no pair.

Buckets are compared inside sorted partitions.  One with more than ``bucket_rows`` fingerprints is dealt out again
by the same construction over the bits its mask left open, which keeps the guarantee.  Every row is copied once a mask
then, so that is only done where the pairs to compare shrink by more than the rows grow; with few bits open (the short
parts of a wide fingerprint) it would multiply the disk and save nothing, and the bucket is searched as it is, whatever
its size.  A bucket gives a spanning forest of its links, not its pairs, and of these only the links whose
ends no earlier table is sure to compare: such ends are connected there.  A dense group, which fills a bucket of almost
every table, has a few links a row that way and not one for each table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, join_groups, settle
from .tokens import pieces_of

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEEDS = (42, 43)
BUCKET_ROWS = 4096
BLOCK_ROWS = 256
BLOCK_SHINGLES = 1 << 20
BLOCK_CELLS = 1 << 17


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of so many words of the lower-cased text (A-Z), space-joined; of all words if there are fewer."""
    found = text.translate(_LOWER).split()  # ASCII white space
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words, n)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in
                        zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)), np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, f0 and, with two lanes, f1 of every row: 64 bits a lane.  A text without words has zeros."""
    def prints(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                bits = [pa.array([majority(shingle_hashes(t, words, s)) for t in texts], pa.int64()) for s in SEEDS[:lanes]]
                yield pa.RecordBatch.from_arrays([part.column("_key"), *bits], names=["_key", *[f"f{i}" for i in range(lanes)]])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(prints, f"_key {kind}, " + ", ".join(f"f{i} long" for i in range(lanes)))


def even_codes(count: int, size: int) -> list[int]:
    """Different non-zero codes under ``size``, chosen one by one so that no mask gets few bits (few bits: large buckets)."""
    odd = np.array([[bin(c & v).count("1") % 2 for v in range(1, size)] for c in range(1, size)])
    out, weight = [], np.zeros(size - 1, dtype=np.int64)
    for _ in range(count):
        best = min((c for c in range(size - 1) if c + 1 not in out), key=lambda c: (np.exp2(-(weight + odd[c])).sum(), c))
        out.append(best + 1)
        weight += odd[best]
    return out


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of the positions are avoided by one of them."""
    size = 1 << (radius + 1)
    if len(positions) < size - 1:
        code = dict(zip(positions, even_codes(len(positions), size), strict=True))
    else:
        code = {p: 1 + i % (size - 1) for i, p in enumerate(positions)}  # every non-zero code, as evenly as can be
    return [sum(1 << p for p in positions if bin(code[p] & v).count("1") % 2) for v in range(1, size)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Table:
    """One table of the first level or of a bucket's next one: the bits that are compared, those still open and how many of these may differ.

    ``before``: the tables that come first, as (compared bits, open bits, radii, how many of them) of its own level and
    of every level above it.
    """

    def __init__(self, mask: int, open_bits: list[int], radius: int, before: tuple = ()):
        self.mask, self.open_bits, self.radius, self.before = mask, open_bits, radius, before

    def code(self) -> Column:
        """The compared bits; a hash of them where they lie in two lanes (buckets are compared exactly anyway)."""
        lanes = [(i, signed(self.mask >> 64 * i & (1 << 64) - 1)) for i in range(2)]
        used = [F.col(f"f{i}").bitwiseAND(F.lit(m)) for i, m in lanes if m]
        return used[0] if len(used) == 1 else F.xxhash64(*used)


def words_of(bits: list[int]) -> np.ndarray:
    """Numbers of up to 128 bits as rows of two lanes."""
    return np.array([[signed(b >> 64 * i & (1 << 64) - 1) for i in range(2)] for b in bits], dtype=np.int64).reshape(-1, 2)


def one_level(masks: list[tuple[int, list[int], int]], before: tuple = ()) -> list[Table]:
    """Tables (compared bits, open bits, radius) that follow each other and the tables of the levels above."""
    compared, open_ = words_of([m for m, _, _ in masks]), words_of([sum(1 << b for b in bits) for _, bits, _ in masks])
    radii = np.array([r for _, _, r in masks])
    return [Table(m, bits, r, ((compared, open_, radii, k), *before)) for k, (m, bits, r) in enumerate(masks)]


def part_radii(parts: int, radius: int) -> list[int]:
    """Radii of the parts: fingerprints beyond all of them differ in their sum and a bit a part, which is beyond the radius."""
    each, more = divmod(max(radius - parts + 1, 0), parts)
    return [each + (p < more) for p in range(parts)]


def first_tables(lanes: int, parts: int, radius: int) -> list[Table]:
    each = 64 * lanes // parts
    out = []
    for p, small in enumerate(part_radii(parts, radius)):
        bits = list(range(p * each, (p + 1) * each))
        for mask in covering_masks(bits, small):
            out.append((mask, [b for b in bits if not mask >> b & 1], small))
    return one_level(out)


def next_tables(table: Table) -> list[Table]:
    """Tables over the bits that a table leaves open; [] where the copies of its rows would outweigh the pairs saved."""
    if len(table.open_bits) <= table.radius + 1:
        return []
    masks = covering_masks(table.open_bits, table.radius)
    if len(masks) * sum(2.0 ** -mask.bit_count() for mask in masks) >= 1:  # rows grow by the first, pairs shrink by the second
        return []
    return one_level([(table.mask | mask, [b for b in table.open_bits if not mask >> b & 1], table.radius) for mask in masks], table.before)


def compared_before(ends: np.ndarray, before: tuple) -> np.ndarray:
    """Which pairs, given by their differing bits, an earlier table is sure to connect.

    The two agree under its mask and differ in no more of its open bits than its next tables cover, so that they stay
    together down to a bucket that is searched.
    """
    out = np.zeros(len(ends), dtype=bool)
    for compared, open_, radii, count in before:
        compared, open_ = compared[:count, :ends.shape[1]], open_[:count, :ends.shape[1]]
        for at in range(0, len(ends), 1024):
            part = ends[at:at + 1024]
            pair, table = np.nonzero(((part[:, None, :] & compared) == 0).all(axis=2))
            out[at + pair[distance(part[pair] & open_[table], np.int64(0)) <= radii[table]]] = True
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose lanes are the last axis (numpy counts signed numbers by absolute value)."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))
    return sum(bits[..., i] for i in range(bits.shape[-1]))  # at most 128; far faster than a sum along a short axis


def may_match(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity, which is at most the lesser size over the greater."""
    return np.minimum(a, b) >= np.maximum(a, b) * (similarity * (1 - 1e-9))


def forest(prints: np.ndarray, radius: int, sizes: np.ndarray | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Links (earlier found, new) that span every component of the rows within the radius of each other, of sizes that may match.

    A row is compared only with those not reached yet, so a dense group costs little more than its size.
    """
    out, rest = [], np.arange(len(prints))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            a = front.pop()
            near = distance(prints[rest], prints[a]) <= radius
            if sizes is not None:
                near &= may_match(sizes[rest], sizes[a], similarity)
            reached = rest[near].tolist()
            out.extend((a, b) for b in reached)
            front.extend(reached)
            rest = rest[~near]
    return out


def with_neighbours(prints: np.ndarray, radius: int, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows have another within the radius, of a size that may match.

    Rows meet in order of size, in blocks that stay in the processor's cache.  In a large bucket a few rows look first:
    they know the members of a dense group, and only the others go on to look.
    """
    n, out, lanes = len(prints), np.zeros(len(prints), dtype=bool), np.ascontiguousarray(prints.T).view(np.uint64)

    def near(a, b):
        bits = np.bitwise_count(lanes[0][a][:, None] ^ lanes[0][b])
        for lane in lanes[1:]:
            bits += np.bitwise_count(lane[a][:, None] ^ lane[b])
        i, j = np.divmod(np.flatnonzero(bits <= radius), len(b))  # far faster than nonzero along two axes
        a, b = a[i], b[j]
        fit = (a != b) & may_match(sizes[a], sizes[b], similarity)
        return a[fit], b[fit]

    for a in range(0, n, 1 + n // 16) if n > 1024 else ():
        for rows in near(np.array([a]), np.arange(n)):
            out[rows] = True
    order = np.argsort(sizes, kind="stable")
    asks, known = order[~out[order]], order[out[order]]
    slack, step = similarity * (1 - 1e-9), max(1, min(64, BLOCK_CELLS // max(n, 1)))
    starts = np.arange(0, len(asks), step)
    least, most = sizes[asks[starts]], sizes[asks[np.minimum(starts + step, len(asks)) - 1]]
    ends = np.searchsorted(sizes[asks] * slack, most, "right")
    low, high = np.searchsorted(sizes[known], least * slack), np.searchsorted(sizes[known] * slack, most, "right")
    for at, end, k, m in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        part = asks[at:at + step]
        for rows in near(part, asks[at:end]):
            out[rows] = True
        if k < m:
            out[near(part, known[k:m])[0]] = True
    return out


def linked(lanes: int, radius: int, limits: list[int], before: list[tuple], sized: bool = False, similarity: float = 0.0):
    """Scanner of partitions sorted by (table, code): links as (0, a..., b...), rows of too large buckets as (table + 1, ...).

    ``limits`` gives, by table, the rows above which a bucket is dealt out again; 0 means never.  ``before`` gives, by
    table, those that come first; what one of them connects is no link again.  With ``sized``, rows have a size n, and
    those whose sizes cannot have the similarity are not linked for their own sake.
    """
    cols = [*[f"f{i}" for i in range(lanes)], *(["n"] if sized else [])]
    names = ["kind", *[f"a{i}" for i in range(lanes)], *[f"b{i}" for i in range(lanes)], *(["n"] if sized else [])]

    def batch_of(kind, a, b):
        ends = [*a.T[:lanes], *b.T[:lanes], *a.T[lanes:]]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *[pa.array(x, pa.int64()) for x in ends]], names=names)

    def search(rows):
        """Links of one bucket."""
        sizes = rows[:, lanes] if sized else np.zeros(len(rows), dtype=np.int64)
        some = with_neighbours(rows[:, :lanes], radius, sizes, similarity)
        rows, sizes = rows[some], sizes[some]
        prints = np.ascontiguousarray(rows[:, :lanes])
        pairs = np.array(forest(prints, radius, sizes if similarity else None, similarity), dtype=np.int64).reshape(-1, 2)
        return rows[pairs[:, 0]], rows[pairs[:, 1]]

    def scan(batches):
        held = None  # rows of the last bucket, which may go on in the next batch
        passing = None  # (table, code) of a bucket that is known to be too large: its rows go straight through
        for batch in batches:
            table, code = batch.column("t").to_numpy(), batch.column("code").to_numpy()
            prints = np.stack([batch.column(c).to_numpy() for c in cols], axis=1)
            if passing is not None:
                same = (table == passing[0]) & (code == passing[1])
                k = len(same) if same.all() else int(np.argmin(same))
                if k:
                    yield batch_of(np.repeat(passing[0] + 1, k), prints[:k], prints[:k])
                if k == len(same):
                    continue
                passing, table, code, prints = None, table[k:], code[k:], prints[k:]
            if held is not None:
                table, code, prints = np.r_[held[0], table], np.r_[held[1], code], np.concatenate([held[2], prints])
            if not len(table):
                continue
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (code[1:] != code[:-1])])
            sizes = np.diff(np.r_[starts, len(table)])
            last = int(starts[-1])
            limit = limits[table[last]]
            open_, held = sizes[-1], None
            if limit and open_ > limit:
                yield batch_of(np.repeat(table[last] + 1, open_), prints[last:], prints[last:])
                passing = (int(table[last]), int(code[last]))
            else:
                held = (table[last:], code[last:], prints[last:])
            yield from closed(table[:last], prints[:last], starts[:-1], sizes[:-1])
        if held is not None:
            yield from closed(held[0], held[2], np.zeros(1, dtype=np.int64), np.array([len(held[0])]))

    def closed(table, prints, starts, sizes):
        """Links of whole buckets; those over their limit go through."""
        if not len(starts):
            return
        run = np.repeat(np.arange(len(starts)), sizes)
        hit = sizes > 32  # the small ones are compared all at once, at every distance inside a bucket
        for lag in range(1, int(min(32, sizes.max()))):
            at = np.flatnonzero((run[lag:] == run[:-lag]) & ~hit[run[lag:]])
            if not len(at):
                break
            near = distance(prints[at][:, :lanes], prints[at + lag][:, :lanes]) <= radius
            hit[run[at[near]]] = True
        two = starts[hit & (sizes == 2)]
        t_out, a_out, b_out = [table[two]], [prints[two]], [prints[two + 1]]
        for r in np.flatnonzero(hit & (sizes != 2)):
            s, n = int(starts[r]), int(sizes[r])
            if 0 < limits[table[s]] < n:
                yield batch_of(np.repeat(table[s] + 1, n), prints[s:s + n], prints[s:s + n])
                continue
            a, b = search(prints[s:s + n])
            t_out.append(np.repeat(table[s], len(a)))
            a_out.append(a)
            b_out.append(b)
        of, a, b = np.concatenate(t_out), np.concatenate(a_out), np.concatenate(b_out)
        new = np.ones(len(a), dtype=bool)
        for t in np.unique(of).tolist():
            new[of == t] = ~compared_before((a[of == t] ^ b[of == t])[:, :lanes], before[t])
        if new.any():
            yield batch_of(np.zeros(int(new.sum())), a[new], b[new])

    return scan, "kind int, " + ", ".join(f"{n} long" for n in names[1:])


def links(prints: DataFrame, lanes: int = 1, parts: int = 1, radius: int = 4, bucket_rows: int = BUCKET_ROWS,
          similarity: float = 0.0) -> DataFrame:
    """Links a0.., b0.. between fingerprints (columns f0, f1) that connect all different ones within the radius, transitively.

    With a similarity, rows also have the size n of their set; only those whose sizes can have it must be connected.
    """
    sized = similarity > 0
    lane_cols = [f"f{i}" for i in range(lanes)]
    cols = lane_cols + (["n"] if sized else [])
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in as many tasks as there are partitions: few tasks would spill what they deal out and hold it twice while they merge
    rows, found = prints.select(*cols).repartition(count, *cols).distinct(), None
    per_source: list[tuple[int | None, Table]] = [(None, t) for t in first_tables(lanes, parts, radius)]
    while True:
        def entry(n: int, t: Table) -> Column:
            return F.struct(F.lit(n).alias("t"), t.code().alias("code"))

        sources: dict[int | None, list[Column]] = {}
        for n, (source, t) in enumerate(per_source):
            sources.setdefault(source, []).append(entry(n, t))
        spread = None
        for source, entries in sources.items():
            part = rows if source is None else rows.filter(F.col("kind") == source + 1)
            part = part.select(*cols, F.explode(F.array(*entries)).alias("_e")).select(*cols, "_e.*")
            spread = part if spread is None else spread.unionByName(part)
        deeper = {n: next_tables(t) for n, (_, t) in enumerate(per_source)}
        limits = [bucket_rows if deeper[n] else 0 for n in range(len(per_source))]
        scan, schema = linked(lanes, radius, limits, [t.before for _, t in per_source], sized, similarity)
        # by fingerprint inside a bucket: the buckets of a dense group then start their forests from the same few rows
        dealt = spread.repartition(count, "t", "code").sortWithinPartitions("t", "code", *lane_cols)
        out = settle(dealt.mapInArrow(scan, schema), "links")
        pairs = [f"{s}{i}" for s in "ab" for i in range(lanes)]
        fresh = out.filter("kind = 0").select(*pairs)
        found = fresh if found is None else found.unionByName(fresh)
        large = sorted(r["kind"] - 1 for r in out.filter("kind > 0").select("kind").distinct().collect())  # at most the tables
        if not large:
            return found.distinct()
        rows = out.filter("kind > 0").select("kind", *[F.col(f"a{i}").alias(f"f{i}") for i in range(lanes)], *(["n"] if sized else []))
        rows = rows.repartition(count, *cols).distinct()
        per_source = [(n, t) for n in large for t in deeper[n]]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of an undirected edge table (a, b), by large and small stars.

    Every round is written to the shared folder; nothing but one number a round reaches the driver.  The minima are
    found map-side and written before they are joined back, so that a hub's rows can be split over tasks.  The rounds
    end when no node has two lesser neighbours: the edges are pointers then, and jump until all lead to a root.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("n"),
                                           (F.max("v") > F.col("u")).alias("over")), "low")
        state = low.agg(F.max("n").alias("n"), F.count_if((F.col("n") > 0) & F.col("over")).alias("between")).first()
        if (state["n"] or 0) < 2:
            break
        least = low.select("u", "m").hint("merge")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = settle(large, "large_star")
        floor = settle(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        small = large.join(floor.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                                            F.col("m").alias("v")).filter("u <> v").distinct()
        used = [edges, low, large, floor]
        edges = settle(small, "small_star")
        discard(used)
    moved = state["between"]
    while moved:
        up = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v")).hint("merge")
        jumped = settle(edges.join(up, F.col("v") == F.col("_u"), "left").select(
            "u", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved")), "jumped")
        moved = jumped.agg(F.count_if("moved")).first()[0]
        discard([edges])
        edges = jumped
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        low.filter("n = 0").select(F.col("u").alias("node"), F.col("u").alias("root")))


def rooted(nodes: DataFrame, lanes: int, parts: int, radius: int, bucket_rows: int = BUCKET_ROWS, similarity: float = 0.0) -> DataFrame:
    """``nodes`` (fingerprints f0.. and other columns, different rows) with the root of each one's component of links."""
    pairs = links(nodes, lanes, parts, radius, bucket_rows, similarity)
    if lanes == 1:
        edges = pairs.select(F.col("a0").alias("a"), F.col("b0").alias("b"))
        name: Column = F.col("f0")
    else:  # a wider fingerprint is compared as one string of digits
        wide = lambda s: F.concat(*[F.lpad(F.hex(F.col(f"{s}{i}")), 16, "0") for i in range(lanes)])
        edges = pairs.select(wide("a").alias("a"), wide("b").alias("b"))
        name = wide("f")
    roots = components(edges)
    return nodes.withColumn("node", name).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_groups(docs: DataFrame, words: int = 4, lanes: int = 1, parts: int = 1, radius: int = 4, key: str = "doc_id",
                text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, fingerprint (hex digits) and component_id (smallest key reachable over links) of every row.

    Equal fingerprints are one node of the link graph, so copies never meet in pairs.  Null and empty texts have
    fingerprint zero and link like any other; repeated rows and keys share a component; a null key takes part, and a
    component without any key has a null id.  Other columns are not read, an empty table gives no rows.
    """
    cols = [f"f{i}" for i in range(lanes)]
    rows = settle(fingerprints(docs, words, lanes, key, text), "fingerprints")
    nodes = settle(rows.groupBy(*cols).agg(F.min("_key").alias("_low")), "nodes")
    known = rooted(nodes, lanes, parts, radius, bucket_rows)
    lowest = known.groupBy("root").agg(F.min("_low").alias("component_id"))
    per_node = known.select(*cols, "root").join(lowest, "root").select(*[F.col(c).alias(f"_{c}") for c in cols], "component_id")
    same = [F.col(c) == F.col(f"_{c}") for c in cols]
    on = same[0] if lanes == 1 else same[0] & same[1]
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.col(c))), 16, "0") for c in cols])
    return rows.join(per_node, on).select(F.col("_key").alias(key), digits.alias("fingerprint"), "component_id")


def shingle_set(text: bytes, words: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, seed))


def set_prints(rows: DataFrame, words: int, lanes: int) -> DataFrame:
    """_row, n (different shingles), s (digest of their set) and the fingerprint of the set, f0.., of every row (_row, _text)."""
    def prints(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text"):
                size, digest, bits = [], [], [[] for _ in range(lanes)]
                for t in pc.fill_null(part.column("_text"), "").cast(pa.binary()).to_pylist():
                    sets = [shingle_set(t, words, s) for s in SEEDS[:lanes]]
                    size.append(len(sets[0]))
                    digest.append(xxhash.xxh3_128_digest(sets[0].tobytes()))
                    for lane, found in zip(bits, sets, strict=True):
                        lane.append(majority(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), *[pa.array(b, pa.int64()) for b in bits]],
                    names=["_row", "n", "s", *[f"f{i}" for i in range(lanes)]])

    return rows.select("_row", "_text").mapInArrow(
        prints, "_row long, n long, s binary, " + ", ".join(f"f{i} long" for i in range(lanes)))


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span every component of the non-empty sets of at least this Jaccard similarity to each other."""
    out, rest, front = [], np.arange(len(sets)), []
    held = np.zeros(0, dtype=np.int64)  # the sets that the arrays below hold: those not reached at the last build
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        if not len(rest):
            break
        if not len(held) or 2 * len(rest) < len(held):
            held = rest
            sizes = np.fromiter((len(sets[i]) for i in held), np.int64, len(held))
            known, token = np.unique(np.concatenate([sets[i] for i in held]), return_inverse=True)
            starts, open_ = np.r_[0, np.cumsum(sizes)[:-1]], np.ones(len(held), dtype=bool)
        a = front.pop()
        open_ &= held != a
        at = np.minimum(np.searchsorted(known, sets[a]), len(known) - 1)
        present = np.zeros(len(known), dtype=np.int64)
        present[at[known[at] == sets[a]]] = 1
        shared = np.add.reduceat(present[token], starts)
        near = open_ & (shared / (len(sets[a]) + sizes - shared) >= similarity)
        reached = held[near].tolist()
        out.extend((a, b) for b in reached)
        front.extend(reached)
        open_ &= ~near
        rest = held[open_]
    return out


def similar_across(sets: list[np.ndarray], labels: list[int], asks: int, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels: the first ``asks`` sets meet all, and what a link joins is one label from then on."""
    own = np.unique(np.array(labels), return_inverse=True)[1]
    if not len(own) or (own == own[0]).all():
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    known, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts, out = np.r_[0, np.cumsum(sizes)[:-1]], []
    for a in range(asks):
        if (own == own[a]).all():
            break
        present = np.zeros(len(known), dtype=np.int64)
        present[token[starts[a]:starts[a] + sizes[a]]] = 1
        shared = np.add.reduceat(present[token], starts)
        for b in np.flatnonzero((own != own[a]) & (shared / (sizes[a] + sizes - shared) >= similarity)).tolist():
            if own[b] != own[a]:
                out.append((a, b))
                own[own == own[b]] = own[a]
    return out


def shingle_sets(members: DataFrame, words: int, kept: list[str]) -> DataFrame:
    """_row, the other kept columns and h (the bytes of the sorted shingle hashes) of members with their _text."""
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in kept)

    def shingles(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text", 1 << 20):  # a word of two bytes becomes eight
                texts = pc.fill_null(part.column("_text"), "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([shingle_set(t, words, SEEDS[0]).tobytes() for t in texts], pa.binary())],
                    names=[*kept, "h"])

    return members.select(*kept, "_text").mapInArrow(shingles, f"{kinds}, h binary")


def searched_cells(dealt: DataFrame, find) -> DataFrame:
    """Links a, b that ``find`` (rows of a cell as lists by column) gives in every cell g, in the order of ``o`` inside it."""
    columns = [c for c in dealt.columns if c not in ("g", "h")]

    def links_of(cell):
        pairs = np.array(find(cell), dtype=np.int64).reshape(-1, 2)
        ids = np.array(cell["_row"], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, i]], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def search(batches):
        last, cell = None, None
        for batch in batches:
            for g, h, *rest in zip(*[batch.column(c).to_pylist() for c in ("g", "h", *columns)], strict=True):
                if g != last:
                    if cell is not None and len(cell["_row"]) > 1:
                        yield links_of(cell)
                    last, cell = g, {c: [] for c in ("h", *columns)}
                for c, value in zip(("h", *columns), (np.frombuffer(h, dtype=np.uint64), *rest), strict=True):
                    cell[c].append(value)
        if cell is not None and len(cell["_row"]) > 1:
            yield links_of(cell)

    count = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "g").sortWithinPartitions("g", "o").mapInArrow(search, "a long, b long")


def similar_links(members: DataFrame, words: int, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The links of ``similar_copies``."""
    return similar_copies(members, words, similarity, block_rows)[0]


def similar_copies(members: DataFrame, words: int, similarity: float, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Links a, b (rows) that connect, in every group, the components of texts of at least this Jaccard similarity,
    and the _row of all but the least row of every component.

    ``members``: _row, _text, root, blocks.  The rows of a group are dealt over its blocks, and every block gives a
    spanning forest of its links.  Then neighbouring blocks are compared, where they are not connected yet.  What is left
    outside its group's largest component is compared with the whole group, in cells of so many such rows and a
    block.  Two components are linked once however many of their rows are similar, so a dense group has about as many
    links as rows.  Components are found once over the links inside blocks; the later links are few and join components
    by their least rows, of which all but one then are copies too.
    """
    mine = F.pmod(F.xxhash64("_row"), F.col("blocks"))
    sets = settle(shingle_sets(members, words, ["_row", "root", "blocks"]).withColumn("block", mine), "shingle_sets")
    inside = sets.select(F.xxhash64("root", "block").alias("g"), F.col("_row").alias("o"), "_row", "h")
    found = settle(searched_cells(inside, lambda cell: similar_forest(cell["h"], similarity)), "similar")
    roots = components(found)
    copies = roots.filter("node <> root").select(F.col("node").alias("_row"))
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        discard([sets])
        return found, copies

    def once(links, rows):
        """One link a, b of every pair of labels x, y."""
        label = lambda c: rows.select(F.col("_row").alias(c), F.col("label").alias(f"_l{c}"))
        pairs = links.join(label("a").hint("merge"), "a").join(label("b").hint("merge"), "b")
        return settle(pairs.groupBy(F.least("_la", "_lb").alias("x"), F.greatest("_la", "_lb").alias("y")).agg(
            F.min(F.struct("a", "b")).alias("_p")).select("x", "y", "_p.a", "_p.b"), "between")

    def joined(fresh):
        """label and _root of every label with a fresh link."""
        return components(fresh.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("root").alias("_root"))

    def more(copies, merged):
        return copies.unionByName(merged.filter("label <> _root").select(F.col("label").alias("_row")))

    # ring of blocks: a row asks the next block and is asked by the one before
    own = roots.select(F.col("node").alias("_row"), F.col("root").alias("_root"))
    rows = settle(large.join(own.hint("merge"), "_row", "left").withColumn("label", F.coalesce("_root", "_row")).drop("_root"), "labelled")
    discard([sets])
    turns = F.explode(F.array(F.struct(F.col("block").alias("c"), F.lit(0).alias("o")),
                              F.struct(F.pmod(F.col("block") - 1, F.col("blocks")).alias("c"), F.lit(1).alias("o"))))
    ring = rows.select("_row", "root", "h", "label", turns.alias("_t")).select(
        F.xxhash64("root", "_t.c").alias("g"), "_t.o", "_row", "label", "h")
    across = lambda cell: similar_across(cell["h"], cell["label"], cell["o"].count(0), similarity)
    fresh = once(settle(searched_cells(ring, across), "ring"), rows)
    found = found.unionByName(fresh.select("a", "b"))
    merged, before = joined(fresh), rows
    copies = more(copies, merged)
    rows = settle(join_groups(before, merged, ["label"], "left").withColumn("label", F.coalesce("_root", "label")).drop("_root"), "labelled")
    discard([before])
    sizes = rows.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    open_ = settle(sizes.filter("others > 0").select("root", "main", F.ceil(F.col("others") / block_rows).alias("askers")), "open_groups")
    if open_.isEmpty():
        discard([rows])
        return found, copies
    rest = join_groups(rows, open_, ["root"])
    asks = rest.filter("label <> main").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("root", F.pmod(F.xxhash64("_row", F.lit(1)), F.col("askers")), "_b").alias("g"), F.lit(0).alias("o"), "_row", "label", "h")
    asked = rest.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1))).select(
        F.xxhash64("root", "_a", "block").alias("g"), F.lit(1).alias("o"), "_row", "label", "h")
    last = once(settle(searched_cells(asks.unionByName(asked), across), "outside"), rows)
    discard([rows])
    return found.unionByName(last.select("a", "b")), more(copies, joined(last))


def near_deduplicated(docs: DataFrame, words: int = 5, lanes: int = 2, parts: int = 7, radius: int = 32, text: str = "text",
                      similarity: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One document of each group, the first, with the columns of ``docs`` whatever their names.

    A group is connected by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is
    checked exactly.  Fingerprints only say where to look: sets of that similarity have a cosine of 8/9, hence differ in
    acos(8/9) / pi = 0.151 of the bits, 19 of 128 on average, and three standard deviations (4) are added.  All texts
    that are connected within the radius are compared, also those beyond it; sets of which one has less than that
    share of the other's shingles cannot be similar and give no link.  Texts of equal shingle sets are one
    node.  Those without words have the empty set: they are copies of each other and of nothing else.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"),
                              F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")), "documents")
    cols = [f"f{i}" for i in range(lanes)]
    prints = settle(set_prints(rows, words, lanes), "fingerprints")
    nodes = settle(prints.groupBy("s", "n", *cols).agg(F.min("_row").alias("_row")), "nodes")
    worded = nodes.filter("n > 0")
    sized = [*cols, "n"]
    found = rooted(worded.select(*sized).distinct(), lanes, parts, radius, similarity=similarity).select(*[F.col(c).alias(f"_{c}") for c in sized], "root")
    on = F.lit(True)
    for c in sized:
        on = on & (F.col(c) == F.col(f"_{c}"))
    members = settle(worded.join(found, on).select("_row", "n", "root"), "members")
    groups = members.groupBy("root").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n")).filter("_m > 1")
    blocks = F.greatest(F.ceil(F.col("_m") / block_rows), F.ceil(F.col("_n") / BLOCK_SHINGLES)).cast("long")
    groups = settle(groups.select("root", blocks.alias("blocks")), "groups")
    compared = settle(join_groups(members, groups, ["root"]).select("_row", "root", "blocks"), "compared")
    # the same plan at every size; rows of large groups are spread by their number
    texts = rows.select("_row", "_text").join(compared.hint("merge"), "_row")
    copies = similar_copies(texts, words, similarity, block_rows)[1]
    kept = nodes.select("_row").join(copies, "_row", "left_anti")
    dropped = settle(prints.select("_row").join(kept, "_row", "left_anti"), "near_copies")
    left = rows.join(dropped.hint("merge"), "_row", "left_anti")
    return left.select(*[(F.col("_text") if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
