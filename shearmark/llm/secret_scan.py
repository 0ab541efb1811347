"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Everything is SQL expressions.  A pattern's matches come from ``regexp_extract_all``; what ``split`` leaves between
them gives their places, by running sums.  The models of random strings and of ordinary identifiers count pairs of
neighbouring characters in labelled samples; a candidate is a secret where random is the likelier by ``THRESHOLD``
nats.  A pair weighs ``CLIP`` nats at most, so that a few rare pairs decide nothing; that also says how short a
candidate can be.  Base spans are cut out of the candidates, what is left of them is scored like any other.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import settle

# The patterns of the base kinds, in their order.
KEYWORD = r"(?i:(password|passwd|secret|token|api_?key))"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a longer run begins at its first AKIA: same as AKIA[A-Z0-9]+ of 16 or more
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,}"
FIT_ROWS = 5000
THRESHOLD = 12.0
CLIP = 1.5
SHORTEST = math.ceil(THRESHOLD / CLIP) + 1  # fewer characters have too few pairs to reach the threshold
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
BACKOFF = 10.0
SPAN = "array<struct<start:int,end:int,kind:int,text:string>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge) -> Column:
    """Running merge of an array, in passes that double their reach: n log n steps and no growing array."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(passes, values, lambda acc, k: F.transform(
        acc, lambda v, i: merge(v, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))))


def plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans (code points, end exclusive) with the text of a group."""
    whole, picked = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))  # what comes before each match
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), picked.alias("text"))
    return bound(rows, lambda r: F.zip_with(
        r, running(F.transform(r, lambda m: m["gap"] + m["size"]), plus), lambda m, end: F.struct(
            (end - m["size"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m["text"].alias("text"))))


def where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind."""
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["text"]) >= 8)
    return F.array_sort(F.concat(
        where(text.rlike(KEYWORD), assign), where(text.contains("AKIA"), matches(text, ACCESS, 1)),
        where(text.rlike("[0-9a-f]{32}"), matches(text, HEX, 2))))


def symbol(char: Column) -> Column:
    """Number of a character in the alphabet, 0 for any other."""
    return F.call_function("instr", F.lit(ALPHABET), char)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all character pairs from rows (text, label: 1 is random).

    A pair's probability leans on that of its second character alone, with the weight of ``BACKOFF`` sightings, and
    that on a uniform one.  The two models have len(alphabet)**2 numbers, the only ones that reach the driver.
    """
    n = len(ALPHABET) + 1
    codes = samples.filter(F.length("text") > 1).select("label", F.transform(F.split("text", ""), symbol).alias("c"))
    pairs = codes.select("label", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"),
                                                         F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p")).select("label", "p.*")
    seen = {0: [[0] * n for _ in range(n)], 1: [[0] * n for _ in range(n)]}
    for r in pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        seen[r["label"]][r["a"]][r["b"]] += r["n"]

    def logs(table):
        single = [sum(column) + 1 for column in zip(*table, strict=True)]
        single = [x / sum(single) for x in single]
        return [math.log((table[a][b] + BACKOFF * single[b]) / (sum(table[a]) + BACKOFF)) for a in range(n) for b in range(n)]

    return [max(-CLIP, min(CLIP, y - x)) for x, y in zip(logs(seen[0]), logs(seen[1]), strict=True)]


def ratio(text: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio of a string: the sum over its neighbouring characters."""
    table, n = F.from_json(F.lit(json.dumps(weights)), "array<double>"), len(ALPHABET) + 1  # folded to one literal
    codes = F.transform(F.split(text, ""), symbol)
    return bound(codes, lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0),
        lambda acc, i: acc + F.get(table, (F.get(c, i) * n + F.get(c, i + 1)).cast("int"))))


def left_over(runs: Column, base: Column) -> Column:
    """What base spans leave of the runs, as runs of at least ``SHORTEST`` characters.  Both are sorted by start; runs do not overlap.

    In the order of starts, a piece can begin at a run or at the end of a base span.  It lasts until the run that is
    open there ends or the next base span begins.
    """
    event = lambda s, run: F.struct(s["start"].alias("start"), F.lit(run).alias("run"), s["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, 0)), F.transform(runs, lambda s: event(s, 1))))
    of = lambda e, run, part: F.transform(e, lambda x: F.when(x["run"] == run, x[part]))
    tracks = lambda e: F.arrays_zip(
        e.alias("e"), running(of(e, 0, "end"), F.greatest).alias("covered"), running(of(e, 1, "end"), F.greatest).alias("open"),
        F.concat(F.slice(F.reverse(running(F.reverse(of(e, 0, "start")), F.least)), F.lit(2), F.size(e)),
                 F.array(F.lit(None).cast("int"))).alias("next"),
        running(F.transform(e, lambda x: x["run"]), plus).alias("number"))
    pieces = bound(bound(events, tracks), lambda t: F.transform(t, lambda x: F.struct(
        F.greatest(F.when(x["e"]["run"] == 1, x["e"]["start"]), x["covered"]).alias("start"),
        F.least(x["open"], x["next"]).alias("end"), (x["number"] - 1).alias("number"))))
    long = F.filter(pieces, lambda p: p["end"] - p["start"] >= SHORTEST)
    cut = F.transform(long, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), F.lit(3).alias("kind"), F.substring(
            F.get(runs, p["number"])["text"], p["start"] - F.get(runs, p["number"])["start"] + 1, p["end"] - p["start"]).alias("text")))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(cut)


def labelled(rows: DataFrame, fit_rows: int) -> DataFrame:
    """Samples from at most ``fit_rows`` keys with base spans, those of smallest hash: values of the spans are random
    strings, identifiers of the same texts outside the values are ordinary.

    Keys are chosen before anything is carried, and only their rows give samples; a key's rows count as one.
    """
    hits = settle(rows.select("_key", base_spans(F.col("t")).alias("base")).filter(F.size("base") > 0), "base_spans")
    keys = settle(hits.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(fit_rows), "fit_keys")
    chosen = F.broadcast(keys.withColumnRenamed("_key", "_chosen"))  # fit_rows keys
    values = hits.join(chosen, F.col("_key").eqNullSafe(F.col("_chosen"))).select(
        "_key", F.explode("base.text").alias("text")).distinct()
    secret = values.select("text", F.lit(1).alias("label"))
    names = rows.join(chosen, F.col("_key").eqNullSafe(F.col("_chosen"))).select(
        "_key", F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))).alias("text")).groupBy("_key", "text").agg(
        F.count(F.lit(1)).alias("n"))
    # an identifier may be a part of a value
    parts = values.select("_key", F.explode(F.concat(F.array("text"), F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("text"))
    plain = names.join(parts.distinct(), ["_key", "text"], "left_anti").select("text", F.lit(0).alias("label"))
    return secret.unionByName(plain)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: DataFrame | None = None, fit_rows: int = FIT_ROWS,
         threshold: float = THRESHOLD) -> DataFrame:
    """key, base and spans of every row: arrays of (start, end, kind, text), by start, then kind (see KINDS).

    ``base`` holds the matches of the fixed patterns.  ``spans`` adds, as kind markov, every run of token characters,
    or what base spans leave of it, whose ratio reaches ``threshold``.  Samples (text, label) are taken from the
    documents unless given, see ``labelled``; without any, nothing is added.  Texts are read whole, once for the
    samples and once to be scanned; a null or empty text has no spans; repeated rows repeat; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), body.alias("t"))
    weights = train(samples if samples is not None else labelled(rows, fit_rows))
    found = rows.select("_key", base_spans(F.col("t")).alias("base"), matches(F.col("t"), CANDIDATE, 3).alias("runs"))
    extra = F.filter(left_over(F.col("runs"), F.col("base")), lambda r: ratio(r["text"], weights) >= threshold)
    extra = extra if any(weights) else F.array().cast(SPAN)
    return found.select(F.col("_key").alias(key), "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def joined(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and joined spans of ``scan``'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
