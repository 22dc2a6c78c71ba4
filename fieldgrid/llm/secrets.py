"""Secret scan: patterns, and character Markov models of random strings and ordinary identifiers.

Everything is made of DataFrame functions.  Positions come from ``split`` and ``regexp_extract_all`` with the same
pattern: the lengths of gaps and matches add up to code-point offsets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more; a shorter run holds no other start of this length
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # a maximal run of 24 or more
KINDS = ("assign", "access", "hex", "model")

# Strings the models judge: maximal runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
SAMPLE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
# An ordinary identifier: words in one of the usual spellings with a short number, capitals, or digits alone.  A long
# word of another shape is neither class and is not learnt from, so a secret cannot vouch for itself.
ORDINARY = r"^[-_/=+]*(?:(?:[A-Z]?[a-z]{2,}+[-_/=+]*+)++[0-9]{0,4}|(?:[A-Z]++[-_/=+]*+)++|(?:[0-9]++[-_/=+]*+)++)$"
_PRIOR = 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of ``(start, kind, stop)`` of all matches of ``pattern``; ``keep(match)`` may drop some."""
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        wanted = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(wanted, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and then kind."""
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 6
    return F.array_sort(
        F.concat(_found(text, ASSIGN, 0, long_enough), _found(text, ACCESS, 1), _found(text, HEX, 2))
    )


def labelled_samples(documents: DataFrame, text: str = "text") -> DataFrame:
    """``token, random`` from whole texts: values of base matches are random, other long words of ordinary shape are not."""
    t = F.coalesce(F.col(text), F.lit(""))
    any_base = f"{ASSIGN}|{ACCESS}|{HEX}"
    values = F.concat(
        F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 16),
        F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
    )
    is_base = t.rlike(any_base)
    none = F.array().cast("array<string>")
    rest = F.when(is_base, F.regexp_replace(t, any_base, " ")).otherwise(t)
    rows = documents.select(
        F.when(is_base, values).otherwise(none).alias("yes"), F.filter(F.regexp_extract_all(rest, F.lit(SAMPLE), F.lit(0)), lambda v: v.rlike(ORDINARY)).alias("no")
    )
    both = F.concat(
        F.transform("yes", lambda v: F.struct(v.alias("token"), F.lit(True).alias("random"))),
        F.transform("no", lambda v: F.struct(v.alias("token"), F.lit(False).alias("random"))),
    )
    return rows.select(F.explode(both).alias("s")).select("s.token", "s.random")


def _neighbours(items: Column, join) -> Column:
    """``join`` of every element and the next; the last has none.  One walk, whatever the length."""
    return F.zip_with(F.slice(items, 1, F.size(items) - 1), F.slice(items, 2, F.size(items) - 1), join)


def train(samples: DataFrame) -> dict[str, int]:
    """Log-likelihood ratio of each character pair in thousandths of a nat, from all samples.

    Both models are first-order chains.  The counts are summed in the cluster; what comes to
    the driver is one row per class and pair of characters, bounded by the alphabet.  Without samples of either class
    every ratio is 0 and nothing is ever reported.
    """
    pairs = (
        samples.where(F.length("token") >= 2)
        .groupBy("token", "random")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("random", "n", F.explode(_neighbours(F.split("token", ""), lambda a, b: F.concat(a, b))).alias("pair"))
        .groupBy("random", "pair")
        .agg(F.sum("n").alias("n"))
    )
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in pairs.collect():
        if all(c in ALPHABET for c in r["pair"]):
            counts[r["random"]][r["pair"]] = r["n"]
    if not counts[True] or not counts[False]:
        return {}
    chains = {k: _chain(counts[k]) for k in counts}
    return {p: round(1000 * (chains[True][p] - chains[False][p])) for p in chains[True]}


def _chain(counts: Mapping[str, int]) -> dict[str, float]:
    """Log-probability of every pair's second character after its first, for one class.

    Pairs are smoothed by how often the second character occurs at all, weighing like ``_PRIOR`` pairs.
    """
    second = {b: sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
    after = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    alone = {b: (second[b] + 1) / (sum(second.values()) + len(ALPHABET)) for b in ALPHABET}
    return {a + b: math.log((counts.get(a + b, 0) + _PRIOR * alone[b]) / (after[a] + _PRIOR)) for a in ALPHABET for b in ALPHABET}


def model_spans(text: Column, ratios: Mapping[str, int], least: int = 12_000) -> Column:
    """Spans of candidate strings whose summed log-likelihood ratio is ``least`` thousandths of a nat or more."""
    if not ratios:
        return F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    listed = ",".join(str(ratios[a + b]) for a in ALPHABET for b in ALPHABET)
    table = F.split(F.lit(listed), ",").cast("array<int>")

    def score(token: Column) -> Column:
        places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))

        def step(acc, x):
            pair = F.when(acc["last"] > 0, F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + x)).otherwise(0)
            return F.struct(x.alias("last"), (acc["sum"] + pair).alias("sum"))

        return F.aggregate(places, start, step, lambda acc: acc["sum"])

    return _found(text, CANDIDATE, 3, lambda hit: score(hit) >= least)


def scan(documents: DataFrame, ratios: Mapping[str, int], text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``all_spans``, arrays of ``(start, kind, stop)`` sorted by start, then kind.

    Offsets are code points, the end is exclusive, ``kind`` is a place in ``KINDS``.  A span of the models never
    overlaps a base span; all base spans stay.  A null or empty text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    with_base = documents.withColumn("base_spans", base_spans(t)).withColumn("_more", model_spans(t, ratios))
    free = F.filter(
        "_more", lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    )
    return with_base.withColumn("all_spans", F.array_sort(F.concat("base_spans", free))).drop("_more")


def written(spans: str) -> Column:
    """``kind:start:stop`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])
    return F.array_join(F.transform(spans, one), ",")


def redact(documents: DataFrame, ratios: Mapping[str, int], mark: str = "[secret]", text: str = "text") -> DataFrame:
    """Replace every span by ``mark``; spans that overlap become one.  Rows without spans stay as they are."""
    found = scan(documents, ratios, text)
    t = F.col(text)

    def step(acc, x):
        gap = F.substring(t, acc["at"] + 1, x["start"] - acc["at"])
        apart = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t)))
    clean = F.when(F.size("all_spans") > 0, F.aggregate("all_spans", start, step, end)).otherwise(t)
    return found.withColumn(text, clean).drop("base_spans", "all_spans")


def find_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``documents``."""
    found = scan(documents.select("doc_id", "text"), train(labelled_samples(documents)))
    number = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(written("base_spans"), 256).alias("base_sha256"),
        written("all_spans").alias("spans"),
    )
