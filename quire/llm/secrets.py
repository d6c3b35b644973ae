"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

Fixed patterns give base spans (kinds assign, access, hex). Besides, every run of 20 or
more characters of [A-Za-z0-9+/_-], with the = that end it, is tested; where a run fits no encoding
(a path, a name with several separators), so is each piece of 20 or more letters and digits in it. Its encoding is
inferred as the smallest alphabet that holds it (digits, hex, letters of one case, base 32, base 36,
base 62, base 64), and four tests ask whether it can be uniform random text in that alphabet:
chi-squared over the alphabet, runs about the alphabet's middle, lag-1 serial
correlation, and pairs of neighbours. The smallest p-value times four (Bonferroni) is the token's.

The test of pairs is for tokens of letters or of digits alone, where words and numbers would pass the others, which know no
language. The probabilities of a letter (in lower case) or digit after another are fitted on all runs of letters or of digits of the table that
are shorter than a candidate. A token's probability by them, over that of uniform text, has the mean 1 (at most) for uniform text of any length, so its
reciprocal is a p-value (Markov's inequality). Each letter of a token in both cases takes a bit for its case. In tables without
short words nothing is known of words, and the test finds nothing.

Chi-squared is a function of the number of equal pairs of characters, whose first three
moments under uniformity are exact for any length and alphabet; its tail is that of the
gamma distribution with these (by the cube-root transform), with a correction for
continuity, so it holds where the expected counts are far below one. Runs are taken given the number of high
characters, also corrected; the correlation has its exact mean and the variance for uniform text. The tests are held against simulations.

Over all tokens of one band of lengths (the tests gain power with length, so bands are
kept apart) Benjamini-Hochberg at RATE decides which are not random. What is controlled so is the share
of random keys among the tokens that are discarded, not that of false secrets. The others, if they have BITS
or more bits of capacity, are spans of kind random.

Benjamini-Hochberg runs on counts of p-values in bins of the logarithm, so it is one
aggregation, not a sort of all candidates.

Defined results: a null text counts as empty; both have no spans; repeated rows and rows
with null or equal ids each get a row of their own; an empty table gives an empty result;
positions are in code points; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import settle, table

# Kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PIECE = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
#: (pattern of the whole token, alphabet), smallest first
ENCODINGS = (
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[0-9A-Za-z_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"),
)
#: first lengths of the bands
BANDS = (20, 24, 32, 48, 64, 96, 160)
RATE = 0.05
BITS = 80.0
#: what the test of pairs knows; the place 0 is a run's beginning
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
BINS = 100
_SPAN = "struct<start:bigint,rank:int,stop:bigint,token:string>"


def _found(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """The spans of a pattern's matches whose group is long enough.

    Splitting by the pattern gives what lies between the matches; the lengths of these
    pieces and of the matches, added up, are the positions.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["hit"].alias("token")).cast(_SPAN)
        good = x["hit"].isNotNull() & (F.length(x["part"]) >= least)
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*(k for k, *_ in PATTERNS), "random")))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by Zelen and Severo's rational approximation (error below 8e-8)."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    # The approximation's coefficients.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def neighbours(docs: DataFrame, text: str = "text") -> list[float]:
    """The logarithms of the probabilities of each symbol after each other, or at the beginning of a run (37 times 37 values).

    Fitted on all runs of letters, and of digits, of the texts with fewer than 20 characters; one is added to each count.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    words = docs.select(F.explode(runs).alias("w")).filter(F.length("w") < 20).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substr(F.concat(F.lit("^"), "w"), i, F.lit(2)))).alias("pair"))
    found = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most 37 * 36
    out = [0.0]
    for before in "^" + SYMBOLS:
        for kind in (SYMBOLS[:26], SYMBOLS[26:]):
            total = sum(found.get(before + c, 0) + 1 for c in kind)
            out += [math.log((found.get(before + c, 0) + 1) / total) for c in kind]
        out.append(0.0)
    return out[:-1]


def _p_words(core: Column, alphabet: Column, logs: list[float]) -> Column:
    """The test of pairs; core: the token without padding."""
    low = F.lower(core)
    place = lambda i: F.instr(F.lit(SYMBOLS), F.substr(low, i, F.lit(1)))
    one = lambda i: F.element_at(F.lit(logs), F.when(i > 1, place(i - 1)).otherwise(0) * (len(SYMBOLS) + 1) + place(i) + 1)
    model = F.aggregate(F.sequence(F.lit(1), F.length(core)), F.lit(0.0), lambda acc, i: acc + one(i))
    case = F.when(core.rlike("[a-z]") & core.rlike("[A-Z]"), math.log(2)).otherwise(0.0)
    ratio = model + F.length(core) * (F.log(alphabet) - case)
    return F.when(core.rlike("^([A-Za-z]+|[0-9]+)$"), F.least(F.lit(1.0), F.exp(-ratio))).otherwise(1.0)


def randomness(tokens: DataFrame, token: str = "token", logs: list[float] | None = None) -> DataFrame:
    """Adds alphabet (its size), p: how likely uniform random text looks as odd as this, and the p-value of each test; tokens fit an encoding and have three characters or more.

    logs: from neighbours(); without them the test of pairs is left out.
    """
    core = F.rtrim(F.translate(token, "=", " "))
    alphabet = F.coalesce(*(F.when(F.col(token).rlike(p), F.lit(a)) for p, a in ENCODINGS))
    out = tokens.withColumn("__alphabet", alphabet)
    out = out.withColumn("__x", F.transform(F.split(core, ""), lambda c: (F.instr(F.col("__alphabet"), c) - 1).cast("double")))
    out = out.withColumn("__a", F.length("__alphabet").cast("double")).withColumn("__n", F.size("__x").cast("double"))
    n_, p_ = F.col("__n"), 1 / F.col("__a")
    squares = F.aggregate(F.array_distinct("__x"), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter("__x", lambda w: w == v)), F.lit(2.0)))
    pairs, triples = n_ * (n_ - 1) / 2, n_ * (n_ - 1) * (n_ - 2) / 6
    spread = F.sqrt(pairs * p_ * (1 - p_))
    out = out.withColumn("__skew", (pairs * p_ * (1 - p_) * (1 - 2 * p_) + 6 * triples * p_ * p_ * (1 - p_)) / F.pow(spread, F.lit(3.0)))
    out = out.withColumn("__y", ((squares - n_) / 2 - 0.5 - pairs * p_) / spread)
    p_chi = _normal_tail(6 / F.col("__skew") * (F.cbrt(F.greatest(F.col("__skew") * F.col("__y") / 2 + 1, F.lit(0.0))) - 1) + F.col("__skew") / 6)
    high = F.transform("__x", lambda v: v >= F.col("__a") / 2)
    n = F.col("__n").cast("int")
    pairs = F.arrays_zip(F.slice(high, 1, n - 1).alias("a"), F.slice(high, 2, n - 1).alias("b"))
    out = out.withColumn("__runs", 1 + F.size(F.filter(pairs, lambda q: q["a"] != q["b"]))).withColumn("__high", F.size(F.filter(high, lambda h: h)).cast("double"))
    mean = 1 + 2 * F.col("__high") * (F.col("__n") - F.col("__high")) / F.col("__n")
    var = (mean - 1) * (mean - 2) / (F.col("__n") - 1)
    p_runs = F.when(var > 0, 2 * _normal_tail(F.greatest(F.abs(F.col("__runs") - mean) - 0.5, F.lit(0.0)) / F.sqrt(var))).otherwise(F.pow(F.lit(2.0), 1 - F.col("__n")))
    out = out.withColumn("__mean", F.aggregate("__x", F.lit(0.0), lambda acc, v: acc + v) / F.col("__n"))
    out = out.withColumn("__d", F.transform("__x", lambda v: v - F.col("__mean")))
    steps = F.arrays_zip(F.slice("__d", 1, n - 1).alias("a"), F.slice("__d", 2, n - 1).alias("b"))
    below = F.aggregate("__d", F.lit(0.0), lambda acc, v: acc + v * v)
    r = F.aggregate(steps, F.lit(0.0), lambda acc, q: acc + q["a"] * q["b"]) / below
    p_serial = F.when(below > 0, 2 * _normal_tail(F.abs(r + 1 / n_) * n_ * F.sqrt(n_ - 1) / (n_ - 2))).otherwise(0.0)
    tests = {"p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial} | ({"p_words": _p_words(core, F.col("__a"), logs)} if logs else {})
    out = out.withColumn("alphabet", F.col("__a")).withColumns(tests).withColumn("p", F.least(F.lit(1.0), len(tests) * F.least(*tests)))
    return out.drop("__x", "__d", "__alphabet", "__a", "__n", "__skew", "__y", "__runs", "__high", "__mean")


def keep_random(tested: DataFrame, rate: float = RATE, bits: float = BITS, token: str = "token") -> DataFrame:
    """The rows that Benjamini-Hochberg, in their band of lengths, doesn't find non-random."""
    length = F.length(token)
    band = F.greatest(*(F.when(length >= b, F.lit(b)).otherwise(F.lit(BANDS[0])) for b in BANDS))
    level = F.least(F.lit(40 * BINS), F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * BINS)).cast("int")
    rows = tested.withColumn("__band", band).withColumn("__level", level)
    bins = rows.groupBy("__band", "__level").agg(F.count("*").alias("n"))
    own = W.partitionBy("__band")
    upto = F.sum("n").over(own.orderBy(F.col("__level").desc()).rowsBetween(W.unboundedPreceding, 0))
    found = upto / F.sum("n").over(own) * rate >= F.pow(F.lit(10.0), -F.col("__level") / BINS)
    cut = bins.withColumn("__found", found).groupBy("__band").agg(F.min(F.when(F.col("__found"), F.col("__level"))).alias("__cut"))
    kept = rows.join(F.broadcast(cut), "__band").filter(F.coalesce(F.col("__level") < F.col("__cut"), F.lit(True)))
    return kept.filter(length * F.log2("alphabet") >= bits).drop("__band", "__level", "__cut")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans: arrays of (start, rank of the kind, stop, token)."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(_found(body, p, g, least, rank) for rank, (_, p, g, least) in enumerate(PATTERNS)))
    runs = _found(body, CANDIDATE, 0, 20, len(PATTERNS))
    rows = docs.select(F.col(key).alias("__id"), F.monotonically_increasing_id().alias("__row"), base.alias("base"), runs.alias("runs"), F.when(body.rlike(CANDIDATE), body).alias("__body"))
    rows = rows.withColumn("other", F.filter("runs", lambda s: ~_encoded(s["token"])))
    pieces = F.when(F.size("other") > 0, F.filter(_found(F.col("__body"), PIECE, 0, 20, len(PATTERNS)), lambda s: F.exists("other", lambda o: (o["start"] <= s["start"]) & (s["stop"] <= o["stop"]))))
    maybe = F.concat(F.filter("runs", lambda s: _encoded(s["token"])), F.coalesce(pieces, F.array().cast(f"array<{_SPAN}>")))
    rows = settle(rows.select("__id", "__row", "base", maybe.alias("maybe")), "secrets")
    tokens = rows.filter(F.size("maybe") > 0).select("__row", F.explode("maybe").alias("span")).select("__row", "span", "span.token")
    tested = settle(randomness(tokens, logs=neighbours(docs, text)), "secrets-tested")
    kept = keep_random(tested).groupBy("__row").agg(F.collect_list("span").alias("more"))
    out = rows.join(kept, "__row", "left")
    return out.select(F.col("__id").alias(key), "base", F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))).alias("spans"))


def _encoded(token: Column) -> Column:
    """Whether an encoding's alphabet holds it."""
    return F.coalesce(*(F.when(token.rlike(p), F.lit(True)) for p, _ in ENCODINGS), F.lit(False))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document."""
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(PATTERNS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
