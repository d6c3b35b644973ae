"""Document fingerprints by winnowing.

A text's words, runs longer than PIECE characters in pieces of so many, have codes (CRC-32, 28 bits of it). Every K
neighbouring words have a hash, a polynomial of their codes modulo 2 ** 31 - 1; of each WINDOW neighbouring hashes the least is
chosen, of equal ones the rightmost. The chosen hashes with their positions (word numbers) are the fingerprint. So two texts that share K + WINDOW - 1 = 12
words in a row, wherever they stand, share a hash of these, and what is shorter than K words never matches (but for
equal hashes of unequal words, of chance 2 ** -28 or less).

All is Column expressions: words, codes, hashes and windows are arrays of one text, each computed once. neighbours() puts each
document beside the next in order of its id: ids are cut at quantiles into buckets of about ROWS rows, and a window looks one
row ahead in each; each bucket also gets the first row of the next, the last that of the first. So texts are shuffled once, and
no task holds more than a bucket; rows with one and the same id share a bucket.

Defined results: a null text counts as empty; an empty or blank text has an empty fingerprint, and the likeness of two
empty fingerprints is 1; a text shorter than K words has one hash, of its codes and zeros; a long text is hashed whole; rows with a null id come first, those
with equal ids follow each other by a hash of their texts; a single row is its own next; an empty table gives an empty
result; other columns are ignored or, by fingerprints(), kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table

#: words of a hash, hashes of a window
K, WINDOW = 5, 8
#: characters of a word, at most
PIECE = 16
TOKEN = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"
#: rows of a bucket, and the most buckets; with more rows buckets grow
ROWS, BUCKETS = 256, 32_768
# The hash's modulus and base, and the bits of a word's code (five products fit a long).
PRIME, BASE = 2147483647, 1000003
CODE_BITS = 28
_POWER = [pow(BASE, i, PRIME) for i in range(K)]
_WORD = 1 << 32
_KEYS = "array<bigint>"


def _let(value: Column, use) -> Column:
    """use(value), computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keys(text: Column | str = "text") -> Column:
    """A text's fingerprint: hash * 2 ** 32 + position (from 0) of what each window chooses, without repeats, by position."""
    text = F.col(text) if isinstance(text, str) else text

    def hashed(c: Column) -> Column:
        return F.transform(c, lambda x, i: sum((F.get(c, i + j) * _POWER[K - 1 - j] for j in range(1, K)), x * _POWER[K - 1]) % PRIME * _WORD + (_WORD - 1 - i))

    def windows(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.least(x, *(F.get(p, i + j) for j in range(1, WINDOW))))

    def chosen(c: Column) -> Column:
        full = F.when((F.size(c) > 0) & (F.size(c) < K), F.concat(c, F.array_repeat(F.lit(0).cast("bigint"), K - F.size(c)))).otherwise(c)
        # hashes that would reach beyond the text are null and last; least() passes over nulls
        least = _let(_let(full, hashed), windows)
        n = F.when(F.size(c) == 0, 0).otherwise(F.greatest(F.size(c) - (K + WINDOW - 2), F.lit(1)))
        return F.transform(F.array_distinct(F.slice(least, F.lit(1), n)), lambda p: p - p % _WORD + (_WORD - 1) - p % _WORD)

    codes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.crc32(w.cast("binary")) % (1 << CODE_BITS))
    return _let(codes, chosen)


def hashes(fingerprint: Column) -> Column:
    """A fingerprint's different hashes."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes, 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def written(fingerprint: Column) -> Column:
    """position:hash, separated by spaces."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat_ws(":", v % (1 << 32), F.shiftright(v, 32))), " ")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with their fingerprints: arrays of hash * 2 ** 32 + position, by position."""
    return docs.withColumn(name, keys(F.coalesce(F.col(text), F.lit(""))))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key (null: 0), found in two steps."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]
    heads, lists = F.from_json(F.lit(json.dumps([p[0] for p in parts])), _KEYS), F.from_json(F.lit(json.dumps(parts)), f"array<{_KEYS}>")
    part = F.size(F.filter(heads, lambda b: b < key)) - 1
    inside = F.size(F.filter(F.get(lists, part), lambda b: b < key))
    return F.when(key.isNull() | (part < 0), 0).otherwise(part * 256 + inside)


def bucketed(docs: DataFrame, key: str, rows: int = ROWS, most: int = BUCKETS) -> DataFrame:
    """docs, __bucket and __extra: buckets of ids that follow each other, dealt by bucket; rows with __extra are the first of the next bucket."""
    count = docs.count()
    n = max(1, min(most, count // rows))
    bounds: list[int] = []
    if n > 1:
        shares = F.from_json(F.lit(json.dumps([i / n for i in range(1, n)])), "array<double>")
        bounds = sorted(set(docs.agg(F.percentile_approx(F.col(key).cast("bigint"), shares, F.lit(20 * n))).first()[0] or []))
    own = docs.withColumn("__bucket", _bucket(F.col(key).cast("bigint"), bounds)).withColumn("__extra", F.lit(False))
    firsts = own.groupBy("__bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("id"))).alias("f"))
    order = W.orderBy("__bucket")  # a row for each bucket
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select(F.col("f.id").alias("__first"), F.coalesce(F.lag("__bucket").over(order), F.last("__bucket").over(whole)).alias("__bucket"))
    extra = docs.join(F.broadcast(firsts), docs[key].eqNullSafe(firsts["__first"])).withColumn("__extra", F.lit(True))
    return own.unionByName(extra.select(*own.columns)).repartition("__bucket")


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), fingerprint, next_text and next_fingerprint: each row with the row that follows by key, the last with the first."""
    narrow = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = bucketed(narrow, "__key").withColumn("__own", keys("__text"))
    order = W.partitionBy("__bucket").orderBy("__extra", F.col("__key").asc_nulls_first(), F.xxhash64("__text"))
    rows = rows.withColumn("__after", F.lead(F.struct(F.col("__text").alias("text"), F.col("__own").alias("keys"))).over(order)).filter("not __extra")
    return rows.select(F.col("__key").alias(key), F.col("__text").alias(text), F.col("__own").alias("fingerprint"), F.col("__after.text").alias("next_text"), F.col("__after.keys").alias("next_fingerprint"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of the document with its last quarter replaced by the next document's beginning, and how alike they are."""
    rows = neighbours(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("gone", F.floor(F.col("n_chars") / 4))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("gone")).cast("int")), F.left("next_text", F.col("gone").cast("int")))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fingerprint").alias("own"), F.col("next_fingerprint").alias("other"), keys("edited").alias("changed"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), *(hashes(F.col(c)).alias(c) for c in ("own", "other", "changed")))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))


def _sql_keys(text: str, name: str, source: str) -> str:
    """CTEs that give position * 2 ** 32 + hash of the fingerprint's hashes, straight from the definition: a row for each word."""
    h = " + ".join(f"lead(c, {j}, 0) OVER w * {pow(BASE, K - 1 - j, PRIME)}" for j in range(K))
    return f"""
{name}_w AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all({text}, '{TOKEN}') AS w FROM {source})),
{name}_c AS (SELECT doc_id, i, n, c FROM {name}_w JOIN crc USING (w)),
{name}_h AS (SELECT doc_id, n, i, ({h}) % {PRIME} * 4294967296 + 4294967295 - i AS p FROM {name}_c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{name}_m AS (SELECT doc_id, n, i, min(p) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM {name}_h WHERE i <= greatest(n - {K}, 0)),
{name}_l AS (SELECT doc_id, list(DISTINCT (4294967295 - m % 4294967296) * 4294967296 + m // 4294967296) AS f FROM {name}_m WHERE i <= greatest(n - {K + WINDOW - 1}, 0) GROUP BY doc_id),
{name} AS (SELECT s.doc_id, coalesce(list_sort(f), []) AS f, coalesce(list_distinct(list_transform(f, lambda v: v % 4294967296)), []) AS h FROM {source} s LEFT JOIN {name}_l l ON l.doc_id = s.doc_id)"""


def _sql_alike(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END::DOUBLE"


_WRITTEN = "array_to_string(list_transform({0}, lambda v: (v // 4294967296) || ':' || (v % 4294967296)), ' ')"
# Ids are taken to be different. DuckDB has no CRC-32: it is computed byte by byte for each different word.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8
), crc_list AS (SELECT list(c ORDER BY i) AS l FROM crc_table WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, t, next_id, CASE WHEN length(t) < 4 THEN t ELSE left(t, length(t) - length(t) // 4) || left(u, length(t) // 4) END AS x FROM n),
words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(t, '{TOKEN}') || regexp_extract_all(x, '{TOKEN}')) AS w FROM e)),
crc AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT % {1 << CODE_BITS} AS c FROM words, crc_list),
{_sql_keys("t", "own", "e")},
{_sql_keys("x", "changed", "e")}
SELECT e.doc_id, length(t)::BIGINT AS n_chars, sha256(x) AS edited_sha256, {_WRITTEN.format("own.f")} AS fingerprint, {_WRITTEN.format("changed.f")} AS edited_fingerprint,
  {_sql_alike("own.h", "changed.h")} AS near_edited, {_sql_alike("own.h", "other.h")} AS near_next
FROM e JOIN own ON own.doc_id = e.doc_id JOIN changed ON changed.doc_id = e.doc_id JOIN own AS other ON other.doc_id = e.next_id
"""
