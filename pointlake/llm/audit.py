"""Filter interaction audit: what each of five quality filters removes, in every order in which they can be applied.

A document fails A with under MIN_WORDS words, B if 100 * distinct words < MIN_DISTINCT * words, C if 100 * A-Z characters >
MAX_UPPER * code points, D with any of #$%&*|, and E if a smaller doc_id has the same text (by SHA-256). Words are maximal
runs without ASCII white space, case kept. One pass gives every document its five flags; rows are counted by flags and part
(at most 32 cells a part), and a CUBE over the five flags and part sums the cells. Its grouping sets with part in which all
selected flags are false are the survivors of a subset of filters, so a step of an order is the difference of two survivors:
the subset before it and that subset with its filter. Shapley sums weigh each of the 80 pairs by the orders that pass it.

Texts are read once; only flags, 32-byte digests and ids are shuffled. Digests that many rows share are broadcast (at most HOT_KEYS
of them, by counting), the others joined by a shuffle. What is left after counting has 32 rows a part at most.

Null text is empty: it has no words, so it fails A only (and E, if repeated). Rows without a doc_id are counted, never fail E, make
no other row fail it and carry no label. Rows of one doc_id count one by one; with the same text they don't fail E for each other.
A label holds if any row of `labels` with the id says 1. Null and empty part are one part, ''. An empty table gives no row.
Only the named columns are read, so others may have any name. Texts of any length are one row each.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import hot_join, table, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
_COUNTS = ("n", "good", "toxic")


def flags(text: Column, min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_upper: int = MAX_UPPER) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    return {
        "a": n < min_words,
        "b": F.size(F.array_distinct(words)) * 100 < n * min_distinct,
        "c": (F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * max_upper),
        "d": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, a, b, c, d, e, good, toxic) for every row of docs, stored."""
    base = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = written(base.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *[c.alias(k) for k, c in flags(F.col("text")).items()]))
    first = base.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # rows of a text that stands alone have no partner; those of repeated ones get the smallest id
    again = hot_join(base.select("doc_id", "digest"), written(first), ["digest"], "_n", base.count())
    later = again.where(F.col("doc_id") > F.col("_first")).select("doc_id", "digest").distinct().withColumn("e", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    out = base.join(later, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "part", "a", "b", "c", "d", F.coalesce("e", F.lit(False)).alias("e"), zero("good"), zero("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that pass all filters of mask (bit i: filter i), for every part and subset."""
    spark = rows.sparkSession
    cells = written(rows.groupBy("part", *"abcde").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    cube = spark.sql(
        "SELECT a, b, c, d, e, part, grouping_id(a, b, c, d, e, part) AS absent, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic FROM {cells} GROUP BY CUBE (a, b, c, d, e, part)",
        cells=cells,
    ).where("absent & 1 = 0 AND " + " AND ".join(f"coalesce(NOT {x}, true)" for x in "abcde"))
    # grouping_id has its first column as bit 5 and part as bit 0, 1 where the column is summed over; mask has bit i for filter i
    mask = sum((((1 - F.getbit("absent", F.lit(5 - i)).cast("int")) * (1 << i)) for i in range(5)), F.lit(0))
    found = cube.select("part", mask.alias("mask"), *_COUNTS)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS])


def audit(rows: DataFrame) -> DataFrame:
    """rows of flagged() -> a row for each part, order and step, zeros included."""
    spark = rows.sparkSession
    alive = written(survivors(rows))
    pairs = [(p, i, p | 1 << i, factorial(p.bit_count()) * factorial(4 - p.bit_count())) for p in range(32) for i in range(5) if not p >> i & 1]
    pairs = F.broadcast(spark.createDataFrame(pairs, "before int, filter int, after int, orders long"))
    a = alive.select("part", F.col("mask").alias("before"), *[F.col(c).alias(f"{c}_0") for c in _COUNTS])
    b = alive.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_1") for c in _COUNTS])
    step = a.join(pairs, "before").join(b, ["part", "after"])
    step = step.select("part", "before", "filter", "orders", F.col("n_1").alias("kept"), *[(F.col(f"{c}_0") - F.col(f"{c}_1")).alias(f"{c}_gone") for c in _COUNTS])
    total = step.groupBy("part", "filter").agg(
        F.sum(F.col("n_gone") * F.col("orders")).alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("n_gone"))).alias("failing"),
        F.max(F.when(F.expr("before = 31 - shiftleft(1, filter)"), F.col("n_gone"))).alias("unique_fails"),
    )
    steps = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(5)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, filter int"))
    return (
        step.join(total, ["part", "filter"]).join(steps, ["before", "filter"])
        .select("part", "filter_order", "step", "kept", F.col("n_gone").alias("removed"), (F.col("failing") - F.col("n_gone")).alias("redundant"), "unique_fails",
                F.col("good_gone").alias("good_lost"), F.col("toxic_gone").alias("toxic_lost"), "shapley")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
w AS (SELECT t.doc_id, t.part, t.text, coalesce(t.doc_id > m.first, false) AS e, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS ws FROM t JOIN m ON t.text = m.text),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
 + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS bad FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, bad, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bad),
o AS (SELECT '' AS ord, 0 AS used UNION ALL SELECT ord || x, used | (1 << (ascii(x) - 65)) FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE (used >> (ascii(x) - 65)) & 1 = 0),
s AS (SELECT ord, k::INTEGER AS step, 1 << (ascii(ord[k]) - 65) AS bit, list_sum([1 << (ascii(ord[j]) - 65) FOR j IN range(1, k)])::INTEGER AS p FROM o, range(1, 6) r(k) WHERE length(ord) = 5),
g AS (SELECT part, ord, step, bit, sum(n) FILTER (WHERE bad & (coalesce(p, 0) | bit) = 0) AS kept, sum(n) FILTER (WHERE bad & coalesce(p, 0) = 0 AND bad & bit > 0) AS removed,
 sum(n) FILTER (WHERE bad & coalesce(p, 0) > 0 AND bad & bit > 0) AS redundant, sum(n) FILTER (WHERE bad = bit) AS unique_fails,
 sum(good) FILTER (WHERE bad & coalesce(p, 0) = 0 AND bad & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE bad & coalesce(p, 0) = 0 AND bad & bit > 0) AS toxic_lost FROM c, s GROUP BY part, ord, step, bit)
SELECT part, ord AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
 coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
 (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g
"""
