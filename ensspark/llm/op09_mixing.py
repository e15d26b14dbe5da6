"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

A source's target over its size is the number of copies that each of its documents is due. Whole copies are
certain; the fraction left is an inclusion probability p. Documents are ranked by their random odds over their
inclusion odds, u/(1-u) : p/(1-p), and taken in this order until their words come nearest to what the source's
target leaves. A tilt may make the copies due differ between the documents of a source.

No window runs over the documents: the rank is cut into bins whose words are summed first, the bin that holds
the cut is cut again, and only the ranks of the last bin are sorted. So a source with a third of all rows is
spread like any other. One row per source is sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, table
from ensspark.llm.op07_quality import words

# Fixed values of the contract.
WEIGHTS = [5, 2, 1]
SHARE = 1.5
MOST_COPIES = 2

SEED = "mix-1"
BITS = 12  # bins of one level: 2^12


def n_words(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources, from rows (source, source_size): adds their order, weight and target.

    Sources by code point, null last, weigh 5, 2, 1, repeating. The share is dealt by weight; no target passes
    twice its source's size, and what is above goes to the others by weight. In closed form: let a source be full
    at level r = 2 * size / weight; it is capped if filling all sources up to its own level takes no more than the
    share. The rest have the level that spends what the capped ones leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "sid")
    rows = sizes.withColumn("sid", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + F.when(F.col("sid") % len(WEIGHTS) == 0, len(WEIGHTS)).otherwise(0)))
    rows = rows.withColumn("cap", MOST_COPIES * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", SHARE * F.sum("source_size").over(everything))
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0)) + F.col("level") * F.sum("weight").over(onward)
    rows = rows.withColumn("capped", spent <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / open_weight)
    return rows.select("source", "sid", "source_size", target.cast("double").alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 from the key's MD5: the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def due_copies(tilt: Column | float = 1.0) -> tuple[Column, Column]:
    """Certain copies and the probability of one more, from target, source_size and the tilt."""
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size") * F.lit(tilt), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    return F.floor(due).cast("int"), due - F.floor(due)


def rank(u: Column, p: Column) -> Column:
    """Pareto rank: random odds over inclusion odds, brought to 0..1 by x/(1+x), which keeps the order."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def cuts(docs: DataFrame) -> DataFrame:
    """Where each source's sample ends, from rows (sid, target, words, p, v, certain words): one row per source."""
    need = docs.groupBy("sid").agg((F.max("target") - F.sum("sure")).alias("need"))
    rows = docs.where("p > 0").select("sid", "words", "v")
    bins = [F.floor(F.col("v") * F.lit(float(1 << (BITS * k)))).cast("long") for k in (1, 2)]
    edge = need.select("sid", "need", F.lit(0.0).alias("before"))
    keys: list[str] = ["sid"]
    for k, b in enumerate(bins, 1):
        rows = rows.withColumn(f"b{k}", b)
        inside = rows if k == 1 else rows.join(edge.select(*keys), keys, "left_semi")
        own = Window.partitionBy("sid").orderBy(f"b{k}")
        # landed, so that rows are summed by bin before the bins of a source meet
        sums = landed(inside.groupBy("sid", f"b{k}").agg(F.sum("words").alias("n")), "mix-bins").withColumn("upto", F.sum("n").over(own))
        found = sums.join(edge.select("sid", "need", "before"), "sid").where("before + upto - n < need AND need <= before + upto")
        keys = [*keys, f"b{k}"] if k == 1 else ["sid", "b1", "b2"]
        back = found.select("sid", "need", (F.col("before") + F.col("upto") - F.col("n")).alias("before"), f"b{k}")
        edge = back if k == 1 else back.join(edge.select("sid", "b1"), "sid")
    own = Window.partitionBy("sid").orderBy("v")
    ties = rows.join(edge.select("sid", "b1", "b2"), ["sid", "b1", "b2"], "left_semi").groupBy("sid", "v").agg(F.sum("words").alias("n"))
    ties = ties.withColumn("upto", F.sum("n").over(own)).join(edge.select("sid", "need", "before"), "sid")
    last = ties.where("before + upto - n + before + upto <= 2 * need").groupBy("sid").agg(F.max("v").alias("last"))
    done = need.join(edge.select("sid", "b2"), "sid", "left").join(last, "sid", "left")
    return done.select("sid", "need", F.col("b2").alias("edge"), "last")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tilt: Column | float = 1.0, seed: str = SEED) -> DataFrame:
    """Every row as ``row`` (a struct of all its columns) with size, source_size, target and copies (0 to 2).

    A null text has size 0, a null source is a source of its own, a null key draws like an empty one. Rows with
    equal keys in one source have equal ranks and are taken together; the cut is where the words come nearest to
    the target. Sources without words have target 0 and no copies. Columns of the input stay inside ``row``, so no
    name can clash; an empty table gives an empty result.
    """
    facts = landed(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("words"), F.col(key).cast("string").alias("key")), "mix-facts")
    targets = landed(source_targets(facts.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    certain, p = due_copies(tilt)

    def placed(rows: DataFrame, by: Column) -> DataFrame:
        rows = rows.join(targets.withColumnRenamed("source", "of"), by.eqNullSafe(F.col("of"))).drop("of")
        rows = rows.withColumn("certain", certain).withColumn("p", p)
        return rows.withColumn("v", F.when(F.col("p") > 0, rank(uniform(F.col("key"), seed), F.col("p"))))

    narrow = placed(facts, F.col("source")).withColumn("sure", F.col("certain") * F.col("words"))
    ends = landed(targets.join(cuts(narrow), "sid", "left"), "mix-cuts")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("src"), n_words(F.col(text)).alias("size"), F.col(key).cast("string").alias("key"))
    rows = rows.join(ends.withColumnRenamed("source", "of"), F.col("src").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("certain", certain).withColumn("p", p)
    rows = rows.withColumn("v", F.when(F.col("p") > 0, rank(uniform(F.col("key"), seed), F.col("p"))))
    bin_ = F.floor(F.col("v") * F.lit(float(1 << (2 * BITS)))).cast("long")
    inside = (bin_ < F.col("edge")) | ((bin_ == F.col("edge")) & (F.col("v") <= F.col("last")))
    taken = F.when((F.col("p") <= 0) | (F.col("need") <= 0), False).when(F.col("edge").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))
    return rows.select("row", "size", "source_size", "target", (F.col("certain") + taken.cast("int")).alias("copies"))


def copied(docs: DataFrame, **options) -> DataFrame:
    """Every row as many times as the mix takes it, with its own columns."""
    rows = mixed(docs, **options).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents."""
    rows = mixed(table(prepared(spark), sf_dir, "documents", "doc_id", "text", "source"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '),
                                              lambda x: x <> '')) AS BIGINT) AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS level FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + level * sum(weight) OVER (ORDER BY level, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= total AS capped FROM l),
t AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE)
                ELSE CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE) * weight / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
      FROM c),
e AS (SELECT d.*, t.sid, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS due
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(due) AS certain, due - floor(due) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
             target - sum(floor(due) * size) OVER (PARTITION BY sid) AS need FROM p),
v AS (SELECT *, odds / (1 + odds) AS v FROM o),
k AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY sid, v) AS own FROM v)
SELECT doc_id, size, source_size, target,
       CAST((certain + CASE WHEN p > 0 AND need > 0 AND 2 * upto - own <= 2 * need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""
