"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a condition over measures of the text that rejects it. On a bounded sample, chosen by the texts' hash, each
rule's cost (seconds) and selectivity (rejected share) are measured; rules then run in the order of rejections per
cost. Each step computes what its rule needs and no earlier one did, only where no earlier rule has rejected the text, so
a text that an early, cheap rule rejects never reaches the dear ones. The order decides about speed only: a text is
kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, table

# Fixed values of the contract.
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]+"
BLANK = r"[ \t-\r]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

SAMPLE_ROWS = 1000  # rows, about, on which cost and selectivity are estimated; they decide about the order alone


def words(text: Column) -> Column:
    """Runs of characters other than space and 09-0D, as an array."""
    return F.array_remove(F.split(text, BLANK), "")


def length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def repeats(of: Column) -> Column:
    """How many elements equal an earlier one."""
    return F.size(of) - F.size(F.array_distinct(of))


def windows(of: Column) -> Column:
    """Hashes of all 3-word windows."""
    every = F.transform(of, lambda w, i: F.xxhash64(w, F.get(of, i + 1), F.get(of, i + 2)))
    return F.slice(every, 1, F.greatest(F.size(of) - 2, F.lit(0)))


PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sorted_places(grams: Column) -> Column:
    """The windows' hashes, cut to their upper 40 bits, with the window's place below, sorted as plain numbers."""
    packed = F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    return F.when(F.size(grams) > PLACE, F.array().cast("array<bigint>")).otherwise(F.sort_array(packed))


def repeat_words(grams: Column, places: Column) -> Column:
    """Words in windows that are found twice or more.

    Windows that agree with a neighbour in the upper bits of the hash are candidates; these alone are sorted by
    the whole hash. Texts with more windows than a place can number are sorted as a whole.
    """
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    likely = F.filter(places, lambda x, i: same(x, F.get(places, i - 1)) | same(x, F.get(places, i + 1)))
    found = F.transform(likely, lambda x: F.struct(F.get(grams, x.bitwiseAND(F.lit(PLACE)).cast("int")).alias("g"), x.bitwiseAND(F.lit(PLACE)).cast("int").alias("i")))
    everything = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    spots = F.sort_array(F.when(F.size(grams) > PLACE, everything).otherwise(found))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(spots, _covered))


def _covered(spots: Column) -> Column:
    later = F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(F.slice(spots, 1, F.size(later)).alias("a"), later.alias("b")), lambda p: p["a"]["g"] == p["b"]["g"])
    places = F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(places), lambda i: F.array(i, i + 1, i + 2)))))


# Each measure: what it is computed from besides the text (body), and how.
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "words": ((), lambda: words(F.col("body"))),
    "lines": ((), lambda: lines(F.col("body"))),
    "grams": (("words",), lambda: windows(F.col("words"))),
    "places": (("grams",), lambda: sorted_places(F.col("grams"))),
    "n_words": (("words",), lambda: F.size("words")),
    "word_chars": (("words",), lambda: F.length(F.array_join("words", ""))),
    "n_symbols": ((), lambda: F.length("body") - length_without(F.col("body"), SYMBOLS)),
    "n_letters": ((), lambda: length_without(F.col("body"), r"[^\p{L}]+")),
    "n_capitals": ((), lambda: F.length("body") - length_without(F.col("body"), r"\p{Lu}+")),
    "n_lines": (("lines",), lambda: F.size("lines")),
    "n_dup_lines": (("lines",), lambda: repeats(F.col("lines"))),
    "n_repeat_words": (("grams", "places"), lambda: repeat_words(F.col("grams"), F.col("places"))),
}


def with_measure(rows: DataFrame, name: str) -> DataFrame:
    """Add a measure and what it is computed from, each in a step of its own, where no rule has rejected the text yet."""
    if name in rows.columns:
        return rows
    sources, formula = MEASURES[name]
    for source in sources:
        rows = with_measure(rows, source)
    return rows.withColumn(name, F.when(F.col("rule").isNull(), formula()))


@dataclass(frozen=True)
class Rule:
    """A name, the measures that the rule needs, and the condition over them that rejects a text."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


# The contract's base, and the method's own rules; prose passes these by a wide margin.
BASE_RULES = [
    Rule("few words", ("n_words",), lambda: F.col("n_words") < MIN_WORDS),
    Rule("repeated words", ("n_repeat_words", "n_words"), lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
]
RULES = [
    Rule("symbols", ("n_symbols", "n_words"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("shouting", ("n_capitals", "n_letters"), lambda: 2 * F.col("n_capitals") > F.col("n_letters")),
    Rule("no letters", ("n_letters", "word_chars"), lambda: 2 * F.col("n_letters") < F.col("word_chars")),
    Rule("long words", ("word_chars", "n_words"), lambda: F.col("word_chars") > 25 * F.col("n_words")),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
]


def cascade(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fill ``rule``, where it is null, with the first rule that rejects the text ``body``; null where none does."""
    for rule in rules:
        for name in rule.needs:
            rows = with_measure(rows, name)
        rows = rows.withColumn("rule", F.when(F.col("rule").isNotNull(), F.col("rule")).when(rule.rejects(), rule.name))
    return rows


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.cost, 1e-4)


def _bodies(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    return docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.lit(None).cast("string").alias("rule"))


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of every rule on a bounded sample, best rejection per cost first.

    The faster one of two runs after a first one counts, less what reading the sample costs, so compiling does not.
    An empty sample leaves the rules in their order.
    """
    bodies = _bodies(docs, text, F.lit(0).alias("none")).drop("kept")
    share = max(1, docs.count() // rows)
    sample = landed(bodies.where(F.pmod(F.xxhash64("body"), F.lit(share)) == 0).limit(4 * rows), "quality-sample")

    def timed(judged: DataFrame) -> tuple[float, int, int]:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            n, rejected = judged.agg(F.count("*"), F.count_if(F.col("rule").isNotNull())).first()
            took.append(time.perf_counter() - began)
        return min(took[1:]), n, rejected

    base, n, _ = timed(sample.withColumn("rule", F.when(F.length("body") < 0, "none")))
    found = []
    for rule in rules:
        took, _, rejected = timed(cascade(sample, [rule]))
        found.append(Estimate(rule, max(took - base, 0.001), rejected / max(n, 1)))
    return sorted(found, key=lambda e: -e.gain)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES), text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    A null text counts as empty, so the first base rule rejects it. Repeated rows are judged alike; an empty
    table stays empty; no column is added, so none can clash.
    """
    order = [e.rule for e in estimate(docs, rules, text)]
    rows = cascade(_bodies(docs, text, *[F.col(c) for c in docs.columns]), order)
    # a filter is not moved below a number of the row; else the optimizer would copy each step into the next one's condition
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.where(F.col("rule").isNull() & (F.col("row") >= 0)).select("kept.*")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: the key, the base measures, whether the base fails, whether it is kept, the rule that rejects.

    The base measures are computed for every text; those of the other rules only where the base and the rules before
    leave the text.
    """
    order = [e.rule for e in estimate(docs, rules, text)]
    rows = _bodies(docs, text, F.col(key).alias("doc_id"))
    for name in BASE:
        rows = with_measure(rows, name)
    rows = cascade(rows, BASE_RULES)
    rows = cascade(rows.withColumn("base_failed", F.col("rule").isNotNull()), order)
    counts = [F.col(c).cast("long").alias(c) for c in BASE]
    return rows.select("kept.doc_id", *counts, "base_failed", F.col("rule").isNull().alias("kept"), F.col("rule").alias("rejected_by"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and judges every document."""
    return judged(table(prepared(spark), sf_dir, "documents", "doc_id", "text")).drop("rejected_by")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
m AS (
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
       length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_capitals
FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_capitals > n_letters
            OR 2 * n_letters < word_chars OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""
