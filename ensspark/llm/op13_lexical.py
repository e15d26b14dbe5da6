"""Ranked lexical search of many queries at once, by common subexpressions of their term bags.

A document's score for an item is a sum of terms' contributions, so items that share terms share partial sums. The
items' bags are mined for shared term sets: terms held by the same items become one set; then the most frequent
neighbouring pairs of sets, in an order common to all items, become new sets until none is shared. What results is a
graph: terms, shared sets, items. For a chunk of documents every shared set's accumulator is filled once, from those
below it, and every item adds up the few that make it up.

Documents are read once per scan of at most ``SCAN_TERMS`` item terms: only what they hold of these terms is kept
(term, occurrences), with their length. Counts of all documents weigh the terms. Each task keeps the best documents of
each item seen so far; the shards' lists meet item by item. Items are dealt to scans by hash, so the query set may be
of any size; tasks hold a block of ``BLOCK_TERMS`` terms times a chunk of documents at a time.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, table
from ensspark.llm.words import words
from ensspark.operators.numbering import number_all

K = 20  # fixed value of the contract
SCAN_TERMS = 1 << 20  # item terms per scan of the documents: 8 bytes each go to every task
BLOCK_TERMS = 1 << 14  # item terms per graph
CHUNK_BYTES = 32 << 20  # accumulators of a chunk of documents
GAPS = np.zeros(256, dtype=bool)  # bytes between terms: ASCII but for digits and letters
GAPS[:128] = True
GAPS[[*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz"]] = False


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct terms (hashes) of each text, their occurrences, and the terms in all."""
    found = defaultdict(list)
    for h, row, _, _ in words(texts, GAPS):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for r, part in zip(row[np.concatenate(([0], cuts))] if len(row) else [], np.split(h, cuts), strict=False):
            found[int(r)].append(part)
    for r in range(len(texts)):
        terms, counts = np.unique(np.concatenate(found[r]), return_counts=True) if r in found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield terms, counts, int(counts.sum())


def _item_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = list(bags(batch["text"]))
        yield pa.RecordBatch.from_pydict({
            "q": batch["q"], "terms": pa.array([t.tobytes() for t, _, _ in own], pa.binary()),
            "counts": pa.array([c.tobytes() for _, c, _ in own], pa.binary()), "size": pa.array([len(t) for t, _, _ in own], pa.int64()),
        })


# --- shared term sets ---


@dataclass
class Graph:
    """Accumulators of a block of items: first one per term and multiplicity, then the shared sets in order."""

    terms: np.ndarray  # of each leaf: its index among the scan's terms
    times: np.ndarray  # of each leaf: its occurrences in the item
    sets: list[np.ndarray]  # of each shared set: the accumulators it adds up
    items: list[tuple[int, np.ndarray]]  # of each item: its number and the accumulators it adds up

    def additions(self) -> int:
        return sum(len(x) - 1 for x in self.sets) + sum(len(x) - 1 for _, x in self.items)


def mined(block: list[tuple[int, np.ndarray, np.ndarray]]) -> Graph:
    """The graph of some items: ``(number, terms, occurrences)``, each with at least one term."""
    leaves: dict[tuple[int, int], int] = {}
    holders = defaultdict(list)
    for at, (_, terms, counts) in enumerate(block):
        for leaf in zip(terms.tolist(), counts.tolist(), strict=True):
            holders[leaves.setdefault(leaf, len(leaves))].append(at)
    classes = defaultdict(list)
    for leaf, where in holders.items():
        classes[tuple(where)].append(leaf)
    sets: list[np.ndarray] = []
    units = [[] for _ in block]  # of each item: shared accumulators, the most shared ones first
    single = [[] for _ in block]
    for where, members in sorted(classes.items(), key=lambda x: (-len(x[0]), x[0])):
        if len(where) == 1:
            single[where[0]] = members
            continue
        unit = members[0]
        if len(members) > 1:
            unit = len(leaves) + len(sets)
            sets.append(np.array(members))
        for at in where:
            units[at].append(unit)
    while True:
        pairs = Counter(p for own in units for p in zip(own[:-1], own[1:], strict=True))
        chosen, taken = {}, set()
        for pair, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if not taken & {*pair}:
                taken |= {*pair}
                chosen[pair] = len(leaves) + len(sets)
                sets.append(np.array(pair))
        if not chosen:
            break
        for at, own in enumerate(units):
            new, i = [], 0
            while i < len(own):
                joint = chosen.get(tuple(own[i : i + 2]))
                new.append(own[i] if joint is None else joint)
                i += 1 if joint is None else 2
            units[at] = new
    items = [(q, np.array(units[at] + single[at])) for at, (q, _, _) in enumerate(block)]
    both = np.array(list(leaves), dtype=np.int64).reshape(-1, 2)
    return Graph(both[:, 0], both[:, 1], sets, items)


def graphs(items: list[tuple[int, np.ndarray, np.ndarray]], block_terms: int = BLOCK_TERMS) -> list[Graph]:
    """Graphs of blocks of items with about so many terms each."""
    found, block, size = [], [], 0
    for item in items:
        block.append(item)
        size += len(item[1])
        if size >= block_terms:
            found.append(mined(block))
            block, size = [], 0
    return found + ([mined(block)] if block else [])


# --- documents ---


def _postings(vocabulary: np.ndarray):
    """What documents hold of a sorted vocabulary, and their number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = np.zeros(len(batch), np.int64), []
            for h, row, _, _ in words(batch["text"], GAPS):
                n += np.bincount(row, minlength=len(batch))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                pair, count = np.unique(row[hit] * len(vocabulary) + at[hit], return_counts=True)
                own.append((pair, count))
            pairs = np.concatenate([p for p, _ in own]) if own else np.zeros(0, np.int64)
            pairs, back = np.unique(pairs, return_inverse=True)  # a long text spans several chunks
            tf = np.bincount(back, np.concatenate([c for _, c in own]) if own else None, len(pairs)).astype(np.int32)
            row, term = np.divmod(pairs, len(vocabulary))
            cuts = 4 * np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(batch)))))
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(x.astype(np.int32).tobytes())])
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "n": pa.array(n), "terms": binary(term), "tf": binary(tf)})

    return run


def _document_counts(size: int):
    """How many documents of a task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch["terms"])[0], minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int32()), "df": pa.array(df[term])})

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit integers of a binary column, one row after the other, and the rows' bounds."""
    column = column.cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    values = np.frombuffer(data, np.int32, int(cuts[-1])) if data is not None and cuts[-1] else np.zeros(0, np.int32)
    return values[cuts[0] :], cuts - cuts[0]


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int):
        self.k, self.held, self.new, self.floor = k, None, [], {}

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.new.append((q, score, doc, null))
        if sum(len(x[0]) for x in self.new) > 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        parts = ([self.held] if self.held is not None else []) + self.new
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        q, score, doc, null = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        order = np.lexsort((doc, null, -score, q))
        q, score, doc, null = (x[order] for x in (q, score, doc, null))
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        last = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.floor = dict(zip(q[last].tolist(), score[last].tolist(), strict=True))
        self.held, self.new = tuple(x[keep] for x in (q, score, doc, null)), []
        return self.held


def _scores(plan: list[Graph], weight: np.ndarray, documents: int, total: int, k: int, chunk_bytes: int):
    """The best documents of each item within a task."""

    def chunk(graph: Graph, local: np.ndarray, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, width: int) -> np.ndarray:
        mine = local[term] >= 0
        base = np.zeros((int(local.max()) + 1, width), np.int64)
        base[local[term[mine]], doc[mine]] = gain[mine]
        n = len(graph.terms)
        sums = np.empty((n + len(graph.sets), width), np.int64)
        np.multiply(base[local[graph.terms]], graph.times[:, None], out=sums[:n])
        for i, members in enumerate(graph.sets):
            sums[members].sum(axis=0, out=sums[n + i])
        return np.stack([sums[members].sum(axis=0) for _, members in graph.items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        locals_ = []
        for graph in plan:
            local = np.full(len(weight), -1)
            own = np.unique(graph.terms)
            local[own] = np.arange(len(own))
            locals_.append(local)
        numbers = [np.array([q for q, _ in graph.items]) for graph in plan]
        for batch in batches:
            n = batch["n"].to_numpy()
            null = batch["id"].is_null().to_numpy(zero_copy_only=False)
            ids = batch["id"].fill_null(0).to_numpy()
            terms, cuts = _flat(batch["terms"])
            tf = _flat(batch["tf"])[0].astype(np.int64)
            m = 100 - 25 + (25 * n * documents) // total
            doc = np.repeat(np.arange(len(n)), np.diff(cuts))
            gain = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            for graph, local, q in zip(plan, locals_, numbers, strict=True):
                step = max(1, chunk_bytes // (8 * (2 * len(graph.terms) + len(graph.sets) + len(q))))
                for a in range(0, len(n), step):
                    b = min(a + step, len(n))
                    part = slice(cuts[a], cuts[b])
                    score = chunk(graph, local, terms[part], doc[part] - a, gain[part], b - a)
                    floor = np.array([max(1, best.floor.get(x, 0)) for x in q.tolist()])
                    i, j = np.nonzero(score >= floor[:, None])
                    best.add(q[i], score[i, j], ids[a + j], null[a + j])
        q, score, ids, null = best.settle()
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(score, pa.int64())})

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
           scan_terms: int = SCAN_TERMS, block_terms: int = BLOCK_TERMS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The k best documents of every item: ``(item_key, rank, doc_key, score)``, scores above 0 only.

    Null or empty texts have no terms: such items give no rows, such documents do not count. Equal scores rank by
    ascending id, rows without an id last. Repeated rows are items or documents of their own, also where ids repeat.
    Empty tables give no rows; other columns are ignored. Document ids are integers. Terms are compared by 64-bit hashes.
    """
    asked = number_all(items.select(F.col(item_key).alias("item"), F.col(text).alias("text")), "q", ["item", "text"])
    asked = landed(asked, "lexical-items")
    held = asked.select("q", "text").mapInArrow(_item_bags, "q long, terms binary, counts binary, size long")
    held = landed(held.where("size > 0"), "lexical-bags")
    scans = -(-(held.agg(F.sum("size")).first()[0] or 0) // scan_terms)
    rows = docs.select(F.col(doc_key).cast("long").alias("id"), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], "q long, id long, score long")
    for scan in range(scans):
        own = held.where(F.pmod(F.xxhash64("q"), F.lit(scans)) == scan).orderBy("q").collect()  # about scan_terms terms
        found = found.unionAll(_scan(rows, own, k, block_terms, chunk_bytes)) if own else found
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_key), "rank", F.col("id").alias(doc_key), "score")


def _scan(rows: DataFrame, own: list, k: int, block_terms: int, chunk_bytes: int) -> DataFrame:
    """Candidates of some items from all documents."""
    vocabulary = np.unique(np.concatenate([np.frombuffer(r.terms, np.uint64) for r in own]))
    postings = landed(rows.mapInArrow(_postings(vocabulary), "id long, n long, terms binary, tf binary"), "lexical-postings")
    documents, total = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    counts = postings.select("terms").mapInArrow(_document_counts(len(vocabulary)), "term int, df long")
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one row per term of the scan
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    bag = [(r.q, np.searchsorted(vocabulary, np.frombuffer(r.terms, np.uint64)), np.frombuffer(r.counts, np.int64)) for r in own]
    step = _scores(graphs(bag, block_terms), weight, documents, total or 1, k, chunk_bytes)
    return postings.where("octet_length(terms) > 0").mapInArrow(step, "q long, id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for every benchmark item."""
    prepared(spark)
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return ranked(docs, items)


ORACLE = """
WITH terms AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
  UNION ALL
  SELECT 'i', item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) FROM benchmark),
lengths AS (SELECT id, count(*) AS n FROM terms WHERE kind = 'd' GROUP BY id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
tfs AS (SELECT id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT id AS item_id, term, count(*) AS times FROM terms WHERE kind = 'i' GROUP BY id, term),
weighed AS (
  SELECT item_id, term, times, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM asked JOIN dfs USING (term), total),
scored AS (
  SELECT item_id, id AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM weighed JOIN tfs USING (term) JOIN lengths USING (id), total GROUP BY item_id, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20
"""
