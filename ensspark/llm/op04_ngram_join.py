"""N-gram Jaccard join by vertical partitioning.

A document is the set of its 5-word shingles, each a 64-bit hash; documents with equal sets are one class. The
global order of all shingles is cut into fragments, and every class' set into one segment for each fragment.

1. Fragments count in how many classes each shingle occurs, each fragment on its own. A shingle of one class alone
   is dead: no pair shares it. Summed over the fragments, a class with fewer than 75% live shingles has no link.
2. The others, few, order their live shingles from rare to frequent. Two that link share one of their first ones
   (the prefix that a set can lose and still link), so only these are candidates.
3. For candidate pairs the segments' overlaps are counted for each fragment separately and summed per pair.

Links are followed to components. A prefix shingle first compares all its classes with one hub; classes that are in
one component by then need no comparison. What is still apart is compared completely, so no link between
components is lost, while a group of thousands of near copies takes one comparison for each member and hub.

A shingle that is frequent within one slice of the input travels beside the fragments and only its mark goes
there, so no fragment gathers a hot shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import landed, partitions, prepared, salted, table, trimmed
from ensspark.llm.words import ODD, mix, shingle_sets

# Fixed values of the contract: five words, a similarity of 75 of 100.
WORDS = 5
PERCENT = 75

SLICE = 2_000_000  # shingles that a task packs into blocks at once
FRAGMENT = 2_500_000  # shingles of a fragment, about
HOT = 64  # classes of one slice that make a shingle hot
SEGMENTS = 4  # fragments in which candidate pairs are counted
SALTS = 8
HUBS = [1, 3, 8]  # hubs that a class is compared with, round by round, before the complete comparison
LOW = np.uint64((1 << 56) - 1)
HOT_RANK = np.uint64(255)


def least_overlap(n):
    """Fewest common shingles of a class of n with any class that it links with."""
    return -(-PERCENT * n // 100)


def class_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of every set, the same for equal sets; 0 for empty ones."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(ODD)), dtype=np.uint64)))
    size = np.diff(bounds)
    keys = mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64) * np.uint64(ODD))
    return np.where(size > 0, np.maximum(keys, np.uint64(1)), np.uint64(0))


def _text_hash(text: Column) -> Column:
    """With the id, this tells the rows of a table apart, up to exact copies."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _wordless(text: Column) -> Column:
    """Whether a text has no shingles, since it has nothing but white space (as in ``words.SPACE``)."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x09-\x0D\x20]")


def members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Document id, number of shingles, class and text hash of every row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), _text_hash(F.col(text)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bounds = shingle_sets(batch[1], WORDS)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(np.diff(bounds)), pa.array(class_keys(sets, bounds).view(np.int64)), batch[2]], names=["id", "n", "class", "h"])

    return rows.mapInArrow(lambda x: trimmed(run(x)), "id long, n long, class long, h long")


BLOCK = "fragment int, kind int, classes binary, sizes binary, counts binary, shingles binary"


def blocks(docs: DataFrame, text: str, fragments: int) -> DataFrame:
    """Packed segments of all classes of a slice, one row for each fragment.

    Kind 0: segments. Kind 1: hot shingles with their classes, under any fragment. Kind 2: marks of hot shingles.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sets, bounds = shingle_sets(batch[0], WORDS)
            held.append((sets, np.diff(bounds), class_keys(sets, bounds)))
            size += len(sets)
            if size >= SLICE:
                yield _packed(held, fragments)
                held, size = [], 0
        if held:
            yield _packed(held, fragments)

    return rows.mapInArrow(lambda x: trimmed(run(x)), BLOCK)


def _seven(shingles: np.ndarray) -> bytes:
    """The low 56 bits of each; the fragment holds the rest."""
    return np.ascontiguousarray(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    wide[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return wide.view(np.uint64).ravel()


def _block(fragment: int, kind: int, classes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shingles: np.ndarray) -> tuple:
    """A block from entries that are sorted by owner."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    own = owner[first]
    counts = np.diff(np.concatenate((first, [len(owner)]))).astype(np.uint32)
    return fragment, kind, classes[own].tobytes(), sizes[own].astype(np.uint32).tobytes(), counts.tobytes(), _seven(shingles)


def _packed(held: list, fragments: int) -> pa.RecordBatch:
    sets, sizes, classes = (np.concatenate([h[i] for h in held]) for i in range(3))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    once = np.zeros(len(classes), dtype=bool)
    once[np.unique(classes, return_index=True)[1]] = True  # equal sets of the slice travel once
    once &= sizes > 1  # a set of one shingle links with equal sets only
    keep = once[owner]
    sets, owner = sets[keep], owner[keep]
    ordered = np.sort(sets)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    hot_sets = ordered[first[np.diff(np.concatenate((first, [len(ordered)]))) >= HOT]]
    fragment_of = lambda s: ((s >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
    rows = []
    if len(hot_sets):
        hot = hot_sets[np.minimum(np.searchsorted(hot_sets, sets), len(hot_sets) - 1)] == sets
        rows.append(_block(int(classes[owner[0]] % np.uint64(fragments)), 1, classes, sizes, owner[hot], sets[hot]))
        marked = fragment_of(hot_sets)
        for f in np.unique(marked):
            rows.append((int(f), 2, b"", b"", b"", _seven(hot_sets[marked == f])))
        sets, owner = sets[~hot], owner[~hot]
    if len(sets):
        fragment = fragment_of(sets)
        order = np.argsort(fragment.astype(np.uint16) if fragments < 65536 else fragment, kind="stable")
        fragment, sets, owner = fragment[order], sets[order], owner[order]
        cuts = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1], [True])))
        rows += [_block(int(fragment[a]), 0, classes, sizes, owner[a:b], sets[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["fragment", "kind", "classes", "sizes", "counts", "shingles"])


LIVE = "bucket int, classes binary, sizes binary, counts binary, records binary"
SURVIVORS = "class long, n long, live long, prefix array<long>, segments array<binary>"


def _entries(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, set sizes and shingles of all entries of some blocks."""
    read = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in block[name]]
    counts = read("counts", np.uint32)
    classes = [np.repeat(c, k) for c, k in zip(read("classes", np.int64), counts, strict=True)]
    sizes = [np.repeat(s, k) for s, k in zip(read("sizes", np.uint32), counts, strict=True)]
    shingles = [_eight(x.as_py()) for x in block["shingles"]]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(classes, np.int64), join(sizes, np.uint32), join(shingles, np.uint64)


def _live(block: pa.Table, buckets: int) -> pa.Table:
    """Live shingles of a fragment, packed by buckets of classes; their upper byte ranks them by their number of classes.

    Hot shingles of any fragment are among them, to be united with the others of their class.
    """
    kind = block["kind"]
    classes, sizes, shingles = _entries(block.filter(pc.equal(kind, 0)))
    marks = [_eight(x.as_py()) for x in block.filter(pc.equal(kind, 2))["shingles"]]
    marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
    order = np.argsort(shingles)
    shingles, classes, sizes = shingles[order], classes[order], sizes[order]
    same = shingles[1:] == shingles[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(shingles) else np.zeros(0, bool)
    hot = np.isin(shingles, marks)
    keep = several | hot
    shingles, classes, sizes, hot = shingles[keep], classes[keep], sizes[keep], hot[keep]
    order = np.lexsort((classes, shingles))
    shingles, classes, sizes, hot = shingles[order], classes[order], sizes[order], hot[order]
    first = np.ones(len(shingles), dtype=bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])
    shingles, classes, sizes, hot = shingles[first], classes[first], sizes[first], hot[first]
    start = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1]))) if len(shingles) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((start, [len(shingles)])))
    classes_of = np.repeat(count, count)
    keep = (classes_of > 1) | hot
    rank = np.where(hot, HOT_RANK, np.minimum(8 * np.log2(np.maximum(classes_of, 1)), 254).astype(np.uint64))
    records = (shingles | (rank << np.uint64(56)))[keep]
    classes, sizes = classes[keep], sizes[keep]
    more = _entries(block.filter(pc.equal(kind, 1)))
    classes, sizes = np.concatenate((classes, more[0])), np.concatenate((sizes, more[1]))
    records = np.concatenate((records, more[2] | (HOT_RANK << np.uint64(56))))
    bucket = (classes.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((classes, bucket))
    classes, sizes, records, bucket = classes[order], sizes[order], records[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = classes[a:b]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.concatenate((first, [b - a]))).astype(np.uint32)
        rows.append((int(bucket[a]), own[first].tobytes(), sizes[a:b][first].tobytes(), counts.tobytes(), records[a:b].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(["bucket", "classes", "sizes", "counts", "records"], kinds, strict=True))})


def _united(block: pa.Table) -> pa.Table:
    """The classes of a bucket that may have links, from what all fragments hold of them."""
    read = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in block[name]]
    counts = read("counts", np.uint32)
    spread = lambda name, kind: np.concatenate([np.repeat(x, k) for x, k in zip(read(name, kind), counts, strict=True)])
    classes, sizes, records = spread("classes", np.int64), spread("sizes", np.uint32), np.concatenate(read("records", np.uint64))
    order = np.lexsort((records, classes))
    classes, sizes, records = classes[order], sizes[order], records[order]
    new = np.ones(len(classes), dtype=bool)  # a shingle that is hot in one slice only comes twice
    new[1:] = (classes[1:] != classes[:-1]) | (records[1:] != records[:-1])
    classes, sizes, records = classes[new], sizes[new].astype(np.int64), records[new]
    start = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    end = np.concatenate((start[1:], [len(classes)]))
    need = least_overlap(sizes[start])
    kept = end - start >= need
    start, end, need = start[kept], end[kept], need[kept]
    prefix, segments = [], []
    for a, b, most in zip(start.tolist(), end.tolist(), need.tolist(), strict=True):
        own = records[a:b]
        prefix.append(own[: b - a - most + 1].view(np.int64))
        segment = (own & LOW) >> np.uint64(54)
        segments.append([own[segment == f].tobytes() for f in range(SEGMENTS)])
    return pa.table({
        "class": pa.array(classes[start]), "n": pa.array(sizes[start]), "live": pa.array(end - start),
        "prefix": pa.array(prefix, pa.list_(pa.int64())), "segments": pa.array(segments, pa.list_(pa.binary())),
    })


def survivors(docs: DataFrame, text: str, shingles: int) -> DataFrame:
    """Classes that may have links: size, prefix and segments of their live shingles. Landed."""
    fragments = max(1, -(-shingles // FRAGMENT))
    # what the fragments answer is packed as well: a row for each fragment and bucket of classes
    buckets = max(partitions(docs.sparkSession), fragments // 2)
    dealt = blocks(docs, text, fragments).repartition(fragments, "fragment")
    live = dealt.groupBy("fragment").applyInArrow(lambda block: _live(block, buckets), LIVE)
    return landed(live.groupBy("bucket").applyInArrow(_united, SURVIVORS), "join-survivors")


def may_link(n: Column, rest: Column, n2: Column, rest2: Column) -> Column:
    """Whether two classes can still link: their sizes fit, and so do the shingles from the common one on.

    If this is their first common shingle, they share no more than it and what comes after it in both. If it is not,
    the first one decides about the pair, so none is lost.
    """
    fit = F.least(n, n2) * 100 >= F.greatest(n, n2) * PERCENT
    return fit & ((1 + F.least(rest, rest2)) * (100 + PERCENT) >= (n + n2) * PERCENT)


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted by segment, each on its own, then summed. Landed."""
    left = segments.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("segments").alias("sa"))
    right = segments.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("segments").alias("sb"))
    both = landed(pairs, "join-pairs").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch[i].flatten() for i in (4, 5)]
            size = [pc.binary_length(x).to_numpy() // 8 for x in sides]
            flat = [np.frombuffer(b"".join(x.to_pylist()), np.uint64) for x in sides]
            # a shingle and the row and segment that it stands in make a key; one that is met twice is common
            owner = [np.repeat(np.arange(len(s), dtype=np.uint64), s) for s in size]
            keys = np.concatenate([np.stack([o, f]) for o, f in zip(owner, flat, strict=True)], axis=1)
            keys = keys[:, np.lexsort((keys[1], keys[0]))]
            twice = (keys[0, 1:] == keys[0, :-1]) & (keys[1, 1:] == keys[1, :-1])
            partial = np.bincount(keys[0, 1:][twice].astype(np.int64), minlength=len(batch) * SEGMENTS).reshape(-1, SEGMENTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(partial.tolist(), pa.list_(pa.int64()))], names=["a", "b", "na", "nb", "partial"])

    counted = both.mapInArrow(lambda x: trimmed(run(x)), "a long, b long, na long, nb long, partial array<long>")
    common = F.aggregate("partial", F.lit(0).cast("long"), lambda x, y: x + y)
    return landed(counted.where(100 * common >= PERCENT * (F.col("na") + F.col("nb") - common)).select("a", "b"), "join-links")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (class, label) after uniting those of linked classes: the smallest label of each component. Landed.

    Works on the graph of labels: each points to its smallest neighbour, pointers are followed, edges within
    one label vanish. At least half of the labels with an edge go in each round.
    """
    by = lambda side: labels.select(F.col("class").alias(side), F.col("label").alias(f"l{side}"))
    edges = links.join(by("a"), "a").join(by("b"), "b").where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v"))
    edges = landed(edges.union(edges.select("v", "u")).distinct(), "join-edges")
    steps = None
    while not edges.isEmpty():
        down = landed(edges.groupBy("u").agg(F.min("v").alias("to")).where("to < u"), "join-down")
        while True:  # every pass halves the hops, until all point to labels that stay
            further = down.select(F.col("u").alias("to"), F.col("to").alias("next"))
            passed = down.join(further, "to", "left").select("u", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            passed = landed(passed, "join-down")
            down = passed.select("u", "to")
            if passed.where("moved").isEmpty():
                break
        if steps is None:
            steps = down
        else:
            more = down.select(F.col("u").alias("to"), F.col("to").alias("next"))
            steps = landed(steps.join(more, "to", "left").select("u", F.coalesce("next", "to").alias("to")).union(down), "join-steps")
        moved = edges
        for side in ("u", "v"):
            moved = moved.join(down.select(F.col("u").alias(side), F.col("to").alias("t")), side, "left").withColumn(side, F.coalesce("t", side)).drop("t")
        edges = landed(moved.where("u <> v").select("u", "v").distinct(), "join-edges")
    if steps is None:
        return labels
    return landed(labels.join(steps.withColumnRenamed("u", "label"), "label", "left").select("class", F.coalesce("to", "label").alias("label")), "join-labels")


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of the prefix shingles that still hold several components, with labels. Landed."""
    rows = postings.join(labels, "class")
    apart = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    return landed(rows.join(apart, "shingle", "left_semi"), "join-open")


def _against(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows with others of their shingle that are in another component and may link.

    A hot shingle's rows are dealt to several tasks, the few others are repeated there.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    renamed = [F.col(c).alias(c[0] + "2" if c != "rest" else "rest2") for c in few.columns if c not in ("shingle", "i")]
    other = few.select("shingle", *renamed, *[c for c in few.columns if c == "i"], salt)
    fit = (F.col("label") != F.col("l2")) & may_link(*map(F.col, ("n", "rest", "n2", "rest2")))
    return rows.withColumn("salt", salted("class", SALTS)).join(other, ["shingle", "salt"]).where(fit)


def components(keep: DataFrame, labels: DataFrame) -> DataFrame:
    """Final labels of the surviving classes."""
    spots = keep.select("class", "n", "live", F.posexplode("prefix").alias("at", "shingle"))
    postings = landed(spots.select("class", "n", (F.col("live") - F.col("at") - 1).alias("rest"), "shingle"), "join-postings")
    segments = keep.select("class", "n", "segments")
    for k, hubs in enumerate([*HUBS, 0]):
        rows = _open(postings, labels)
        if rows.isEmpty():
            break
        size = rows.groupBy("shingle", "label").agg(F.count("*").alias("c"))
        large = size.groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("top")).select("shingle", F.col("top.label").alias("large"))
        small = landed(rows.join(large, "shingle").where("label <> large").drop("large"), "join-small")
        if hubs:  # each class outside against a few hubs: of its shingles' hubs those with the smallest hashes
            h = [F.xxhash64("class", F.lit(k), F.lit(i)) for i in range(hubs)]
            least = [F.min(F.struct(x.alias("h"), "class", "n", "rest", "label")) for x in h]
            few = rows.groupBy("shingle").agg(F.array(*least).alias("hubs")).select("shingle", F.posexplode("hubs").alias("i", "hub"))
            found = _against(small, few.select("shingle", "hub.*", "i")).groupBy("class", "i").agg(F.min(F.struct("h2", "c2")).alias("hub"))
            pairs = found.select("class", F.col("hub.c2").alias("c2"))
        else:  # completely: all that are outside of the shingle's largest component, against all
            pairs = _against(rows, small)
        pairs = pairs.select(F.least("class", "c2").alias("a"), F.greatest("class", "c2").alias("b")).distinct()
        labels = relabelled(labels, verified(pairs, segments))
    return labels


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's id, n, class, text hash, component_id and ``part``, which tells components apart whatever their ids."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    own = landed(members(rows, "doc_id", "text"), "join-members")
    classes = own.where("n > 0").groupBy("class").agg(F.min("id").alias("id"))
    total = own.agg(F.sum("n")).first()[0] or 0
    keep = survivors(rows, "text", total)
    first = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "class").alias("label")
    labels = landed(classes.join(keep.select("class"), "class", "left_semi").select("class", first), "join-labels")
    labels = components(keep, labels)
    found = classes.join(labels, "class", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).when(~F.col("label.none"), F.col("label.id"))
    part = F.coalesce("label.class", "class").alias("part")
    found = landed(found.select("class", component.alias("component_id"), part), "join-components")
    return own.join(found, "class", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    A null or empty text, or one without words, has no shingles and its own id as component. Rows that repeat an
    id are documents of their own; a null id is larger than all others and a component of nothing but such ids has
    none. Other columns are ignored; an empty table gives an empty result. Whole texts count, however long.
    """
    return grouped(docs, key, text).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component (the one with its id), with all their columns.

    One row of each component stays, whatever ids other components have: where several of its rows have its id, the
    one with the smallest text. Documents without shingles all stay.
    """
    found = grouped(docs, key, text).where("n > 0").where(F.col("id").eqNullSafe(F.col("component_id")))
    firsts = found.groupBy("part", "id", "h").agg(F.count("*").alias("rows"))  # equal texts are of one component
    firsts = landed(firsts, "join-firsts")
    size = firsts.groupBy("part").agg(F.sum("rows").alias("size"))
    firsts = landed(firsts.join(size, "part"), "join-firsts")
    match = (F.col("d.id").eqNullSafe(F.col("f.id"))) & (F.col("d.h") == F.col("f.h"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), _text_hash(F.col(text)).alias("h"), _wordless(F.col(text)).alias("wordless"))
    bare, full = rows.where("wordless").select("row.*"), rows.where("not wordless").alias("d")
    alone = full.join(firsts.where("size = 1").alias("f"), match, "left_semi").select("row.*")
    repeated = full.join(firsts.where("size > 1").alias("f"), match).select("f.part", "d.row")
    smallest = repeated.groupBy("part").agg(F.min_by("row", F.col(f"row.{text}")).alias("row")).select("row.*")
    return bare.unionByName(alone).unionByName(smallest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return linked(table(prepared(spark), sf_dir, "documents", "doc_id", "text"))
