"""What the two span finders share: spans as rows, their digests, merging found spans with fixed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, str]  # first code point, the one after the last, kind

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def ordered(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def apart(spans: Iterable[Span], fixed: Sequence[Span]) -> list[Span]:
    """The spans that overlap none of the fixed ones."""
    taken = sorted((s, e) for s, e, _ in fixed)
    found, at = [], 0
    for span in sorted(spans):
        while at < len(taken) and taken[at][1] <= span[0]:
            at += 1
        if at == len(taken) or taken[at][0] >= span[1]:
            found.append(span)
    return found


def with_spans(docs: DataFrame, text: str, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], kinds: Sequence[str]) -> DataFrame:
    """Every row as ``row`` (a struct of all its columns) and ``spans``: base spans and those the method adds.

    ``find`` is called once in each task and gives the function over a text. A null text counts as empty.
    """
    kinds = list(kinds)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"), F.struct("*").alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = find()
        for batch in batches:
            found = []
            for body in batch[0]:
                base, more = search(body.as_py())
                known = set(base)
                found.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in known} for s, e, k in ordered([*base, *apart(more, base)], kinds)])
            yield pa.RecordBatch.from_arrays([batch[1], pa.array(found, ARROW)], names=["row", "spans"])

    return rows.mapInArrow(run, f"row {row_type}, spans {SPANS}")


def count(kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(base_only: bool) -> Column:
    """kind:start:end of all spans, comma-joined."""
    chosen = F.filter("spans", lambda s: s["base"]) if base_only else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame, base_kinds: Sequence[str], key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts by base kind, SHA-256 of the base spans, all spans."""
    return rows.select(
        f"row.{key}",
        *[count(kind).alias(f"n_{kind}") for kind in base_kinds],
        F.sha2(F.encode(joined(True), "UTF-8"), 256).alias("base_sha256"),
        joined(False).alias("spans"),
    )
