"""SentencePiece encoding and decoding with the N best segmentations.

The text's characters and the model's pieces form a lattice; a segmentation's score is the sum of its pieces'
scores. A forward Viterbi pass gives the best score up to every character. These scores are exact heuristics for
an A* search from the end back to the start, which so meets the complete segmentations in the order of their
scores and expands little beside them.

No piece has a blank after another character, so the lattice falls apart before every run of blanks. Each part
is searched once per task and remembered; the N best of a text are those of its parts, combined: only the N - 1
parts that lose least by their second choice can differ from their first one. Characters that no piece covers
are spelt in bytes, so decoding gives back every text. The model file's path is a parameter; executors get the
pieces, which are of a fixed number.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import prepared, table, trimmed

MODEL = "piece_bpe_32k.model"  # of the public tokenizers' folder, unless a path is given
N_BEST = 4
KNOWN_PARTS = 400_000  # parts that a task remembers at a time
WIDEST = 64  # longest part, in characters, that is searched side by side with others of its length
ROWS = 1 << 13  # parts that are searched at once
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PART = re.compile(r" *[^ ]+| +")
BLANK = "▁"
Part = tuple[list[float], list[list[int]]]  # scores and ids, best first


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """The model's pieces: text (blanks for blank marks) to id and score, bytes to ids, ids to bytes."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        self.scores: dict[str, tuple[int, float]] = {}
        self.bytes, self.raw = [-1] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                text = piece.replace(BLANK, " ")
                self.scores[text] = (i, model.get_score(i))
                self.raw.append(text.encode())
        self.longest = max(map(len, self.scores))
        self.starts: dict[str, tuple[int, float] | None] = {t[:k]: None for t in self.scores for k in range(1, len(t))}
        self.starts.update(self.scores)
        self.unknown = min(s for _, s in self.scores.values()) - 10.0  # a character in bytes is worse than any piece
        self.tables = self._tables()

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: sorted 64-bit hashes of all beginnings of pieces, their ids (-1 if they are none) and scores."""
        found = []
        for k in range(1, self.longest + 1):
            own = [(t, x) for t, x in self.starts.items() if len(t) == k]
            codes = np.frombuffer("".join(t for t, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64)
            h = np.zeros(len(own), np.uint64)
            for i in range(k):
                h = h * FACTOR + (codes[:, i] + np.uint64(1)) * SPREAD
            order = np.argsort(h)
            ids = np.array([-1 if x is None else x[0] for _, x in own], np.int32)
            scores = np.array([0.0 if x is None else x[1] for _, x in own])
            if len(np.unique(h)) < len(h):
                raise ValueError("two beginnings of pieces have the same hash")
            found.append((h[order], ids[order], scores[order]))
        return found

    def firsts(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``first`` of many parts: best scores, what the second best lose, numbers of ids, ids one part after the other."""
        size = np.array([len(p) for p in parts], np.int64)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size) - size
        score, gap, count, held = np.zeros(len(parts)), np.zeros(len(parts)), np.zeros(len(parts), np.int64), []
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            width = int(size[same[0]])
            if width > WIDEST:
                for k in same.tolist():
                    score[k], gap[k], ids = self.first(parts[k])
                    count[k] = len(ids)
                    held.append((np.array([k]), np.array(ids, np.int32)))
                continue
            for a in range(0, len(same), ROWS):
                own = same[a : a + ROWS]
                score[own], gap[own], count[own], ids = self._side_by_side(codes[start[own] + np.arange(width)[:, None]])
                held.append((own, ids))
        begin = np.zeros(len(parts), np.int64)
        at = 0
        for own, ids in held:
            begin[own] = at + np.cumsum(count[own]) - count[own]
            at += len(ids)
        flat = np.concatenate([ids for _, ids in held]) if held else np.zeros(0, np.int32)
        return score, gap, count, gathered(flat, begin, count)

    def _side_by_side(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward Viterbi over columns of code points, one part each."""
        width, many = codes.shape
        best, second = np.full((width + 1, many), -np.inf), np.full((width + 1, many), -np.inf)
        back, what = np.zeros((width + 1, many), np.int16), np.full((width + 1, many), -1, np.int32)
        best[0] = 0.0
        terms = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD

        def relax(i: int, j: int, rows: np.ndarray, gain: np.ndarray | float, ids: np.ndarray | int) -> None:
            score, top, next_ = best[i, rows] + gain, best[j, rows], second[j, rows]
            up = score > top
            second[j, rows] = np.where(up, np.maximum(top, second[i, rows] + gain), np.maximum(next_, score))
            best[j, rows] = np.where(up, score, top)
            won = rows[up]
            back[j, won] = i
            what[j, won] = ids if np.isscalar(ids) else ids[up]

        for i in range(width):
            live, h, single = np.arange(many), np.zeros(many, np.uint64), np.zeros(many, bool)
            for k in range(1, min(self.longest, width - i) + 1):
                keys, ids, scores = self.tables[k - 1]
                h = h * FACTOR + terms[i + k - 1, live]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                known = keys[at] == h
                live, h, at = live[known], h[known], at[known]
                if not len(live):
                    break
                piece = ids[at] >= 0
                rows, at = live[piece], at[piece]
                if k == 1:
                    single[rows] = True
                relax(i, i + k, rows, scores[at], ids[at])
            relax(i, i + 1, np.flatnonzero(~single), self.unknown, -1)
        j, rows, steps = np.full(many, width), np.arange(many), []
        while len(rows):
            steps.append((rows, what[j[rows], rows], back[j[rows], rows].astype(np.int64)))
            j[rows] = steps[-1][2]
            rows = rows[j[rows] > 0]
        owner, ids, place = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((place, owner))
        owner, ids, place = owner[order], ids[order], place[order]
        if (ids < 0).any():  # characters without a piece are spelt in bytes
            spelt = [[x] if x >= 0 else [self.bytes[b] for b in chr(codes[p, r]).encode("utf-8", "surrogatepass")] for x, p, r in zip(ids.tolist(), place.tolist(), owner.tolist(), strict=True)]
            owner = np.repeat(owner, [len(x) for x in spelt])
            ids = np.array([i for x in spelt for i in x], np.int32)
        return best[width], best[width] - second[width], np.bincount(owner, minlength=many), ids

    def first(self, part: str) -> tuple[float, float, list[int]]:
        """Forward Viterbi: the best score, how much the second best loses, the best ids."""
        size, get, none = len(part), self.starts.get, -float("inf")
        best, second, back = [none] * (size + 1), [none] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            one, two, single = best[i], second[i], False
            for j in range(i + 1, size + 1):
                found = get(part[i:j], False)
                if found is False:
                    break
                if found is None:
                    continue
                if j == i + 1:
                    single = True
                score = one + found[1]
                if score > best[j]:
                    other = two + found[1]
                    second[j] = best[j] if best[j] > other else other
                    best[j], back[j] = score, (i, found[0])
                elif score > second[j]:
                    second[j] = score
            if not single:
                j, score = i + 1, one + self.unknown
                if score > best[j]:
                    other = two + self.unknown
                    second[j] = best[j] if best[j] > other else other
                    best[j], back[j] = score, (i, part[i])
                elif score > second[j]:
                    second[j] = score
        tail, j, chain = None, size, []
        while j:
            j, what = back[j]
            chain.append(what)
        for what in chain:
            tail = (what, tail)
        return best[size], best[size] - second[size], self._ids(tail)

    def nbest(self, part: str, n: int = N_BEST) -> Part:
        """The n best segmentations of a part, ties by the search: longer last pieces first."""
        size, longest, scores = len(part), self.longest, self.scores
        best = [0.0] * (size + 1)
        edges: list[list[tuple[int, float, object]]] = [[]] * (size + 1)
        for j in range(1, size + 1):
            own, top = [], None
            for i in range(max(0, j - longest), j):
                found = scores.get(part[i:j])
                if found:
                    own.append((i, found[1], found[0]))
                    if top is None or best[i] + found[1] > top:
                        top = best[i] + found[1]
            if not own or own[-1][0] != j - 1:
                own.append((j - 1, self.unknown, part[j - 1]))
                if top is None or best[j - 1] + self.unknown > top:
                    top = best[j - 1] + self.unknown
            best[j], edges[j] = top, own
        heap: list[tuple] = [(-best[size], size, 0, 0.0, None)]
        found_scores, found_ids, count = [], [], 0
        while heap and len(found_scores) < n:
            f, j, _, g, tail = heapq.heappop(heap)
            if j == 0:
                found_scores.append(-f)
                found_ids.append(self._ids(tail))
                continue
            for i, score, what in edges[j]:
                count += 1
                heapq.heappush(heap, (-(g + score + best[i]), i, count, g + score, (what, tail)))
        return found_scores, found_ids

    def _ids(self, tail) -> list[int]:
        ids: list[int] = []
        while tail is not None:
            what, tail = tail
            if isinstance(what, str):
                ids.extend(self.bytes[b] for b in what.encode("utf-8", "surrogatepass"))
            else:
                ids.append(what)
        return ids


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of a flat array that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Grown:
    """An array that grows."""

    def __init__(self, kind: type):
        self.values, self.size = np.empty(1 << 16, dtype=kind), 0

    def extend(self, more: Sequence) -> None:
        while self.size + len(more) > len(self.values):
            self.values = np.concatenate((self.values, np.empty_like(self.values)))
        self.values[self.size : self.size + len(more)] = more
        self.size += len(more)


class Encoder:
    """Encodes batches of texts and remembers the parts it met."""

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n = pieces, n
        self.raw = np.frombuffer(b"".join(pieces.raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in pieces.raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.more: dict[str, Part] = {}  # second and further choices: what they lose, their ids
        self.best, self.gap, self.start, self.count = Grown(np.float64), Grown(np.float64), Grown(np.int64), Grown(np.int64)
        self.ids = Grown(np.int32)

    def learn(self, parts: Sequence[str]) -> None:
        """Take in parts that are not known yet."""
        score, gap, count, ids = self.pieces.firsts(parts)
        self.start.extend(self.ids.size + np.cumsum(count) - count)
        self.best.extend(score)
        self.gap.extend(gap)
        self.count.extend(count)
        self.ids.extend(ids)

    def choices(self, part: str) -> Part:
        """What the further segmentations of a part lose, and their ids."""
        found = self.more.get(part)
        if found is None:
            k = self.index[part]
            best = self.ids.values[self.start.values[k] :][: self.count.values[k]].tolist()
            scores, ids = self.pieces.nbest(part, self.n)
            own = [(scores[0] - x, i) for x, i in zip(scores, ids, strict=True) if i != best][: self.n - 1]
            self.more[part] = found = [x for x, _ in own], [i for _, i in own]
        return found

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[float], list[list]]:
        """Bounds of the texts' ids, the ids, the best scores, and the others up to the n-th of each text.

        Another segmentation is its score and its changes: the part's first code point, the one after its last, and
        the ids that replace the best ones.
        """
        if len(self.index) > KNOWN_PARTS or self.ids.size > 8 * KNOWN_PARTS:
            self.forget()
        names = [PART.findall(" " + t) if t else [] for t in texts]
        known, number = len(self.index), self.index.setdefault
        index = np.array([number(name, len(self.index)) for own in names for name in own], dtype=np.int64)
        self.learn(list(itertools.islice(reversed(self.index), len(self.index) - known))[::-1])
        parts = np.concatenate(([0], np.cumsum([len(own) for own in names]))).astype(np.int64)
        sizes = self.count.values[index]
        ids = gathered(self.ids.values, self.start.values[index], sizes)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[parts]
        scores, others = [], []
        for own, a, b in zip(names, parts[:-1], parts[1:], strict=True):
            scores.append(float(self.best.values[index[a:b]].sum()))
            others.append(self._others(own, index[a:b], scores[-1]))
        return bounds, ids, scores, others

    def _others(self, names: Sequence[str], index: np.ndarray, score: float) -> list:
        gaps = self.gap.values[index]
        near = np.argsort(gaps, kind="stable")[: self.n - 1]
        near = near[np.isfinite(gaps[near])].tolist()
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for k in near:
            losses = self.choices(names[k])[0]
            best = sorted([*best, *((lost + loss, (*done, (k, c))) for lost, done in best for c, loss in enumerate(losses))], key=lambda x: (x[0], x[1]))[: self.n]
        if len(best) == 1:
            return []
        starts = np.concatenate(([0], np.cumsum(list(map(len, names)))))
        change = lambda k, c: {"start": max(0, int(starts[k]) - 1), "end": int(starts[k + 1]) - 1, "ids": self.choices(names[k])[1][c]}
        return [{"score": score - lost, "changes": [change(k, c) for k, c in sorted(done)]} for lost, done in best[1:]]

    def decode(self, bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids between bounds, without the blank in front of each."""
        sizes = self.raw_size[ids]
        data = gathered(self.raw, self.raw_start[ids], sizes)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        keep = np.ones(len(data), dtype=bool)
        keep[cuts[:-1][np.diff(cuts) > 0]] = False
        cuts = cuts - np.concatenate(([0], np.cumsum(np.diff(cuts) > 0)))
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes()))


CHANGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
OTHER = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(CHANGE))]))
OTHERS = "array<struct<score:double,changes:array<struct<start:int,end:int,ids:array<int>>>>>"


def encoded(docs: DataFrame, text: str = "text", n: int = N_BEST, model: str | None = None) -> DataFrame:
    """Every row as ``row`` (a struct of all its columns but the text) with the encoding of its whole text.

    ids and score: the best segmentation; others: the second to the n-th, as changes to it; n_tokens; round_trip:
    whether decoding gives the text. A null or empty text has no ids, score 0 and no others; repeated rows get
    equal results; columns stay inside ``row``, so no name can clash; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"), F.struct(*keep).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    pieces = Pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, n)
        for batch in batches:
            bounds, ids, scores, others = encoder.encode(batch[0].to_pylist())
            same = pc.equal(encoder.decode(bounds, ids), batch[0].cast(pa.large_string()))
            arrays = [batch[1], pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(scores, pa.float64()), pa.array(others, OTHER), same]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_tokens", "ids", "score", "others", "round_trip"])

    return rows.mapInArrow(lambda x: trimmed(run(x)), f"row {row_type}, n_tokens int, ids array<int>, score double, others {OTHERS}, round_trip boolean")


def decoded(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Every row as ``row`` with the ``text`` of its ids; null ids give an empty text."""
    pieces = Pieces(model)
    rows = rows.select(F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"), F.struct("*").alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            bounds = batch[0].offsets.to_numpy().astype(np.int64)
            found = encoder.decode(bounds - bounds[0], batch[0].values.to_numpy()[bounds[0] : bounds[-1]])
            yield pa.RecordBatch.from_arrays([batch[1], found.cast(pa.string())], names=["row", "text"])

    return rows.mapInArrow(lambda x: trimmed(run(x)), f"row {row_type}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document: best ids, the others of the four best, and whether decoding gives the text back."""
    rows = encoded(table(prepared(spark), sf_dir, "documents", "doc_id", "text"))
    return rows.select("row.doc_id", "n_tokens", "ids", "score", "others", "round_trip")
