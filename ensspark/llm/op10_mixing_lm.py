"""Language-model scores by online logistic context mixing.

The base is a smoothed unigram model over words. The model codes each word in two steps: eight bits of the word's
hash, predicted bit by bit, and the word among those with the same bits, by the base. The product of the
bits' probabilities and the base's share is a probability over the same words, so scores compare.

Each bit is predicted by several predictors: how often the bit was set at this place of the code (order 0), after
the word before, after the two words before, after the word before that one (counts in hashed tables of a fixed
size, summed over all training texts), and by what followed when the last two words were last met in this text.
Their log odds are added with weights that a gate chooses by the bit's place and by whether there is such a match.
Weights are learnt online while a text is read, block by block, from weights fitted to all training texts; a
last stage refines the probability adaptively, by its own recent errors. The code length gives bits per byte.

Counts of words are exact. A slice of the input sends its distinct words with their counts, packed, to fragments
of the hash range; each fragment adds them up and answers every slice for its words, so no vocabulary is ever in
one place, and a frequent word arrives once per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import landed, partitions, prepared, table
from ensspark.llm.words import ODD, ODD2, all_words, mix

# Fixed values of the contract.
FOLDS, HELD_OUT = 7, 2

BITS = 8  # bits of a word's code
TABLE_BITS = 18  # slots of each hashed table: 2^18
CONTEXTS = 3
CHUNK = 1 << 14  # slots of a table that travel together
STEP = 32  # words after which weights are learnt
LANES = 256  # texts that are scored side by side
RATE, REFINE_RATE, CELLS = 0.02, 0.03, 24
FIT_TOKENS = 20_000  # tokens that are fitted side by side
GATHER_TOKENS = 200_000  # tokens that are counted side by side
RIDGE, FIT_STEP = 1.0, 1.0  # keep weights of gates that are rarely met, and bound the fit's step
SLICE_BYTES = 8 << 20  # about so many input bytes make a slice
END = np.uint64(0x51ED270B9F1C2A37)  # the end token's hash
NONE = np.uint64(0x2545F4914F6CDD1D)  # stands for a missing word before the first
UNKNOWN_CODE = 0


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end) of all rows, and the rows' bounds."""
    h, row = all_words(texts)
    count = np.bincount(row, minlength=len(texts))
    bounds = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.empty(int(bounds[-1]), dtype=np.uint64)
    out[bounds[1:] - 1] = END
    out[np.arange(len(h)) + row] = h
    return out, bounds


def codes(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(ODD2)) >> np.uint64(64 - BITS)).astype(np.int64)


# For each code and bit: the place in the code's tree, the bit, and the place's part of a slot's hash.
NODES = (1 << np.arange(BITS)) | (np.arange(1 << BITS)[:, None] >> (BITS - np.arange(BITS)))
CODE_BITS = (np.arange(1 << BITS)[:, None] >> (BITS - 1 - np.arange(BITS))) & 1
NODE_HASHES = NODES.astype(np.uint64) * np.uint64(ODD) * np.uint64(ODD2)


def context_hashes(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's contexts; nothing reaches across texts."""
    one, two = np.concatenate(([NONE], h[:-1])), np.concatenate(([NONE, NONE], h[:-2]))[: len(h)]
    first = bounds[:-1]
    one[first] = NONE
    two[first] = NONE
    second = first + 1
    two[second[second < bounds[1:]]] = NONE
    return [mix(one * np.uint64(3)), mix(one * np.uint64(ODD) + two * np.uint64(ODD2)), mix(two * np.uint64(ODD) + np.uint64(5))]


def slots(context: np.ndarray, node_hash: np.ndarray) -> np.ndarray:
    """Slots of the hashed table for each word and place of the code, whose hashes are rows of ``NODE_HASHES``."""
    return ((context * np.uint64(ODD2))[:, None] + node_hash >> np.uint64(64 - TABLE_BITS)).view(np.int64)


def matches(h: np.ndarray, bounds: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For each token, where in its text the token stands that followed the same two words last time; -1: nowhere."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = mix(context + owner.astype(np.uint64) * np.uint64(ODD))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.full(len(h), -1, dtype=np.int64)
    found[order[1:][same]] = order[:-1][same]
    found[np.arange(len(h)) < np.repeat(bounds[:-1] + 2, np.diff(bounds))] = -1
    return found


# --- what is gathered from the corpus -----------------------------------------------------------------------

GATHERED = "kind int, slice long, part int, a binary, b binary"


def sliced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, held_out, text and slice of every row.

    A slice is a run of rows of a file, of about ``SLICE_BYTES`` of text. It follows from the row's place in its file, so
    it is the same in every scan, however Spark cuts the files then. What comes from no file is landed first.
    """
    plain = [F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    try:
        rows = docs.select(*plain, *place)
    except AnalysisException:
        rows = landed(docs.select(*plain), "lm-texts").select("id", "body", *place)
    many, size = rows.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
    step = max(1, SLICE_BYTES * many // max(1, size or 0))
    where = F.xxhash64("file", F.floor(F.col("place") / step))
    return rows.select("id", held_out(F.col("id")).alias("held"), "body", where.alias("slice"))


def gathered(rows: DataFrame, fragments: int) -> DataFrame:
    """Kind 0: a slice's distinct words of a fragment with their training counts. Kind 1: sums of a hashed table's chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, list] = {}
        tables = np.zeros((CONTEXTS, 1 << TABLE_BITS, 2), dtype=np.uint32)
        task = None
        for batch in batches:
            h, bounds = tokens(batch["body"])
            train = ~batch["held"].to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            learn = np.repeat(train, size)
            code = codes(h)[learn]
            for k, context in enumerate(context_hashes(h, bounds)):
                own = context[learn]
                for a in range(0, len(code), GATHER_TOKENS):  # some at a time, for memory
                    part = code[a : a + GATHER_TOKENS]
                    at = 2 * slots(own[a : a + GATHER_TOKENS], NODE_HASHES[part]) + CODE_BITS[part]
                    tables[k] += np.bincount(at.ravel(), minlength=2 << TABLE_BITS).astype(np.uint32).reshape(-1, 2)
            where = batch["slice"].to_numpy()
            for s in np.unique(where):
                task = int(s) if task is None else task
                own = np.repeat(where == s, size)
                known, inverse = np.unique(h[own], return_inverse=True)
                part = words.setdefault(int(s), [])
                part.append((known, np.bincount(inverse, weights=learn[own], minlength=len(known)).astype(np.uint64)))
                if sum(len(x) for x, _ in part) > 4_000_000:
                    words[int(s)] = [_summed(part)]
        for s, part in words.items():
            known, count = _summed(part)
            at = ((known >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            yield _batch([(0, s, int(at[a]), known[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        if task is not None:
            n = (1 << TABLE_BITS) // CHUNK
            tables[..., 0] += tables[..., 1]  # a slot's count, and how often the bit was set
            chunks = tables.swapaxes(1, 2).reshape(CONTEXTS, 2, n, CHUNK)
            yield _batch([(1, task, k * n + c, chunks[k, 0, c].astype(np.uint64).tobytes(), chunks[k, 1, c].astype(np.uint64).tobytes()) for k in range(CONTEXTS) for c in range(n)])

    return rows.select("held", "body", "slice").mapInArrow(run, GATHERED)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of some lists and the sums of their counts."""
    words, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(counts, first) if len(first) else counts


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "slice", "part", "a", "b"])


def _answers(block: pa.Table) -> pa.Table:
    """A fragment's answers: for every slice its words' training counts over all slices, and the fragment's sums by code.

    The sums (kind 1) are the training count and the number of distinct training words for each code.
    """
    words = [np.frombuffer(x.as_py(), np.uint64) for x in block["a"]]
    counts = [np.frombuffer(x.as_py(), np.uint64) for x in block["b"]]
    known, total = _summed(list(zip(words, counts, strict=True)))
    rows = [(0, s.as_py(), block["part"][0].as_py(), w.tobytes(), total[np.searchsorted(known, w)].tobytes()) for s, w in zip(block["slice"], words, strict=True)]
    code = codes(known)
    sums = np.bincount(code, weights=total.astype(np.float64), minlength=1 << BITS).astype(np.uint64)
    distinct = np.bincount(code[total > 0], minlength=1 << BITS).astype(np.uint64)
    rows.append((1, 0, block["part"][0].as_py(), sums.tobytes(), distinct.tobytes()))
    return pa.Table.from_batches([_batch(rows)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the same part, added up as they come."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, a, b in zip(batch["part"].to_pylist(), batch["a"], batch["b"], strict=True):
            own = sums.setdefault(part, [np.zeros(CHUNK, np.uint64), np.zeros(CHUNK, np.uint64)])
            own[0] += np.frombuffer(a.as_py(), np.uint64)
            own[1] += np.frombuffer(b.as_py(), np.uint64)
    yield _batch([(1, part, part, a.tobytes(), b.tobytes()) for part, (a, b) in sums.items()])


def hashed_tables(chunks: DataFrame) -> np.ndarray:
    """Counts of all slots, (contexts, 2, slots): summed in two steps, so that no task reads the chunks of all tasks."""
    n = CONTEXTS * (1 << TABLE_BITS) // CHUNK
    near = chunks.repartition(partitions(chunks.sparkSession), "part", F.pmod(F.xxhash64("slice"), F.lit(16))).mapInArrow(_added, GATHERED)
    whole = near.repartition(n, "part").mapInArrow(_added, GATHERED)
    tables = np.zeros((n, 2, CHUNK), dtype=np.uint64)
    for row in whole.collect():  # n chunks of a fixed size
        tables[row.part, 0], tables[row.part, 1] = np.frombuffer(row.a, np.uint64), np.frombuffer(row.b, np.uint64)
    return tables.reshape(CONTEXTS, -1, 2, CHUNK).swapaxes(1, 2).reshape(CONTEXTS, 2, -1)


# --- the model ----------------------------------------------------------------------------------------------


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def log_odds(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a bit from counts, nearer to zero the fewer there are."""
    return (np.log((ones + 0.4) / (n - ones + 0.4)) * (n / (n + 0.6))).astype(np.float32)


def _left_out(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of each slot, once without a clear and once without a set bit; meant for slots that have met it."""
    clear, met = np.maximum(n - 1, 0), np.maximum(ones - 1, 0)
    return np.stack([log_odds(np.maximum(clear, ones), ones), log_odds(np.maximum(clear, met), met)], axis=-1).ravel()


class Model:
    """Totals, the code's tree, the hashed tables and the first weights."""

    def __init__(self, total: int, distinct: int, by_code: np.ndarray, distinct_by_code: np.ndarray, tables: np.ndarray):
        self.total, self.distinct = int(total), int(distinct)
        self.floor = float(self.total + self.distinct + 1)
        mass = by_code.astype(np.float64) + distinct_by_code
        mass[UNKNOWN_CODE] += 1
        self.code_share = np.log10(np.maximum(mass, 1e-300) / self.floor)
        tree = np.zeros(2 << BITS)
        tree[1 << BITS :] = mass
        for k in range((1 << BITS) - 1, 0, -1):
            tree[k] = tree[2 * k] + tree[2 * k + 1]
        ones = tree[1::2][1:]
        self.order0 = np.zeros(1 << BITS, dtype=np.float32)
        self.order0[1:] = np.log((ones[: (1 << BITS) - 1] + 1e-6) / (tree[2::2][: (1 << BITS) - 1] + 1e-6))
        self.left_out = [_left_out(t[0].astype(np.float64), t[1].astype(np.float64)) for t in tables]
        self.tables = [log_odds(t[0].astype(np.float64), t[1].astype(np.float64)) for t in tables]
        self.weights = np.zeros((2 * BITS, 2 + CONTEXTS), dtype=np.float32)
        self.weights[:, 0], self.weights[:, 1:-1], self.weights[:, -1] = 0.5, 0.3, 1.0

    def compact(self) -> Model:
        """Without what only fitting needs."""
        self.left_out = None
        return self

    def inputs(self, h: np.ndarray, bounds: np.ndarray, code: np.ndarray, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictors' log odds (words, bits, predictors), gates and bits. leave_out: without each token's own count."""
        node, bit, node_hash = NODES[code], CODE_BITS[code], NODE_HASHES[code]
        x = np.empty((len(h), BITS, 2 + CONTEXTS), dtype=np.float32)
        x[:, :, 0] = self.order0[NODES][code]
        contexts = context_hashes(h, bounds)
        for k, context in enumerate(contexts):
            at = slots(context, node_hash)
            x[:, :, k + 1] = self.left_out[k][2 * at + bit] if leave_out else self.tables[k][at]
        last = matches(h, bounds, contexts[1])
        met = last >= 0
        guess = code[np.maximum(last, 0)]
        agrees = met[:, None] & (NODES[guess] == node)
        x[:, :, -1] = np.where(agrees, np.where(CODE_BITS[guess], np.float32(2), np.float32(-2)), np.float32(0))
        return x, np.arange(BITS) + BITS * agrees, bit

    def read(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each text's codes, and the texts' last weights; texts side by side, block by block."""
        size = np.diff(bounds)
        score, last = np.zeros(len(size)), np.empty((len(size), *self.weights.shape), dtype=np.float32)
        by_size = np.argsort(-size, kind="stable")
        for a in range(0, len(size), LANES):
            lanes = by_size[a : a + LANES]
            weights = np.repeat(self.weights[None], len(lanes), axis=0)
            refine = np.zeros((len(lanes), BITS, CELLS), dtype=np.float32)
            for step in range(0, int(size[lanes[0]]), STEP):
                live = int(np.searchsorted(-size[lanes], -step, side="left"))
                own = lanes[:live]
                at = bounds[own][:, None] + step + np.arange(min(STEP, int(size[lanes[0]]) - step))
                valid = at < bounds[own + 1][:, None]
                at = np.where(valid, at, 0)
                score[own] += self._block(x[at], gate[at], bit[at], valid, weights[:live], refine[:live])
            last[lanes] = weights
        return score, last

    def _block(self, x, gate, bit, valid, weights, refine) -> np.ndarray:
        """Score a block (texts, words, bits) with the weights so far, then learn from it, in place."""
        n = len(x)
        row = np.arange(n)[:, None, None]
        gates = row * (2 * BITS) + gate
        used = weights.reshape(-1, x.shape[3]).take(gates, axis=0)
        odds = np.clip(np.einsum("lwbp,lwbp->lwb", x, used), -12, 12)
        p = squash(odds)
        cell = ((odds + 12) * ((CELLS - 1) / 24) + 0.5).astype(np.int64)
        cells = (row * BITS + np.arange(BITS)) * CELLS + cell
        fine = squash(odds + refine.ravel().take(cells))
        final = np.clip((p + fine) / 2, 1e-6, 1 - 1e-6)
        coded = np.where(valid, np.log10(np.where(bit == 1, final, 1 - final)).sum(axis=2), 0.0).sum(axis=1)
        wrong = ((bit - p) * valid[:, :, None]).astype(np.float32)
        flat = gates.ravel()
        for k in range(x.shape[3]):
            weights[:, :, k] += RATE * np.bincount(flat, weights=(wrong * x[..., k]).ravel(), minlength=n * 2 * BITS).reshape(n, 2 * BITS).astype(np.float32)
        left = ((bit - fine) * valid[:, :, None]).ravel()
        refine += REFINE_RATE * np.bincount(cells.ravel(), weights=left, minlength=n * BITS * CELLS).reshape(n, BITS, CELLS).astype(np.float32)
        return coded

    def code_of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, codes(h), UNKNOWN_CODE)

    def slopes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the texts' code length by gate, at the weights so far."""
        many = 2 + CONTEXTS
        slope, curve = np.zeros((2 * BITS, many)), np.zeros((2 * BITS, many, many))
        h, bounds = tokens(texts)
        for a, b in _groups(bounds, FIT_TOKENS):
            part = slice(int(bounds[a]), int(bounds[b]))
            x, gate, bit = self.inputs(h[part], bounds[a : b + 1] - bounds[a], codes(h[part]), leave_out=True)
            for place in range(BITS):
                here, met = np.ascontiguousarray(x[:, place]), gate[:, place] >= BITS
                for g, at in ((place, np.flatnonzero(~met)), (place + BITS, np.flatnonzero(met))):  # a place's two gates
                    own = here.take(at, axis=0).astype(np.float64)
                    p = squash(np.clip(own @ self.weights[g], -12, 12))
                    slope[g] += own.T @ (bit[:, place].take(at) - p)
                    curve[g] += (own * (p * (1 - p))[:, None]).T @ own
        return slope, curve

    def fit(self, slope: np.ndarray, curve: np.ndarray) -> Model:
        """First weights: one Newton step from the plain ones, by the slopes summed over all training texts."""
        step = np.linalg.solve(curve + RIDGE * np.eye(curve.shape[1]), slope[..., None])[..., 0]
        self.weights = (self.weights + np.clip(step, -FIT_STEP, FIT_STEP)).astype(np.float32)
        return self

    def score(self, h: np.ndarray, bounds: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base and model scores of some texts, from their tokens and these' training counts."""
        base = np.log10((count.astype(np.float64) + 1) / self.floor)
        code = self.code_of(h, count)
        within = np.add.reduceat(base - self.code_share[code], bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        coded = np.zeros(len(bounds) - 1)
        for a, b in _groups(bounds, 100_000):
            part = slice(int(bounds[a]), int(bounds[b]))
            own = bounds[a : b + 1] - bounds[a]
            coded[a:b] = self.read(*self.inputs(h[part], own, code[part]), own)[0]
        return np.add.reduceat(base, bounds[:-1]) if len(bounds) > 1 else within, within + coded


def _groups(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many tokens, a larger text alone: some at a time, for memory."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, side="right")) - 1)
        yield a, b
        a = b


def _fitted(rows: DataFrame, model: Model) -> Model:
    """The model with first weights from all training texts; a task sends sums of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve = 0.0, 0.0
        for batch in batches:
            own = model.slopes(batch["body"])
            slope, curve = slope + own[0], curve + own[1]
        if np.ndim(slope):
            yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], names=["a", "b"])

    many = 2 + CONTEXTS
    slope, curve = np.zeros((2 * BITS, many)), np.zeros((2 * BITS, many, many))
    for row in rows.where("NOT held").select("body").mapInArrow(run, "a binary, b binary").collect():
        slope += np.frombuffer(row.a).reshape(slope.shape)
        curve += np.frombuffer(row.b).reshape(curve.shape)
    return model.fit(slope, curve)


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scorer(model: Model):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        texts = docs["body"].combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else (texts.chunk(0) if texts.num_chunks else pa.array([], pa.string()))
        h, bounds = tokens(texts)
        known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers["a"]])
        total = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers["b"]])
        order = np.argsort(known)
        known, total = known[order], total[order]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        if len(h) and not (known[at] == h).all():
            raise ValueError("the slice was cut otherwise when words were counted")
        count = total[at]
        base, score = model.score(h, bounds, count)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        per_byte = np.where(size > 0, -score * np.log2(10) / np.maximum(size, 1), np.nan)
        n = len(texts)
        return pa.table({
            "doc_id": docs["id"], "held_out": docs["held"], "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), bounds[:-1]) if n else np.zeros(0, np.int64)),
            "train_tokens": pa.array(np.full(n, model.total, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            "bits_per_byte": pa.array(per_byte, from_pandas=True),
        })

    return run


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fold, tokens, known tokens, training tokens, base and model score, bits per byte.

    A null text is empty and has the end token alone; a null id counts as an empty string for the fold. Rows that
    repeat are scored, and learnt from, each. Without training texts every token is unknown. Other columns are
    ignored; an empty table gives an empty result. Texts are read whole; a long one takes one lane.
    """
    spark = docs.sparkSession
    rows = sliced(docs, key, text)
    fragments = max(partitions(spark), 1)
    found = landed(gathered(rows, fragments), "lm-gathered")
    words = found.where("kind = 0").repartition(fragments, "part").groupBy("part").applyInArrow(_answers, GATHERED)
    answers = landed(words, "lm-answers")
    sums, distinct = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.uint64)
    folded = answers.where("kind = 1").select(F.pmod("part", F.lit(64)).alias("part"), "a", "b").groupBy("part").applyInArrow(_folded, "a binary, b binary")
    for row in folded.collect():  # at most 64 rows of a fixed size
        sums += np.frombuffer(row.a, np.uint64)
        distinct += np.frombuffer(row.b, np.uint64)
    model = Model(int(sums.sum()), int(distinct.sum()), sums, distinct, hashed_tables(found.where("kind = 1")))
    _fitted(rows, model)
    own = answers.where("kind = 0").select("slice", "a", "b")
    return rows.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(_scorer(model.compact()), f"doc_id {rows.schema['id'].dataType.simpleString()}, {SCORES}")


def _folded(block: pa.Table) -> pa.Table:
    add = lambda name: np.sum([np.frombuffer(x.as_py(), np.uint64) for x in block[name]], axis=0, dtype=np.uint64).tobytes()
    return pa.table({"a": pa.array([add("a")], pa.binary()), "b": pa.array([add("b")], pa.binary())})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(table(prepared(spark), sf_dir, "documents", "doc_id", "text"))
