"""Token ids of a corpus as sharded wavelet matrices.

Each distinct atom of a worker is encoded once by the tokenizers library and remembered; a text's ids are those of its
atoms, and an end id follows every document. Atoms are words cut between ASCII letters, digits and other signs (but for
the apostrophe), whatever the case of ASCII letters. That holds for tokenizers that drop white space, cut there too and
know small letters only, which is tried on the driver before. In texts with characters above U+017F, some of which
combine with what precedes them, atoms are whole words as they stand; texts with a special token's string are encoded
as a whole. Documents are dealt by
sampled ranges of their id and sorted; a task encodes them and rolls shards of about ``SHARD_TOKENS`` ids, each one
compressed file (``wavelet.py``) with its documents' bounds, written under a temporary name, renamed when complete. The manifest is
written last, with the sums of earlier shards' ids; readers trust the files that it lists, and check their hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensspark.llm import wavelet
from ensspark.llm.common import kept, prepared, table, trimmed, work_dir
from ensspark.llm.op08_sentencepiece import Grown, gathered
from ensspark.llm.words import buffers, words

TOKENIZER = "word_bpe_49k.json"  # of the public tokenizers' folder, unless a path is given
END = 2  # fixed value of the contract
SHARD_TOKENS = 1 << 22
CACHED_ATOMS = 1 << 20  # atoms that a worker remembers, with CACHED_IDS ids: 40 MB
CACHED_IDS = 1 << 22
READERS = 10_000  # tasks that read shards back, at most
WIDE = 0xC6  # first byte of characters from U+0180 on, some of which combine with the character before
EXACT = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64)  # letters' case tells words apart
MANIFEST = "part int, seq int, file string, documents long, tokens long, bytes long, sha256 string"
PROBE = "Words, it's\twe'll  12a3\nÉté J̌ <a>b-c_d\r\n日本\x0bx don't--'s .\x27d Straße:«Où?»A1,b2 "
KINDS = np.full(256, 4, np.uint8)  # 1 ASCII letter, 2 sign, 3 digit, 4 anything else
KINDS[33:127] = 2
KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz"]] = 1
KINDS[[*b"0123456789"]] = 3
KINDS[[*b"'"]] = 4
CUT = np.zeros((5, 5), dtype=bool)
CUT[1, 2] = CUT[2, 1] = CUT[3, :] = CUT[:, 3] = True


def atoms(data: np.ndarray) -> np.ndarray:
    """Before which bytes an atom starts, if there is no gap anyway."""
    kind = KINDS[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = CUT[kind[:-1], kind[1:]]
    return cut


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def specification(path: str | None = None) -> str:
    """A tokenizer's JSON; raises if atoms can't be encoded on their own."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(path), encoding="utf-8") as source:
        text = source.read()
    model = Tokenizer.from_str(text)
    for probe in (PROBE, "".join(c for c in PROBE if c < "\u0180")):
        found = np.concatenate(list(Encoder(text).encode(pa.array([probe, probe.swapcase()]))))
        whole = [i for p in (probe, probe.swapcase()) for i in model.encode(p, add_special_tokens=False).ids]
        if found.tolist() != whole:
            raise ValueError("this tokenizer does not encode words on their own, or tells capital letters from small ones")
    return text


class Encoder:
    """Ids of whole texts, from words that are encoded once while they are remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_str(spec)
        self.units = self.model.model
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, their places in the bounds
        self.bounds, self.ids = Grown(np.int64), Grown(np.uint32)
        self.bounds.extend([0])

    def learn(self, hashes: np.ndarray, spelt: list[str]) -> None:
        # an atom of ASCII letters is one unit for the model; the others pass the normalizer and the splitter
        found = [[x.id for x in self.units.tokenize(w.lower())] if w.isascii() and w.isalpha() else None for w in spelt]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self.model.encode_batch_fast([spelt[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = x.ids
        place = len(self.known) + np.arange(len(found))
        self.bounds.extend(self.ids.size + np.cumsum([len(x) for x in found]))
        self.ids.extend(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
        at = np.searchsorted(self.known, hashes)  # both are sorted
        self.known, self.place = np.insert(self.known, at, hashes), np.insert(self.place, at, place)

    def _words(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch's words, one after the other, and how many each has."""
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any() and (len(self.known) + new.sum() > CACHED_ATOMS or self.ids.size > CACHED_IDS):
            self.forget()
            new[:] = True
        if new.any():
            where = first[new]
            self.learn(distinct[new], [data[a:b].tobytes().decode() for a, b in zip(starts[where], ends[where], strict=True)])
        place = self.place[np.searchsorted(self.known, distinct)][back]
        low, count = self.bounds.values[place], self.bounds.values[place + 1] - self.bounds.values[place]
        return gathered(self.ids.values, low, count), count

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a null has none."""
        plain = pc.fill_null(texts, "").cast(pa.large_string())
        special = np.zeros(len(plain), bool)
        for s in self.special:
            special |= pc.match_substring(plain, s).to_numpy(zero_copy_only=False)
        data, bounds = buffers(plain)
        high = bounds[0] + np.flatnonzero(data[bounds[0] : bounds[-1]] >= WIDE)
        wide = np.searchsorted(high, bounds[1:]) > np.searchsorted(high, bounds[:-1])
        parts = [self._ids(plain, ~special & ~wide, {"cuts": atoms}), self._ids(plain, ~special & wide, {"values": EXACT})]
        for r in range(len(plain)):
            if special[r]:
                yield np.array(self.model.encode(plain[r].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                ids, at = parts[int(wide[r])]
                yield ids[at[r] : at[r + 1]]

    def _ids(self, texts: pa.Array, which: np.ndarray, how: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some of the texts, one text after the other, and each text's bounds."""
        chosen, total = np.flatnonzero(which), np.zeros(len(which), np.int64)
        own = texts.take(pa.array(chosen))
        data, _ = buffers(own)
        parts = [p for p in words(own, **how) if len(p[0])]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(which) + 1, np.int64)
        h, row, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, count = self._words(data, h, starts, ends)
        total[chosen] = np.bincount(row, count, len(own)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(total)))


def write(docs: DataFrame, out: str, path: str | None = None, end: int | None = END, shard_tokens: int = SHARD_TOKENS,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids below ``out`` in ascending order of their id; returns the manifest.

    Documents without an id come first; equal ids are ordered by their text's hash. A null or empty text has the end id
    only. Repeated rows are documents of their own. An empty table gives an empty manifest. Documents are never cut, so
    a shard may exceed ``shard_tokens`` by its last document. Other columns are ignored.
    """
    spark, spec = docs.sparkSession, specification(path)
    order = ["id", "hash", "row"]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    writer = _writer(out, spec, end, shard_tokens)
    dealt.mapInArrow(lambda x: trimmed(writer(x)), MANIFEST).write.json(f"{out}/shards")
    shards = spark.read.schema(MANIFEST).json(f"{out}/shards")
    # two steps: inside a task's shards, then over the tasks, of which there are as many as shuffle partitions
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    manifest = shards.join(starts, "part").select(*shards.columns, (inside + F.col("before")).alias("start"))
    manifest.write.json(f"{out}/manifest")
    return spark.read.schema(f"{MANIFEST}, start long").json(f"{out}/manifest")


def _writer(out: str, spec: str, end: int | None, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = kept(f"tokens-{zlib.crc32(spec.encode())}", lambda: Encoder(spec)), np.array([] if end is None else [end], np.uint32)
        size = encoder.model.get_vocab_size()
        width, kind = max(1, (size - 1).bit_length()), np.uint16 if size <= 1 << 16 else np.uint32
        part, held, tokens, done = TaskContext.get().partitionId(), [], 0, []
        for batch in batches:
            for key, ids in zip(batch["id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                held.append((key, np.concatenate((ids, tail)).astype(kind)))
                tokens += len(held[-1][1])
                if tokens >= shard_tokens:
                    done.append(_shard(out, part, len(done), held, width))
                    held, tokens = [], 0
        if held:
            done.append(_shard(out, part, len(done), held, width))
        columns = ["part", "seq", "file", "documents", "tokens", "bytes", "sha256"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_pylist([dict(zip(columns, x, strict=True)) for x in done], schema=pa.schema(list(zip(columns, types, strict=True))))

    return run


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def _shard(out: str, part: int, seq: int, held: list, width: int) -> tuple:
    """Write a shard's file under a temporary name and rename it."""
    values = np.concatenate([x[1] for x in held])
    keys, nulls = np.array([x[0] or 0 for x in held]), np.array([x[0] is None for x in held])
    bounds = np.concatenate(([0], np.cumsum([len(x[1]) for x in held])))
    data = wavelet.built(values, width, keys, nulls, bounds)
    system, base = _filesystem(out)
    name = f"tokens-{part:06d}-{seq:05d}.wm"
    temporary = f"{base}/_temporary/{name}.{uuid.uuid4().hex}"
    system.create_dir(f"{base}/_temporary", recursive=True)
    with system.open_output_stream(temporary, compression=None) as sink:
        sink.write(data)
    system.move(temporary, f"{base}/{name}")
    return part, seq, name, len(held), len(values), len(data), hashlib.sha256(data).hexdigest()


def _opened(out: str, entry: dict, whole: bool) -> wavelet.Wavelet:
    """A shard's file; its hash is checked if all of it is read anyway."""
    system, base = _filesystem(out)
    if whole:
        with system.open_input_stream(f"{base}/{entry['file']}", compression=None) as source:
            data = source.read()
        if len(data) != entry["bytes"] or hashlib.sha256(data).hexdigest() != entry["sha256"]:
            raise ValueError(f"{entry['file']}: not the file that the manifest lists")
        found = wavelet.Wavelet(pa.BufferReader(data))
    else:
        found = wavelet.Wavelet(system.open_input_file(f"{base}/{entry['file']}"))
    if found.n != entry["tokens"] or len(found.keys) != entry["documents"]:
        raise ValueError(f"{entry['file']}: other counts than in the manifest")
    return found


def _each_shard(manifest: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(entry)``: record batches of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                yield from rows(entry)

    return manifest.repartition(min(READERS, max(1, manifest.count()))).mapInArrow(lambda x: trimmed(run(x)), schema)


def read(manifest: DataFrame, out: str, ids: bool = False) -> DataFrame:
    """One row per document from the files: id, ids of all documents before it, ids, their crc32 (and the ids)."""

    def rows(entry: dict) -> Iterator[pa.RecordBatch]:
        shard = _opened(out, entry, whole=True)
        values, bounds = shard.values().astype("<u4"), shard.bounds
        for a in range(0, len(shard.keys), 10_000):
            part = range(a, min(a + 10_000, len(shard.keys)))
            found = [values[bounds[i] : bounds[i + 1]] for i in part]
            columns = {
                "doc_id": pa.array(shard.keys[part.start : part.stop], mask=shard.nulls[part.start : part.stop]),
                "start": pa.array(entry["start"] + bounds[part.start : part.stop]),
                "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([x.tolist() for x in found], pa.list_(pa.int32()))} if ids else {}))

    return _each_shard(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""), rows)


def tokens_at(manifest: DataFrame, out: str, places: Sequence[int]) -> DataFrame:
    """The ids at some places of the whole corpus: ``(place, token)``; places beyond it give no row."""
    places = np.unique(np.array(places, np.int64))

    def rows(entry: dict) -> Iterator[pa.RecordBatch]:
        own = places[np.searchsorted(places, entry["start"]) : np.searchsorted(places, entry["start"] + entry["tokens"])]
        if len(own):
            found = _opened(out, entry, whole=False).access(own - entry["start"])
            yield pa.RecordBatch.from_pydict({"place": pa.array(own), "token": pa.array(found.astype(np.int32))})

    return _each_shard(manifest, "place long, token int", rows)


def counted(manifest: DataFrame, out: str, tokens: Sequence[int]) -> DataFrame:
    """How often some ids occur in the corpus: ``(token, n)``, 0 included; each shard is asked by rank alone."""
    tokens = sorted(set(tokens))

    def rows(entry: dict) -> Iterator[pa.RecordBatch]:
        shard = _opened(out, entry, whole=False)
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int32()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    return _each_shard(manifest, "token int, n long", rows).groupBy("token").agg(F.sum("n").alias("n"))


def located(manifest: DataFrame, out: str, tokens: Sequence[int]) -> DataFrame:
    """Every occurrence of some ids: ``(token, doc_id, place)``, place counted from the document's first id; by select."""
    tokens = sorted(set(tokens))

    def rows(entry: dict) -> Iterator[pa.RecordBatch]:
        shard = _opened(out, entry, whole=False)
        for token in tokens:
            at = shard.occurrences(token)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                doc = np.searchsorted(shard.bounds, part, side="right") - 1
                columns = {"token": np.full(len(part), token, np.int32), "place": part - shard.bounds[doc]}
                ids = pa.array(shard.keys[doc], mask=shard.nulls[doc])
                yield pa.RecordBatch.from_pydict({"token": pa.array(columns["token"]), "doc_id": ids, "place": pa.array(columns["place"])})

    return _each_shard(manifest, "token int, doc_id long, place long", rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as wavelet matrices, then gives one row per document read back."""
    out = work_dir(prepared(spark), "tokens")
    manifest = write(table(spark, sf_dir, "documents", "doc_id", "text"), out)
    return read(manifest, out)
