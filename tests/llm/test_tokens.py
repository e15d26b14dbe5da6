"""Token ids in wavelet matrices: against the tokenizers library and plain arrays."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ensspark.llm import op11_tokens, wavelet
from ensspark.llm.common import table, work_dir

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op11_tokens.tokenizer_path())


def plain_ids(model, text, end=(2,)):
    return [*model.encode(text or "", add_special_tokens=False).ids, *end]


@pytest.mark.parametrize(("n", "width", "top"), [(0, 3, 8), (1, 1, 2), (70_000, 5, 32), (200_000, 16, 49_408), (9, 17, 100_000)])
def test_wavelet_against_an_array(n, width, top):
    rng = np.random.default_rng(n)
    values = np.minimum(rng.zipf(1.3, n) - 1, top - 1).astype(np.uint16 if width <= 16 else np.uint32)
    bounds = np.array([0, n // 3, n // 3, n])
    data = wavelet.built(values, width, np.array([5, 0, -7]), np.array([False, True, False]), bounds)
    found = wavelet.Wavelet(pa.BufferReader(data), blocks=3)
    assert (found.values() == values).all() and found.keys.tolist() == [5, 0, -7] and found.nulls.tolist() == [False, True, False]
    assert found.bounds.tolist() == bounds.tolist()
    at = rng.integers(0, n, 300) if n else np.zeros(0, int)
    assert (found.access(at) == values[at]).all()
    for value in {0, 1, top - 1, top + 5, *values[:20].tolist()}:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert found.count(value) == (values == value).sum() and found.count(value, a, b) == (values[a:b] == value).sum()
        assert (found.occurrences(value) == np.flatnonzero(values == value)).all()
        assert (found.occurrences(value, a, b) == a + np.flatnonzero(values[a:b] == value)).all()


def test_encoder_agrees_with_the_library(model):
    rng = random.Random(11)
    parts = [*"aBJKİıé ß'«…,.-_=<|>0129\t\n\x0b\x0c\r\x1c\x85  ̸́̌日本😀ǆﬁ", "'S", "'re", "n't", "Hello", "<|endoftext|>", "<|startoftext|>", "  ", "World"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    latin = [x for x in parts if max(map(ord, x)) < 0x180 and not x.startswith("<|")]
    texts += ["".join(rng.choices(latin, k=rng.randint(0, 60))) for _ in range(4000)] + [None, ""]
    encoder = op11_tokens.Encoder(op11_tokens.specification())
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        for text, ids in zip(part, encoder.encode(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == plain_ids(model, text, ()), repr(text)


def test_encoder_forgets(model, monkeypatch):
    monkeypatch.setattr(op11_tokens, "CACHED_ATOMS", 50)
    encoder = op11_tokens.Encoder(op11_tokens.specification())
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}x" for j in range(i, i + 30)) for i in range(60)]
    for a in range(0, 60, 7):
        part = texts[a : a + 7]
        assert [x.tolist() for x in encoder.encode(pa.array(part))] == [plain_ids(model, t, ()) for t in part]


def test_a_tokenizer_that_keeps_white_space_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="on their own"):
        op11_tokens.specification(public_tokenizers.path("byte_bpe_50k.json"))


def expected(model, rows):
    """(doc_id, start, n, crc) in ascending order of the id, null first."""
    start = 0
    for key, ids in sorted(((k, plain_ids(model, t)) for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        yield key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_hold_all_documents(corpus, model):
    docs = table(corpus, SF_DIR, "documents", "doc_id", "text", "n_chars").withColumnRenamed("n_chars", "start").repartition(5)
    out = work_dir(corpus, "tokens")
    manifest = op11_tokens.write(docs, out, shard_tokens=3000)
    assert manifest.count() == len(glob.glob(f"{out.removeprefix('file:')}/*.wm")) > 10
    got = sorted(tuple(r) for r in op11_tokens.read(manifest, out).collect())
    assert got == sorted(expected(model, [(r.doc_id, r.text) for r in docs.collect()]))
    stream = [i for r in sorted(op11_tokens.read(manifest, out, ids=True).collect()) for i in r.ids]
    places = [0, 1, len(stream) // 2, len(stream) - 1, len(stream), 10**12]
    assert sorted(map(tuple, op11_tokens.tokens_at(manifest, out, places).collect())) == [(p, stream[p]) for p in places[:4]]
    asked = [2, stream[0], stream[100], 49_000]
    assert dict(map(tuple, op11_tokens.counted(manifest, out, asked).collect())) == {t: stream.count(t) for t in asked}
    starts = {k: s for k, s, _, _ in got}
    where = sorted((r.token, starts[r.doc_id] + r.place) for r in op11_tokens.located(manifest, out, asked).collect())
    assert where == sorted((t, i) for i, t in enumerate(stream) if t in asked)


def test_odd_rows_and_no_rows(corpus, odd, none, model):
    out = work_dir(corpus, "tokens")
    got = op11_tokens.read(op11_tokens.write(odd, out, shard_tokens=50), out).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = list(expected(model, rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k is not None, k or 0, n, c) for k, _, n, c in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # rows with equal or no ids may change places with each other
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    out = work_dir(corpus, "tokens")
    assert op11_tokens.read(op11_tokens.write(none, out), out).collect() == []


def test_a_broken_file_is_refused(corpus, odd):
    out = work_dir(corpus, "tokens")
    manifest = op11_tokens.write(odd, out)
    name = glob.glob(f"{out.removeprefix('file:')}/*.wm")[0]
    with open(name, "r+b") as file:
        file.write(b"\0\1")
    with pytest.raises(Exception, match="not the file that the manifest lists"):
        op11_tokens.read(manifest, out).collect()
