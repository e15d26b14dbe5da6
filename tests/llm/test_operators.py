"""Every operator on odd rows and empty tables, and against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ensspark.llm import (
    op01_urls, op02_pii, op03_warc, op04_ngram_join, op05_topk, op06_secrets, op07_quality, op08_sentencepiece, op09_mixing, op10_mixing_lm, queries,
)
from ensspark.llm.common import work_dir
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(corpus, name):
    assert compare(corpus, connect(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR) > 0


# --- 1: url filter ---


def test_automaton_matches_globs():
    rng = random.Random(1)
    globs = ["".join(rng.choices("ab/.*+?", k=rng.randint(1, 40))) for _ in range(60)]
    texts = ["".join(rng.choices("ab/.cé", k=rng.randint(0, 30))) for _ in range(300)]
    found = op01_urls.Automaton(globs).matches(texts)
    for j, g in enumerate(globs):
        pattern = re.compile("".join({"*": ".*", "+": "[^/]*", "?": "."}.get(c, re.escape(c)) for c in g), re.S)
        assert [bool(pattern.fullmatch(t)) for t in texts] == found[:, j].tolist()


def test_urls_odd(corpus):
    rows = [(1, None), (2, "nothing"), (3, "http://EXAMPLE.net/en/x?y"), (3, "http://EXAMPLE.net/en/x?y"), (None, "x://a.org/fr"), (4, "http://" + "a" * 5000 + ".net/")]
    got = op01_urls.judge(corpus.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host"), op01_urls.RULES).collect()
    assert [(r.host, r.rule, r.verdict) for r in got][:5] == [("", None, "allow"), ("", None, "allow")] + [("example.net", "example.net/en/", "allow")] * 2 + [("a.org", None, "allow")]
    assert got[5].rule == "net/" and got[5].verdict == "block"


# --- 2 and 6: spans ---

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_pii(text):
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and op02_pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            yield m.start(), m.end(), kind


def brute_secrets(text):
    yield from ((m.start(), m.end(), "assign") for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 6)
    yield from ((m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20)
    yield from ((m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24)


@pytest.mark.parametrize(("base", "brute", "letters"), [(op02_pii.base_spans, brute_pii, "12 3.-+()@a.bZ9:%/\n0"), (op06_secrets.base_spans, brute_secrets, ["token", "=", " ", "API_KEY", "'", "0", "a1f", "AKIA", "Z9", "secret:", "é", "0123456789abcdef"])])
def test_base_spans(base, brute, letters):
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 50)))
        assert sorted(brute(text)) == sorted(base(text)), text


@pytest.mark.parametrize(("operator", "brute", "kinds"), [(op02_pii, brute_pii, op02_pii.KINDS), (op06_secrets, brute_secrets, op06_secrets.KINDS)])
def test_span_digests(odd, none, operator, brute, kinds):
    got = operator.spans.digest(operator.detected(odd), kinds).collect()
    assert len(got) == odd.count()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        text = texts[r.doc_id].pop(0)
        base = [f"{k}:{s}:{e}" for s, e, k in operator.spans.ordered(brute(text), kinds)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))
    assert operator.detected(none).count() == 0


def test_field_adds_other_spellings():
    field = op02_pii.Field().train(op02_pii.examples())
    for text, kind, inner in [("call (743) 555-3824 now", "phone", "(743) 555-3824"), ("to bob [at] foo.com ok", "email", "bob [at] foo.com")]:
        assert [(text[s:e], k) for s, e, k in op02_pii.find(text, field)[1]] == [(inner, kind)]
    for text in ("on 2024-01-02 at 10:20:30", "12345678", "x@y", "plain words only", "3.14.15"):
        assert op02_pii.find(text, field) == ([], [])


def test_field_finds_spans_anywhere_in_a_line():
    field = op02_pii.Field().train(op02_pii.examples())
    for n in range(8, 60):
        text = " ".join(["12"] * n) + " (743) 555-3824 " + " ".join(["12"] * 9)
        assert [(text[s:e], k) for s, e, k in op02_pii.find(text, field)[1]] == [("(743) 555-3824", "phone")]
    mail = "john.doe [at] mail [dot] example [dot] com"
    assert [(f"to {mail} ok"[s:e], k) for s, e, k in op02_pii.find(f"to {mail} ok", field)[1]] == [(mail, "email")]


def test_ratio_tells_keys_from_words():
    plain = [f"{a}{b}" for a, b in product(["north", "house", "table", "river", "garden", "window"], ["light", "stone", "works", "field"])] * 20
    ratio = op06_secrets.Ratio([], plain)
    keys = op06_secrets.generated(300)
    assert sum(map(ratio.secret, keys)) > 0.95 * len(keys)
    names = [w for w in op06_secrets.joined_words(plain[7:], 300) if len(w) >= op06_secrets.LEAST_CHARS]
    assert sum(map(ratio.secret, names)) < 0.01 * len(names)


def test_redaction(odd):
    rows = op06_secrets.redacted(odd)
    assert rows.columns == odd.columns
    got, before = {r.doc_id: r.text for r in rows.collect()}, {r.doc_id: r.text for r in odd.collect()}
    assert got[8].count("[SECRET]") >= 2 and "24be64439" not in got[8] and "AKIA" not in got[8]
    assert {k: v for k, v in got.items() if k not in (8, None)} == {k: v for k, v in before.items() if k not in (8, None)}


# --- 3: WARC ---


def test_warc_is_deterministic_and_checked(corpus, odd):
    pages = odd.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "size AS shard")
    files = []
    for _ in range(2):
        out = work_dir(corpus, "warc-test")
        manifest = op03_warc.write(pages, out, shard_bytes=50_000, roll_bytes=500)
        files.append({(r.file, r.sha1) for r in manifest.collect()})
        got = op03_warc.read(manifest, out, payload=True).collect()
        want = Counter((r.page_id, hashlib.sha1((r.html or "").encode()).hexdigest()) for r in pages.collect())
        assert Counter((r.page_id, r.payload_digest) for r in got) == want
        revisits = {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"}
        assert revisits == ({(1, 2), (None, 2)} if len(pages.collect()[0].html) >= 1000 else set())
    assert files[0] == files[1] and len(files[0]) > 1
    name = sorted(files[1])[0][0]
    path = f"{out.removeprefix('file://')}/{name}"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    os.remove(path)
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017
        op03_warc.read(manifest, out).collect()
    assert op03_warc.read(op03_warc.write(pages.limit(0), out := work_dir(corpus, "warc-test")), out).count() == 0


@pytest.mark.parametrize("hot", [None, 500_000])
def test_warc_deals_a_hot_id_to_several_shards(corpus, hot):
    rows = [(hot if i % 3 == 0 else i * 997, f"u{i}", f"{i} " * 100) for i in range(1200)]
    pages, out = corpus.createDataFrame(rows, "page_id long, url string, html string"), work_dir(corpus, "warc-test")
    manifest = op03_warc.write(pages, out, shard_bytes=30_000).collect()
    records = Counter()
    for m in manifest:
        records[m.shard] += m.records
    assert sum(records.values()) == len(rows) and max(records.values()) < len(rows) / 6
    got = op03_warc.read(corpus.createDataFrame(manifest, op03_warc.MANIFEST), out).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)


# --- 4: n-gram Jaccard join ---


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_join_against_brute_force(corpus, odd, none, monkeypatch):
    assert Counter(map(tuple, op04_ngram_join.linked(odd).collect())) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert op04_ngram_join.linked(none).count() == 0
    monkeypatch.setattr(op04_ngram_join, "HOT", 4)
    rng, rows = random.Random(5), []
    for i in range(400):
        own = random.Random(i % 9)
        w = [own.choice("abcdefghij") + own.choice("xyz") for _ in range(own.choice([6, 20, 40, 80]))]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice("qrstuvw")
        rows.append((rng.choice([i, i, None, i // 2]), " ".join(w) if rng.random() > 0.05 else rng.choice([None, "", "a b", "A B c"])))
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, op04_ngram_join.linked(docs).collect())) == brute_components(rows)


def test_join_counts_a_shingle_hot_in_one_slice_once(corpus, monkeypatch):
    monkeypatch.setattr(op04_ngram_join, "HOT", 4)
    passage = " ".join(f"p{k}" for k in range(24))
    text = lambda i, n: passage + "".join(f" d{i}x{k}" for k in range(n))
    first = [(i, text(i, 26 if i < 2 else 200)) for i in range(6)]
    second = [(10 + i, text(i, 26)) for i in range(2)]
    slices = corpus.sparkContext.parallelize([first, second], 2).flatMap(lambda rows: rows)
    got = op04_ngram_join.linked(corpus.createDataFrame(slices, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_components(first + second)


def test_join_follows_long_chains(corpus):
    n = 50
    labels = corpus.range(n).selectExpr("id AS class", "id AS label")
    links = corpus.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert sorted(map(tuple, op04_ngram_join.relabelled(labels, links).collect())) == [(i, 0) for i in range(n)]
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 14))) for i in range(n)]
    got = op04_ngram_join.linked(corpus.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_components(rows) == Counter({(i, 10, 0): 1 for i in range(n)})


def test_one_row_of_each_component_whatever_its_id(corpus, none):
    own = lambda i: [f"d{i}x{k}" for k in range(40)]
    near = lambda i: " ".join([*own(i), "more"])
    rows = [(None, " ".join(own(i))) for i in range(5)]  # components of null ids only, one of them of two rows
    rows += [(None, near(0)), (None, " ".join(own(1)))]
    rows += [(7, " ".join(own(10))), (7, " ".join(own(11)))]  # one id, two components
    rows += [(3, " ".join(own(20))), (8, near(20)), (8, " ".join(own(21))), (9, near(21)), (None, near(21))]  # an id that stands for one component only
    rows += [(None, None), (None, ""), (None, " \n"), (7, ""), (3, None)]
    docs = corpus.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, place long")
    got = op04_ngram_join.one_of_each(docs.repartition(3))
    assert got.columns == docs.columns
    kept = [" ".join(own(i)) for i in (0, 1, 2, 3, 4, 10, 11, 20, 21)]
    ids = [None] * 5 + [7, 7, 3, 8]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(zip(ids, kept, strict=True)) + Counter(rows[-5:])
    assert op04_ngram_join.one_of_each(none).count() == 0


# --- 5: top-k ---


def test_top_k_odd(corpus):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (None, [1.0] * 5), (7, rows[9][1]), (304, [0.5])]
    vectors = corpus.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS x")
    got = op05_topk.nearest(vectors, vectors.where("vec_id % 100 = 0"))
    scaled = [(r.vec_id, [int((1024 * x) // 1) for x in r.embedding]) for r in vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and abs(x) < 9 for x in r.embedding)]
    want = set()
    for i, q in scaled:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in scaled if j != i)[:10]
            want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert op05_topk.nearest(vectors.limit(0), vectors).count() == 0


def test_top_k_broadcasts_no_copies_of_blocks(corpus, monkeypatch):
    monkeypatch.setattr(op05_topk, "SHARD", 8)
    monkeypatch.setattr(op05_topk, "BLOCK", 4)
    vectors = corpus.createDataFrame([(i, [float(i % 7), -1.0, 0.5 * (i % 3)]) for i in range(100)], "vec_id long, embedding array<float>")
    found = op05_topk.nearest(vectors, vectors.where("vec_id % 10 = 0"))
    assert found.count() == 100
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_top_k_of_large_components(corpus):
    rng = random.Random(4)
    big = [1.0, 2.0**14, 2.0**22, 2.0**31, 2.0**53, 1e300]
    rows = [(i, [rng.choice([-1, 1]) * rng.randint(1, 1000) / 999 * rng.choice(big[: 1 + i % 6]) for _ in range(4)]) for i in range(120)]
    rows += [(200, [1e308] * 4), (201, [1e308] * 4), (202, [float("inf")] * 4)]
    scaled = [(i, [int(x) * 1024 if abs(x) >= 2**43 else int(1024 * x // 1) for x in v]) for i, v in rows if i != 202]

    def best(queries, vectors):
        for i, q in queries:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in vectors if j != i)[:10]
            yield from ((i, rank, j, -s if -(2**63) <= -s < 2**63 else None) for rank, (s, j) in enumerate(found, 1))

    for few in (rows, [r for r in rows if r[0] < 200 and r[0] % 6 < 3]):
        vectors = corpus.createDataFrame(few, "vec_id long, embedding array<double>")
        kept = [r for r in scaled if r[0] in dict(few)]
        assert {tuple(r) for r in op05_topk.nearest(vectors, vectors).collect()} == set(best(kept, kept))


# --- 7: quality ---


def test_cascade(odd, none):
    got = {(r.doc_id, r.n_words): r for r in op07_quality.judged(odd).collect()}
    assert got[(6, 32000)].n_repeat_words == 32000 and got[(6, 32000)].base_failed
    assert got[(None, 0)].base_failed and not got[(4, 0)].kept
    kept = op07_quality.kept_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, r in got.items() if r.kept) + Counter({2: 1})
    assert op07_quality.kept_documents(none).count() == 0 and op07_quality.judged(none).count() == 0


def test_rejected_texts_skip_later_measures(corpus):
    """A text that the base or an earlier rule rejects has no value in the measures of later rules."""
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, "few words"), (2, prose + " ###############"), (3, prose.upper()), (4, prose)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    rules = op07_quality.RULES[:2]  # symbols, then shouting
    found = op07_quality.cascade(op07_quality._bodies(docs, "text", docs.doc_id), [*op07_quality.BASE_RULES, *rules])
    got = {r.kept.doc_id: r for r in found.collect()}
    assert [got[i].rule for i in (1, 2, 3, 4)] == ["few words", "symbols", "shouting", None]
    assert got[1].n_repeat_words is None and got[1].n_symbols is None  # the base's own second rule is skipped too
    assert got[2].n_symbols == 15 and got[2].n_capitals is None and got[2].n_letters is None
    assert got[4].n_capitals == 0 and got[4].n_letters == len(prose) - 79
    kinds = {r.doc_id: r.rejected_by for r in op07_quality.judged(docs).collect()}
    assert kinds == {1: "few words", 2: "symbols", 3: "shouting", 4: None}


def test_cheap_rejections_come_first(odd):
    found = op07_quality.estimate(odd, op07_quality.BASE_RULES)
    assert [e.gain for e in found] == sorted((e.gain for e in found), reverse=True)


# --- 8: SentencePiece ---


def test_nbest_against_enumeration():
    pieces = op08_sentencepiece.Pieces()
    encoder = op08_sentencepiece.Encoder(pieces, 4)

    def every(s, i=0):
        if i == len(s):
            yield 0.0
            return
        single = False
        for j in range(i + 1, min(len(s), i + pieces.longest) + 1):
            if found := pieces.scores.get(s[i:j]):
                single |= j == i + 1
                yield from (found[1] + rest for rest in every(s, j))
        if not single:
            yield from (pieces.unknown + rest for rest in every(s, i + 1))

    for text in ["hello", "a  b", "Enüö x\n", "▁x  ", "日本 😀", " lead", "x"]:
        bounds, ids, scores, others = encoder.encode([text])
        want = sorted(every(" " + text), reverse=True)[:4]
        assert [round(s) for s in (scores[0], *(o["score"] for o in others[0]))] == [round(s) for s in want]
        assert encoder.decode(bounds, ids).to_pylist() == [text]


def test_round_trip(odd, none):
    rows = op08_sentencepiece.encoded(odd)
    got = rows.collect()
    assert all(r.round_trip for r in got) and len(got) == odd.count()
    assert Counter(r.text for r in op08_sentencepiece.decoded(rows).collect()) == Counter(r.text or "" for r in odd.collect())
    assert op08_sentencepiece.encoded(none).count() == 0


# --- 9: mixing ---


def test_mix_comes_near_its_targets(corpus, odd, none):
    docs = corpus.createDataFrame([(i, "w " * (1 + i * 7 % 40), f"s{i % 5 * (i % 3)}") for i in range(2000)], "doc_id long, text string, source string")
    got = op09_mixing.mixed(docs).selectExpr("row.source", "size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1
    assert op09_mixing.mixed(odd).count() == odd.count() and op09_mixing.mixed(none).count() == 0
    assert op09_mixing.copied(odd).columns == odd.columns


# --- 10: language model ---


def test_model_against_brute_force_and_base(corpus, odd, none):
    docs = corpus.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows, got = docs.collect(), op10_mixing_lm.scored(docs).collect()
    tokens = [(r.doc_id, [*words(r.text), None]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    total = sum(count.values())
    from math import log10

    want = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), total, round(sum(log10((count[w] + 1) / (total + len(count) + 1)) for w in t), 3)) for i, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert op10_mixing_lm.scored(none).count() == 0


def test_model_does_not_depend_on_splits(corpus, monkeypatch):
    """Other splits when the words are counted than when the texts are scored, as after executors are lost or gained."""
    monkeypatch.setattr(op10_mixing_lm, "SLICE_BYTES", 20_000)
    docs = corpus.read.parquet(f"{SF_DIR}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert op10_mixing_lm.sliced(docs, "doc_id", "text").select("slice").distinct().count() > 10
    whole = sorted(map(str, op10_mixing_lm.scored(docs).collect()))
    cogrouped = op10_mixing_lm.scored(docs)
    kept = corpus.conf.get("spark.sql.files.maxPartitionBytes")
    corpus.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert sorted(map(str, cogrouped.collect())) == whole
    finally:
        corpus.conf.set("spark.sql.files.maxPartitionBytes", kept)
    unfiled = op10_mixing_lm.scored(corpus.createDataFrame(docs.collect(), docs.schema)).collect()
    assert len(unfiled) == len(whole) and whole[0].startswith("Row(doc_id='d")


def test_first_weights_come_from_every_training_text(corpus, monkeypatch):
    seen, scorer = [], op10_mixing_lm._scorer
    monkeypatch.setattr(op10_mixing_lm, "_scorer", lambda model: seen.append(model.weights) or scorer(model))
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:200]
    texts = [(i, " ".join(f"w{(i * 31 + j * j) % 50}" for j in range(120))) for i in ids]
    for rows in (texts, [*texts[:-1], (ids[-1], "many other words " * 2000)]):
        op10_mixing_lm.scored(corpus.createDataFrame(rows, "doc_id long, text string")).count()
    assert all(abs(w[:, 0] - 0.5).max() > 0.01 for w in seen)
    assert abs(seen[0] - seen[1]).max() > 0.001  # one long text among many counts


def test_model_fits_from_tables(monkeypatch):
    """Fitting reads each token's log odds without its own count from tables, instead of working them out per token."""
    rng = np.random.default_rng(5)
    tables = np.zeros((op10_mixing_lm.CONTEXTS, 2, 1 << op10_mixing_lm.TABLE_BITS), dtype=np.uint64)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 40, size)) for size in (0, 1, 2, 300, 50)])
    h, bounds = op10_mixing_lm.tokens(texts)
    code = op10_mixing_lm.codes(h)
    places = [[(1 << b | int(c) >> 8 - b, int(c) >> 7 - b & 1) for b in range(8)] for c in code]
    assert op10_mixing_lm.NODES[code].tolist() == [[n for n, _ in word] for word in places]
    at = [op10_mixing_lm.slots(c, op10_mixing_lm.NODE_HASHES[code]) for c in op10_mixing_lm.context_hashes(h, bounds)]
    for k, slot in enumerate(at):
        for word, row in zip(places, slot, strict=True):
            for (_, bit), s in zip(word, row, strict=True):
                tables[k, 0, s] += 1
                tables[k, 1, s] += bit
    distinct = len(set(h.tolist()))
    by_code = np.bincount(code, minlength=256).astype(np.uint64)
    model = op10_mixing_lm.Model(len(h), distinct, by_code, (by_code > 0).astype(np.uint64), tables)
    plain = op10_mixing_lm.log_odds
    monkeypatch.setattr(op10_mixing_lm, "log_odds", None)
    x, _, bit = model.inputs(h, bounds, code, leave_out=True)
    slope, curve = model.slopes(texts)
    for k, slot in enumerate(at):
        assert (x[:, :, k + 1] == plain(tables[k, 0][slot] - 1.0, tables[k, 1][slot] - bit)).all()
    assert np.isfinite(slope).all() and np.isfinite(curve).all() and (curve[:8, 0, 0] > 0).all()


# --- the pipeline ---


def test_pipeline(corpus, odd, none):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, op04_ngram_join.landed(stage(corpus, docs, SF_DIR), "test-stage")
        assert stage(corpus, none.select(*corpus_pipeline.COLUMNS), SF_DIR).count() == 0
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k == 1:
            own = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, _, c in own if i == c}
    assert docs.count() >= 1
