"""Merkle manifest against brute force: odd rows, several layers of superblocks, tampered rows."""

import hashlib
from collections import Counter, defaultdict

import pytest

from ensspark.llm import op12_merkle as merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows, claims):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row (doc_id, source, lang, n_chars, text)."""

    def climb(nodes):
        paths = [[] for _ in nodes]
        owners = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [list(range(i, min(i + 8, len(nodes)))) for i in range(0, len(nodes), 8)]
            for run in runs:
                for j in run:
                    others = [nodes[x] for x in run if x != j]
                    for o in owners[j]:
                        paths[o].append((run.index(j), others))
            owners = [[o for j in run for o in owners[j]] for run in runs]
            nodes = [h(*(nodes[j] for j in run)) for run in runs]
        return nodes[0], paths

    groups = defaultdict(list)
    for row, claim in zip(rows, claims):
        groups[row[2]].append((row, leaf(row), leaf(claim)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]])
    root, tops = climb([trees[g][0] for g in names])
    for g, top in zip(names, tops):
        for (row, own, claim), path in zip(groups[g], trees[g][1]):
            folded = claim
            for at, others in path + top:
                folded = h(*others[:at], folded, *others[at:])
            yield row[0], own, trees[g][0], root, h(*(x for _, others in path + top for x in others)), folded


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_brute_force(corpus, odd, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8**height)
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(r) for r in odd.select(*merkle.COLUMNS).collect()]
    rows += [(i * 7 % 1201 + 10**17, "s", "en", i, f"Text É {i}") for i in range(600)] + [(5, None, f"l{i}", None, "Ab") for i in range(20)]
    data = corpus.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    other = merkle.leaf_of([merkle.small_letters(data[c]) if c == "text" else data[c] for c in merkle.COLUMNS])
    got = merkle.proven(merkle.built(data, claim=other)).collect()
    want = list(brute(rows, [(*r[:4], r[4] and r[4].translate(small)) for r in rows]))
    assert Counter(tuple(r)[:6] for r in got) == Counter((a, b, c, d, e, f) for a, b, c, d, e, f in want)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and 0 < sum(r.verified for r in got) < len(got)


def test_manifest_of_nothing_and_of_one_row(corpus, odd, none):
    empty = merkle.built(none)
    assert empty.root is None and merkle.proven(empty).collect() == []
    one = odd.where("doc_id = 7")
    row = merkle.proven(merkle.built(one)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("") and row.verified


def test_a_large_group_is_cut_into_superblocks(corpus):
    rows = corpus.range(20_000).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "CAST(id AS string) AS text")
    built = merkle.built(rows)
    assert [x.count() for x in built.layers] == [5, 1]
    assert merkle.proven(built).where("verified").count() == 20_000

