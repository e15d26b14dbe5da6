"""What the fragments of the n-gram join answer does not grow with their number."""

from ensspark.llm import op04_ngram_join as join
from ensspark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_answers_are_packed(corpus, monkeypatch):
    docs = table(corpus, SF_DIR, "documents", "doc_id", "text")
    counts, found = {}, {}
    for fragments in (1, 4, 16):
        monkeypatch.setattr(join, "FRAGMENT", -(-160_000 // fragments))
        dealt = join.blocks(docs, "text", fragments)
        live = dealt.groupBy("fragment").applyInArrow(lambda block: join._live(block, 8), join.LIVE)
        counts[fragments] = live.count()
        rows = live.groupBy("bucket").applyInArrow(join._united, join.SURVIVORS).collect()
        found[fragments] = sorted((r["class"], r.n, r.live, tuple(r.prefix), tuple(map(bytes, r.segments))) for r in rows)
    assert all(counts[f] <= 8 * f for f in counts)  # a row for each fragment and bucket, however many classes there are
    assert [x[:3] for x in found[1]] == [x[:3] for x in found[4]] == [x[:3] for x in found[16]] and found[1]
