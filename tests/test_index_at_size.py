"""What the index costs as texts grow: rows by bucket and not by word, words cut at once as one by one."""

import pyarrow as pa
from pyspark.sql import functions as F

from stanzaline.operators import search as S
from stanzaline.operators import search_index as X


def test_rows_do_not_follow_words(spark, tmp_path):
    """Words that one text alone has share the rows of their buckets, and are found there."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(400)) + " running") for k in range(100)]
    index = X.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    assert index.packed().count() <= X.TERM_BUCKETS < 40_001 == index.all_postings().count()
    assert [(r.key, [tuple(h) for h in r.hits]) for r in X.match(index, "w7x11 runs").collect()] == [(7, [(11, 0), (400, 1)])]
    assert [r.hits for r in X.match(index, "w7x11", places_=False).collect()] == [[]]
    got = {r.key: (r.tokens, r.of) for r in X.counted(index, ["run", "w3x3"]).collect()}
    assert got == {k: (401, [1, int(k == 3)]) for k in range(100)}


def test_postings_of_terms_are_those_of_all(spark, tmp_path):
    rows = [(k, f"love{k % 3} loves the {'love ' * (k % 4)}") for k in range(30)]
    index = X.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    wanted = [r for r in index.all_postings().collect() if r.term in ("love", "the")]
    assert sorted(index.postings(["love", "the", "none"]).collect()) == sorted(wanted)
    assert index.postings(["love"]).select(F.sum(F.size("entries"))).first()[0] == 30


def test_words_are_cut_as_one_by_one():
    """Every Latin character, those of more bytes, and texts that begin or end within words."""
    texts = [f"{a}{chr(c)}{b}" for c in [*range(0x600), 0x1E9E, 0x212A, 0x2C65, 0x4E00, 0x1F600] for a, b in (("", ""), ("a", "B"), (" ", "1 "))]
    for own in (texts, [None, "", *texts[:900], "", None, "Ab"], []):
        for k in range(0, max(1, len(own)), 61):
            part = pa.array(own, pa.string()).slice(k, 61)
            words, sizes = S.words_of(part)
            wanted = [S.words_in(t) for t in part.to_pylist()]
            assert words.to_pylist() == [w for o in wanted for w in o] and sizes.tolist() == [len(o) for o in wanted]
