import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stanzaline.llm import packing as P
from awkward import awkward_rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(3)
    pool = "ab Zéñß'st'll 12½ \t\n  \x1c\x85日本ﬁİǅ́-—.,!<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)] + [t or "" for _, t, *_ in awkward_rows()]
    encode = P.encoder(P.tokenizer_path()).encode
    for t in texts:
        assert encode(t.encode()) == ids(tokenizer, t)[:-1].tobytes(), repr(t)


def check(rows, tokenizer, got):
    wanted = {}
    for i, t, *_ in rows:
        own = ids(tokenizer, t)
        for k in range(0, len(own), P.CAPACITY):
            piece = own[k : k + P.CAPACITY]
            key = (i, k // P.CAPACITY, k, len(piece), zlib.crc32(piece.tobytes()))
            wanted[key] = wanted.get(key, 0) + 1
    found = {}
    by_sequence = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids))
        found[key] = found.get(key, 0) + 1
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == wanted
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return len(by_sequence)


def test_documents(docs, clashing, tokenizer):
    assert check(awkward_rows(), tokenizer, P.pack_documents(docs).collect())
    assert check(awkward_rows(), tokenizer, P.pack_documents(clashing).collect())


def test_empty(no_docs):
    assert P.pack_documents(no_docs).count() == 0


def test_sum_of_squares_by_brute_force():
    rng, cap = random.Random(2), 12
    packer, gaps = P.SumOfSquares(cap), {}
    for _ in range(300):
        size = rng.randint(1, cap)
        sequence, offset = packer.place(size)
        before = dict(gaps)

        def cost(state):
            per = {}
            for g in state.values():
                if 0 < g < cap:
                    per[g] = per.get(g, 0) + 1
            return sum(n * n for n in per.values())

        options = [cost({**before, s: g - size}) for s, g in before.items() if g >= size]
        assert offset == cap - before.get(sequence, cap) and (sequence in before) == bool(options)
        gaps[sequence] = before.get(sequence, cap) - size
        assert gaps[sequence] >= 0 and cost(gaps) == min(options, default=cost({**before, "new": cap - size}))


def test_few_sequences(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 600) for _ in range(3000)]
    rows = spark.createDataFrame([(i, i, 0, n) for i, n in enumerate(sizes)], "doc_id long, row long, piece int, length long")
    made = P.pack(rows).select("sequence_id").distinct().count()
    assert made <= -(-sum(sizes) // P.CAPACITY) + 1


def test_equal_rows_are_spread(spark):
    rows = spark.createDataFrame([(1, 1, 0, 100)] * 4000, "doc_id long, row long, piece int, length long")
    shards = {r.sequence_id >> 40 for r in P.pack(rows, shard_pieces=500).collect()}
    assert len(shards) == 8


def test_other_tokenizers_go_their_own_way():
    """A tokenizer file of another layout is not split at blanks."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = P.encoder(path), Tokenizer.from_file(path)
    assert not own.by_words and P.encoder(P.tokenizer_path()).by_words
    for t in ("A word  and\ttwo", " leading", "x\n\ny <|endoftext|>", ""):
        assert own.encode(t.encode()) == np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_query(spark, tmp_path, tokenizer):
    """The registered query, whose digests stand for the ids, on whole texts."""
    from collections import Counter

    from stanzaline.llm import queries

    spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_packing(spark, str(tmp_path)).collect()
    wanted = Counter()
    for i, t, *_ in awkward_rows():
        own = ids(tokenizer, t)
        for k in range(0, len(own), 2048):
            wanted[(i, k // 2048, k, len(own[k : k + 2048]), zlib.crc32(own[k : k + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1
