"""What a worker keeps when its task is done: workers stay for the stages after theirs."""

import pyarrow as pa
import pytest

from stanzaline.llm import common, packing


def test_memory_is_given_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k))], names=["x"]) for k in (5, 0, 3)]
    own = common.slices(iter(batches), 2)
    assert [next(own).num_rows for _ in range(5)] == [2, 2, 1, 2, 1] and not given
    assert list(own) == [] and given == [1]
    assert list(common.slices(iter([]))) == [] and given == [1, 1]


def test_give_back():
    common.give_back()
    assert pa.default_memory_pool().bytes_allocated() >= 0


def test_words_of_a_task_are_dropped():
    """What a task has seen can be dropped; ids stay the same."""
    pytest.importorskip("public_tokenizers")
    own = packing.encoder(packing.tokenizer_path())
    ids = own.encode(b"some words of one text")
    assert own.parts
    own.forget()
    assert not own.parts and not own.words and own.encode(b"some words of one text") == ids
