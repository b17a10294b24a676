import gc
import os
import re
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lisible.llm import byte_bpe, common, simhash

WORDS = [f"w{i}" for i in range(300)]


def own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


class Frame:
    """Stands for a DataFrame whose mapInArrow runs here, over one batch of 4,000 texts, and keeps the sizes of what comes out."""

    def __init__(self):
        self.sizes = []

    def __getattr__(self, name):
        return lambda *_, **__: self

    def mapInArrow(self, run, _):
        texts = [" ".join(WORDS[i % 50 :]) for i in range(4000)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["doc_id", "text"])
        self.sizes += [out.num_rows for out in run(iter([batch]))]
        return self


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="Linux tells this")
def test_free_memory_goes_back_to_the_system():
    """Many small blocks under a last one that stays: without hand_back() the process keeps them."""

    def run(batches):
        for batch in batches:
            held = [bytes(2000 + i % 7) for i in range(60_000)]
            kept.append(bytes(3000))
            del held
            yield batch

    kept, batch = [], pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    common.hand_back()
    before = own_mb()
    assert [b.num_rows for b in common.handing_back(run)(iter([batch]))] == [1]
    assert own_mb() - before < 30


def test_other_operators_empty_what_one_has_left():
    """A worker that has encoded gives up its memory of pre-tokens when a task of another operator begins; one of its own keeps it."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    codec = byte_bpe._codec(data, public_tokenizers.PATTERN)
    codec.encode("some words to remember")
    same = lambda batches: batches
    list(common.handing_back(same, "byte_bpe")(iter([])))
    assert byte_bpe._codec(data, public_tokenizers.PATTERN) is codec and codec.memo
    list(common.handing_back(same)(iter([])))
    assert byte_bpe._codec.cache_info().currsize == 0
    gone = weakref.ref(codec)
    del codec
    list(common.handing_back(same)(iter([])))
    gc.collect()
    assert gone() is None


def test_texts_are_taken_a_slice_at_a_time(spark):
    """spark, as columns are named."""
    frame = Frame()
    simhash._described(frame, "doc_id", "text", np.zeros(0, np.uint64))
    assert sum(frame.sizes) == 4000 and max(frame.sizes) <= common.SLICE
    batch = pa.RecordBatch.from_arrays([pa.array(range(1203))], ["x"])
    assert [b.num_rows for b in common.slices(iter([batch, batch.slice(0, 0)]))] == [500, 500, 203]
