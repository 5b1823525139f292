"""What worker processes hold while they work, and after."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gradus.llm import bpe, common, language_id


def test_scoring_holds_few_texts_at_a_time():
    model = language_id.Model(["a", "b"], np.zeros(2), np.random.default_rng(1).random((2, 1 << language_id.BITS), np.float32))
    texts = [None, "", "1 2", *(f"Text {k} é " * 300 for k in range(4000))]
    batch = pa.array(texts, pa.string())  # outside of what is traced, as a batch from Spark is
    tracemalloc.start()
    got = next(language_id.scored(iter([batch]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    langs, scores = model.score(texts)
    assert got.field("lang_pred").to_pylist() == langs and got.field("score").to_pylist() == scores.tolist()
    assert peak < 24 << 20  # 4000 such texts as strings, twice, are 28 million characters
    assert [len(x) for x in language_id.scored(iter([batch[:0]]), model)] == [0]


def test_workers_let_go_of_what_an_earlier_stage_kept():
    content = bpe.vocabulary()
    assert bpe._codec(content) is bpe._codec(content) and common._kept
    common.let_go()
    assert not common._kept
