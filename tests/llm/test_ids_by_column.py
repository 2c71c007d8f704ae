"""Ids of a column of texts are those of the texts one by one."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parlance.llm import simple8b

TEXTS = [None, "", " ", "  \n", "Hello, World HELLO", "\tÉtude\x0bΣΑΣ it's\x0c x\xa0y \x1c\x85", "a" * 300, "don't  stop 123 😀\r\n"]


@pytest.mark.parametrize("apart", [True, False])
def test_columns_of_texts(apart):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = simple8b.ChunkIds(f.read(), apart)
    for column in (pa.array(TEXTS), pa.array(TEXTS * 3).slice(3, 9), pa.array([], pa.string())):
        want = [[*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in column.to_pylist()]
        values, lengths = ids.encode_column(column, 7)
        assert lengths.tolist() == [len(w) for w in want]
        assert np.array_equal(values, [x for w in want for x in w])
