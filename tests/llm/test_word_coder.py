"""The shortcut of encoding pieces against the library, on random texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import encode_all

from citeforge.llm.textvec import flat_slices
from citeforge.llm.wordcoder import WordCoder, vocabulary_path

PIECES = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "\u0085", "'", "'s", "'LL", "it's", "a", "B", "word", "Word", "ÄÖ", "é", "e\u0301", "ß", "ſ", "İ", "×", "÷", "日本", "語", "🎉", "👩\u200d🚀", "١٢", "0", "12", "3.14", ",", ".", "...", "!?", "-", "--", "_", "#", "<|", "<|endoftext|>", "|>", "</s>", "\u0300", "\ufeff", "\u200b", "x" * 30]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library_on_random_texts(name):
    rng = random.Random(12)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x20, 0x3100)))) for _ in range(rng.randrange(20))) for _ in range(3000)]
    coder, got = WordCoder(vocabulary_path(name), most=500), []
    for _, _, flat in flat_slices(pa.array(texts), 1 << 12):
        ids, counts = coder.slice_ids(flat)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x[:-1] for x in encode_all(name, texts)]
