"""Every letter, followed by punctuation, gets the ids that the tokenizer gives it."""

import numpy as np
import public_tokenizers
import pytest

from fleetfold.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("form", ["{},", "a{}.", "{}b!", "Ab{}c-)"])
def test_ids_of_all_letters(form):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or c >= 0x20000)]
    letters += [chr(c) for c in (0x3400, 0x4E00, 0x9FFF, 0xAC00, 0xAC01, 0xD7A3, 0x20000, 0x2F800, 0x2FA1D)]
    texts = [form.format(c) for c in letters]
    want = plain.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want) if np.frombuffer(own.encode(t), dtype=own.dtype).tolist() != w.ids]
    assert wrong == []
