"""Ids of random strings by both libraries."""

import numpy as np

from docloom.llm import packing


def test_random_strings_have_the_ids_of_the_tokenizer():
    rng = np.random.default_rng(21)
    plain = [chr(c) for c in range(0x250) if packing.PLAIN.fullmatch(chr(c))]
    common = list("  \n\t'.,-0123456789etaoinsrhdlu'sS")
    other = [chr(c) for c in (0x130, 0x131, 0x3B1, 0x4E2D, 0x1F600, 0x301, 0x200B, 0xFEFF, 0x2028)]
    for number in range(4000):
        signs = common + plain if number % 2 else common + plain[:100] + other
        text = "".join(rng.choice(signs, rng.integers(1, 60)))
        assert packing.token_ids(text) == packing.token_ids(text, ranks=None), repr(text)
