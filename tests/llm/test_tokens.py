import random

import numpy as np
from tokenizers import Tokenizer

from linkgauge.llm.tokens import TokenBytes, default_tokenizer

ODD = ["İstanbul ΣΑΣ", "a b c\td\x0be\x85f", "<|endoftext|> x <|startoftext|>", "it's we'll I'd 'S 'T 123 ４５ é ́x a ́b",
       "ﬁ Ǆ ß ẞ ſ K Å", "日本語 text。漢字 \U0001F600‍", "\x00\x01 a\x1cb\x1db", "ŉ ĳ İ ı", "'", "  lead and trail \n\n x ", "á̧", "#*$%&|<>", "naïve—dash…", "", None]


def test_same_ids_as_the_library():
    path = default_tokenizer()
    library, ours = Tokenizer.from_file(path), TokenBytes(path, most=500)
    library.encode_special_tokens = True
    draw = random.Random(1)
    letters = "aé'sßΣσς́  \n\t\x0b\x1c9½Ǆİ<|>endof日​.,!-_~AZ"
    for text in ODD + ["".join(draw.choice(letters) for _ in range(40)) for _ in range(3000)]:
        expected = library.encode(text, add_special_tokens=False).ids if text else []
        assert ours(text) == np.array(expected, dtype="<u4").tobytes(), text
