"""Ids of texts that fall apart at spaces, line feeds and marks are the library's own."""

import random

from tokenizers import Tokenizer

from bitloom.llm import token_files

#: What a piece may be broken at, and what must not break it.
PARTS = ["a", "b ", " ", "\n", "'s", "'", "é", "Z", "9", "\t", ".", "***", "中", "\r", "-", "ſ", "İ", "\x85", "\x1f", "\xa0", "\u2028", "ß!?"]
FIXED = ["", "\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "a\tb\nc", "x\r\ny z", "a'\ns b", "a'\n's b'll", "foo.\nBar, it''s", "<|endoftext|>\na", "word" * 5000 + "\nx", "a\n" * 5000]


def test_ids_at_line_feeds_and_marks():
    path, _ = token_files.default_tokenizer()
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert encoder.lines
    r = random.Random(5)
    texts = [*FIXED, *("".join(r.choices(PARTS, k=r.randint(1, 12))) for _ in range(8000))]
    for most in (token_files.CACHE, 50):  # the second empties its tables again and again
        encoder.most = most
        got = [ids.tolist() for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at : at + 100])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
