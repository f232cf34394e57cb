"""Prefix tables under random appends, cuts and replacements, and one very long piece, against plain merging."""

import random
import time

import public_tokenizers
import pytest

from tracemill.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(public_tokenizers.path(bpe.TOKENIZER), public_tokenizers.PATTERN)


def test_random_edits(vocabulary):
    rng = random.Random(12)
    parts = [b"the", b"inter", b"ation", b"ing", b"zz", b"\xc3\xa9", b"\xf0\x9f", b"a", b"  ", b"\n", b"123", b"qu"]
    piece = lambda n: b"".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(30):
        text = piece(8)
        table = bpe.PrefixTable(vocabulary, text)
        for _ in range(12):
            kind = rng.randrange(3)
            if kind == 0:
                more = piece(4)
                table.append(more)
                text += more
            elif kind == 1:
                at = rng.randint(0, len(text))
                table.cut(at)
                text = text[:at]
            else:
                start = rng.randint(0, len(text))
                end = rng.randint(start, len(text))
                new = piece(3)
                table.replace(start, end, new)
                text = text[:start] + new + text[end:]
            assert table.tokens() == (vocabulary.merged(text) if text else [])


def test_one_long_piece_takes_linear_time(vocabulary):
    text = "abcdefgh" * 125_000
    start = time.time()
    ids = vocabulary.encode(text)
    assert vocabulary.decode(ids) == text.encode() and time.time() - start < 60
