"""Cached chunks give the tokenizer's own ids, whatever has been forgotten by then."""

import random

import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import queries, tokens

PIECES = [*"aB cÉß.,;'\n\t  \r1２ñİ\x1c<|>€😀 ", "<|endoftext|>", " word", " Word.", "\n\n", " a", "'s", "l'"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("entries", [1, 7, 150_000])
def test_ids_are_the_librarys(name, entries):
    path = queries.tokenizer(name)
    plain, cached = Tokenizer.from_file(path), tokens.Encoder(path, entries)
    draw = random.Random(entries)
    texts = ["", " ", "word", "x" * 300 + "qzj" * 100, *["".join(draw.choices(PIECES, k=draw.randint(1, 50))) for _ in range(1500)]]
    for text in texts + texts[:100]:
        assert cached.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(cached.cache) <= entries and len(cached.cache.older) <= entries


def test_common_chunks_outlive_rare_ones():
    coder = tokens.Encoder(queries.tokenizer("byte_bpe_50k.json"), 10)
    learned = []
    plain = coder.cache.learn
    coder.cache.learn = lambda chunk: learned.append(chunk) or plain(chunk)
    for k in range(40):
        coder.encode("the " + "".join(chr(97 + k // 26) + chr(97 + k % 26)))
    assert learned.count("the") == 1 and len(learned) == 41
