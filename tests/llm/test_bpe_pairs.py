"""The trie walk's parts against plain merging and the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casekit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_neighbours_stay_apart_as_plain_merging_says(codec):
    rng = random.Random(1)
    ids = [t for t in codec.ids.values() if t not in codec.special.values()]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(6000)]
    for t in rng.sample(ids, 4000):  # pairs that spell a token
        b = codec.token[t]
        pairs += [(codec.ids[b[:i]], codec.ids[b[i:]]) for i in range(1, len(b)) if b[:i] in codec.ids and b[i:] in codec.ids]
    got = [codec.stands(*p) for p in pairs]
    assert got == [codec.merged(codec.token[a] + codec.token[b]) == [a, b] for a, b in pairs]
    assert 0.1 < sum(got) / len(got) < 0.9


def test_ids_of_every_code_point_and_with_everything_forgotten_in_between(codec, monkeypatch):
    lib = Tokenizer.from_file(PATH)
    docs = [chr(c) * 2 + " " + chr(c) for c in (*range(1, 0xD800, 7), *range(0xE000, 0x11000, 13), *range(0x1F300, 0x1F700))]
    docs += ["", " ", "  a\n\n b ", "it's we'll 'LL", "<|endoftext|>x <|endoftext|>", "e" * 5000, "ab" * 3000]
    want = [e.ids for e in lib.encode_batch(docs, add_special_tokens=False)]
    assert codec.encode(docs) == want
    for name in ("KEEP_WORDS", "KEEP_PAIRS", "KEEP_STEPS"):
        monkeypatch.setattr(bpe, name, 50)
    assert codec.encode(docs[::-1]) == want[::-1]
    codec.ranked = False  # a file whose ids do not follow its merges
    codec.fits.clear()
    assert codec.encode(docs[:500]) == want[:500]
    codec.ranked = True
