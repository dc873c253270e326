"""Token links between two tokenizers against brute force over byte offsets and Python counters."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from casekit.llm import alignment, bpe
from casekit.llm import queries as Q
from casekit.llm.common import table

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    a_tok = Tokenizer.from_file(PATH_A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {i: bytes(letter[c] for c in t) for t, i in json.load(open(PATH_A, encoding="utf-8"))["model"]["vocab"].items() if all(c in letter for c in t)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    docs = []
    for doc_id, text in rows:
        spans, groups, held = [], [], Counter()
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            parts = [(i, vocab[i]) for i in a], [(i, piece(b_tok.id_to_piece(i))) for i in b]
            if all(b"".join(x for _, x in p) == (" " + text).encode() for p in parts):
                for p in parts:
                    at, out = 0, []
                    for i, x in p:
                        out.append((at, at := at + len(x), i))
                    spans.append(out)
        if spans:
            ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            for s, e in zip([0, *ends], ends):
                left, right = ([i for x, y, i in side if s <= x and y <= e] for side in spans)
                groups.append((left, right))
                held.update((x, y) for x in left for y in right)
        docs.append((doc_id, groups, held))
    count = Counter(p for *_, held in docs for p in held)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, groups, held in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(held.values()),
                    sum(m for p, m in held.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in held.items()),
                    hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [(1, "Hello world, it's <|endoftext|> fine </s> <unk>"), (1, "Hello world, it's <|endoftext|> fine </s> <unk>"), (2, None), (3, ""), (4, " "),
       (5, "a" * 3000), (6, "naïve Überraschung – 東京タワー 👩‍👩‍👧  x▁y"), (7, "tabs\tand\n\n lines \r\n  spaces   end "), (None, "no id"),
       (8, "x y " * 5000), (9, "\x00\x01 ctrl"), (10, "ab" + "é" * 500 + " 123456789 " * 30), (11, "▁▁ a"), (12, "😀" * 400)]


@pytest.mark.parametrize("most", [0, 10 ** 6])
def test_links_match_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(alignment, "SALTS", 3)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, n_a string, pairs string")
    assert rows_of(alignment.links(df, PATH_A, PATH_B, most)) == brute(ODD)
    assert alignment.links(df.limit(0), PATH_A, PATH_B, most).count() == 0


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(Q.op12_token_alignment(spark, SF)) == brute(rows)


def test_windows_forgotten_in_between_change_nothing(monkeypatch):
    w = alignment.Windows(alignment.TokenizerA(PATH_A), alignment.TokenizerB(PATH_B))
    docs = [t for _, t in ODD if t]
    whole = [c.to_pylist() for c in w.align(docs)]
    monkeypatch.setattr(alignment, "KEEP_WINDOWS", -1)
    monkeypatch.setattr(alignment, "LONG_GROUP", 1)
    one = [[c.to_pylist()[0] for c in w.align([t])] for t in docs]
    assert whole == [list(c) for c in zip(*one)]


def test_merging_by_rank_gives_the_library_ids():
    """Every token's bytes encode to it, so ranks decide as the merges do; and the ids agree on many texts."""
    lib = Tokenizer.from_file(PATH_A)
    lib.encode_special_tokens = True
    a = alignment.TokenizerA(PATH_A)
    assert a.ranked
    codec = bpe.Codec(PATH_A)
    assert all(codec.merged(t) == [i] for t, i in codec.ids.items() if i not in codec.special.values())
    rng = random.Random(5)
    chars = [chr(c) for c in (*range(32, 1000), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640), 10, 9, 13, 0xA0, 0x2028)]
    docs = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(400)] + ["".join(rng.choice("etaoins hr") for _ in range(300)) for _ in range(300)]
    docs += [chr(c) * 3 for c in range(1, 3000)] + ["<|endoftext|>", "a  b   c", "it's 'll", ""]
    assert [x.tolist() for x in a.encode(docs)] == [lib.encode(" " + t, add_special_tokens=False).ids for t in docs]
