"""Operator 4: byte-level BPE encoding and decoding by a trie walk over distinct words.

The distinct pre-token words of a slice of texts are put in byte order, which is the depth-first
order of their trie; the path from the root to the current word is a stack. Each node (a prefix)
holds one state: the last token of the prefix's encoding. A node's state follows from its byte and
its ancestors: it is the one token that ends here and is compatible with the last token of the
prefix before it. Shared prefixes are therefore encoded once, and a word's ids are read by walking
back from its end. Compatibility of two neighbouring tokens (merging their bytes gives the same two
tokens back) is worked out once for each pair.

Nulls and empty texts give no tokens; every input row gives one output row (repeated rows too);
long texts are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import held, slices, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the pre-token pattern of the byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same matches, found faster: what is letters, numbers or signs needs no way back.
POSSESSIVE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Words kept from one slice to the next (twice as many at most), and the longest such word (bytes); both bound memory only.
KEEP_WORDS, KEEP_BYTES = 40_000, 48
KEEP_PAIRS, KEEP_STEPS = 200_000, 250_000  # judged pairs of tokens, steps from ending to ending
SLICE = 250_000  # text bytes encoded at once
ALONE, ALONE_SLICE = 200_000, 500_000  # the same for a worker that does nothing else


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file uses for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """``kept`` makes what is remembered of a word from its ids."""

    def __init__(self, path: str, kept=tuple, keep: int | None = None):
        self.kept, self.keep = kept, keep
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge = {(self.ids[to_bytes(a)], self.ids[to_bytes(b)]): (i, self.ids[to_bytes(a + b)])
                      for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.shown = {t: str(t) for t in self.token}
        self.size = {t: len(b) for t, b in self.token.items()}
        # with ids in the order of merges, a pair is judged by how its tokens were made
        self.ranked = all(t == 256 + i for i, t in self.merge.values()) and all(self.ids.get(bytes([i]), 256) < 256 for i in range(256))
        self.made = {t: pair for pair, (_, t) in self.merge.items()}
        self.starts = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}  # beginnings of tokens
        self.forget()
        self.words = regex.compile(POSSESSIVE)
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({names})") if names else None
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def forget(self) -> None:
        """Drop the remembered endings; number 0 is the empty one."""
        self.number, self.ending, self.found, self.go = {b"": 0}, [b""], [()], {}

    def step(self, ending: int, byte: int) -> int:
        """The longest ending of ``ending`` and one more byte that begins some token; its tokens are listed once."""
        s = self.ending[ending] + bytes([byte])
        while s not in self.starts:
            s = s[1:]
        if (n := self.number.get(s)) is None:
            n = self.number[s] = len(self.ending)
            self.ending.append(s)
            self.found.append(tuple((self.ids[s[i:]], len(s) - i) for i in range(len(s)) if s[i:] in self.ids))
        self.go[ending << 8 | byte] = n
        return n

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost first; only for pairs of tokens."""
        out = [self.ids[data[i:i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(((self.merge.get((a, b), (1 << 60, 0))[0], i) for i, (a, b) in enumerate(zip(out, out[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            out[i:i + 2] = [self.merge[out[i], out[i + 1]][1]]
        return out

    def compatible(self, before: int, token: int) -> bool:
        """Whether ``token`` stands as it is after ``before`` (-1: at the start of a word)."""
        if len(self.fits) > KEEP_PAIRS:
            self.fits.clear()
        if token not in self.alone:
            self.alone[token] = self.merged(self.token[token]) == [token]
        ok = self.alone[token]
        if ok and before >= 0:
            ok = self.stands(before, token) if self.ranked else self.merged(self.token[before] + self.token[token]) == [before, token]
        self.fits[(before + 1) << 20 | token] = ok
        return ok

    def stands(self, left: int, right: int) -> bool:
        """Whether two neighbours stay apart: the tokens at their border are taken back, the latest merge first, and no two
        that meet there may merge before the one that was taken back."""
        made, merge, limit = self.made, self.merge, 1 << 60
        while True:
            met = merge.get((left, right))
            if met is not None and met[1] < limit:
                return False
            if left > right:
                limit, pair = left, made.get(left)
                if pair is not None:
                    left = pair[1]
                    continue
                limit, pair = right + 1, made.get(right)
                if pair is None:
                    return True
                right = pair[0]
            else:
                limit, pair = right + 1, made.get(right)
                if pair is not None:
                    right = pair[0]
                    continue
                limit, pair = left, made.get(left)
                if pair is None:
                    return True
                left = pair[1]

    def walk(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of sorted distinct words: depth-first over their trie, one state for each prefix."""
        if len(self.go) > KEEP_STEPS:
            self.forget()
        out, before, last, ending = [], b"", [-1], [0]
        found, size, go, fits, push, push_ending = self.found, self.size, self.go.get, self.fits.get, last.append, ending.append
        for w in words:
            n, i = min(len(w), len(before)), 0
            while i < n and w[i] == before[i]:
                i += 1
            del last[i + 1:], ending[i + 1:]
            now, end = ending[i], i
            for byte in w[i:]:
                end += 1
                now = go(now << 8 | byte) or self.step(now, byte)
                push_ending(now)
                for token, length in found[now]:
                    start = last[end - length]
                    ok = fits(start + 1 << 20 | token)
                    if ok or ok is None and self.compatible(start, token):
                        push(token)
                        break
            got, end = [], len(w)
            while end:
                got.append(last[end])
                end -= size[last[end]]
            out.append(tuple(got[::-1]))
            before = w
        return out

    def pieces(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return self.words.findall(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def encoded(self, docs: list[str]) -> list[list[tuple]]:
        """What is kept of each word, for the words of whole texts."""
        cut = [self.pieces(t) for t in docs]
        kept, words = self.kept, set(chain.from_iterable(cut))
        if len(self.known) > (self.keep or KEEP_WORDS):  # words that come again are taken over, others go with the next turn
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = words.difference(known)
        if again := new.intersection(old):
            known.update((w, old[w]) for w in again)
            new -= again
        walked = []
        for w in sorted(new):  # in the order of their bytes too
            b = w.encode()
            t = self.special.get(w)
            if t is None and (t := self.ids.get(b)) is not None and not self.alone.get(t):
                t = None
            if t is None:
                walked.append((w, b))
            else:  # one token
                known[w] = kept((t,))
        known.update(zip((w for w, _ in walked), map(kept, self.walk([b for _, b in walked]))))
        out = [list(map(known.__getitem__, p)) for p in cut]
        for w, b in walked:
            if len(b) > KEEP_BYTES:
                del known[w]
        return out

    def encode(self, docs: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [list(chain.from_iterable(words)) for words in self.encoded(docs)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class DigestCodec(Codec):
    """Remembers of each word the number of its ids, the ids as text, and the bytes that they decode to."""

    def __init__(self, path: str, keep: int | None = None):
        super().__init__(path, self.told, keep)

    def told(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(self.shown.__getitem__, ids)), b"".join(map(self.token.__getitem__, ids))

    def digests(self, docs: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids, digest of the text decoded from them."""
        for words in self.encoded(docs):
            n, shown, data = zip(*words) if words else ((), (), ())
            text = b"".join(data).decode("utf-8", "replace")
            yield sum(n), hashlib.sha256(",".join(shown).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids (array), text`` decoded again, for callers that want the tokens themselves."""
    def run(batches):
        c = held(("bpe", path), lambda: Codec(path))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = c.encode(texts(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return _needed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


def encode_digests(docs: DataFrame, path: str, alone: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    def run(batches):
        c = held(("bpe digests", path, alone), lambda: DigestCodec(path, ALONE if alone else None))
        for batch in batches:
            for part in slices(batch, "text", ALONE_SLICE if alone else SLICE):
                n, a, b = zip(*c.digests(texts(part, "text")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _needed(docs).mapInArrow(run, SCHEMA)


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
