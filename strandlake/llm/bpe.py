"""Byte-level BPE encoding and decoding over a trie of distinct words.

The encoding of a word's prefix is the encoding of some shorter prefix and one more token, its
last token. It's the only one of the vocabulary's tokens ending there that BPE would leave
standing beside the last token of the shorter prefix. So a trie of the distinct words of a
batch is walked depth first, each node gets its last token and the node at which that begins,
and a prefix that many words share is encoded once.

Texts are split by the tokenizer's own pattern; strings of added tokens are cut out first, as
the tokenizers library does. Results equal that library's for tokenizers of byte-level BPE
without normalizer, dropout and ``ignore_merges``.

Edge cases: null texts count as empty; empty texts have no ids; other columns are ignored. A task
holds one slice of texts, its trie, and a cache of at most ``CACHE_WORDS`` words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from tokenizers.pre_tokenizers import ByteLevel

from .common import require, table, vocabulary

CACHE_WORDS = 400_000
#: Words of more bytes aren't kept in the cache.
CACHE_BYTES = 64
SLICE = 256
#: Pairs of tokens whose standing side by side is remembered.
STANDS = 1_000_000

# Letters and digits up to U+02AF. Texts without characters beyond these and some punctuation are split by
# Python's own regular expressions, others by the library's splitter, which is slower but knows all of Unicode.
NEAR_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
NEAR_DIGITS = "0-9²³¹¼½¾"
NEAR = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{NEAR_LETTERS}]+| ?[{NEAR_DIGITS}]+| ?[^\s{NEAR_LETTERS}{NEAR_DIGITS}]+|\s+(?!\S)|\s+")
FAR_CHARS = re.compile("[^\t\n\r -~¡-ʯ‐-‧]")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Trie:
    """Nodes are numbers; node 0 is the empty word."""

    def __init__(self, words: list[bytes] = ()) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.ends = [self.insert(w) for w in words]

    def insert(self, word: bytes) -> int:
        node, nodes = 0, self.next
        for b in word:
            below = nodes[node].get(b)
            if below is None:
                below = nodes[node][b] = len(nodes)
                nodes.append({})
            node = below
        return node


class Bpe:
    """A vocabulary file of the tokenizers library, kind BPE at byte level."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, letters = told["model"], byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = (model["vocab"][x] for x in (left, right, left + right))
            self.pairs[a, b] = rank, made
            self.parts.setdefault(made, (rank, a, b))
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.stands: dict[int, bool] = {}
        self.tokens = Trie(list(self.ids))
        self.token_at = [-1] * len(self.tokens.next)
        for node, i in zip(self.tokens.ends, self.ids.values(), strict=True):
            self.token_at[node] = i
        self.cache: dict[str, bytes] = {}
        self.split = ByteLevel(add_prefix_space=False)
        #: Bytes of each id, by which decoding is a lookup.
        self.decoding = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]

    def stand(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side. Undoes the merges at their border, latest first: if the parts that
        met there would have merged before one of them was made, the border wouldn't be."""
        found, limit, left, right = True, 1 << 60, a, b
        while True:
            met = self.pairs.get((left, right))
            if met is not None and met[0] < limit:
                found = False
                break
            l, r = self.parts.get(left), self.parts.get(right)
            if l is not None and (r is None or l[0] > r[0]):
                limit, left = l[0], l[2]
            elif r is not None:
                limit, right = r[0] + 1, r[1]
            else:
                break
        if len(self.stands) > STANDS:
            self.stands.clear()
        self.stands[a << 32 | b] = found
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by depth-first propagation of last tokens through the trie of all of them.

        Each node knows its last token and its origin, the node at which that token begins. On the way down go the
        tokens that have begun: pairs of an origin and a place in the trie of the vocabulary.
        """
        trie = Trie(words)
        last, origin = [-1] * len(trie.next), [0] * len(trie.next)
        nodes, tokens, token_at, stands = trie.next, self.tokens.next, self.token_at, self.stands.get
        stack = [(0, [])]
        while stack:
            node, begun = stack.pop()
            begun.append((node, 0))
            for byte, below in nodes[node].items():
                on = []
                for start, at in begun:
                    at = tokens[at].get(byte)
                    if at is not None:
                        on.append((start, at))
                        token = token_at[at]
                        if token >= 0 and last[below] < 0:
                            stand = not start or stands(last[start] << 32 | token)
                            if stand or stand is None and self.stand(last[start], token):
                                last[below], origin[below] = token, start
                stack.append((below, on))
        out = []
        for node in trie.ends:
            found = []
            while node:
                found.append(last[node])
                node = origin[node]
            out.append(found[::-1])
        return out

    def words(self, text: str) -> list[str]:
        if FAR_CHARS.search(text):
            return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]
        return NEAR.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.cut.split(t) if self.cut and self.cut.search(t) else [t] for t in texts]
        split = [[[p] if i % 2 else self.words(p) for i, p in enumerate(ps)] for ps in pieces]
        known = self.cache
        new = list({w for ps in split for ws in ps[::2] for w in ws if w not in known})
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for ps in split for ws in ps[::2] for w in ws})
        codes = self.encode_words([w.encode() for w in new])
        known.update((w, np.array(c, dtype="<u4").tobytes()) for w, c in zip(new, codes, strict=True))
        get = known.__getitem__
        out = [b"".join(np.array([self.added[ws[0]]], dtype="<u4").tobytes() if i % 2 else b"".join(map(get, ws)) for i, ws in enumerate(ps)) for ps in split]
        for w in new:
            if len(w) > CACHE_BYTES:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.decoding.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE, chars: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of at most ``most`` rows and about ``chars`` characters, with their texts; null texts are empty."""
    for batch in batches:
        at, sizes = 0, batch.column(column)
        lengths = [n or 0 for n in pa.compute.binary_length(sizes).to_pylist()]
        while at < batch.num_rows:
            to, total = at + 1, lengths[at]
            while to < batch.num_rows and to - at < most and total + lengths[to] <= chars:
                total += lengths[to]
                to += 1
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = to


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every text: ids as binary, little-endian unsigned 32-bit integers."""
    require(docs, key, text)

    def run(batches):
        bpe = load(path)
        for part, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(bpe.encode(texts), pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ids; null ids count as none."""
    require(encoded, key, "ids")

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([bpe.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes each text and decodes the ids in the same pass, so that neither ids nor texts travel; returns their digests."""
    require(docs, "doc_id", "text")

    def run(batches):
        bpe = load(path)
        for part, texts in slices(batches, "text"):
            codes = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in codes], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of ``documents`` encoded by the 50k byte-level vocabulary and decoded again, by digest."""
    return round_trip(table(spark, sf_dir, "documents"), path or vocabulary("byte_bpe_50k.json"))
