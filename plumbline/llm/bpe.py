"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoding machine.

A merge can only be changed by text to its right through a chain of merges of falling priority that
each take the left neighbour away from the next one. ``sufficient_lookahead`` bounds the length of
such a chain over the merge list, so a token that ends that far before the end of what has been
read can no longer change and is emitted. The transducer keeps one block and the lookahead, whatever
the length of the word.

The tokenizer file is read on the driver, where its size is checked, and broadcast.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

MAX_TOKENIZER_BYTES = 64 << 20
CACHED_WORDS = 100_000
CACHED_WORD_CHARS = 64
SHORT = 40
NO_MERGE = 1 << 62

# Fixed values of the word split: contractions, letters, single digits, other visible characters.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACES = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
# The same split for texts of the first 256 code points only.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN_WORDS = re.compile(rf"{CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


def byte_characters() -> list[str]:
    """The visible stand-in of every byte: itself where printable, else the next code point above 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """How many symbols to the right of a token's end can still change it, at most.

    Merge m' can take from merge m the token that m needs as the left edge of its right part only if
    m' comes earlier in the list and its left part lies on the left edge of m's right part. The
    longest such chain, in symbols, is found in one pass through the list.
    """

    def width(token: str) -> int:
        return len(token) - len(suffix) if suffix and token.endswith(suffix) else len(token)

    left_child: dict[str, str] = {}
    reach: dict[str, int] = {}  # by the left part: symbols that a chain ending in such a merge spans
    longest = 0
    for left, right in merges:
        edge, beyond = right, 0
        while edge is not None:
            beyond = max(beyond, reach.get(edge, 0))
            edge = left_child.get(edge)
        span = width(left) + max(width(right), beyond)
        reach[left] = max(reach.get(left, 0), span)
        left_child.setdefault(left + right, left)
        longest = max(longest, span)
    return longest


class Transducer:
    """Merges, vocabulary and splitting rules of one tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE file is needed")
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.block = 4 * self.lookahead
        ids = self.vocabulary
        # The rank of a pair of ids, the two packed into one number, and the token of each rank.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [ids[a + b] for a, b in pairs]
        self.widths = {i: len(token) for token, i in ids.items()}  # in symbols, inside a word
        signs = byte_characters()
        self.inner = [ids[sign] for sign in signs]
        self.final = [ids[sign + self.suffix] for sign in signs]
        self.by_piece = (spec.get("decoder") or {}).get("type") != "ByteLevel"
        values = {sign: value for value, sign in enumerate(signs)}
        names = {i: token for token, i in [*ids.items(), *self.added.items()]}
        self.pieces = {
            i: token.encode() if self.by_piece else bytes(values[c] for c in token) for i, token in names.items()
        }
        contents = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.special = regex.compile(f"({contents})") if contents else None
        self.words = _Memory(self)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of ids, lowest rank first and from the left."""
        return self._merge_short(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """A list of ranks is cheap to search while it is short."""
        rank_of, merged, none = self.ranks.get, self.merged, NO_MERGE
        found = [rank_of(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            new = merged[best]
            symbols[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = rank_of(symbols[i - 1] << 32 | new, none)
            if i < len(found):
                found[i] = rank_of(new << 32 | symbols[i + 1], none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """A queue of pairs, for the blocks of long words."""
        last = len(symbols) - 1
        symbols, after, before = list(symbols), [*range(1, last + 2)], [*range(-1, last)]
        alive, queue = [True] * (last + 1), []

        def offer(i: int, j: int) -> None:
            rank = self.ranks.get(symbols[i] << 32 | symbols[j])
            if rank is not None:
                heapq.heappush(queue, (rank, i, symbols[i], symbols[j]))

        for i in range(last):
            offer(i, i + 1)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j > last or symbols[i] != a or symbols[j] != b:
                continue  # one of the two is gone
            symbols[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[i] <= last:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, there in zip(symbols, alive) if there]

    def stream(self, word: Iterable[int]) -> Iterator[int]:
        """Token ids of one word given byte by byte; holds ``block + lookahead`` symbols at most."""
        held: list[int] = []
        waiting = None  # the last byte read: only its successor tells that it doesn't end the word
        for byte in word:
            if waiting is not None:
                held.append(self.inner[waiting])
                if len(held) >= self.block + self.lookahead:
                    stable, end = [], 0
                    for token in self.merge(held[:]):
                        end += self.widths[token]
                        if end > len(held) - self.lookahead:
                            break
                        stable.append(token)
                    yield from stable
                    held = held[sum(map(self.widths.__getitem__, stable)) :]
            waiting = byte
        if waiting is not None:
            held.append(self.final[waiting])
            yield from self.merge(held)

    def encode_word(self, word: bytes) -> Iterable[int]:
        """A word that is shorter than a block is the transducer's last step alone."""
        if len(word) > self.block:
            return self.stream(word)
        inner = self.inner
        return self.merge([inner[b] for b in word[:-1]] + [self.final[word[-1]]])

    def split(self, text: str) -> list[str]:
        """The words of a text without control strings: composed, in lower case, cut by the rules."""
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = text.replace("Σ", "σ").lower()  # each character for itself: no special final sigma
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return WORDS.findall(text)
        return LATIN_WORDS.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text; control strings of the file are cut out first, as they stand."""
        if self.special is None or not self.special.search(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), np.int32)
        parts: list[bytes] = []
        for place, part in enumerate(self.special.split(text)):
            if place % 2:
                parts.append(_packed([self.added[part]]))
            else:
                parts.extend(map(self.words.__getitem__, self.split(part)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids: pieces go through an incremental byte-to-text machine."""
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text as it becomes certain; an unfinished character waits for the bytes that complete it.

        A file without decoder joins its pieces by single spaces.
        """
        machine, gap, pieces = codecs.getincrementaldecoder("utf-8")("replace"), b" " if self.by_piece else b"", self.pieces
        rest, first = iter(ids), True
        while True:
            part = [pieces[i] for _, i in zip(range(chunk), rest)]
            if not part:
                break
            yield machine.decode(gap.join(part) if first else gap + gap.join(part))
            first = False
        yield machine.decode(b"", final=True)


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class _Memory(dict):
    """Ids of words already met, as bytes; long words are not stored and a full memory starts anew."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        ids = _packed(self.transducer.encode_word(word.encode()))
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


_LOADED: dict[int, Transducer] = {}


def loaded(source: Broadcast) -> Transducer:
    """The transducer of a broadcast file, built once in each Python worker."""
    key = hash(source.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(source.value)
    return _LOADED[key]


def read_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file as a broadcast; larger files than ``MAX_TOKENIZER_BYTES`` are refused."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))


def encoded(text: Column, tokenizer: Broadcast) -> Column:
    """Token ids of a text column; NULL counts as the empty text, which has none."""

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = loaded(tokenizer)
        for batch in batches:
            yield _id_lists([transducer.encode(t.as_py() or "") for t in batch])

    return encode(text)


def decoded(ids: Column, tokenizer: Broadcast) -> Column:
    """Text of a column of token ids; NULL gives the empty text."""

    @arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = loaded(tokenizer)
        for batch in batches:
            yield pa.array([transducer.decode(ids.as_py() or ()) for ids in batch], pa.string())

    return decode(ids)


def recoded(text: Column, tokenizer: Broadcast) -> Column:
    """Struct of the token ids of a text and the text they decode to, in one pass through Python."""

    @arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def recode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = loaded(tokenizer)
        for batch in batches:
            rows = [transducer.encode(t.as_py() or "") for t in batch]
            texts = pa.array([transducer.decode(ids.tolist()) for ids in rows], pa.string())
            yield pa.StructArray.from_arrays([_id_lists(rows), texts], names=["ids", "decoded"])

    return recode(text)
