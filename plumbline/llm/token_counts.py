"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are spliced again.

Texts up to ``CHUNK_CHARS`` are counted where they are read. Longer ones are cut into chunks that
overlap; the chunks spread over all tasks, each is encoded by itself, and reports the places of its
tokens and words inside the two overlaps. Neighbours are spliced at a boundary that provably is one of
the whole text:

* a word begin (of the split before the merges) that both chunks have, ``MARGIN`` bytes before the left
  one ends. The split goes from left to right and looks no further than that, so from a common begin on
  both chunks split alike, and every word is merged by itself;
* inside a word that covers the whole overlap: a token that both chunks have. A sequence of tokens is the
  encoding of its text exactly if each two neighbours are the encoding of theirs, so the left tokens up to
  a common one, followed by the right ones, are the encoding of the whole.

Tokens of the left chunk behind the splice and of the right one before it are subtracted. Where an overlap
has no such boundary, the text is cut anew with chunks and overlaps ``WIDEN`` times as long, until it has.

Words and their tokens are the library's: it encodes every distinct word that the memory doesn't hold, and
characters outside of Latin-1 are sorted into letters, digits, blanks and others by its own split.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.scratch import materialize, scratch_path

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
WIDEN = 4
MARGIN = 16
CACHED_WORDS = 300_000
CACHED_WORD_CHARS = 64
_YIELDED_BYTES = 4 << 20

# Fixed values of the split before the merges, for the first 256 code points: contractions, and with one
# space before them letters, digits and others; blanks leave their last character to the next word.
_LETTERS, _DIGITS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_BLANKS}{_LETTERS}{_DIGITS}]+"
    rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)

_ZONE = pa.schema(
    [("key", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]
    + [(f"{side}_{what}", pa.list_(pa.int64())) for side in ("left", "right") for what in ("tokens", "words")]
    + [("first_end", pa.int64())]
)
_ZONE_SQL = "key long, pair long, n long, `begin` long, `end` long, left_tokens array<long>, left_words array<long>, right_tokens array<long>, right_words array<long>, first_end long"
_CHUNK_SQL = "key long, no long, `begin` long, `end` long, next_begin long, previous_end long, text string"


class _Kinds(dict):
    """A Latin-1 stand-in for every other character, of the kind that the library's split takes it for."""

    def __init__(self, split):
        super().__init__((c, chr(c)) for c in range(256))
        self.split = split

    def __missing__(self, code: int) -> str:
        def joins(text: str) -> bool:
            return len(self.split(text)) == 1

        c = chr(code)
        self[code] = kind = "a" if joins(f"a{c}") else "1" if joins(f"1{c}") else "!" if joins(f"!{c}") else "\t"
        return kind


class WordCounter(dict):
    """Number of tokens by word, from the library; a full memory starts anew, long words are not stored."""

    def __init__(self, source: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        check_source(source)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kinds = _Kinds(self.tokenizer.pre_tokenizer.pre_tokenize_str)

    def ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> int:
        n = len(self.ids(word))
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            ends = [*accumulate(map(len, WORDS.findall(text.translate(self.kinds))), initial=0)]
            return [text[a:b] for a, b in zip(ends, ends[1:])]
        return WORDS.findall(text)

    def words(self, text: str) -> list[str]:
        """The words of a text, which join to the text; control strings of the file are words as they stand."""
        if self.special is None or not self.special.search(text):
            return self._split(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.added else self._split(part))]

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.words(text)))

    def begins(self, word: str, at: int) -> list[int]:
        """Byte places where the tokens of a word begin, if the word begins at ``at``."""
        if word in self.added:
            return [at]
        widths = [len(self.tokenizer.id_to_token(i)) for i in self.ids(word)]
        return [*accumulate(widths[:-1], initial=at)]

    def safe_cut(self, text: str, cut: int) -> int:
        """The cut, moved before a control string that it would part."""
        for content in self.added:
            n = len(content)
            found = text.rfind(content, max(0, cut - n + 1), cut + n - 1)
            if 0 <= found < cut:
                cut = found
        return cut

    def chunks(self, text: str, chars: int, overlap: int) -> Iterator[tuple]:
        """``(no, begin, end, next begin, previous end, text)`` with byte places; the last is no shorter than half."""
        count = max(1, round(len(text) / chars))
        starts = [self.safe_cut(text, k * chars) for k in range(count)]
        ends = [max(s, self.safe_cut(text, s + overlap)) for s in starts[1:]] + [len(text)]
        cuts = sorted({*starts, *ends})
        places, at, before = {}, 0, 0
        for cut in cuts:
            at += len(text[before:cut].encode())
            before = places[cut] = at
            before = cut
        for k, (a, b) in enumerate(zip(starts, ends)):
            after = places[starts[k + 1]] if k + 1 < count else None
            yield k, places[a], places[b], after, places[ends[k - 1]] if k else None, text[a:b]

    def zones(self, text: str, begin: int, next_begin: int | None, previous_end: int | None) -> tuple:
        """Tokens of a chunk, and begins of tokens and words in its left and its right overlap."""
        words = self.words(text)
        total, sizes = 0, [len(w.encode()) for w in words]
        head: tuple[list, list] = ([], [])
        tail: tuple[list, list] = ([], [])
        at, first_end = begin, begin + (sizes[0] if sizes else 0)
        for word, size in zip(words, sizes):
            inside = (previous_end is not None and at < previous_end) or (next_begin is not None and at + size > next_begin)
            if inside:
                places = self.begins(word, at)
                total += len(places)
                if previous_end is not None and at < previous_end:
                    head[0].extend(p for p in places if p < previous_end)
                    head[1].append(at)
                if next_begin is not None and at + size > next_begin:
                    tail[0].extend(p for p in places if p >= next_begin)
                    if at >= next_begin:
                        tail[1].append(at)
            else:
                total += self[word]
            at += size
        return total, head, tail, first_end


def check_source(source: str) -> None:
    """Refuse files that this split doesn't stand for."""
    import json

    spec = json.loads(source)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    flags = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    model = spec["model"]
    if not plain or flags or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("a plain byte-level BPE file is needed")


_LOADED: dict[int, WordCounter] = {}


def loaded(source: Broadcast) -> WordCounter:
    """The counter of a broadcast file, built once in each Python worker."""
    key = hash(source.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordCounter(source.value)
    return _LOADED[key]


def excess(left_tokens: list, left_words: list, right_tokens: list, right_words: list, begin: int, end: int, first_end: int) -> int | None:
    """Tokens that two overlapping chunks count too often; None without a proven common boundary.

    ``begin`` and ``end`` bound the overlap; ``first_end`` is where the right chunk's first word ends.
    """
    common = [p for p in sorted({*left_words} & {*right_words}) if p + MARGIN <= end]
    if common:
        at = common[0]
    elif not left_words and first_end >= end:
        spans = {*zip(left_tokens, [*left_tokens[1:], end])}
        shared = [s for s in zip(right_tokens, right_tokens[1:]) if s in spans]
        if not shared:
            return None
        at = shared[0][0]
    else:
        return None
    return sum(p >= at for p in left_tokens) + sum(p < at for p in right_tokens)


def _counted(text: Column, tokenizer: Broadcast) -> Column:
    @arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = loaded(tokenizer)
        for batch in batches:
            yield pa.array([counter.count(t.as_py() or "") for t in batch], pa.int64())

    return count(text)


def _spliced(texts: DataFrame, tokenizer: Broadcast, chars: int, overlap: int) -> DataFrame:
    """``texts(key, text)`` to ``(key, n_tokens)``, NULL where an overlap has no proven boundary."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(tokenizer)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for chunk in counter.chunks(value.as_py(), chars, overlap):
                    rows.append((key, *chunk))
                    held += len(chunk[-1])
                    if held > _YIELDED_BYTES:
                        yield _chunk_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _chunk_batch(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(tokenizer)
        for batch in batches:
            out = []
            plain = [batch.column(k).to_pylist() for k in range(6)]
            for key, no, begin, end, after, before, value in zip(*plain, batch.column(6)):
                n, head, tail, first_end = counter.zones(value.as_py(), begin, after, before)
                out.append((key, no, n, None, end, tail[0], tail[1], None, None, None))
                if before is not None:
                    out.append((key, no - 1, 0, begin, None, None, None, head[0], head[1], first_end))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(_ZONE), _ZONE)], schema=_ZONE)

    @arrow_udf(T.LongType())
    def splice(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns))
            # Behind the last chunk of a text there is nothing to splice.
            yield pa.array([0 if r[4] is None else excess(*r) for r in rows], pa.int64())

    zones = texts.mapInArrow(cut, _CHUNK_SQL).repartition(partitions, "key", "no").mapInArrow(encode, _ZONE_SQL)
    wide = ("begin", "end", "left_tokens", "left_words", "right_tokens", "right_words", "first_end")
    pairs = zones.groupBy("key", "pair").agg(F.sum("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in wide])
    spliced = pairs.select("key", "n", splice("left_tokens", "left_words", "right_tokens", "right_words", "begin", "end", "first_end").alias("over"))
    whole = F.count("over") == F.count(F.lit(1))
    return spliced.groupBy("key").agg(F.when(whole, F.sum("n") - F.sum("over")).alias("n_tokens"))


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()]
    names = ["key", "no", "begin", "end", "next_begin", "previous_end", "text"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def huge_counts(texts: DataFrame, tokenizer: Broadcast, chars: int | None = None, overlap: int | None = None) -> DataFrame:
    """``texts(key, text)`` with unique keys to ``(key, n_tokens)``; a job for every widening of the overlaps."""
    chars, overlap = chars or CHUNK_CHARS, overlap or OVERLAP_CHARS
    done, left = None, texts
    while True:
        counted = materialize(_spliced(left, tokenizer, chars, overlap))
        known = counted.where("n_tokens is not null")
        done = known if done is None else done.unionByName(known)
        open_keys = counted.where("n_tokens is null").select("key")
        if open_keys.isEmpty():
            return done
        left = texts.join(open_keys, "key", "left_semi")
        chars, overlap = chars * WIDEN, overlap * WIDEN


def token_counts(docs: DataFrame, tokenizer: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row per input row; NULL and empty texts have no bytes and no tokens.

    Ids may repeat or be NULL: huge texts are told apart by a number of their own, fixed in a written
    table. Runs jobs while it is called.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    is_huge = F.char_length("text") > CHUNK_CHARS
    small = rows.where(~is_huge).select("doc_id", size, _counted(F.col("text"), tokenizer).alias("n_tokens"))
    path = scratch_path(docs.sparkSession, "huge-texts")
    rows.where(is_huge).select(F.monotonically_increasing_id().alias("key"), "doc_id", size, "text").write.parquet(path)
    huge = docs.sparkSession.read.parquet(path)
    counts = huge_counts(huge.select("key", "text"), tokenizer)
    return small.unionByName(huge.select("key", "doc_id", "n_bytes").join(counts, "key").drop("key"))
