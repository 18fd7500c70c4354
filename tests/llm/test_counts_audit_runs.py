"""Token counts, the filter audit and periodic runs against the library and brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, filter_audit, oracles, periods, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

DOCUMENTS = "doc_id long, text string, lang string, key long, n long, mask int, part string, `begin` long, found string"
LABELS = "doc_id long, quality int, toxic int, good int, mask string"
LONG = " ".join(f"w{i * i % 997}" for i in range(30000))
PIECES = ["a", "e", "ing", "th", "'s", "'re", "'", "!", "?!", "12", "²", "É", "é", "Σ", "İ", "漢", "字", "😀", "\xa0", "\x85", "\x1c", "\n", " ", "  ", "　", "<|endoftext|>", "<|endof", "½", "Ⅷ", "ﬁ", "_", "\x00", "՘"]


def document_rows():
    good = " ".join(f"word{i}" for i in range(250))
    texts = [good, good, good, None, "", " \n\t\x0b", "a b " * 40, "SHOUT " * 300, "x$ " * 5, "é " * 260, LONG, "short", "one two three four five six " * 3, "b b b b b b b b b b b c"]
    rows = [(i, t, ("en", "de", None)[i % 3], 1, 2, 3, "p", 4, "f") for i, t in enumerate(texts)]
    return [*rows, rows[0], (10**12, good, "", *rows[0][3:]), (None, good, "en", *[None] * 6), (None, "lonely", None, *[None] * 6), (20, good, "fr", *rows[0][3:])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels = [(i, i % 2, int(i % 5 == 0), 1, "m") for i in range(12)] + [(0, 1, 0, None, None), (7, 0, 1, 2, "m"), (None, 1, 1, 1, "m"), (99, 1, 1, 1, "m"), (2, None, None, 1, "m")]
    spark.createDataFrame(document_rows(), DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return token_counts.WordCounter(file.read())


# ---------------------------------------------------------------- token counts


def test_counts_of_whole_texts(library, counter):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert "".join(counter.words(text)) == text
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def spliced(counter, text, chars, overlap):
    """The splices of one text in one process, widened until they are proven."""
    rounds = 0
    while True:
        chunks = list(counter.chunks(text, chars, overlap))
        zones = [counter.zones(c[5], c[1], c[3], c[4]) for c in chunks]
        over = [
            token_counts.excess(*left[2], *right[1], second[1], first[2], right[3])
            for first, second, left, right in zip(chunks, chunks[1:], zones, zones[1:])
        ]
        if None not in over:
            return sum(z[0] for z in zones) - sum(over), rounds
        chars, overlap, rounds = chars * token_counts.WIDEN, overlap * token_counts.WIDEN, rounds + 1


def test_spliced_chunks_count_as_the_whole(library, counter):
    rng, widened = random.Random(2), 0
    for trial in range(700):
        pieces = rng.sample(PIECES, rng.randint(1, 8)) if trial % 2 else PIECES
        runs = rng.choice([1, 1, 40])
        text = "".join(rng.choice(pieces) * rng.randint(1, runs) for _ in range(rng.randint(1, 300)))
        n, rounds = spliced(counter, text, rng.choice([40, 64, 100]), rng.choice([8, 16, 30]))
        assert n == len(library.encode(text, add_special_tokens=False).ids)
        widened += rounds > 0
    assert widened > 20


@pytest.mark.parametrize("unit", ["a", "ab", "=", " ", "\n", "😀", "abcdefg", "<|endoftext|>", "漢字", "1"])
def test_spliced_words_longer_than_a_chunk(library, counter, unit):
    for head in ("", "x", "xy ", "xyz!"):
        text = head + unit * (3000 // len(unit)) + " tail"
        assert spliced(counter, text, 200, 30)[0] == len(library.encode(text, add_special_tokens=False).ids)


def expected_counts(library, rows):
    return sorted(
        (str(r[0]), len((r[1] or "").encode()), n, n > 512) for r in rows for n in [len(library.encode(r[1] or "", add_special_tokens=False).ids)]
    )


@pytest.mark.parametrize("chars, overlap", [(None, None), (64, 16)])
def test_token_counts_of_documents(spark, folder, library, monkeypatch, chars, overlap):
    if chars:
        monkeypatch.setattr(token_counts, "CHUNK_CHARS", chars)
        monkeypatch.setattr(token_counts, "OVERLAP_CHARS", overlap)
    found = queries.QUERIES["op11_token_counts"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected_counts(library, document_rows())


def test_other_tokenizer_files_are_refused(spark):
    source = bpe.read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json")).value
    with pytest.raises(ValueError):
        token_counts.check_source(source)


# ---------------------------------------------------------------- filter audit


def test_trie_keeps_whole_texts():
    rng = random.Random(3)
    for _ in range(200):
        trie, known = filter_audit.RadixTrie(), {}
        for _ in range(60):
            text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))
            terminal = trie.terminal(text)
            assert terminal.text == text and known.setdefault(text, terminal) is terminal
        assert len(trie.terminals) == len(known)


def brute_audit(rows, labels):
    masks, words = [], lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for doc, text, lang, *_ in rows:
        text = text or ""
        w = words(text)
        twin = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in rows)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), twin]
        good, toxic = (doc is not None and any(r[0] == doc and r[k] == 1 for r in labels) for k in (1, 2))
        masks.append((lang or "", fails, good, toxic))
    out = {}
    for part in {m[0] for m in masks}:
        sums = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = [m for m in masks if m[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                kept = [m for m in left if not m[1][f]]
                redundant = sum(m[1][f] for m in whole) - len(gone)
                unique = sum(m[1][f] and sum(m[1]) == 1 for m in whole)
                sums[f] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step] = [len(kept), len(gone), redundant, unique, sum(m[2] for m in gone), sum(m[3] for m in gone), f]
                left = kept
        for (p, *_), row in out.items():
            if p == part:
                row[6] = sums[row[6]]
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


@pytest.mark.parametrize("trie_bytes", [filter_audit.TRIE_BYTES, 100])
def test_audit_of_every_order(spark, folder, monkeypatch, trie_bytes):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", trie_bytes)
    labels = [tuple(r)[:3] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    found = audited(queries.QUERIES["op12_filter_audit"](spark, folder))
    assert len(found) == 4 * 600 and found == brute_audit(document_rows(), labels)


def test_audit_equals_its_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    cursor = db.execute(oracles.ORACLES["op12_filter_audit"])
    names = [c[0] for c in cursor.description]
    rows = [dict(zip(names, r)) for r in cursor.fetchall()]
    expected = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}
    assert audited(queries.QUERIES["op12_filter_audit"](spark, folder)) == expected


def test_borders_part_texts_behind_a_long_common_beginning(spark):
    texts = ["same beginning " * 300 + f"{i:04d}" for i in range(2000)] + ["other"] * 500
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    borders = filter_audit.text_borders(docs, F.col("text"), 8)
    assert len(borders) >= 4 and borders == sorted(borders)
    assert max(collections.Counter(filter_audit.bisect_right(borders, t.encode()) for t in set(texts)).values()) < 1000


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=12):
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_runs_equal_brute_force():
    rng, texts = random.Random(4), []
    for trial in range(1500):
        n, letters = rng.randint(0, 90), rng.randint(1, 4)
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if trial % 3 == 0 and n:
            a, p = rng.randrange(n), rng.randint(1, 15)
            words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
        texts.append(words)
    for least in (2, 3, 12):
        found = periods.runs_of(texts, least)
        assert sum(map(len, found)) > 300
        for words, runs in zip(texts, found):
            assert sorted(runs) == brute_runs(words, least) and runs == sorted(runs, key=lambda r: (r[0], r[2]))


def test_runs_of_long_texts():
    assert periods.runs_of([[b"a"] * 150_000]) == [[(0, 150_000, 1)]]
    long = [b"%d" % (i % 700) for i in range(60_000)]
    assert periods.runs_of([[b"x", *long, b"x"], []]) == [[(1, 60_000, 700)], []]


def planted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_documents(spark, folder):
    extra = [(i, f"{'lorem ipsum dolor ' * 9}{i}", "en", 1, 2, 3, "p", 4, "f") for i in range(100, 160)]
    docs = [*document_rows(), *extra]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in extra) > 2
    path = f"{folder}/more"
    spark.createDataFrame(docs, DOCUMENTS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    expected = []
    for doc, text, *_ in docs:
        words = planted(doc, text)
        runs = brute_runs(words) if len(words) < 5000 else [r for r in periods.runs_of([[w.encode() for w in words]])[0]]
        longest = min(((-n, s, q) for s, n, q in runs), default=None)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        digests = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))), " ".join(w for i, w in enumerate(words) if i not in dropped)
        top = (None,) * 4 if longest is None else (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2])
        expected.append((doc, len(runs), *top, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    found = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, path).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["op11_token_counts", "op12_filter_audit", "op13_periodic_runs"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
