"""The operators' inner steps against brute force; no Spark."""

import itertools
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bpe, chat, crf_quality, decontaminate, hmm, main_text, pii, secret_scan, simhash

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def transducer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return bpe.Transducer(file.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


PIECES = ["a", "e", "ing", "th", "'s", "'", "!", "?!", "12", "²", "É", "é", "Σ", "ß", "İ", "漢", "😀", "\xa0", "\x85", "\x1c", "\n", " ", "　", "<|endoftext|>", "</w>", "½", "ﬁ", "_", "\x00"]


def test_bpe_equals_library_on_mixed_texts(transducer, library):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert transducer.encode(text).tolist() == ids
        assert transducer.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "aehtinls", "!", "é"])
def test_bpe_streams_words_longer_than_its_block(transducer, library, letters):
    rng = random.Random(2)
    text = "".join(rng.choice(letters) for _ in range(4 * transducer.block))
    assert list(transducer.stream(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_bpe_decoder_waits_for_whole_characters():
    machine = bpe.Transducer.__new__(bpe.Transducer)
    machine.by_piece, machine.pieces = False, {0: b"\xe6\xbc", 1: b"\xa2", 2: b"\xff"}
    assert "".join(machine.decode_stream([0, 1, 2, 0], chunk=1)) == "漢��"


def test_suffix_array_and_longest_matches():
    rng = np.random.default_rng(0)
    for trial in range(120):
        words = rng.integers(0, rng.integers(2, 5), rng.integers(1, 60)).astype(np.int32)
        if trial % 3 == 0:
            words = np.tile(words[:4], 15)[: len(words)].astype(np.int32)
        words = np.append(words, 0)

        def suffix(i):
            return list(itertools.takewhile(bool, words[i:].tolist()))

        order = decontaminate.suffix_array(words, 1000)
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(words)) if words[i])
        item = [b"%d" % n for n in rng.integers(1, 4, 8)]
        block = decontaminate.TestBlock(2).build([("x", item)])
        numbered = np.array([block.vocabulary.get(b"%d" % n, 0) if n else 0 for n in words], np.int32)
        best, where = decontaminate.longest_matches(numbered, decontaminate.suffix_array(numbered, 8), block)
        text = numbered.tolist()
        for s, n, found, place in zip(block.starts, block.lengths, best, where):
            probe = block.flat[s : s + n].tolist()
            longest = max((k for k in range(n + 1) if any(text[i : i + k] == probe[:k] for i in range(len(text)))), default=0)
            assert found == longest
            assert longest == 0 or text[place : place + longest] == probe[:longest]


def test_fingerprint_by_hand():
    import xxhash

    text = "One two THREE four five six one two three four"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(text.encode()) % 2**64 == expected
    assert simhash.fingerprint_of(b" \n ") == 0
    assert simhash.fingerprint_of(b"a b") % 2**64 == xxhash.xxh64_intdigest(b"a b", seed=42)


@pytest.mark.parametrize("distinct", [1, 10**7, 10**12])
def test_parts_leave_no_pair_out(distinct):
    rng = random.Random(3)
    masks = simhash.part_masks(distinct)
    for _ in range(2000):
        changed = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(changed & m == 0 for m in masks)


def test_pivot_search_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    table = np.bitwise_count(prints[:, None] ^ simhash.pivots()[None]).astype(np.uint8)
    every = np.arange(len(prints))
    i, j = simhash._links_of(prints, table, every, every, 4)
    distance = np.bitwise_count(prints[:, None] ^ prints[None])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= 4))))


@pytest.mark.parametrize("segment", [7, 64, 1024])
def test_hidden_markov_recursions_against_loops(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    k = hmm.STATES
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.CLASSES), k).T)
    texts = [rng.integers(0, hmm.CLASSES, n) for n in (1, 2, 63, 64, 65, 200)]
    likelihood, starts, moves, emits = [], np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for t in texts:
        a, total = [model.start * model.emit[t[0]]], 0.0
        for c in t[1:]:
            total += np.log(a[-1].sum())
            a[-1] = a[-1] / a[-1].sum()
            a.append((a[-1] @ model.move) * model.emit[c])
        likelihood.append(total + np.log(a[-1].sum()))
        b = [np.ones(k)]
        for c in t[:0:-1]:
            x = model.move @ (model.emit[c] * b[-1])
            b.append(x / x.sum())
        b.reverse()
        for n, c in enumerate(t):
            gamma = a[n] * b[n] / (a[n] * b[n]).sum()
            emits[c] += gamma
            if n == 0:
                starts += gamma
            else:
                joint = a[n - 1][:, None] * model.move * (model.emit[c] * b[n])[None]
                moves += joint / joint.sum()
    batch = hmm.Batch(texts)
    assert np.allclose(batch.likelihoods(model), likelihood)
    for found, expected in zip(batch.expected(model), (starts, moves, emits)):
        assert np.allclose(found, expected)


def test_language_model_runs_texts_of_like_length_together():
    rng = np.random.default_rng(5)
    sizes = np.where(rng.random(4_000) < 0.1, 3_000, rng.integers(1, 300, 4_000))
    column = pa.array([rng.integers(0, hmm.CLASSES, n).astype("<u2").tobytes() for n in sizes], pa.binary())
    groups = list(hmm._batches(column))
    assert sorted(i for places, _ in groups for i in places.tolist()) == list(range(4_000))
    assert all(t.tobytes() == column[i].as_py() for places, texts in groups for i, t in zip(places.tolist(), texts))
    assert all(sum(map(len, texts)) <= hmm.BATCH_CLASSES for _, texts in groups)
    # A column costs some calls, however few rows it has: only the groups with long texts may have many columns.
    assert sum(len(hmm.Batch(texts).reach) for _, texts in groups) <= 2 * hmm.SEGMENT


def test_language_model_tokens_of_whole_batches_against_loops():
    every = [bytes([a, b, c]) for a in range(256) for b in (0, 28, 32, 65, 91, 0xA0) for c in (9, 13, 31, 90, 0xC3)]
    texts = [None, b"", b" ", b"A bb\x0bA  a\n", *every, None, " É É\u00a0É İ ".encode()]
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.binary())[7:], pa.array(texts, pa.large_binary()), pa.array([], pa.binary())):
        tokens, numbers, sizes = hmm.tokens_of(column)
        words = np.split(numbers, np.cumsum(sizes)[:-1]) if len(sizes) else []
        assert [[tokens[i].as_py() for i in w.tolist()] for w in words] == [(t or b"").lower().split() for t in column.to_pylist()]
        assert len(set(tokens.to_pylist())) == len(tokens)
    assert hmm.tail_classes(pa.array([b"a", b"abcd", b"xbcd"], pa.binary())).tolist() == [hmm.tail_class(t) for t in (b"a", b"bcd", b"bcd")]


def test_field_marginals_and_gradient():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (9, crf_quality.WIDTH)).astype(np.float32)
    counts, labels = np.array([4, 1, 4]), np.array([1, 0, 1])
    p = rng.normal(0, 0.3, crf_quality.PARAMETERS)
    chains = crf_quality.Chains(x, counts)
    good, _, total = chains.marginals(p)
    signal, move, at = x @ p[: crf_quality.WIDTH], np.array([[0, p[-3]], [p[-2], p[-1]]]), 0
    for d, n in enumerate(counts):
        z, expected = 0.0, np.zeros(n)
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(signal[at + i] * s[i] for i in range(n)) + sum(move[a, b] for a, b in zip(s, s[1:])))
            z, expected = z + w, expected + w * np.array(s)
        assert np.allclose(good[at : at + n], expected / z) and np.isclose(total[d], np.log(z))
        at += n
    slope = [(chains.gradient(p + 1e-5 * e, labels)[0] - chains.gradient(p - 1e-5 * e, labels)[0]) / 2e-5 for e in np.eye(len(p))]
    assert np.allclose(slope, chains.gradient(p, labels)[1:-1], atol=1e-6)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("2024-02-29", "date"), ("1.2.2020", "date"), ("12/31/1999", "date"), ("4111-1111-1111-1111", "card"),
        ("GB82 WEST 1234 5698 7654 32", "iban"), ("a.b+c@x-y.co.uk", "email"), ("192.168.0.1", "ip"),
        ("078-05-1120", "ssn"), ("+1 (394) 555-4006", "phone"), ("415-555-2671", "phone"),
        # Years beyond the usual ones, and letters and digits of other scripts.
        ("1815-12-10", "date"), ("31.12.2150", "date"), ("9999-12-31", "date"), ("0001-01-01", "date"),
        ("иван@example.com", "email"), ("ÀÉ@example.com", "email"), ("李明.ΑΣ@example.com", "email"),
        ("(٥٥٥) ١٢٣ ٤٥٦٧", "phone"), ("+44 ५५५-१२३-४५६७", "phone"),
    ],
)
def test_pseudonyms_keep_format_link_and_return(text, kind):
    new, counts = pii.replace_text(f"x {text} y {text}.", b"key")
    assert counts == {kind: 2} and len(new) == len(text) * 2 + 6 and text not in new
    first, second = new[2 : 2 + len(text)], new[-1 - len(text) : -1]
    assert first == second and pii.PATTERN.fullmatch(first)[kind]
    assert pii.replace_text(new, b"key", back=True)[0] == f"x {text} y {text}."
    assert pii.replace_text(text, b"other")[0] != first


@pytest.mark.parametrize("text", ["1234567812345678", "999.1.1.1", "2023-02-30", "GB83 WEST 1234 5698 7654 32", "plain words", ""])
def test_values_that_fail_their_check_stay(text):
    assert pii.replace_text(text, b"key") == (text, {})


@pytest.mark.parametrize(
    "text, value, kind",
    [
        ("card 4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 12/26.", "4111 1111 1111 1111", "card"),
        ("ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("AT61 1904 3002 3457 3201 77 EUR", "AT61 1904 3002 3457 3201", "iban"), ("BE68 5390 0754 7034 ON", "BE68 5390 0754 7034", "iban"),
        ("no 12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"), ("GB83 4111-1111-1111-1111", "4111-1111-1111-1111", "card"),
        ("123 456 7890 1234", "123 456 7890", "phone"),
    ],
)
def test_values_inside_of_failed_candidates(text, value, kind):
    for n in range(60):  # some pseudonyms would let the longer candidate pass
        key = b"key %d" % n
        new, counts = pii.replace_text(text, key)
        assert counts == {kind: 1} and value not in new and len(new) == len(text)
        before, after = text.split(value)
        assert new.startswith(before) and new.endswith(after)
        assert pii.replace_text(new, key, back=True)[0] == text


def test_letters_keep_script_and_case():
    name = "Иван.Ÿé_李ª٣"
    for n in range(50):
        new = pii.replace_text(f"{name}@ab.com", b"key %d" % n)[0].split("@")[0]
        assert [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in name]
        assert [ord(c) // 128 for c in new] == [ord(c) // 128 for c in name] and new[:4] != name[:4]


def test_days_stay_in_their_span():
    for text in ("1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "0476-09-04"):
        for n in range(50):
            year = int(pii.replace_text(text, b"key %d" % n)[0][:4])
            assert (year < 1900, year > 2099) == (text < "1900", text > "2100")


def test_permutation_is_one_to_one():
    seen = {tuple(pii.feistel(b"k", "t", [a, b, c], [7, 3, 5])) for a in range(7) for b in range(3) for c in range(5)}
    assert len(seen) == 105


def test_trigram_queries():
    query = secret_scan.trigram_query
    assert query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert query("[0-9a-f]{24,}") == frozenset()
    assert query("(cat|dog)s?x*") == {frozenset({"cat"}), frozenset({"dog"})}
    assert query("a(bc|d)") == frozenset()
    rng = random.Random(4)
    for rule in secret_scan.RULES:
        for _ in range(50):  # whatever a rule matches satisfies its query
            text = "".join(rng.choice(["token", "=", ' "', "abcdef12", "AKIA", "A1B2C3D4E5F6G7H8", "ghp_", "aB3" * 14, "xoxb-", "://", "u:p@"]) for _ in range(12))
            if rule.kind != "hex" and re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in branch) for branch in query(rule.pattern))


def test_chat_template_is_reversible():
    rng = random.Random(5)
    parts = [*chat.CONTROLS, "\\", "\n", "<", "[", "|>", "a b", "é"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "to\\ol\nx", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        formatted, mask = chat.write_window(turns)
        assert chat.read_window(formatted) == [t[:2] for t in turns]
        assert [chat.unescape(formatted[a:b]) for a, b in mask] == [x for role, x, again in turns if role == "assistant" and not again and x]
        assert formatted.count(chat.TURN) == len(turns)


PAGES = [
    ("", ""),
    ("<p>x", "x"),
    ("<main><header><h1>T</h1></header><p>a &amp; b&nbsp;c <b>d</b>e</p><aside>no</aside><p class=ad>no<p>yes<form>q<input></form></main>", "T\na & b c de\nyes"),
    ("<nav><a href=/>Home</a></nav><script>if(a<b){}</script><article><h1>Hi</h1>to.<!-- x --></article><footer>no</footer>", "Hi\nto."),
    ("<style>", ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert main_text.main_text(html) == text


def test_main_text_without_article_marks():
    body = "Real text stands here. " * 8
    html = f"<div id=menu><a>One</a></div><div><p>{body}</p><p>Short.</p><div class=comments>{body}</div><p>{body}</p></div><div class='site-footer'>{body}</div>"
    assert main_text.main_text(html) == "\n".join([body.strip(), "Short.", body.strip()])


BODY = "Real text stands here. " * 8


@pytest.mark.parametrize(
    "html, text",
    [
        # Short and link-only blocks between a surge and its dive, also around furniture.
        (f"<p>{BODY}<p>One.<p><a href=x>A link of its own</a><p>Two.<div class=ad>no</div><p>Three.<p>{BODY}", [BODY, "One.", "A link of its own", "Two.", "Three.", BODY]),
        (f"<p>{BODY}<nav><ul><li>a<li>b<li>c<li>d</ul></nav><p>Short end.", [BODY, "Short end."]),
        # A window of links alone is a dive.
        (f"<p><a>1</a><p><a>2</a><p><a>3</a><p>{BODY}<p><a>4</a><p><a>5</a><p><a>6</a><p>{'x' * 20}", [BODY]),
        # Wrappers with names of furniture.
        (f"<div class=has-sidebar><nav>no</nav><article><p>{BODY}<p>a</article><div class=sidebar>no</div></div>", [BODY, "a"]),
        (f"<form><main><p>{BODY}</main></form>", [BODY]),
        (f"<div class='content with-sidebar'><p>{BODY}<p>{BODY}<p>b<div class=sidebar>{BODY[:60]}</div></div>", [BODY, BODY, "b"]),
        (f"<main><p>{BODY}</main><div class=related><article>no</article></div>", [BODY]),
        (f"<article><p>{BODY}<div class=comments>{BODY * 9}</div></article>", [BODY]),
        # The mark is a weight: it does not hide the greater part of the text.
        (f"<article>A teaser.</article><p>{BODY}<p>{BODY}", ["A teaser.", BODY, BODY]),
        (f"<article><p>{BODY}<p>{BODY}</article><p>{BODY}", [BODY, BODY]),
    ],
)
def test_main_text_by_windows(html, text):
    assert main_text.main_text(html).split("\n") == [t.strip() for t in text]


@pytest.mark.parametrize(
    "html, text",
    [
        # A page of a few words keeps them, and a name of furniture counts as the last telling part only.
        ("<p>Short first.</p>", ["Short first."]),
        ("<p>One.</p><p>Two.</p><div class=ad-box>no</div>", ["One.", "Two."]),
        (f"<p>{BODY}<div class=related-work><p>a</div><section id=social-history><p>b</section><div class=related-posts>no</div>", [BODY, "a", "b"]),
        (f"<p>{BODY}<p>a<div id=comment-list-2>no</div><div class='main-nav left'>no</div>", [BODY, "a"]),
        # What stands between two marked parts is not in the mark.
        (f"<main><article><p>{BODY}</article></main><p>no<main><p>{BODY}</main>", [BODY, BODY]),
        # The windows choose: of a marked page too, only what hangs together with a surge.
        (f"<article>Teaser.</article><p>1<p>2<p>3<p>4<article>{BODY}</article>", [BODY]),
    ],
)
def test_main_text_of_short_and_compound_names(html, text):
    assert main_text.main_text(html).split("\n") == [t.strip() for t in text]


def test_surges_equal_plain_windows():
    """Brute force over all windows: join what no weightless window parts, keep what holds a surge, trim it."""
    rng = random.Random(3)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, 1, 20, 50, 90, 200]) for _ in range(rng.randint(0, 25))]
        least, window = rng.choice([0, 30, 86, 150.5]), rng.randint(1, 4)
        dives = {i for j in range(len(weights) - window + 1) if not any(weights[j : j + window]) for i in range(j, j + window)}
        expected, first = [], 0
        for end in [*sorted(dives), len(weights)]:
            stretch = [i for i in range(first, end) if weights[i]]
            if stretch:
                a, b = stretch[0], stretch[-1] + 1
                if max(sum(weights[j:b][:window]) for j in range(a, b)) > least:
                    expected.append((a, b))
            first = end + 1
        assert main_text.surges(weights, least, window) == expected


@pytest.mark.parametrize(
    "piece",
    ['<a "', '<a b="', "<a \"'", "<a ", "<div>x", "<div class=ad>x", "<b><p>x</i>", "<!", "</", "<script></script", "<div class=ad><article>", '<p title="a>b'],
)
def test_main_text_of_broken_markup_is_linear(piece):
    start = time.perf_counter()
    main_text.main_text(piece * 50_000)
    assert time.perf_counter() - start < 20  # a second or two; the square of it would be hours
