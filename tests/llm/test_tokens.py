import random
import time

import pytest
from quillmill.llm import bpe, wordpiece

TEXTS = [
    "", " ", "The cat's hats, they'll go 123 times!!", "it'S <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaa" * 40, "$$$$$$%%%%&&&&" * 30,
    "ΣΑΣ ΌΣΟΣ Ǆ İstanbul ß ﬁ", "é  x y\x1cz\x85w​q", "日本語のテキスト 𝔘𝔫𝔦 😀👍🏽 ½ ² Ⅷ", "\x00\x01 tab\tnew\nline\x0bv\x0cf\r", "don't 'RE 'Ve ''s", "x" * 3000,
]


def mixed(seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("abcdeth  '’.,!12éüßñΣσ\n\t$%&日本😀İ") for _ in range(400))


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())


def test_ids_and_decoding_equal_the_library(tokenizer):
    texts = TEXTS + [mixed(s) for s in range(200)]
    got = list(bpe.Encoder(bpe.vocabulary(bpe.default_path())).encode(texts))
    for text, (n, ids, decoded) in zip(texts, got, strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text[:80]
        assert n == len(want)
        assert decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_long_words_equal_the_library_and_take_n_log_n(tokenizer):
    r = random.Random(5)
    texts = ["".join(r.choices(a, k=n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "thequickbrownfoxjumpsover", "日本語のテキスト", "éüßñ", "$%&!?") for n in (500, 513, 3000, 20_000)] + ["a" * 50_000, "the" * 9000 + " x", "x " + "ab" * 400]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for text in texts:
        n, ids, decoded = next(encoder.encode([text]))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == tokenizer.decode(want, skip_special_tokens=False)
    start = time.time()
    next(encoder.encode(["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))]))
    assert time.time() - start < 60
    assert sum(map(len, filter(lambda w: isinstance(w, str), encoder.seen))) < 1_100_000


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    n, most = 0, max(map(len, vocabulary))
    while word:
        k = next(k for k in range(min(most, len(word)), 0, -1) if word[:k] in vocabulary)
        word, n = word[k:], n + 1
    return n


def test_automaton_counts_longest_matches():
    vocabulary = wordpiece.pieces(bpe.default_path("byte_bpe_50k.tiktoken"))
    known = set(vocabulary)
    words = [b" " + w for t in TEXTS + [mixed(s) for s in range(60)] for w in t.encode().split()]
    got = wordpiece.count_pieces(words, wordpiece.automaton(vocabulary))
    assert got.tolist() == [greedy(w, known) for w in words]


def test_small_vocabulary_with_long_failures():
    vocabulary = [bytes([b]) for b in range(256)] + [b"abcde", b"bcd", b"ab", b"cdx", b"bc", b"aaab"]
    words = [b"abcdx", b"abcdabcde", b"aaaaab", b"bcdx", b"abcabcdcdx", b"aaaa"]
    assert wordpiece.count_pieces(words, wordpiece.automaton(vocabulary)).tolist() == [greedy(w, set(vocabulary)) for w in words]


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        wordpiece.automaton([b"a"])


def test_columns_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (None, "The cat", "y", 6), (1, None, "x", 5), (2, "", None, 7)], "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode(docs, bpe.default_path())
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    rows = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in out.collect()}
    assert rows == {(1, 0, (), ""), (None, 2, (518, 2368), "the</w> cat</w>"), (2, 0, (), "")}
    assert out.count() == 4
    assert bpe.encode(docs.limit(0), bpe.default_path()).count() == 0
    counts = wordpiece.token_counts(docs, bpe.default_path("byte_bpe_50k.tiktoken"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in counts.collect()) == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
