import random

from logloom.llm.queries import tokenizer_path
from logloom.llm.token_counts import END, Automaton, marked, token_counts, vocabulary


def greedy(word, tokens):
    n, at = 0, 0
    while at < len(word):
        length = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in tokens), 0)
        if not length:
            return 1
        n, at = n + 1, at + length
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(4)
    for _ in range(60):
        tokens = {tuple(rng.choices(range(3), k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        a = Automaton(sorted(tokens))
        for _ in range(60):
            word = tuple(rng.choices(range(3), k=rng.randint(1, 14)))
            assert a.count(word) == greedy(word, tokens), (tokens, word)


def test_documents(spark):
    texts = ["", None, "Hello  wORLD\tthe\nthe", "naïve Überraschung 12345", "x" * 5000, "the " * 30000]
    tokens = set(vocabulary(tokenizer_path()))
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(None, "the", "", ""), (2, texts[2], "", "")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_words string").repartition(2), tokenizer_path()).collect()
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().lower().split()
        want.append((i, len(words), sum({w: greedy((*w, END), tokens) for w in set(words)}[w] for w in words)))
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_tokens) for r in got))) == sorted(map(repr, want))
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_every_word_is_spelt_to_its_end(spark):
    tokens = vocabulary(tokenizer_path())
    known = {marked(t) for t in tokens}
    assert len(known) == len(tokens) and all((b,) in known and marked((b, END)) in known for b in range(256))
    words = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        words.update((r.text or "").encode().lower().split())
    words |= {"für".encode(), "ç".encode(), b"thre", b"reha"}
    got = {r.w: r.n_tokens for r in token_counts(spark.createDataFrame([(w.decode(), w.decode()) for w in words], "w string, text string"), tokenizer_path(), "w").collect()}
    for w in words:
        symbols, n = marked((*w, END)), 0
        while symbols:
            length = next(k for k in range(len(symbols), 0, -1) if symbols[:k] in known)
            symbols, n = symbols[length:], n + 1
        assert got[w.decode()] == n, w
        assert n > 1 or marked((*w, END)) in known, w  # never one token by failure
