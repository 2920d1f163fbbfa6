import random
import unicodedata
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from logloom.llm.packing import BestFit, WordTokenizer, pack
from logloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, sequence_id string, piece string"
TEXTS = ["", None, "Hello, world. don't Stop... <|endoftext|> <|ENDOFTEXT|>.", "ÜBER été\t\r\nx\n\n  y", "a " * 9000, "rock', 'n' roll.,., 12.5 ***end.", "same text", "same text", "Σίσυφος ΟΔΟΣ. école"]


def brute(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_pieces_hold_the_ids_and_fill_sequences(spark):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(TEXTS)]
    got = pack(spark.createDataFrame(rows + rows[-1:], DOCS).repartition(3), tokenizer_path()).collect()
    want = brute(TEXTS)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, ids in enumerate(want):
        name = i if i != 3 else None
        mine = sorted(by_doc[name], key=lambda r: r.start)
        if i == len(TEXTS) - 1:
            assert len(mine) == 2 and mine[0].ids == mine[1].ids  # the repeated row
            mine = mine[:1]
        assert b"".join(r.ids for r in mine) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r.length == 4096 for r in mine[:-1]) and [r.piece for r in mine] == list(range(len(mine)))
        assert zlib.crc32(mine[0].ids) == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[:4096]))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []


@pytest.mark.parametrize("open_bins", [1, 2, 50])
def test_best_fit_is_bounded_and_tight(open_bins):
    import random

    rng, bins, closed = random.Random(open_bins), BestFit(100, open_bins, 0), []
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    for n in lengths:
        closed += bins.add(n, n)
        assert bins.n_open <= open_bins
    closed += bins.rest()
    assert sorted(x for _, items in closed for x in items) == sorted(lengths)
    assert all(sum(items) <= 100 for _, items in closed) and len({n for n, _ in closed}) == len(closed)
    if open_bins == 50:
        assert len(closed) <= 1.05 * sum(lengths) / 100


def test_a_tokenizer_of_another_kind_encodes_whole_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in pack(spark.createDataFrame([(i, x, "", "") for i, x in enumerate(TEXTS[:4])], DOCS), path, max_tokens=1 << 16).collect()}
    assert got == {i: b"".join(x.to_bytes(4, "little") for x in [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in enumerate(TEXTS[:4])}


def test_few_more_sequences_than_there_must_be(spark):
    rng = random.Random(4)
    rows = [(i, "word " * min(int(rng.paretovariate(0.9) * 60), 9000), "", "") for i in range(6000)]
    got = pack(spark.createDataFrame(rows, DOCS).repartition(6), tokenizer_path()).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 4096 + 1


def test_words_are_encoded_as_in_whole_texts_whatever_their_letters():
    w = WordTokenizer(tokenizer_path())
    assert w.by_word
    # Assigned code points but the large blocks of ideographs and syllables, of which every 97th.
    points = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") and (c % 97 == 0 or not 0x3400 <= c < 0xD7A4 and not c >= 0x17000)]
    for form in ("{}", "a{}", "{}a", "a{},", "{}.", "É{}a.,", "{}{}..", "ab,{}", "A{} {}."):
        texts = [form.replace("{}", c) for c in points]
        assert w._by_words(texts, b"") == w._whole(texts, b""), form


def test_random_texts_of_letters_that_lower_casing_parts():
    w, rng = WordTokenizer(tokenizer_path()), random.Random(61)
    some = ["İ", "क़", "ড়", "é", "é", "ß", "ſ", "ǅ", "Σ", "ς", "a", "B", ".", ",", " ", "\n", "ͅ", "1", "'s"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(20_000)]
    assert w._by_words(texts, b"") == w._whole(texts, b"")
