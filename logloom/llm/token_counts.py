"""Greedy longest-match token counts by one linear pass over an automaton.

The vocabulary's trie gets failure links, as in string matching, and for each node the number of
tokens that following its link pops. A word's token count is then a walk with sums: no piece is
built, and no character is read twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Symbol after a word's last byte.
END = 256
#: Words whose counts a worker keeps at most.
CACHE_WORDS = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Symbol strings of a byte-level vocabulary; the end mark becomes END. Special tokens are left out."""
    data = json.load(open(path, encoding="utf-8"))
    symbols, special = byte_symbols(), {t["content"] for t in data["added_tokens"]}
    out = []
    for token in data["model"]["vocab"]:
        if token not in special:
            body = token.removesuffix(end_mark)
            out.append(tuple(symbols[c] for c in body) + ((END,) if body != token else ()))
    return out


def marked(symbols: Iterable[int]) -> tuple[int, ...]:
    """Last byte and END as one symbol, so that no piece takes a word's last byte and leaves its end behind."""
    *body, last = symbols
    return (*body[:-1], END + 1 + body[-1]) if last == END and body else (*body, last)


class Automaton:
    """Trie over symbols; go[node][symbol], fail[node], popped[node]. Node 0 is the root, -1 is none."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        go: list[dict[int, int]] = [{}]
        token = [False]
        for t in tokens:
            node = 0
            for s in t:
                if s not in go[node]:
                    go[node][s] = len(go)
                    go.append({})
                    token.append(False)
                node = go[node][s]
            token[node] = node != 0
        fail, popped = [-1] * len(go), [0] * len(go)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in go[u].items():
                if token[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    z, n = fail[u], popped[u]
                    while z != -1 and s not in go[z]:
                        n += popped[z]
                        z = fail[z]
                    if z != -1:
                        fail[v], popped[v] = go[z][s], n
                queue.append(v)
        self.go, self.fail, self.popped = go, fail, popped

    def count(self, symbols: Iterator[int] | bytes) -> int:
        """Tokens of a word by greedy longest match; a word that the vocabulary can't spell is one token."""
        go, fail, popped, node, n = self.go, self.fail, self.popped, 0, 0
        for s in symbols:
            while s not in go[node]:
                n += popped[node]
                node = fail[node]
                if node == -1:
                    return 1
            node = go[node][s]
        while node:
            n += popped[node]
            node = fail[node]
            if node == -1:
                return 1
        return n


_AUTOMATA: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_words long, n_tokens long of each row.

    Words are maximal runs of characters other than blank and \\x09-\\x0D, A-Z lower-cased; each is
    cut greedily into the longest tokens of a byte-level vocabulary with word ends; a word's last byte
    is matched together with its end, so a vocabulary of all bytes spells every word. Null and empty
    texts have none. Null ids and repeated rows keep their rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _AUTOMATA:
            _AUTOMATA[tokenizer_path] = Automaton([marked(t) for t in vocabulary(tokenizer_path)]), {}
        automaton, known = _AUTOMATA[tokenizer_path]
        for batch in batches:
            words, tokens = [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    split = (text or b"").lower().split()
                    for w in set(split):
                        if w not in known:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                                for x in set(split):
                                    known[x] = automaton.count(marked((*x, END)))
                            known[w] = automaton.count(marked((*w, END)))
                    words.append(len(split))
                    tokens.append(sum(map(known.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(docs[id_col], docs[text_col].cast("binary")).mapInArrow(run, schema)
