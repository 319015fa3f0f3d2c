"""Token counts by a linear longest-match automaton.

A word (run of non-white-space, with a leading mark) is cut greedily into the longest
pieces of a vocabulary; bytes that no longer piece covers are pieces of their own.  The
automaton is the vocabulary's trie over bytes.  Where a node has no edge for the next
byte, its failure link leads to the node that spells what is left after the pieces that
are certain by then have been popped; how many those are is stored with the link.  So a
word's count takes time linear in its length and no piece is ever built.

Many words go through the automaton at once, one byte per step in numpy, and counts of
words are kept in a bounded table, so a word of the corpus is matched about once a worker.

Defined cases: a null or empty text has 0 tokens; other columns are not read; rows that are
alike count alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table, tidy

MARK = "▁"
#: Words that a worker keeps at most, and characters of one.
CACHE_WORDS, CACHE_CHARS = 200_000, 64

_AUTOMATA: dict[str, "LongestMatch"] = {}


def vocabulary(name: str = "piece_bpe_32k.model") -> list[bytes]:
    """The pieces of a sentencepiece file as bytes, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i).encode() for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class LongestMatch:
    """fail[u], popped[u]: where to go on from u without an edge, and how many pieces that pops; at_end[u]: pieces that u leaves at a word's end."""

    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            u = 0
            for b in piece:
                v = edges[u].get(b)
                if v is None:
                    v = edges[u][b] = len(edges)
                    edges.append({})
                    final.append(False)
                u = v
            final[u] = True
        n = len(edges)
        fail, popped = [0] * n, [0] * n
        queue = deque([0])
        while queue:
            p = queue.popleft()
            for b, u in edges[p].items():
                queue.append(u)
                if final[u]:
                    fail[u], popped[u] = 0, 1
                    continue
                # single bytes are pieces, so a node that isn't one has a parent other than the root
                z, k = fail[p], popped[p]
                while b not in edges[z]:
                    k += popped[z]
                    z = fail[z]
                fail[u], popped[u] = edges[z][b], k
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        at_end = np.zeros(n, np.int32)
        u, todo = self.fail.copy(), np.arange(n)
        at_end += self.popped
        while (u != 0).any():
            at_end += self.popped[u] * (u != 0)
            u = np.where(u != 0, self.fail[u], 0)
        self.at_end = at_end
        pairs = sorted((p << 8 | b, u) for p, e in enumerate(edges) for b, u in e.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([u for _, u in pairs], np.int32)
        self.kept: dict[str, int] = {}

    def _edge(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, -1 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.to[i], -1)

    def lengths(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each word."""
        raw = [(MARK + w).encode(errors="surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])[order]
        size = size[order]
        state, count = np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            at, byte = np.arange(live), data[start[:live] + t]
            while len(at):
                u = state[at]
                v = self._edge(u, byte)
                hit = v >= 0
                state[at[hit]] = v[hit]
                at, byte, u = at[~hit], byte[~hit], u[~hit]
                count[at] += self.popped[u]
                state[at] = self.fail[u]
        count += self.at_end[state] * (state != 0)
        out = np.empty(len(raw), np.int64)
        out[order] = count
        return out

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and words of each text."""
        kept = self.kept
        split = [(t or "").split() for t in texts]
        new = list(set().union(*split) - kept.keys())
        if new:
            counts = dict(zip(new, self.lengths(new).tolist()))
            if len(kept) < CACHE_WORDS:  # words that come often come early
                kept.update((w, n) for w, n in counts.items() if len(w) <= CACHE_CHARS)
                rest = {w: n for w, n in counts.items() if len(w) > CACHE_CHARS}
                kept = {**kept, **rest} if rest else kept
            else:
                kept = {**kept, **counts}
        get = kept.__getitem__
        return [sum(map(get, words)) for words in split], [len(words) for words in split]


def automaton(name: str = "piece_bpe_32k.model") -> LongestMatch:
    if name not in _AUTOMATA:
        _AUTOMATA[name] = LongestMatch(vocabulary(name))
    return _AUTOMATA[name]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, n_words."""

    def run(batches):
        match = automaton(tokenizer)
        for batch in batches:
            tokens, words = match.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "n_tokens", "n_words"])

    d = docs.select(docs["`doc_id`"].cast("long").alias("doc_id"), docs["`text`"].cast("string").alias("text"))
    return batched(d).mapInArrow(tidy(run, lambda: automaton(tokenizer).kept), "doc_id long, n_tokens long, n_words long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens"), F.col("n_words"))
