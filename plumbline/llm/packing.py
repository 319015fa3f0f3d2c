"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A document's tokens are its byte-level BPE ids and one end id.  Only documents longer
than a sequence are cut, from the end, into full pieces, so the first piece may be
shorter.  A bin is filled greedily: the longest piece left, then again and again the
longest that fits.  Then the bin's smallest piece gives way to two pieces that are not
yet packed if together they fill the expanded gap more tightly.

Lengths are all that packing needs, so the plan is made on the histogram of lengths (at
most ``capacity`` counts, whatever the number of documents): a bin's pattern of lengths is
used as often as the counts allow, which uses up one length or more.  Pieces get their
places by their rank within their length; ranks come from counts by (length, bucket) and a
row number within that pair, so a length with a third of all pieces is spread out.

Defined cases: a null or empty text is the end id alone; rows that are alike are packed
each on its own; null ids are kept; an empty table gives an empty table; other columns are
not read.  The string of a special token in a text becomes that token's id.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, staged, table, tidy

CAPACITY = 1024
END_ID = 2
#: Rows that share a bucket of one length, about.
BUCKET_ROWS = 50_000
#: Words that a worker keeps at most, and characters of one.
CACHE_WORDS, CACHE_CHARS = 400_000, 64

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of byte_bpe_50k.  What stands between two spaces is encoded once, with the space before it, and kept.

    A token of the pre-tokenizer never crosses a space that something other than white space
    follows, so these parts can be encoded one by one; texts with other spaces are split by
    the pre-tokenizer's own pattern.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.word_ids = self._twin(public_tokenizers, name) or self._ids_of
        self.kept: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _twin(self, public_tokenizers, name: str):
        """The same vocabulary as a rank file, which takes a third of the time a word; only if it gives the same ids for a sample."""
        path = public_tokenizers.path(name.replace(".json", ".tiktoken"))
        if not name.endswith(".json") or not os.path.exists(path):
            return None
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        twin = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        words = sorted(self.tokenizer.get_vocab())[::25]
        sample = [f" {a}{b}" for a, b in zip(words, reversed(words))]
        return twin if all(twin(w) == self._ids_of(w) for w in sample) else None

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.specials):
            return array("I", self._ids_of(text)).tobytes()
        first, *rest = text.split(" ")
        spaced, word_ids = self.spaced, self.word_ids
        try:
            return self._by_words(first) + b"".join(map(spaced.__getitem__, rest))
        except KeyError:
            pass
        parts = list(map(spaced.get, rest))
        for i, ids in enumerate(parts):
            if ids is None:
                w = rest[i]
                if not w or w[0].isspace():
                    return self._by_words(text)
                if w.isalpha():  # one word, without the pattern
                    ids = array("I", word_ids(" " + w)).tobytes()
                elif w[-1] in ".," and (core := w[:-1]).isalpha():
                    ids = (spaced.get(core) or array("I", word_ids(" " + core)).tobytes()) + self._word(w[-1])
                else:
                    ids = self._by_words(" " + w)
                parts[i] = ids
                if len(spaced) < CACHE_WORDS and len(w) <= CACHE_CHARS:  # words that come often come early
                    spaced[w] = ids
        return self._by_words(first) + b"".join(parts)

    def _by_words(self, text: str) -> bytes:
        return b"".join(map(self._word, self.words(text)))

    def _word(self, word: str) -> bytes:
        got = self.kept.get(word)
        if got is None:
            got = array("I", self.word_ids(word)).tobytes()
            if len(self.kept) < CACHE_WORDS and len(word) <= CACHE_CHARS:
                self.kept[word] = got
        return got


def encoders() -> dict[str, Encoder]:
    return _ENCODERS


def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as packed bytes)."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity if n > capacity else n
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(part), part if with_ids else b"")):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    d = docs.select(docs["`doc_id`"].cast("long").alias("doc_id"), docs["`text`"].cast("string").alias("text"))
    out = batched(d).mapInArrow(tidy(run, encoders), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), by best-two-fit on a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    top = capacity
    while top > 0:
        if not left[top]:
            top -= 1
            continue
        used: list[int] = []
        gap, limit = capacity, top
        while gap > 0:
            fits = np.flatnonzero(left[1 : min(gap, limit) + 1])
            if not len(fits):
                break
            limit = int(fits[-1]) + 1
            k = min(int(left[limit]), gap // limit)
            used += [limit] * k
            left[limit] -= k
            gap -= k * limit
            limit -= 1
        if gap and len(used) > 1:
            small = used[-1]
            a, b = _best_two(left, gap + small)
            if a + b > small:
                used[-1:] = [a, b]
                left[a] -= 1
                left[b] -= 1
                left[small] += 1
        kinds, k = np.unique(used, return_counts=True)
        more = int((left[kinds] // k).min())
        left[kinds] -= more * k
        plan.append((used, more + 1))
    return plan


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths that are left, with the largest sum of at most room; (0, 0) if there are none."""
    have = np.flatnonzero(left[: room + 1] > 0)
    have = have[have > 0]
    best = (0, 0)
    if len(have):
        other = np.searchsorted(have, room - have, "right") - 1
        ok = other >= 0
        a, b = have[ok], have[other[ok]]
        alone = (a == b) & (left[a] < 2)
        if alone.any():  # the next smaller one stands in for a second that isn't there
            lower = other[ok] - 1
            b = np.where(alone, np.where(lower >= 0, have[np.maximum(lower, 0)], 0), b)
        total = np.where(b > 0, a + b, 0)
        if len(total) and total.max() > 0:
            i = int(total.argmax())
            best = (int(a[i]), int(b[i]))
    return best


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset.  pieces must be staged: it is read three times."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows, first = [], 0
    start = dict.fromkeys(counts, 0)
    for lengths, n in plan_bins(counts, capacity):
        at = 0
        for x in sorted(lengths, reverse=True):
            rows.append((x, start[x], first, at))
            start[x] += n
            at += x
        first += n
    rows.sort()
    slots = np.array(rows, np.int64).reshape(-1, 4)
    lo_of = np.searchsorted(slots[:, 0], np.arange(capacity + 2))

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "pk_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                part = slots[lo_of[x] : lo_of[x + 1]]
                i = np.searchsorted(part[:, 1], rank[mine], "right") - 1
                seq[mine], off[mine] = part[i, 2] + rank[mine] - part[i, 1], part[i, 3]
            keep = [i for i, c in enumerate(b.schema.names) if c != "pk_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq), pa.array(off)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    buckets = max(4, max(counts.values(), default=0) // BUCKET_ROWS + 1)
    p = pieces.withColumn("pk_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    key = ["length", "pk_bucket"]
    before = Window.partitionBy("length").orderBy("pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy(*key).agg(F.count(F.lit(1)).alias("pk_n")).select(*key, F.coalesce(F.sum("pk_n").over(before), F.lit(0)).alias("pk_before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = p.withColumn("pk_row", rank).join(base, key).withColumn("pk_rank", F.col("pk_before") + F.col("pk_row") - 1)
    ranked = ranked.select(*pieces.columns, "pk_rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    return placed(staged(token_pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces"), capacity)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
