"""Removal of byte strings that occur more than once, with suffix arrays per shard.

A byte goes if some string of WIDTH bytes that covers it also starts anywhere else, in the
same document or another; strings never cross documents.

Every window of WIDTH bytes has one anchor: its smallest hash of GRAM bytes, the last one
among equals.  Alike windows have alike anchors at the same place, so only windows whose
anchor value occurs twice can repeat, and only those are sorted.  A run of windows with one
anchor is a segment; of segments that are alike as a whole, two are sorted, and what is
found of them holds for all.  Where segments that alone have their anchor value follow one
another in both places, they are sorted as one piece, since next to one another they share
all but a few of their bytes.  All segments of an anchor value meet in a shard, which builds
the suffix array of its segments and marks the windows that have WIDTH bytes in common with
a neighbour.  An anchor value with more than BLOCK segments is cut into shards of its own;
each pair of them is merged by binary search of the windows of one in the array of the
other.  Nothing is removed that the arrays did not mark.

Defined cases: a null text is empty; texts shorter than WIDTH lose nothing; copies of a long
enough text are removed all of them; rows that are alike are copies; an empty table gives an
empty table; other columns are not read.  Segments count as alike by 64-bit hashes of each
and of its anchor, so by 128 bits together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, staged, table, tidy
from .ngram_join import mixed
from .suffix_array import common_prefixes, found_in, suffix_array

WIDTH, GRAM = 200, 48
SLICE_BYTES, CHUNK_BYTES = 1 << 18, 1 << 23
#: Segments of one anchor value that share a shard, and bytes of segments in a shard, about.
BLOCK, SHARD_BYTES = 2048, 1 << 20
#: Bytes up to which segments that follow one another in both of their places are sorted as one piece.
PIECE_BYTES = 1024

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
POSITIONS = np.uint64((1 << 24) - 1)

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, BACK)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return [p[:n] for p in _POWERS]


def anchored(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(piece, start, length, span, count, anchor, content) of the segments of pieces of text that are next to each other.

    Alike segments that follow one another at once are one row: length is that of the first,
    span reaches to the end of the last.
    """
    n = len(text)
    power, back = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[text] * power[:n], out=total[1:])
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    grams = mixed((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    m = (grams & ~POSITIONS) | (POSITIONS - np.arange(len(grams), dtype=np.uint64))
    want, have = width - gram + 1, 1
    while 2 * have <= want:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < want:
        m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
    anchor_at = (POSITIONS - (m & POSITIONS)).astype(np.int64)
    piece = np.searchsorted(starts, np.arange(len(m)), "right") - 1
    valid = np.arange(len(m)) + width <= ends[piece]
    w = np.flatnonzero(valid)
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    a = anchor_at[w]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (np.diff(w) != 1)))
    last = np.append(first[1:], len(w)) - 1
    start, end = w[first], w[last] + width
    anchor = grams[a[first]]
    content = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * BASE)
    which = piece[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (which[1:] != which[:-1]) | (start[1:] != end[:-1] - width + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    return which[head], start[head] - starts[which[head]], (end - start)[head], end[tail] - start[head], tail - head + 1, anchor[head].view(np.int64), content[head].view(np.int64)


SEGMENT = pa.schema([("ref", pa.int64()), ("n_bytes", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("span", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])


def _segments(batches):
    """Rows of SEGMENT.  A task gives the segments of a text twice at most: whether there are more copies makes no difference."""
    seen: dict[tuple[int, int], int] = {}
    for b in batches:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for ref, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) < WIDTH:
                continue
            times = seen[ref, len(raw)] = seen.get((ref, len(raw)), 0) + 1
            if times > 2:
                continue
            for a in range(0, max(1, len(raw) - WIDTH + 1), CHUNK_BYTES):
                part = raw[a : a + CHUNK_BYTES + WIDTH - 1] if len(raw) > CHUNK_BYTES else raw
                held.append((ref, len(raw), a, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    yield _segment_batch(held)
                    held, size = [], 0
        if held:
            yield _segment_batch(held)


def _segment_batch(held) -> pa.RecordBatch:
    ref, n_bytes, at, parts = zip(*held)
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    which, start, length, span, n, anchor, content = anchored(np.frombuffer(b"".join(parts), np.uint8), ends - size, ends)
    columns = (np.array(ref)[which], np.array(n_bytes)[which], start + np.array(at)[which], length, span, n, anchor, content)
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, SEGMENT)], schema=SEGMENT)


def repeated_windows(pdf: pd.DataFrame, width: int = WIDTH) -> pd.DataFrame:
    """(anchor, content, at, marked): runs of bytes that repeat in the segments of a shard, or between two shards of one anchor value.

    A row of pdf is a piece of one or more segments; kinds has the anchor, content and length of each.
    """
    pdf = pdf.drop_duplicates(["anchor", "content", "copy"]).reset_index(drop=True)
    between = bool((pdf["i"] != pdf["j"]).any())
    sides = [pdf[pdf["blk"] == pdf["i"]], pdf[pdf["blk"] == pdf["j"]]] if between else [pdf]
    made = []
    for side in sides:
        size = np.array([len(s) for s in side["seg"]], np.int64)
        text = np.frombuffer(b"".join(side["seg"]), np.uint8)
        edge = np.cumsum(size)
        ends = np.repeat(edge, size)
        depth = 256 if between else int(size.max(initial=0))  # prefixes are carried from suffix to suffix in full order only
        made.append((side, text, edge - size, ends, suffix_array(text, ends, depth)))
    out = []
    for k, (side, text, starts, ends, sa) in enumerate(made):
        n = len(text)
        whole = np.flatnonzero(ends - np.arange(n) >= width)
        mark = np.zeros(n + 1, bool)
        if between:
            _, text2, _, ends2, sa2 = made[1 - k]
            mark[whole[found_in(text2, ends2, sa2, text, whole, width)]] = True
        else:
            lcp = common_prefixes(text, starts, ends, sa, width, width)
            alike = np.flatnonzero(lcp >= width)
            mark[sa[alike]] = True
            mark[sa[alike - 1]] = True
        one = np.flatnonzero(side["copy"].to_numpy() == 0)
        if not len(one):
            continue
        kinds = [side["kinds"].iloc[k] for k in one]
        n_kinds = np.array([len(k) for k in kinds]) // 24
        kind = np.frombuffer(b"".join(kinds), np.int64).reshape(-1, 3)
        n_windows = kind[:, 2] - width + 1
        before = np.cumsum(n_windows) - n_windows
        begin = before + np.repeat(starts[one] - before[np.cumsum(n_kinds) - n_kinds], n_kinds)
        which = np.repeat(np.arange(len(kind)), n_windows)
        at = np.arange(len(which)) + (begin - before)[which]
        hit = np.flatnonzero(mark[at])
        if not len(hit):
            continue
        at, which = at[hit], which[hit]
        first = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(which) != 0)))
        last = np.append(first[1:], len(hit)) - 1
        of = which[first]
        out.append(pd.DataFrame({"anchor": kind[of, 0], "content": kind[of, 1], "at": at[first] - begin[of], "marked": at[last] - at[first] + width}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor", "content", "at", "marked")})


def _pieces(wanted: list) -> list[list]:
    """A text's segments, together those that are sorted as one piece."""
    out: list[list] = []
    for w in sorted(wanted, key=lambda w: (w["copy"], w["start"])):
        last = out[-1][-1] if out else None
        if last and w["alone"] and last["alone"] and w["copy"] == last["copy"] and w["other"] == last["other"] and w["other_bytes"] == last["other_bytes"]:
            step = last["length"] - WIDTH + 1
            if w["start"] == last["start"] + step and w["other_start"] == last["other_start"] + step and w["start"] + w["length"] - out[-1][0]["start"] <= PIECE_BYTES:
                out[-1].append(w)
                continue
        out.append([w])
    return out


def _cut(batches):
    """The bytes of the pieces that are listed with a text; copies of a text have the same ones, so a task cuts them once."""
    names = ["anchor", "content", "copy", "pieces", "kinds", "seg"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    seen: set[tuple[int, int]] = set()
    for b in batches:
        for a in range(0, b.num_rows, 500):
            part = b.slice(a, 500)
            rows = []
            for _, ref, n_bytes, text, wanted in zip(*(part.column(i).to_pylist() for i in range(5))):
                if (ref, n_bytes) in seen:
                    continue
                seen.add((ref, n_bytes))
                raw = text.encode("utf-8", "surrogatepass")
                for ws in _pieces(wanted):
                    w, end = ws[0], ws[-1]["start"] + ws[-1]["length"]
                    kinds = np.array([(x["anchor"], x["content"], x["length"]) for x in ws], np.int64).tobytes()
                    rows.append((w["anchor"], w["content"], w["copy"], w["pieces"], kinds, raw[w["start"] : end]))
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, end) without overlap or touch, from (start, length)."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, and spans)."""
    text = F.coalesce(docs["`text`"].cast("string"), F.lit(""))
    d = docs.select(docs["`doc_id`"].cast("long").alias("doc_id"), F.xxhash64(text).alias("ref"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    fields = "ref long, n_bytes long, start long, length int, span int, n int, anchor long, content long"
    segments = staged(batched(d).where(F.col("n_bytes") >= WIDTH).select("ref", "text").mapInArrow(tidy(_segments), fields), "segments")
    twice = segments.groupBy("anchor").agg(F.sum("n").alias("t")).where("t > 1").select("anchor")
    shared = staged(segments.join(twice, "anchor"), "shared")
    place = F.struct("ref", "n_bytes", "start", "length", "n")
    kinds = shared.groupBy("anchor", "content").agg(F.sum("n").alias("times"), F.min(place).alias("one"), F.max(place).alias("two"))
    kinds = staged(kinds, "kinds")
    pieces = kinds.groupBy("anchor").agg(F.sum(F.least("times", F.lit(2))).alias("pieces"))
    # of segments that follow one another at once, the second begins where the windows of the first are over
    next_start = F.col("two.start") + F.when((F.col("one") == F.col("two")) & (F.col("two.n") > 1), F.col("two.length") - F.lit(WIDTH - 1)).otherwise(0)
    one = [F.col("one.ref"), F.col("one.n_bytes"), F.col("one.start")]
    two = [F.col("two.ref"), F.col("two.n_bytes"), next_start]
    segment = lambda copy, own, other, length: F.struct(F.lit(copy).alias("copy"), *[x.alias(c) for x, c in zip([*own, *other, length], ("ref", "n_bytes", "start", "other", "other_bytes", "other_start", "length"))])
    first, second = segment(0, one, two, F.col("one.length")), segment(1, two, one, F.col("two.length"))
    both = F.explode(F.when(F.col("times") > 1, F.array(first, second)).otherwise(F.array(first)))
    alone = (F.col("times") > 1) & (F.col("pieces") == 2) & (F.col("one.n") == 1) & (F.col("two.n") == 1)
    listed = kinds.join(pieces, "anchor").select("anchor", "content", "pieces", alone.alias("alone"), both.alias("s"))
    listed = listed.select("s.ref", "s.n_bytes", F.struct("anchor", "content", "s.copy", "pieces", "alone", "s.start", "s.length", "s.other", "s.other_bytes", "s.other_start").alias("w"))
    listed = staged(listed, "listed")
    n_bytes = listed.agg(F.sum(F.when(F.col("w.alone"), F.col("w.length") - F.lit(WIDTH - 1)).otherwise(F.col("w.length")))).first()[0] or 0
    wanted = listed.groupBy("ref", "n_bytes").agg(F.collect_list("w").alias("wanted"))  # a text's own segments
    # doc_id comes along so that both joins with the texts have the same shuffle of them, which Spark then does once
    cut = d.join(wanted, ["ref", "n_bytes"]).select("doc_id", "ref", "n_bytes", "text", "wanted").mapInArrow(tidy(_cut), "anchor long, content long, copy int, pieces long, kinds binary, seg binary")
    parts = F.ceil(F.col("pieces") / F.lit(BLOCK)).cast("int")
    cut = cut.withColumn("parts", parts).withColumn("blk", F.pmod(F.xxhash64("content", "copy"), F.col("parts")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shards = F.lit(max(1, n_bytes // SHARD_BYTES))
    cut = cut.select("anchor", "content", "copy", "kinds", "seg", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), F.when(F.col("parts") == 1, F.pmod(F.xxhash64("anchor"), shards)).otherwise(F.col("anchor")).alias("grp"), (F.col("parts") > 1).alias("big"))
    marks = cut.groupBy("grp", "big", "i", "j").applyInPandas(lambda pdf: repeated_windows(pdf), "anchor long, content long, at long, marked long")
    # a run of segments that are alike is marked from its beginning to its end, since each of them is whole
    many = F.col("n") > 1
    run = F.struct(F.when(many, F.col("start")).otherwise(F.col("start") + F.col("at")).alias("start"), F.when(many, F.col("span")).otherwise(F.col("marked")).cast("long").alias("span"))
    gone = shared.join(marks, ["anchor", "content"]).select("ref", "n_bytes", run.alias("s")).groupBy("ref", "n_bytes").agg(F.collect_set("s").alias("spans"))

    def finish(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                drop = merged_spans([(s["start"], s["span"]) for s in spans or ()])
                edges = [0, *(x for s in drop for x in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(drop), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, [x for s in drop for x in s] if with_kept else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    out = d.join(gone, ["ref", "n_bytes"], "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")
    return out if with_kept else out.drop("kept", "spans")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
