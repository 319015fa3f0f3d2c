"""N-gram Jaccard self join of documents: MinHash banding, then full n-gram sets.

Texts are sets of word n-grams (lower case, split at white space; a shorter text is one
n-gram of all its words).  Texts that are alike form one node.  Minima of random
permutations are cut into bands; how many bands of how many rows follows from the recall
wanted at the threshold.  Nodes with a band in common are candidates: each bucket links its
nodes to its smallest one, a row per node and not per pair, and the connected components of
these links hold all candidate pairs.  Within a component all pairs are verified on their
full n-gram sets, each pair once, however many bands it shares.  Components of more than
BLOCK nodes or BLOCK_GRAMS n-grams are cut into blocks, and every pair of blocks is a task of
its own; what a task returns is a count per node and a spanning forest, never the pairs.

A document's class is the smallest doc_id of its component of verified links.

Defined cases: a null text counts as empty; a text without words is linked to nothing, so
only copies share its class; null ids are no class ids as long as the class has another;
rows that are alike are copies; an empty table gives an empty table; other columns are not
read.  Texts are told apart by two 64-bit hashes, n-grams by one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, DOCUMENT_COLUMNS, batched, staged, table, tidy
from .components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Permutations that a text may cost at most.
MAX_HASHES = 128
#: Nodes that are compared at a time, and n-grams of a block, or of small components that share a task, about.
BLOCK, BLOCK_GRAMS = 512, 1 << 21
#: Bits of the first hash of a text.
IDENTITY_BITS = 64
#: Words that a worker keeps at most, and characters of one.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
STEP = np.uint64(0x9E3779B97F4A7C15)

_WORD_HASHES: dict[str, int] = {}


def known_words() -> dict[str, int]:
    return _WORD_HASHES


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall at the threshold."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1, 1)
    for rows in range(2, max_hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, one after the other, and the number of each text's."""
    split = [(t or "").lower().split() for t in texts]
    new, digest = set().union(*split) - _WORD_HASHES.keys(), xxhash.xxh64_intdigest
    room = len(_WORD_HASHES) < CACHE_WORDS  # words that come often come early
    if room:
        _WORD_HASHES.update((w, digest(w.encode("utf-8", "surrogatepass"))) for w in new if len(w) <= CACHE_CHARS)
    rest = {w: digest(w.encode("utf-8", "surrogatepass")) for w in new if not room or len(w) > CACHE_CHARS}
    known = {**_WORD_HASHES, **rest} if rest else _WORD_HASHES
    n = np.array([len(w) for w in split], np.int64)
    total = int(n.sum())
    h = np.fromiter((known[w] for ws in split for w in ws), np.uint64, total)
    grams = np.maximum(n - words + 1, np.minimum(n, 1))
    if not total:
        return h, grams
    rolled = h.copy()
    for k in range(1, words):
        rolled[: total - k] = rolled[: total - k] * STEP + h[k:] if k < total else rolled[:0]
    first = np.cumsum(n) - n
    long = n >= words
    parts = np.zeros(int(grams.sum()), np.uint64)
    at = np.cumsum(grams) - grams
    index = np.arange(len(parts)) - np.repeat(at, grams) + np.repeat(first, grams)
    if len(parts):
        parts[:] = rolled[np.minimum(index, total - 1)]
    for i in np.flatnonzero(~long & (n > 0)):  # all words of a short text
        value = int(n[i])
        for x in h[first[i] : first[i] + n[i]].tolist():
            value = (value * int(STEP) + x) % 2**64
        parts[at[i]] = value
    return mixed(parts), grams


def signatures(hashes: np.ndarray, grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """The band hashes (texts x bands) of texts that each have an n-gram."""
    r = np.random.default_rng(seed)
    factors = r.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    adds = r.integers(0, 2**32, bands * rows, dtype=np.uint32)
    starts = np.cumsum(grams) - grams
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(grams), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(grams), band + 1, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            value = (value ^ np.minimum.reduceat(short * factors[j] + adds[j], starts)) * STEP
            value ^= value >> np.uint64(29)
        out[:, band] = mixed(value)
    return out


def in_chunks(texts: list, n_chars: int = 1_500_000):
    """Slices of texts with about so many characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= n_chars:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def linked(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Matrix of the pairs whose Jaccard is the threshold or more.  left: a mask; then only pairs from one side to the other."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    common = np.zeros((m, m), np.float32)
    values, where = np.concatenate(sets), np.repeat(np.arange(m), size.astype(np.int64))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, where = number[column[shared]], where[shared]
    order = np.argsort(column, kind="stable")
    column, where = column[order], where[order]
    width = max(64, min(8192, 8_000_000 // max(1, m)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((m, width), np.float32)
        part[where[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    ok = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    ok &= (size > 0)[:, None] & (size > 0)[None, :]
    np.fill_diagonal(ok, False)
    return ok if left is None else ok & (left[:, None] != left[None, :])


def forest(ok: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches in the graph ok."""
    label = np.arange(len(ok))
    while True:
        low = np.minimum(label, np.where(ok, label[None, :], len(ok)).min(axis=1, initial=len(ok)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, other, n): other is null and n a number of links, or other is a node of the same class."""
    out = []
    for _, part in pdf.drop_duplicates("node").sort_values("node").groupby("root", sort=False):
        nodes = part["node"].to_numpy()
        if len(nodes) < 2:
            continue
        left = (part["blk"] == part["i"]).to_numpy() if (part["i"] != part["j"]).any() else None
        ok = linked([np.frombuffer(s, np.uint64) for s in part["grams"]], threshold, left)
        n = ok.sum(axis=1)
        label = forest(ok)
        out.append(pd.DataFrame({"node": nodes, "other": np.where(label != np.arange(len(nodes)), nodes[label], nodes), "n": n})[n > 0])
    return pd.concat(out) if out else pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, nd_node (hash of the text), class_id, n_links (other texts), n_copies (other rows with the text)."""
    bands, rows = choose_bands(threshold, recall)

    def sign(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            found: list = [None] * len(texts)
            sizes: list[int] = []
            for part in in_chunks(texts):
                hashes, grams = ngram_hashes(texts[part], words)
                some = np.flatnonzero(grams > 0)
                if len(some):
                    sig = signatures(hashes, grams[some], bands, rows).view(np.int64)
                    for i, s in zip(some.tolist(), sig):
                        found[part.start + i] = s
                sizes += grams.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "raw", "second", "n_grams", "bands"])

    text = F.coalesce(docs["`text`"].cast("string"), F.lit(""))
    d = docs.select(docs["`doc_id`"].cast("long").alias("doc_id"), first_hash(text).alias("raw"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("second"))
    sig = staged(batched(d).mapInArrow(tidy(sign, known_words), "doc_id long, raw long, second long, n_grams long, bands array<long>"), "signatures")
    texts = sig.groupBy("raw", "second").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"))
    # a node is a text's first hash; of texts that share it, all but one get a new one from both hashes
    clash = staged(texts.groupBy("raw").agg(F.min("second").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "clashes")
    n_clash = clash.limit(BROADCAST_ROWS + 1).count()

    def named(df: DataFrame) -> DataFrame:
        if not n_clash:
            return df.withColumn("node", F.col("raw"))
        both = df.join(F.broadcast(clash) if n_clash <= BROADCAST_ROWS else clash, "raw", "left")
        return both.withColumn("node", F.when(F.col("second") != F.col("keeps"), F.xxhash64("raw", "second")).otherwise(F.col("raw"))).drop("keeps")

    sig, texts = named(sig), named(texts)
    # copies have the same bands, so the distinct (band, node) are those of the texts
    band = sig.select("node", F.explode("bands").alias("band"))
    low = band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").drop("hi")
    candidates = components(band.join(low, "band").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    held = candidates.join(texts.select("node", "raw", "second", "rep", "n_grams"), "node")
    sizes = held.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_grams").alias("grams"))
    parts = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("grams") / F.lit(BLOCK_GRAMS)))
    sized = held.join(sizes, "root")
    sized = staged(sized.withColumn("parts", F.least(parts, F.col("size")).cast("int")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "candidates")
    n, all_grams = sized.agg(F.count(F.lit(1)), F.sum("n_grams")).first()

    def shingle(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            sets: list[bytes] = []
            for part in in_chunks(texts):
                hashes, grams = ngram_hashes(texts[part], words)
                sets += [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(grams)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "grams"])

    ids = sized.select("node", F.col("raw").alias("of_raw"), F.col("second").alias("of_second"), "rep")
    rep = (F.col("raw") == F.col("of_raw")) & (F.col("second") == F.col("of_second")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    chosen = d.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, rep)
    grams = chosen.select("node", "text").mapInArrow(tidy(shingle, known_words), "node long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    few = F.lit(max(1, (all_grams or 0) // BLOCK_GRAMS))
    tasks = sized.select("root", "node", "blk", "parts", other.alias("o")).select(
        "root", "node", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), few)).otherwise(F.col("root")).alias("grp"), (F.col("parts") > 1).alias("big"),
    )
    found = grams.join(tasks, "node").groupBy("grp", "big", "i", "j").applyInPandas(lambda pdf: verified(pdf, threshold), "node long, other long, n long")
    found = staged(found, "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    classed = texts.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classed = classed.join(least, "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return sig.select("doc_id", "raw", "node").join(classed, "node").select("doc_id", F.col("raw").alias("nd_node"), "class_id", "n_links", "n_copies")


def first_hash(text: Column) -> Column:
    h = F.xxhash64(text)
    return h if IDENTITY_BITS == 64 else F.pmod(h, F.lit(1 << IDENTITY_BITS))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: that with the smallest doc_id, and text hash among those.

    Null ids come last; of rows alike in both, one stays.
    """
    near = near_duplicates(docs)
    # a class without any id is told apart by its texts, whose copies alone then share it
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "nd_node")
    group = F.when(F.col("class_id").isNull(), F.col("nd_node"))
    kept = near.groupBy("class_id", group.alias("g")).agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("kept_id"), F.col("o.nd_node").alias("kept_node"))
    kept = staged(kept, "kept")
    few = kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    d = docs.select(*[docs[f"`{c}`"] for c in DOCUMENT_COLUMNS]).withColumn("nd_node", first_hash(F.coalesce("text", F.lit(""))))
    on = (F.col("nd_node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    rows = d.join(F.broadcast(kept) if few else kept, on, "left_semi")
    twice = staged(near.groupBy("doc_id", "nd_node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id"), F.col("nd_node").alias("twice_node")), "twice")
    on = (F.col("nd_node") == F.col("twice_node")) & F.col("doc_id").eqNullSafe(F.col("twice_id"))
    few = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(twice) if few else twice, on, "left")
    single = marked.where("twice_node IS NULL").select(*DOCUMENT_COLUMNS)
    several = marked.where("twice_node IS NOT NULL").groupBy("doc_id", "nd_node").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return single.unionByName(several.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY text) AS node, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT node, count(*) AS n FROM g GROUP BY node),
l AS (SELECT x.node AS a, y.node AS b FROM g x JOIN g y ON x.gram = y.gram AND x.node <> y.node
      JOIN n p ON p.node = x.node JOIN n q ON q.node = y.node
      GROUP BY x.node, y.node, p.n, q.n HAVING count(*) >= 0.8 * (p.n + q.n - count(*))),
t AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY text) AS node, count(*) OVER (PARTITION BY text) AS copies, text FROM d),
reach AS (SELECT node, node AS other FROM t UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
k AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, CAST(t.copies - 1 AS BIGINT) AS n_copies
FROM d JOIN t ON t.text = d.text JOIN c ON c.node = t.node LEFT JOIN k ON k.node = t.node
"""
