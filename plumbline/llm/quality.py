"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Trusted text is the documents labelled with quality 1; a fifth of them, by a hash of the
id, is held out.  A model for each language counts n-grams of symbols in the rest: bytes,
an end symbol, and for a run of words that only repeat the word before them one symbol that
tells about how long the run is (else loops, being easy to predict, would pass as fluent).
Tasks count what they read, and counts, continuation counts, discounts (from counts of
counts) and back-off weights come from joins and sums that are sharded by language and
n-gram.

Scoring joins too, so nothing of the model or the texts goes through the driver.  Texts are
dealt into blocks of about BLOCK_BYTES.  A block asks for each n-gram that it has, once; the
n-grams asked for meet the model in shards of about MODEL_ROWS n-grams, by a hash of the two
symbols before the last one (all that an n-gram's back-off needs has them too, but for pairs
and single symbols, which every shard has).  A shard answers blocks in groups, so no task
has all of them.  The answers join their blocks, where losses are summed by document.

A document's mean loss, less an allowance for short texts, whose mean scatters, is compared
with its language's threshold.  That is made of quantiles of the held-out documents: the
language's median, and beyond it its way to the 85 % quantile, drawn out as far as the TAIL
quantile of all held-out documents lies when each is measured by its own language's way.
Languages with few documents borrow from the others for that way, the fewer the more.
A language with less than LEAST_HELD held-out documents, but with trusted ones, is judged by a
model and a threshold of all trusted text.

Defined cases: a null or empty text, and a language without any trusted document (null is a
language of its own), cannot be judged and stay; any character may be in a text, NUL too;
labels may repeat, disagree (the lowest quality counts) or be null; ids that repeat share
their label; an empty table gives an empty table; other columns are carried along, whatever
their names.  The table that is judged must read alike twice, as files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, DOCUMENT_COLUMNS, batched, keep_ids, staged, table, tidy

ORDER = 5
#: Symbols: bytes, then before the beginning, the end, and runs of 1, 2, 3, 4 to 6, 7 to 12, ... repeated words up to the last one.
PAD, END, REPEAT, LAST_REPEAT = 256, 257, 258, 265
ALPHABET = 266
#: Bits of a symbol in an n-gram's code.
BITS = 9
HELD_OUT = 5
LEAST_HELD = 5
#: Quantiles of held-out documents, the weight of the other languages in documents, and the allowance for short texts.
MID, HIGH, TAIL = 0.5, 0.85, 0.995
BORROWED, SHORT = 20.0, 2.5
MODEL_ROWS = 2_000_000
#: Bytes of text in a block, blocks that a shard answers in one task, and bytes that are dealt at a time.
BLOCK_BYTES, BLOCK_GROUP, CHUNK_BYTES = 1 << 24, 32, 1 << 20
SLICE_BYTES, BATCH_ROWS = 1 << 18, 2000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The model of all trusted text.
POOLED = "*"

_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(2 * n, BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def symbols(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first one of each text): PAD (order - 1 times), the text with its runs of repeated words put short, END."""
    size = np.array([len(t) for t in texts], np.int64) + order
    end = np.cumsum(size)
    start = end - size
    a = np.frombuffer(b"".join(x for t in texts for x in (bytes(order - 1), t, b"\n")), np.uint8).astype(np.uint16)
    a[(start[:, None] + np.arange(order - 1)).ravel()] = PAD
    a[end - 1] = END
    gap = np.flatnonzero((a <= 32) | (a == END))
    if len(gap) < 2:
        return a, start
    size = np.diff(gap) - 1
    same = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0))
    if not len(same):
        return a, start
    power = _powers(len(a))
    total = np.concatenate([[np.uint64(0)], np.cumsum(a * power)])
    one, two, three = gap[same], gap[same + 1], gap[same + 2]  # the gaps around a word and the one before it
    alike = same[(total[two] - total[one + 1]) * power[two - one] == total[three] - total[two + 1]]
    if not len(alike):
        return a, start
    run = np.flatnonzero(np.append(True, np.diff(alike) > 1))
    length = np.diff(np.append(run, len(alike)))
    first, last = gap[alike[run] + 1] + 1, gap[alike[run] + length + 1]
    kind = np.where(length <= 3, length, 4 + np.log2(length / 3.0001).astype(np.int64))
    a[first] = np.minimum(REPEAT - 1 + kind, LAST_REPEAT)
    drop = np.zeros(len(a) + 1, np.int8)
    drop[first + 1] += 1
    drop[last] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return a[kept], (np.cumsum(kept) - 1)[start]


def codes(a: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each symbol, as an integer with the last symbol lowest; PADs have none."""
    c = a.astype(np.int64)
    for k in range(1, order):
        c[k:] |= a[:-k].astype(np.int64) << (BITS * k)
    return c[a != PAD]


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(texts: list[bytes], which: np.ndarray):
    """Groups of the numbers in which, with texts of about SLICE_BYTES together."""
    group, size = [], 0
    for i in which.tolist():
        group.append(i)
        size += len(texts[i])
        if size >= SLICE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _by_key(column) -> list[tuple[str, np.ndarray]]:
    """(key, rows) of each key but null."""
    keys = np.array(column.to_pylist(), object)
    return [(x, np.flatnonzero(keys == x)) for x in sorted({x for x in keys.tolist() if x is not None})]


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n) over the texts of docs (text, lang), null languages left out: summed in each task, then by n-gram."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> None:
            c, n = (np.concatenate(x) for x in zip(*held[lang]))
            c, back = np.unique(c, return_inverse=True)
            held[lang] = [(c, np.bincount(back, n).astype(np.int64))]

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                texts = _texts(b.column(0))
                for lang, which in _by_key(b.column(1)):
                    for group in _slices(texts, which):
                        held.setdefault(lang, []).append(np.unique(codes(symbols([texts[i] for i in group], order)[0], order), return_counts=True))
                        if len(held[lang]) >= 16:
                            merged(lang)
        for lang in held:
            merged(lang)
            c, n = held[lang][0]
            for k in range(0, len(c), 100_000):
                part = c[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[k : k + 100_000])], ["lang", "code", "n"])

    return batched(docs.select("text", "lang")).mapInArrow(tidy(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, code, kind, value): kind a has what is left of an n-gram's probability after its discount, kind g a context's back-off weight (size: its own length)."""
    parts, cur = [], counts
    few = counts.select("lang").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for size in range(order, 0, -1):  # each order is staged, which keeps the plans small
        n = F.col("n")
        of = cur.groupBy("lang").agg(*[F.count(F.when(n == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # where counts of counts are too few for the estimate, half of the count
        found = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(i / 2.0)) for i in (1, 2, 3)]
        of = of.select("lang", *[x.alias(f"d{i}") for i, x in enumerate(found, 1)])
        off = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = cur.join(F.broadcast(of) if few else of, "lang").select("lang", "code", F.shiftright("code", BITS).alias("ctx"), "n", off.alias("off"))
        ctx = rows.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("off").alias("taken"))
        grams = rows.join(ctx, ["lang", "ctx"]).select("lang", F.lit(size).alias("size"), "code", F.lit("a").alias("kind"), ((n - F.col("off")) / F.col("total")).alias("value"))
        weights = ctx.select("lang", F.lit(size - 1).alias("size"), F.col("ctx").alias("code"), F.lit("g").alias("kind"), (F.col("taken") / F.col("total")).alias("value"))
        parts.append(staged(grams.unionByName(weights), f"model-{size}"))
        if size > 1:
            cur = cur.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
            cur = staged(cur, f"ngrams-{size - 1}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Table:
    """Integers to doubles, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 1.4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        self.mask = (1 << bits) - 1
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            _, first = np.unique(slot[todo], return_index=True)
            won = todo[first]
            won = won[self.keys[slot[won]] == -1]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slots(self, q: np.ndarray) -> np.ndarray:
        return ((q.astype(np.uint64) * BASE) >> self.shift).astype(np.int64)

    def get(self, q: np.ndarray, default: float) -> np.ndarray:
        slot = self._slots(q)
        there = self.keys[slot]
        out = self.values[slot].astype(np.float64)
        bad = np.flatnonzero(there != q)
        out[bad] = default
        bad = bad[there[bad] != -1]
        while len(bad):
            slot = (slot[bad] + 1) & self.mask if len(slot) != len(bad) else (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == q[bad]
            out[bad[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            bad, slot = bad[on], slot[on]
        return out


class Model:
    """Losses (negative log probabilities) of one language's n-grams: those of one shard, or all."""

    def __init__(self, size: np.ndarray, code: np.ndarray, is_gram: np.ndarray, value: np.ndarray, order: int = ORDER):
        self.order = order
        known, weight = {}, {}
        for k in range(order + 1):
            mine = (size == k) & is_gram
            known[k] = (code[mine], value[mine])
            mine = (size == k) & ~is_gram
            weight[k] = (code[mine], value[mine])
        rest = float(weight[0][1][0]) if len(weight[0][1]) else 1.0
        self.unseen = -np.log(rest / ALPHABET)  # a symbol that trusted text never has
        self.backoff = {k: Table(c, -np.log(np.maximum(v, 1e-12))) for k, (c, v) in weight.items() if k}
        self.loss = {}
        for k in range(1, order + 1):
            c, v = known[k]
            if k == 1:
                p = v + rest / ALPHABET
            else:
                lower = np.exp(-self.loss[k - 1].get(c & ((1 << BITS * (k - 1)) - 1), self.unseen))
                p = v + np.exp(-self.backoff[k - 1].get(c >> BITS, 0.0)) * lower
            self.loss[k] = Table(c, -np.log(p))

    def losses(self, c: np.ndarray) -> np.ndarray:
        out = self.loss[self.order].get(c, np.nan)
        todo = np.flatnonzero(np.isnan(out))
        if len(todo):
            q, total = c[todo], np.zeros(len(todo))
            live = np.arange(len(todo))
            for k in range(self.order - 1, 0, -1):
                total[live] += self.backoff[k].get(q[live] >> BITS, 0.0)
                q = q & ((1 << BITS * k) - 1)
                found = self.loss[k].get(q[live], np.nan if k > 1 else self.unseen)
                hit = ~np.isnan(found)
                total[live[hit]] += found[hit]
                live = live[~hit]
            out[todo] = total
        return out


def _shard_of(code, n: int):
    """The shard of an n-gram by the two symbols before its last one; a number or an array."""
    return ((code >> BITS & (1 << 2 * BITS) - 1) * 2654435761 >> 16) % n


def shards(model: DataFrame, n: int) -> DataFrame:
    """(key, shard, model): a language's n-grams of a shard, packed."""
    two = F.lit((1 << 2 * BITS) - 1)
    before = F.when(F.col("kind") == "a", F.shiftright("code", BITS)).otherwise(F.col("code")).bitwiseAND(two)
    own = F.pmod(F.shiftright(before * F.lit(2654435761), 16), F.lit(n))
    # n-grams of less than three symbols and contexts of less than two
    everywhere = F.col("size") < F.when(F.col("kind") == "a", 3).otherwise(2)
    at = F.when(everywhere, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(own.cast("int")))
    rows = model.select(F.col("lang").alias("key"), F.explode(at).alias("shard"), F.col("size").cast("byte").alias("size"), "code", (F.col("kind") == "a").alias("a"), F.col("value").cast("float").alias("value"))

    def pack(key, t):
        return pa.table({"key": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int32()), "model": pa.array([_packed(t.select(["size", "code", "a", "value"]))], pa.binary())})

    return rows.groupBy("key", "shard").applyInArrow(pack, "key string, shard int, model binary")


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def with_loss(docs: DataFrame, model: DataFrame, key: str = "q_key", order: int = ORDER) -> DataFrame:
    """docs (with text and a key among its columns) and q_loss, q_symbols: the sum of losses and the number of symbols; null for a null key and one without a model."""
    schema = T.StructType([*docs.schema.fields, T.StructField("q_loss", T.DoubleType()), T.StructField("q_symbols", T.LongType())])
    at_text, at_key = docs.columns.index("text"), docs.columns.index(key)
    n_shards = max(1, -(-model.count() // MODEL_ROWS))
    n_blocks = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    groups = max(1, n_blocks // BLOCK_GROUP)

    def deal(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() * 7919
        for whole in batches:
            size = np.cumsum(whole.column(at_text).to_pandas().str.len().fillna(0).to_numpy(dtype=np.int64, na_value=0))
            a = 0
            while a < whole.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK_BYTES)))
                yield pa.RecordBatch.from_arrays([pa.array([at % n_blocks]), pa.array([_packed(pa.Table.from_batches([whole.slice(a, b - a)]))], pa.binary())], ["block", "rows"])
                a, at = b, at + 1

    def each(t: pa.Table):
        """(key, numbers of rows, symbols, codes, first code of each row) of the chunk's groups of texts."""
        texts = _texts(t.column(at_text))
        for name, which in _by_key(t.column(at_key)):
            for group in _slices(texts, which):
                a, start = symbols([texts[i] for i in group], order)
                # PADs have no code; a text's first symbol that has one comes after its order - 1 PADs
                yield name, group, codes(a, order), start - (order - 1) * np.arange(len(group))

    def ask(t):
        held: dict[str, list[np.ndarray]] = {}
        for raw in t.column("rows").to_pylist():
            for name, _group, c, _start in each(_unpacked(raw)):
                mine = held.setdefault(name, [])
                mine.append(np.unique(c))
                if len(mine) >= 16:
                    held[name] = [np.unique(np.concatenate(mine))]
        block, rows = t.column("block")[0].as_py() if t.num_rows else 0, []
        for name, mine in held.items():
            c = np.unique(np.concatenate(mine))
            shard = _shard_of(c, n_shards)
            for k in np.unique(shard).tolist():
                wanted = c[shard == k]
                rows.append((block, name, k, block % groups, _packed(pa.table({"step": np.diff(wanted, prepend=0)}))))
        return pa.table([pa.array(x, f) for x, f in zip(zip(*rows) if rows else [[]] * 5, ASKED.types)], schema=ASKED)

    def answer(asked, have):
        rows = []
        if have.num_rows:
            m = _unpacked(have.column("model")[0].as_py())
            known = Model(*(m.column(i).to_numpy() for i in (0, 1)), m.column(2).to_pandas().to_numpy(bool), m.column(3).to_numpy(), order)
            for block, raw in zip(asked.column("block").to_pylist(), asked.column("codes").to_pylist()):
                wanted = np.cumsum(_unpacked(raw).column(0).to_numpy())
                rows.append((block, asked.column("key")[0].as_py(), _packed(pa.table({"step": np.diff(wanted, prepend=0), "loss": known.losses(wanted).astype(np.float32)}))))
        return pa.table([pa.array(x, f) for x, f in zip(zip(*rows) if rows else [[]] * 3, ANSWERED.types)], schema=ANSWERED)

    def add_up(dealt, answers):
        told: dict[str, list[pa.Table]] = {}
        for name, raw in zip(answers.column("key").to_pylist(), answers.column("losses").to_pylist()):
            told.setdefault(name, []).append(_unpacked(raw))
        tables = {name: Table(np.concatenate([np.cumsum(t.column(0).to_numpy()) for t in ts]), np.concatenate([t.column(1).to_numpy() for t in ts])) for name, ts in told.items()}
        out = []
        for raw in dealt.column("rows").to_pylist():
            t = _unpacked(raw)
            loss, n = np.full(t.num_rows, np.nan), np.full(t.num_rows, -1, np.int64)
            for name, group, c, start in each(t):
                if name in tables:
                    loss[group] = np.add.reduceat(tables[name].get(c, np.nan), start)
                    n[group] = np.diff(np.append(start, len(c)))
            out.append(t.append_column("q_loss", pa.array(loss, from_pandas=True)).append_column("q_symbols", pa.array(n, mask=n < 0)))
        return pa.concat_tables(out).combine_chunks()

    dealt = batched(docs).mapInArrow(tidy(deal), "block long, rows binary")
    asked = dealt.groupBy("block").applyInArrow(ask, "block long, key string, shard int, part long, codes binary")
    have = shards(model, n_shards).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    by = ["key", "shard", "part"]
    answers = asked.groupBy(*by).cogroup(have.groupBy(*by)).applyInArrow(answer, "block long, key string, losses binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)


ASKED = pa.schema([("block", pa.int64()), ("key", pa.string()), ("shard", pa.int32()), ("part", pa.int64()), ("codes", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("key", pa.string()), ("losses", pa.binary())])


def limits(held: DataFrame, short: float = SHORT, tail: float = TAIL) -> DataFrame:
    """(q_key, q_limit) from scored held-out documents (q_key, q_loss, q_symbols)."""
    d = held.where("q_symbols > 1").select("q_key", (F.col("q_loss") / F.col("q_symbols") - F.lit(short) / F.sqrt("q_symbols")).alias("x"))
    q = F.percentile_approx("x", [MID, HIGH], 10_000)
    own = d.groupBy("q_key").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select("q_key", "n", F.col("q")[0].alias("mid"), (F.col("q")[1] - F.col("q")[0]).alias("way"))
    all_ = own.agg(F.try_divide(F.sum(F.col("way") * F.col("n")), F.sum("n")).alias("others"))  # one row
    own = own.crossJoin(F.broadcast(all_)).select("q_key", "mid", ((F.col("way") * F.col("n") + F.col("others") * F.lit(BORROWED)) / (F.col("n") + F.lit(BORROWED))).alias("way"))
    own = staged(own, "languages")
    few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    far = d.join(F.broadcast(own) if few else own, "q_key").agg(F.percentile_approx(F.try_divide(F.col("x") - F.col("mid"), F.col("way")), tail, 10_000).alias("far"))  # one row
    return own.crossJoin(F.broadcast(far)).select("q_key", (F.col("mid") + F.coalesce("far", F.lit(0.0)) * F.col("way")).alias("q_limit"))


def judged(docs: DataFrame, labels: DataFrame, short: float = SHORT, tail: float = TAIL, order: int = ORDER) -> DataFrame:
    """The columns of docs but text in a struct q_row, and text, q_symbols, q_mean (loss a symbol), q_threshold, q_keep."""
    label = labels.groupBy(labels["`doc_id`"].cast("long").alias("id")).agg(F.min(labels["`quality`"]).alias("quality"))
    trusted = label.where("quality = 1 AND id IS NOT NULL").select("id")
    held = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    lang = docs["`lang`"].cast("string")
    own = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))
    d = docs.select(docs["`doc_id`"].cast("long").alias("id"), docs["`text`"].cast("string").alias("text"), own.alias("own"))
    good = keep_ids(d, trusted, ["id"])
    # which model a language is judged by
    names = good.groupBy("own").agg(F.count_if(held).alias("n")).select("own", F.when(F.col("n") >= LEAST_HELD, F.col("own")).otherwise(POOLED).alias("q_key"))
    names = staged(names, "models")
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pooled = names.where(F.col("q_key") == POOLED).limit(1).count() > 0
    counts = staged(ngram_counts(good.where(~held).select("text", F.col("own").alias("lang")), order), "ngrams")
    if pooled:
        counts = counts.unionByName(counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "code", "n"))
    model = kneser_ney(counts, order)
    keys = F.array_distinct(F.array(F.col("q_key"), F.lit(POOLED) if pooled else F.col("q_key")))
    held_out = good.where(held).join(F.broadcast(names) if few else names, "own").select("text", F.explode(keys).alias("q_key"))
    limit = staged(limits(staged(with_loss(held_out, model, order=order).drop("text"), "held-out"), short, tail), "limits")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("q_row"), docs["`text`"].cast("string").alias("text"), own.alias("own"))
    rows = rows.join(F.broadcast(names) if few else names, "own", "left").drop("own")
    scored = with_loss(rows, model, order=order)
    out = scored.join(F.broadcast(limit) if few else limit, "q_key", "left")
    mean, most = F.col("q_loss") / F.col("q_symbols"), F.col("q_limit") + F.lit(short) / F.sqrt("q_symbols")
    keep = F.coalesce((F.col("q_symbols") <= 1) | (mean <= most), F.lit(True))
    return out.select("q_row", "text", "q_symbols", mean.alias("q_mean"), most.alias("q_threshold"), keep.alias("q_keep"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    j = judged(d, table(spark, sf_dir, "labels"))
    return j.select("q_row.doc_id", "q_row.lang", "q_symbols", F.exp("q_mean").alias("perplexity"), F.exp("q_threshold").alias("threshold"), F.col("q_keep").alias("kept")).withColumnRenamed("q_symbols", "n_symbols")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    j = judged(docs.select(*[docs[f"`{c}`"] for c in DOCUMENT_COLUMNS]), labels)
    return j.where("q_keep").select(*["text" if c == "text" else f"q_row.{c}" for c in DOCUMENT_COLUMNS])
