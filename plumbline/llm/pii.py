"""Personal data: exact base patterns, and a skip-chain conditional random field that adds to them.

The base finds emails, ip addresses, card and phone numbers by fixed patterns and checks.
The field labels the words that hold a digit or an at sign (all others are no personal
data, which cuts the chain there without loss): a word's own potentials come from its
shape and the word before it, neighbours share potentials, and words that are alike or have
the same last digits share skip potentials wherever they stand in the document: each with one
of them, the first in a base span or else the first of all, so that any two are two links
apart at most.  Words of base spans are fixed evidence.  Loopy belief propagation over all
documents of a batch at once, each until its messages stop changing, gives marginals, so that
a number known from one place is found again in all others.
A word whose marginal for one kind is SURE or more becomes a span; neighbours of a kind join.

The weights are trained here, by pseudo-likelihood on documents made by ``examples``.

Defined cases: a null text is empty and has no spans; texts of any length are read whole, in
time linear in their length; rows that are alike give like results; an empty table gives an
empty table; other columns are carried along by ``redacted`` and not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import DOCUMENT_COLUMNS, batched, table, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SURE = 0.75
#: Messages that change by less have stopped; a document whose messages never do ends after ROUNDS.
STILL, ROUNDS = 1e-4, 2000
#: What fixes a word: more than all messages to it together, however many words are linked to it.
EVIDENCE = 1e8
#: Least number of digits for words with the same last digits to be taken as the same number.
ALIKE_DIGITS = 7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>|%$#*&=~_/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


#: Words before personal data, in the languages of the corpus.
CUES = {
    "email": "email e-mail mail mailto correo courriel write contact".split(),
    "ip": "ip host server address adresse dirección client from".split(),
    "card": "card visa mastercard amex karte carte tarjeta credit".split(),
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono ring".split(),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
FEATURES = [
    "always", "at", "at_dot", "at_many", "letters", "hex", "digits_only", "luhn_card", "card_length", "octets", "octets_large", "three_dots", "dots",
    "plus", "paren", "three_digits", "seven_dashed", "ten_dashed", "phone_length", "long_run", "dash", "slash", "colon", "short", "four_digits", "percent", "money",
    *(f"cue_{k}" for k in KINDS),
]
NUMBER = {f: i for i, f in enumerate(FEATURES)}


def features(word: str, before: str) -> list[int]:
    core = word.strip(EDGE)
    d = _digits(core)
    out = ["always"]
    add = out.append
    if "@" in core:
        name, _, host = core.partition("@")
        add("at")
        if name and DOMAIN.fullmatch(host):
            add("at_dot")
        if "@" in host:
            add("at_many")
    if any(c.isalpha() for c in core):
        add("letters")
        if len(core) >= 16 and all(c in "0123456789abcdefABCDEF" for c in core):
            add("hex")
    elif core == d and d:
        add("digits_only")
    if 16 <= len(d) <= 19 and all(c.isdigit() or c in " -" for c in core):
        add("card_length")
        if luhn(d):
            add("luhn_card")
    parts = core.split(".")
    if len(parts) == 4 and all(p and p == _digits(p) for p in parts):
        add("octets" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "octets_large")
    if len(parts) > 4:
        add("three_dots")
    if len(parts) > 1:
        add("dots")
    if word.startswith("+"):
        add("plus")
    if re.fullmatch(r"\(\d{2,4}\)", word.strip(".,;:")):
        add("paren")
    if len(d) == 3 and core == d:
        add("three_digits")
    if re.fullmatch(r"\d{3}[-.]\d{4}", core):
        add("seven_dashed")
    if re.fullmatch(r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}", core):
        add("ten_dashed")
    if 8 <= len(d) <= 15:
        add("phone_length")
    if len(d) > 19:
        add("long_run")
    for name, mark in (("dash", "-"), ("slash", "/"), ("colon", ":"), ("percent", "%")):
        if mark in core or (mark == "%" and "%" in word):
            add(name)
    if len(d) <= 2:
        add("short")
    if len(d) == 4 and core == d:
        add("four_digits")
    if word[:1] in "$€£#":
        add("money")
    cue = CUE_OF.get(before.strip(EDGE).lower())
    if cue:
        add(f"cue_{cue}")
    return [NUMBER[f] for f in out]


def key(word: str) -> str:
    d = _digits(word)
    return d[-ALIKE_DIGITS:] if len(d) >= ALIKE_DIGITS else word.strip(EDGE).lower()


def graph(words: list[tuple[int, int, str]], text_adjacent: list[bool], fixed: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Edges (word, word, 0: neighbours or 1: skip); the occurrences of a key are linked to the first one that is fixed (0 or more), else to the first."""
    out = [(i - 1, i, 0) for i in range(1, len(words)) if text_adjacent[i]]
    keys = [key(w) for _, _, w in words]
    hub: dict[str, int] = {}
    for i, k in enumerate(keys):
        if k not in hub or (fixed and fixed[i] >= 0 > fixed[hub[k]]):
            hub[k] = i
    for i, k in enumerate(keys):
        a, b = sorted((hub[k], i))
        if a != b and not (a == b - 1 and text_adjacent[b]):
            out.append((a, b, 1))
    return out


def examples(n: int = 600, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """Documents as words with labels, made by rule."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        while True:
            d = r.choice("3456") + num(15)
            if luhn(d) == good:
                return d

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return r.choice([[f"+{r.choice(['1', '44', '49', '33'])}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}{a}{b}{c}"], [f"{a}.{b}.{c}"]])

    def email() -> list[str]:
        return [f"{r.choice(['ann', 'bo', 'info', 'j.doe', 'x'])}{r.choice(['', num(2)])}@{r.choice(['mail', 'post', 'corp'])}{r.choice(['', num(1)])}.{r.choice(['example', 'net', 'site'])}.{r.choice(['com', 'org', 'de'])}"]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def cards() -> list[str]:
        d = card(True)
        return r.choice([[d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join((d[:4], d[4:8], d[8:12], d[12:]))]])

    def nothing() -> list[str]:
        return r.choice([
            lambda: [num(r.randint(1, 6))], lambda: [f"{r.randint(1900, 2030)}"], lambda: [card(False)], lambda: [num(r.randint(17, 40))],
            lambda: [f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 9)}"], lambda: [f"{r.randint(256, 999)}.{r.randint(0, 300)}.{r.randint(256, 999)}.{r.randint(0, 9)}"],
            lambda: [f'"{"".join(r.choice("0123456789abcdef") for _ in range(40))}"'], lambda: [f"{r.randint(1, 99)}%"], lambda: [f"${num(3)}.{num(2)}"],
            lambda: [f"{num(2)}:{num(2)}"], lambda: [f"{num(2)}/{num(2)}/{num(4)}"], lambda: [f"a{num(3)}b"], lambda: ["@home"], lambda: [f"user@{num(2)}"],
            lambda: [f"{num(4)}-{num(2)}-{num(2)}"], lambda: [num(r.randint(7, 15))], lambda: [f"{num(1)},{num(3)},{num(3)}"], lambda: [f"v{num(1)}.{num(1)}.{num(1)}.{num(1)}"],
        ])()

    made = {"email": email, "ip": ip, "card": cards, "phone": phone}
    docs = []
    for _ in range(n):
        words, labels, known = [], [], []
        for _ in range(r.randint(2, 6)):
            words += ["word"] * r.randint(1, 3)
            labels += [0] * (len(words) - len(labels))
            if known and r.random() < 0.35:
                kind, item = r.choice(known)
                if r.random() < 0.5:
                    item = [r.choice(["".join(item), _digits("".join(item)) if kind in ("phone", "card") else "".join(item)])]
            else:
                kind = r.choice([*KINDS, "other", "other", "other"])
                item = made[kind]() if kind != "other" else nothing()
                known.append((kind, item))
            if kind != "other" and r.random() < 0.4:
                words.append(r.choice(CUES[kind]))
                labels.append(0)
            words += item
            labels += [LABELS.index(kind)] * len(item)
        docs.append((words, labels))
    return docs


@lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features x labels, neighbours: labels x labels, skip: labels x labels), by pseudo-likelihood."""
    rows, wanted, near, skip = [], [], [], []
    for words, labels in examples():
        at = [i for i, w in enumerate(words) if HINT.search(w)]
        cells = [(i, i, words[i]) for i in at]
        edges = graph(cells, [False] + [at[k] == at[k - 1] + 1 for k in range(1, len(at))])
        first = len(rows)
        for i in at:
            x = np.zeros(len(FEATURES))
            x[features(words[i], words[i - 1] if i else "")] = 1
            rows.append(x)
            wanted.append(labels[i])
        for a, b, kind in edges:
            (skip if kind else near).append((first + a, first + b))
    x, y = np.array(rows), np.array(wanted)
    n, k = len(x), len(LABELS)
    one = np.eye(k)[y]
    sides = []
    for pairs in (near, skip):
        p = np.array(pairs)
        left, right = np.zeros((n, k)), np.zeros((n, k))
        np.add.at(left, p[:, 1], one[p[:, 0]])
        np.add.at(right, p[:, 0], one[p[:, 1]])
        sides.append((left, right))
    w, t, s = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))
    (nl, nr), (sl, sr) = sides
    for step in range(400):
        z = x @ w + nl @ t + nr @ t.T + (sl + sr) @ s
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (one - p) / n
        rate = 4.0 / (1 + step / 200)
        ds = (sl + sr).T @ g
        w += rate * (x.T @ g - 2e-4 * w)
        t += rate * (nl.T @ g + g.T @ nr - 2e-4 * t)
        s += rate * ((ds + ds.T) / 2 - 2e-4 * s)
    return w, t, s


def marginals(node: np.ndarray, edges: np.ndarray, near: np.ndarray, skip: np.ndarray, owner: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs by loopy sum-product, damped, all messages at a time; edges: (node, node, kind), owner: each node's document, in order."""
    if len(edges):
        to_v, to_u = np.zeros((len(edges), node.shape[1])), np.zeros((len(edges), node.shape[1]))
        owner = np.zeros(len(node), np.int64) if owner is None else owner
        live = np.argsort(owner[edges[:, 0]], kind="stable")
        belief = np.empty_like(node)
        changed = True
        for done in range(rounds):
            if changed:  # documents have ended: what the others need
                u, v = edges[live, 0], edges[live, 1]
                pair = np.where(edges[live, 2, None, None] == 0, near[None], skip[None])
                touched = np.unique(np.append(u, v))
                doc = owner[u]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                sizes = np.diff(np.append(first, len(doc)))
                mine_v, mine_u = to_v[live], to_u[live]
            belief[touched] = node[touched]
            np.add.at(belief, v, mine_v)
            np.add.at(belief, u, mine_u)
            off_v = _soft((belief[u] - mine_u)[:, :, None] + pair, 1) - mine_v
            off_u = _soft((belief[v] - mine_v)[:, None, :] + pair, 2) - mine_u
            step = 0.5 if done < 200 else 0.1 if done < 800 else 0.02  # messages that swing are damped more
            mine_v, mine_u = mine_v + step * off_v, mine_u + step * off_u
            most = np.maximum.reduceat(np.maximum(np.abs(off_v).max(axis=1), np.abs(off_u).max(axis=1)), first)
            on = np.repeat(most > STILL, sizes)
            changed = not on.all()
            if changed or done == rounds - 1:
                to_v[live], to_u[live] = mine_v, mine_u
                live = live[on]
                if not len(live):
                    break
        u, v = edges[:, 0], edges[:, 1]
        node = node.copy()
        np.add.at(node, v, to_v)
        np.add.at(node, u, to_u)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    m = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
    return m - m.max(axis=1, keepdims=True)


def all_spans(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    w, near, skip = weights()
    out: list = [([], [])] * len(texts)
    cells, owner, rows, evidence, edges, first_of, joined = [], [], [], [], [], {}, []
    for n, text in enumerate(texts):
        if not text or not HINT.search(text):
            continue
        base = base_spans(text)
        out[n] = (base, [])
        words, adjacent, feats, fixed = [], [], [], []
        by_start = sorted((a, b, k) for k, a, b in base)
        before, before_end, last, s, reach = "", -1, -2, 0, []
        for i, m in enumerate(WORD.finditer(text)):
            word = m[0]
            if HINT.search(word):
                words.append((m.start(), m.end(), word))
                adjacent.append(last == i - 1)
                feats.append(features(word, before))
                while s < len(by_start) and by_start[s][0] < m.end():
                    reach.append(by_start[s])
                    s += 1
                reach = [x for x in reach if x[1] > m.start()]
                fixed.append(reach[0][2] + 1 if reach else -1)
                last = i
            before = word
        start = len(cells)
        cells += words
        owner += [n] * len(words)
        rows += feats
        evidence += fixed
        joined += adjacent
        edges += [(start + a, start + b, kind) for a, b, kind in graph(words, adjacent, fixed)]
    if not cells:
        return out
    node = np.zeros((len(cells), len(LABELS)))
    flat = np.array([f for r in rows for f in r])
    np.add.at(node, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), w[flat])
    known = np.array(evidence)
    at = np.flatnonzero(known >= 0)
    node[at] -= EVIDENCE
    node[at, known[at]] += EVIDENCE
    p = marginals(node, np.array(edges, np.int64).reshape(-1, 3), near, skip, np.array(owner))
    label = np.where(known >= 0, 0, np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0))
    previous = -1
    for i in np.flatnonzero(label).tolist():
        a, b, word = cells[i]
        core = word.strip(EDGE)
        if not core:
            continue
        head = word.index(core)
        span = [int(label[i]) - 1, a + head, a + head + len(core)]
        added = out[owner[i]][1]
        if previous == i - 1 and joined[i] and owner[previous] == owner[i] and added and added[-1][0] == span[0]:
            added[-1] = (span[0], added[-1][1], span[2])
        else:
            added.append(tuple(span))
        previous = i
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the base), spans (base and added)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            both = all_spans(b.column(1).to_pylist())
            counts = np.array([[sum(1 for s in base if s[0] == k) for k in range(len(KINDS))] for base, _ in both], np.int64).reshape(len(both), len(KINDS))
            digest = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in both]
            spans = [_written(base + added) for base, added in both]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names)

    d = docs.select(docs["`doc_id`"].cast("long").alias("doc_id"), docs["`text`"].cast("string").alias("text"))
    return batched(d).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; where spans overlap, the first one's kind stands for all."""
    parts, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars that follows; a null text stays null."""
    names = list(docs.columns)
    at_text, at_n = names.index("text"), names.index("n_chars")

    def run(batches):
        for b in batches:
            texts = b.column(at_text).to_pylist()
            new = [t if not t else redact(t, base + added) for t, (base, added) in zip(texts, all_spans(texts))]
            n = [old if t == x else len(x) for old, t, x in zip(b.column(at_n).to_pylist(), texts, new)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at_text], columns[at_n] = pa.array(new, b.schema.field(at_text).type), pa.array(n, b.schema.field(at_n).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return batched(docs).mapInArrow(tidy(run), docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def pii_stage(docs: DataFrame) -> DataFrame:
    return redacted(docs.select(*[docs[f"`{c}`"] for c in DOCUMENT_COLUMNS]))
