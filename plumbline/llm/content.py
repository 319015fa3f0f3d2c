"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags.  A word scores what its surroundings are
worth: the elements around it (tag names, and words of class, id and role) have weights
learned from the labelled pages of ``labelled_pages``: smoothed log odds of their words being
main text, where they are against it, and the least of them counts.  A word of a class is
weighed apart for elements that read like prose (sentences, few links) and for others, so a
class that stands on lists of links says nothing against paragraphs.  What holds the page as a
whole says nothing against its words either: body, classes that tell what the page has
(has-sidebar), classes of a place beside one of content (top-story), a form with most of the
page's words, main, and an element with most of the words that has the article inside.  If no
word is left that scores above zero, elements with most of the words stop counting, outermost
first.  A tag scores below zero, less where labelled pages have it outside the main text.

One linear scan finds the contiguous region with the largest sum.  What interrupts an
article from within (an aside, an advert) costs no more than INSET, however long, so the parts
before and after stay together.  The main text is the region's words, except those that
themselves score below zero.

Character references are decoded; white space within a block becomes one space; blocks are
trimmed and joined by one newline.

Defined cases: a null html is empty; a page without words gives an empty text; broken and
cut off markup is read as far as it goes, in time linear in its length however deep it is
nested; rows that are alike give like results; other columns are not read.  A page without
any known element is taken whole.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batched, table, tidy
from .content_labels import CLOSE, OPEN, labelled_pages

#: What is no text at all, tags, and text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|select|svg|iframe|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD_OF_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input button".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A word and a tag, where the labelled pages say nothing, and the least of each: what parts two
#: stretches of the main text, such as an advert, must not outweigh a short stretch.
WORD_SCORE, TAG_SCORE = 1.0, -0.05
LEAST_WORD, LEAST_TAG = -0.3, -0.2
#: The most that an interruption within an article takes off.
INSET = 3.0
#: Prose: the largest share of words in links, and the least number of words in its longest stretch of text.
LINKED, STRETCH = 0.5, 8
#: First words of classes that tell what a page has or is, and words that tell of a place only.
STATES = frozenset("has with without no is not show hide".split())
PLACES = frozenset("top bottom side column rail".split())
#: Elements and marks that hold the main text, and elements that never do whatever they hold.
CONTENT = frozenset("article main .article .main .content .story .post .entry".split())
NEVER = frozenset("nav aside header footer article/header article/footer".split())


def marks_of(name: str, rest: str) -> list[str]:
    """Words of class, id and role."""
    marks = []
    for found in MARKS.findall(rest):
        for token in " ".join(found).split():
            words = [w.lower() for w in WORD_OF_MARK.findall(token)]
            if words and not (len(words) > 1 and words[0] in STATES):
                marks += [f".{w}" for w in words]
    if not CONTENT.isdisjoint([name, *marks]):
        marks = [x for x in marks if x[1:] not in PLACES]
    return [] if name in ("html", "body") else marks


def sequence(page: str):
    """(innermost element around or None, text or None, tag name or None, what the tag puts between words) for each text and tag of the page; an element is (number, marks, the element around it, its tag name)."""
    stack: list[tuple[str, tuple, str]] = []  # name, element, the innermost block's name
    within: Counter = Counter()
    number = 0

    def up_to(name: str) -> None:
        while True:
            closed = stack.pop()[0]
            within[closed] -= 1
            if closed == name:
                return

    for m in TOKEN.finditer(page):
        text = m["text"]
        inside = stack[-1][1] if stack else None
        if text is not None:
            yield inside, text, None, ""
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if within[name]:
                up_to(name)
        elif name not in EMPTY and not m["rest"].endswith("/"):
            if name in ("p", "li") and stack and name in (x for x, *_ in stack[-4:]):  # an end tag left out
                up_to(name)
            block = stack[-1][2] if stack else ""
            marks = [name]
            if name == "a":
                marks = [f"{block}/a" if block else "a"]
            elif name in ("header", "footer"):
                marks = [f"article/{name}" if within["article"] or within["main"] else name]
            number += 1
            within[name] += 1
            element = (number, (*marks, *marks_of(name, m["rest"])), stack[-1][1] if stack else None, name)
            stack.append((name, element, block if name in INLINE else name))
        yield stack[-1][1] if stack else None, None, m["close"] + name, " " if name in ("br", "img") else "" if name in INLINE else "\n"


class Elements:
    """The elements of a page that have words, each after those around it, and what is known of their words."""

    def __init__(self, parts: list):
        self.at: dict[int, tuple] = {}
        words: Counter = Counter()
        stretch: dict[int, int] = {}
        for inside, text, *_ in parts:
            if text is not None and inside is not None and (n := len(text.split())):
                words[inside[0]] += n
                stretch[inside[0]] = max(stretch.get(inside[0], 0), n)
        self.loose = sum(len(text.split()) for inside, text, *_ in parts if text is not None and inside is None)
        for inside, *_ in parts:
            while inside is not None and inside[0] not in self.at and inside[0] in words:
                path = []
                while inside is not None and inside[0] not in self.at:
                    path.append(inside)
                    inside = inside[2]
                self.at.update((e[0], e) for e in path)
        self.order = sorted(self.at)  # an element has a larger number than those around it
        self.direct, self.words, self.linked, self.stretch = set(words), words, Counter(), stretch
        for k in reversed(self.order):
            _, _, around, name = self.at[k]
            if name == "a":
                self.linked[k] = words[k]
            if around is not None:
                up = around[0]
                words[up] += words[k]
                self.linked[up] += self.linked[k]
                stretch[up] = max(stretch.get(up, 0), stretch.get(k, 0))

    def keys(self, k: int) -> list[str]:
        """Marks of an element as they are weighed."""
        prose = self.stretch.get(k, 0) >= STRETCH and self.linked[k] <= LINKED * self.words[k]
        return [x + ("+" if prose else "-") if x[0] == "." else x for x in self.at[k][1]]


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """Weights of surroundings and of tags, from the labelled pages."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in labelled_pages():
        main = False
        parts = list(sequence(page))
        e = Elements([(i, t and re.sub(f"[{OPEN}{CLOSE}]", "", t), *rest) for i, t, *rest in parts])
        for inside, text, tag, _ in parts:
            if tag is not None:
                tags[main][tag] += 1
                continue
            for part in re.split(f"([{OPEN}{CLOSE}])", text):
                if part in (OPEN, CLOSE):
                    main = part == OPEN
                elif n := len(part.split()):
                    marks, at = set(), inside
                    while at is not None:
                        marks.update(e.keys(at[0]))
                        at = at[2]
                    for mark in marks | {x[:-1] for x in marks if x[0] == "."}:
                        words[main][mark] += n
    odds = lambda c, x: math.log((c[True][x] + 0.5) / (c[False][x] + 0.5))
    of_words = {x: WORD_SCORE if odds(words, x) >= 0 else max(LEAST_WORD, odds(words, x)) for x in words[True].keys() | words[False].keys()}
    of_tags = {x: max(LEAST_TAG, min(TAG_SCORE, odds(tags, x))) for x in tags[True].keys() | tags[False].keys()}
    return of_words, of_tags


def weight(key: str, of_words: dict[str, float]) -> float:
    """A mark's weight.  Prose of a class that was only seen around lists is not weighed; a list of one that was only seen around prose is weighed as that."""
    if key in of_words:
        return of_words[key]
    return of_words.get(key[:-1], WORD_SCORE) if key[0] == "." and key[-1] == "-" else WORD_SCORE


def scores(parts: list, of_words: dict[str, float]) -> tuple[dict[int, float], dict[int, int]]:
    """(what a word within an element is worth, the interruption that an element belongs to), by the number of the innermost element."""
    e = Elements(parts)
    marks = {k: e.at[k][1] for k in e.order}
    around = {k: e.at[k][2][0] if e.at[k][2] else 0 for k in e.order}
    own = {k: min(weight(x, of_words) for x in e.keys(k)) for k in e.order}
    half = (e.loose + sum(e.words[k] for k in e.order if not around[k])) / 2
    wide = {k for k in e.order if own[k] <= 0 and e.words[k] > half and NEVER.isdisjoint(marks[k])}
    good = {k for k in e.order if own[k] > 0 and not CONTENT.isdisjoint(marks[k])}
    holds_good: set[int] = set()
    for k in reversed(e.order):
        if k in good or k in holds_good:
            holds_good.add(around[k])
    void = {k for k in wide if "form" in marks[k] or k in holds_good}

    def worth() -> dict[int, float]:
        out = {0: WORD_SCORE}
        for k in e.order:
            if k in good and marks[k][0] == "main":
                out[k] = own[k]
            else:
                out[k] = out[around[k]] if k in void else min(out[around[k]], own[k])
        return out

    out = worth()
    for k in sorted(wide - void):
        if e.loose or any(out[j] > 0 for j in e.direct):
            break
        void.add(k)
        out = worth()
    in_good, inset = {0: False}, {0: 0}
    for k in e.order:
        in_good[k] = in_good[around[k]] or k in good
        inset[k] = inset[around[k]] or (k if out[k] <= 0 and in_good[around[k]] else 0)
    return out, inset


def best_region(values: list[float]) -> tuple[int, int]:
    """(first, last + 1) of the contiguous values with the largest sum above zero, by one scan; (0, 0) if there are none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None) -> str:
    of_words, of_tags = weights()
    parts = list(sequence(page or ""))
    known, inset = scores(parts, of_words)
    items: list[tuple[float, str | None, str]] = []
    values: list[float] = []
    spent: Counter = Counter()
    for inside, text, tag, between in parts:
        at = inside[0] if inside else 0
        if text is not None:
            text = references.unescape(text)
            w = known.get(at, WORD_SCORE)
            items.append((w, text, ""))
            values.append(w * len(text.split()))
        else:
            items.append((0.0, None, between))
            values.append(of_tags.get(tag, TAG_SCORE))
        if (k := inset.get(at, 0)) and values[-1] < 0:
            values[-1] = -min(-values[-1], INSET - spent[k])
            spent[k] -= values[-1]
    first, last = best_region(values)
    blocks, now = [], []
    for w, text, between in items[first:last]:
        if text is not None:
            if w > 0:
                now.append(text)
        elif between == "\n":
            blocks.append("".join(now))
            now = []
        else:
            now.append(between)
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select(pages["`page_id`"].cast("long").alias("page_id"), pages["`url`"].cast("string").alias("url"), pages["`html`"].cast("string").alias("html"))
    return batched(p).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op3_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
