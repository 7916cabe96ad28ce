"""Evaluation texts leaking into training text: find the documents, the items and the spans, and take them out."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import cut_lineage, require, ship_package

#: Characters of test text whose index is broadcast at once. More test text is searched for in blocks of this size.
BLOCK_CHARS = 8_000_000
#: Words of documents whose pairs are looked up at once.
CHUNK_WORDS = 50_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakRules:
    """``min_words``: words of the item that must stand in a row in the document. An isolated word changed, added or dropped is let
    go; ``min_equal`` is the least share of the run's words that must be equal. ``seeds``: pairs of neighbouring words that a document must
    share with an item, each in reach of the next by equal words or one edit, before the two are verified; more than ``chain`` never are asked for."""

    seeds: int = 8
    min_words: int = 25
    min_equal: float = 0.7

    @property
    def chain(self) -> int:
        """Seeds that every run has: between two edits stand two equal words at least, at either end one, so e equal words make at
        most e // 2 + 1 pieces, and a piece of m words has m - 1 pairs of neighbours."""
        equal = math.ceil(self.min_equal * self.min_words - 1e-9)
        return min(self.seeds, equal - equal // 2 - 1)


def _flat(text: str) -> str:
    """Lower case, compatibility forms unified, if that leaves every character in its place; else as much of it as does."""
    low = text.lower()
    flat = unicodedata.normalize("NFKC", low) if not low.isascii() else low
    if len(flat) != len(text):
        flat = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return flat


def words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Normalised words of a text with the bounds of each in the text as it was: no case, no punctuation, no spacing.

    Compatibility forms are unified first if that leaves every character in its place; else the text is taken as it is.
    A word hyphenated over a line end counts as two.
    """
    found = list(_WORD.finditer(_flat(text)))
    return [m.group() for m in found], [m.start() for m in found], [m.end() for m in found]


#: Word offsets of two pairs of neighbours, the second of which follows at once (``NEXT``), after a third word (``SKIP``) or right behind (``PAIRS``).
NEXT, SKIP, PAIRS = (0, 1, 2), (0, 1, 3, 4), (0, 1, 2, 3)
#: How far each takes the pair on.
STEP = {NEXT: 1, SKIP: 3, PAIRS: 2}
#: What the words of a document and of an item look like from one seed to the next: no edit, a word changed, added, dropped.
MOVES = ((NEXT, NEXT), (SKIP, SKIP), (SKIP, PAIRS), (PAIRS, SKIP))


@dataclass
class ItemIndex:
    """Test items as word numbers, laid end to end, and the sorted keys of each pattern of their words with postings; it is what gets broadcast."""

    ids: list[int]
    items: list[np.ndarray]
    vocab: dict[str, int]
    places: list[dict[int, list[int]]]
    first: np.ndarray
    patterns: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]
    rules: LeakRules = field(default_factory=LeakRules)

    @classmethod
    def build(cls, rows: list[tuple[int, str]], rules: LeakRules) -> "ItemIndex":
        vocab: dict[str, int] = {}
        ids, items = [], []
        for item, text in rows:
            w = words(text or "")[0]
            if len(w) >= rules.min_words:
                ids.append(item)
                items.append(np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], dtype=np.int64))
        first = np.cumsum([0, *(len(x) for x in items)])
        patterns = {}
        for shape in (NEXT, SKIP, PAIRS):
            keys = np.concatenate([np.zeros(0, np.int64), *(_keys(x, shape) for x in items)])
            post = np.concatenate([np.zeros(0, np.int64), *(first[i] + np.arange(max(0, len(x) - shape[-1])) for i, x in enumerate(items))])
            order = np.argsort(keys, kind="stable")
            uniq, start = np.unique(keys[order], return_index=True)
            patterns[shape] = uniq, np.append(start, len(keys)), post[order].astype(np.int32)
        return cls(ids, items, vocab, [_places(x) for x in items], first, patterns, rules)

    def search(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """Leaks in a text: (item id, first character, end character, first item word, item words, equal words), one per run."""
        return [x[1:] for x in self.search_all([text])]

    def search_all(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """:func:`search` over many texts, each leak behind the number of its text. Seeds are looked up for ``CHUNK_WORDS`` words at once,
        whole texts with unknown words between them; only texts with seeds are read for the bounds of their words."""
        if not self.items:
            return
        get, gap = self.vocab.get, [0] * 8
        flat: list[int] = []
        first, owner = [], []
        for n, t in enumerate(texts):
            w = _WORD.findall(_flat(t))
            if w:
                first.append(len(flat))
                owner.append(n)
                flat += [get(x, 0) for x in w]
                flat += gap
            if len(flat) > CHUNK_WORDS or (n == len(texts) - 1 and flat):
                yield from self._search(texts, np.array(flat, np.int64), np.array(first), owner)
                flat, first, owner = [], [], []
        if flat:
            yield from self._search(texts, np.array(flat, np.int64), np.array(first), owner)

    def _search(self, texts: list[str], x: np.ndarray, first: np.ndarray, owner: list[int]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        ends = np.append(first[1:], len(x)) - 8
        for k, items in self.candidates(x, first).items():
            doc = x[first[k] : ends[k]]
            _, a, b = words(texts[owner[k]])
            for i, seeds in items.items():
                for start, last, lo, hi, equal in _runs(self.places[i], doc, seeds, self.rules):
                    yield owner[k], self.ids[i], a[lo], b[hi], start, last - start + 1, equal

    def candidates(self, x: np.ndarray, first: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By text and item worth verifying, the seeds (item word, word of the text); without a seed, all of both is to be looked at."""
        if self.rules.chain < 2:  # runs so short that they needn't hold two pairs
            return {k: {i: [] for i in range(len(self.items))} for k in range(len(first))}
        by: dict[int, dict[int, list[tuple[int, int]]]] = {}
        i, p, j = self.seeds(x)
        text = np.searchsorted(first, j, side="right") - 1
        for k, i_, p_, j_ in zip(text.tolist(), i.tolist(), p.tolist(), (j - first[text]).tolist()):
            by.setdefault(k, {}).setdefault(i_, []).append((p_, j_))
        return by

    def seeds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, item word, word) wherever a chain of shared pairs has come to ``chain`` of them."""
        need = self.rules.chain
        none = np.zeros(0, np.int64)
        width = len(x) + 8
        sources, targets = [none], [none]
        for doc, item in MOVES:
            keys, start, post = self.patterns[item]
            g = _keys(x, doc)
            if not len(keys) or not len(g):
                continue
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            j = np.flatnonzero(keys[at] == g)
            at = at[j]
            n = start[at + 1] - start[at]
            j = np.repeat(j, n)
            p = post[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(len(j))].astype(np.int64)
            sources.append(p * width + j)
            targets.append((p + STEP[item]) * width + j + STEP[doc])
        src, dst = np.concatenate(sources), np.concatenate(targets)
        ends = dst
        for _ in range(need - 2):
            go = np.isin(src, ends)
            src, dst = src[go], dst[go]
            ends = dst
        ends = np.unique(ends)
        p, j = ends // width, ends % width
        owner = np.searchsorted(self.first, p, side="right") - 1
        return owner, p - self.first[owner], j


def _keys(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hash keys of the words at the offsets ``shape`` from every word; 64 bits, multiplicative."""
    n = len(x) - shape[-1]
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in shape:
        key = (key ^ x[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _places(item: np.ndarray) -> dict[int, list[int]]:
    """Where each word stands in an item; under -1 how many words it has."""
    pos: dict[int, list[int]] = {-1: [len(item)]}
    for p, v in enumerate(item.tolist()):
        pos.setdefault(v, []).append(p)
    return pos


def _runs(pos: dict[int, list[int]], doc: np.ndarray, seeds: list[tuple[int, int]], r: LeakRules) -> list[tuple[int, int, int, int, int]]:
    """Runs of at least ``min_words`` item words in the document around the seeds: (first, last item word, first, last word, equal).

    Over the equal word pairs in reach of a seed, the longest chain ends at each pair, where the next pair follows at once or
    after one word changed (both skip one), added (the document skips one) or dropped (the item skips one). Within reach of a seed (item
    word, word) a run leaves its diagonal by one for every third word at most. Without seeds every pair is looked at.
    """
    size = pos[-1][0]
    before, after = max(r.min_words, 3 * r.chain + 2), 2 + r.min_words  # a chain's first pair stands at most three words a seed before
    drift = max(before, after) // 3 + 2
    low, high = np.full(len(doc) + 1, size), np.full(len(doc) + 1, -1)
    for q, j in seeds:
        a, b = max(0, j - before), min(len(doc), j + after)
        line = np.arange(a, b) + (q - j)
        np.minimum(low[a:b], line - drift, out=low[a:b])
        np.maximum(high[a:b], line + drift, out=high[a:b])
    if not seeds:
        low[:], high[:] = 0, size
    reached = np.flatnonzero(high[: len(doc)] >= 0)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}  # pair -> (equal words, edits since a pair, first item word, first word)
    ends: dict[tuple[int, int], tuple[int, int, int]] = {}  # start -> (equal, last item word, last word)
    for j, v, lowest, highest in zip(reached.tolist(), doc[reached].tolist(), low[reached].tolist(), high[reached].tolist()):
        for p in pos.get(v, ()):
            if not lowest <= p <= highest:
                continue
            cand = best.get((p - 1, j - 1))
            found = (cand[0] + 1, 0, cand[2], cand[3]) if cand else None
            for q in ((p - 2, j - 2), (p - 1, j - 2), (p - 2, j - 1)):
                c = best.get(q)
                if c and c[1] == 0 and (found is None or c[0] + 1 > found[0]):
                    found = (c[0] + 1, 1, c[2], c[3])
            found = found or (1, 0, p, j)
            if found[1] and best.get((p - 1, j - 1)) and best[(p - 1, j - 1)][0] + 1 >= found[0]:
                c = best[(p - 1, j - 1)]
                found = (c[0] + 1, 0, c[2], c[3])
            best[(p, j)] = found
            if p - found[2] + 1 >= r.min_words and found[0] >= r.min_equal * (p - found[2] + 1):
                key = (found[2], found[3])
                if key not in ends or ends[key][0] < found[0]:
                    ends[key] = (found[0], p, j)
    out: list[tuple[int, int, int, int, int]] = []
    for (first, start), (equal, last, end) in sorted(ends.items(), key=lambda e: -e[1][0]):
        if all(end < o[2] or start > o[3] for o in out):
            out.append((first, last, start, end, equal))
    return out


def _blocks(items: DataFrame, item_id: str, text: str, chars: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """The number of blocks, and the test items in blocks of about ``chars`` characters; each is collected only when its turn comes."""
    sized = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-int(total) * 2 // chars)) if total > chars else 1
    for k in range(n):
        yield n, [(r.i, r.t) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i").collect()]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: LeakRules = LeakRules(), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start_char, end_char, item_word, n_words, n_equal``: every run of test words in a document.

    All documents are scanned whole, in one pass per block of test items, without a shuffle: the word patterns of a block are broadcast
    (``block_chars`` bounds them; test text beyond it makes further blocks) and documents with a chain of hits are verified word by
    word. Null and empty texts, and items shorter than a run, give no rows; a document that repeats gives its rows again;
    an item that leaks twice into a document gives two rows; overlapping runs of an item are reported once, the longest.
    """
    require(docs, [doc_id, text])
    require(items, [item_id, item_text])
    ship_package(docs.sparkSession)
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_char int, end_char int, item_word int, n_words int, n_equal int"
    slim = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    out = None
    for blocks, rows in _blocks(items, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex.build(rows, rules))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = shared.value
            for pdf in batches:
                ids = pdf["d"].tolist()
                found = [(ids[k], *s) for k, *s in index.search_all(pdf["t"].tolist())]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_char", "end_char", "item_word", "n_words", "n_equal"])

        part = slim.mapInPandas(scan, schema)
        if blocks > 1:  # one block at a time is held
            part = cut_lineage(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", min_left: float = 0.0) -> DataFrame:
    """``docs`` with the spans cut out of ``text``, ``n_removed`` characters each; documents with less than ``min_left`` of them left go.

    Documents without a span keep their text. Overlapping spans are cut once. Spans are grouped per document, of which there
    are at most as many as its words allow.
    """
    per = spans.groupBy(F.col("doc_id").alias("__d")).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("__s"))
    joined = docs.drop("n_removed").join(per, F.col(doc_id) == F.col("__d"), "left").drop("__d")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col(text)

    def step(acc, s):  # noqa: ANN001, ANN202
        keep = F.substring(t, acc["at"] + 1, F.greatest(s["start_char"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], keep).alias("out"), F.greatest(acc["at"], s["end_char"]).alias("at"))

    done = F.aggregate("__s", zero, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    clean = joined.withColumn("__c", F.when(F.col("__s").isNull(), t).otherwise(done))
    clean = clean.withColumn("n_removed", F.coalesce(F.length(t) - F.length("__c"), F.lit(0)))
    kept = clean.where(F.col("n_removed").isNull() | (F.col("n_removed") <= F.coalesce(F.length(t), F.lit(0)) * (1 - min_left)))
    return kept.withColumn(text, F.col("__c")).drop("__c", "__s")
