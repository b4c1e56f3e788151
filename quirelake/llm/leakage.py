"""Evaluation passages inside a training corpus.

Both sides are brought to words in one form (compatibility forms, case,
look-alikes, ignorables and punctuation removed) joined by single spaces. By the
q-gram lemma a passage of L characters with at most e edits shares at least
L - q + 1 - q * e q-grams with its copy, all within a diagonal band of e. Hits
of a document are counted in overlapping diagonal bands, bands under the bound
are dropped, and what is left is verified by a banded alignment.

The items are cut into blocks of bounded size, each a sorted q-gram index. A task
reads its documents once, in place and without a shuffle, holds a bounded part of
them in comparable form, and goes through the blocks with it, one index at a time.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.lookalike import FILLERS, LOOKS
from quirelake.sources.tables import table

Q = 6
#: Edits allowed inside a passage before the exact check.
EDITS = 1
WORDS = 10
#: Characters of item text held by a task at once; more items are searched in more blocks.
BLOCK_CHARS = 4_000_000
#: Characters of documents that a task holds while it goes through the blocks, if there is more than one.
HELD_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")
_LOOKS = str.maketrans(LOOKS)
_PRIME = np.uint64(1_000_003)


class _Ignorable(dict):
    def __missing__(self, c: int):
        s = chr(c)
        gone = unicodedata.category(s) == "Cf" or s in FILLERS or 0xFE00 <= c <= 0xFE0F
        self[c] = None if gone else c
        return self[c]


_DROP = _Ignorable()


def _comparable(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(_DROP)).translate(_LOOKS)


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    """For each code point whether it is dropped or read as another letter; most texts have no such."""
    odd = np.array([_comparable(c) != unicodedata.normalize("NFKC", c) for c in map(chr, range(sys.maxunicode + 1))])
    _DROP.clear()
    return odd


def words(text: str) -> list[str]:
    """The runs of letters and digits of `text` in comparable form."""
    if not text.isascii():
        text = _comparable(text) if _odd()[codes_of(text)].any() else unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def plain(text: str | None) -> str:
    """Words joined and surrounded by single spaces, so words are equal only as a whole."""
    return " " + " ".join(words(text)) + " " if text else " "


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that begins at each position."""
    n = max(0, len(codes) - Q + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        h = h * _PRIME + codes[k : k + n].astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: Postings that are sorted into bands at once.
POSTINGS = 400_000
#: Bins, less one, in which hits are counted before they are sorted.
BINS = (1 << 21) - 1


class ItemIndex:
    """Postings of the q-grams of a block of items: hash -> (item, position)."""

    def __init__(self, items: list[tuple[int, str]], edits: int = EDITS, min_words: int = WORDS) -> None:
        self.edits, self.min_words = edits, min_words
        self.ids, self.texts, bounds = [], [], []
        hashes, owner, pos = [], [], []
        for item_id, text in items:
            w = words(text or "")
            if len(w) < min_words:
                continue
            t = " " + " ".join(w) + " "
            sizes = np.cumsum([0] + [len(x) + 1 for x in w])
            shortest = int((sizes[min_words:] - sizes[:-min_words]).min()) + 1
            c = codes_of(t)
            h = qgrams(c)
            owner.append(np.full(len(h), len(self.ids)))
            pos.append(np.arange(len(h)))
            hashes.append(h)
            self.ids.append(item_id)
            self.texts.append(c)
            bounds.append(max(1, shortest - Q + 1 - Q * edits))
        self.bound = np.array(bounds, dtype=np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if hashes else np.zeros(0, np.int64)
        self.unique, self.first = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.hash)))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that occur in the index, their place among the unique hashes)."""
        if not len(self.unique):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.unique, h)
        at[at == len(self.unique)] = 0
        hit = np.flatnonzero(self.unique[at] == h)
        return hit, at[hit]

    def bands(self, doc: np.ndarray, p: np.ndarray, u: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, first diagonal, diagonals, from, to) of the bands that meet the bound.

        Hits of many documents at once: document, position, place among the unique
        hashes. A band spans 2 * width diagonals and begins at every multiple of
        width, so some band holds all diagonals of a passage with at most `edits`
        edits. Two bands next to each other that hold the same hits are given as one.
        """
        n = self.count[u]
        total = int(n.sum())
        if not total:
            return []
        start = np.repeat(self.first[u] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
        docs, where, items, pos = np.repeat(doc, n), np.repeat(p, n), self.owner[start], self.pos[start]
        width = self.edits + 1
        cell = np.floor_divide(where - pos, width)
        # few hits lie in a band that can meet the bound: the rest goes before the sort (bins may be shared, which keeps more)
        bins = (docs * np.int64(1_000_003) + items) * np.int64(7_919) + cell
        often = np.bincount(bins & BINS, minlength=BINS + 2)
        here = often[bins & BINS]
        some = here + np.maximum(often[(bins + 1) & BINS], often[(bins - 1) & BINS]) >= self.bound[items]
        docs, where, items, cell = docs[some], where[some], items[some], cell[some]
        if not len(docs):
            return []
        docs, items, where, keys = np.tile(docs, 2), np.tile(items, 2), np.tile(where, 2), np.concatenate([cell, cell - 1])
        order = np.lexsort((where, keys, items, docs))
        docs, items, keys, where = docs[order], items[order], keys[order], where[order]
        start_of = np.append(True, (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (keys[1:] != keys[:-1]))
        new, band = np.flatnonzero(start_of), np.cumsum(start_of) - 1
        # an edit takes away at most q neighbouring q-grams, so `bound` hits of a passage lie close
        need = self.bound[items]
        at = np.arange(len(items)) + need - 1
        ok = at < len(items)
        at[~ok] = 0
        ok &= (band[at] == band) & (where[at] - where <= need - 1 + (Q + 1) * self.edits)
        keep = np.zeros(len(new), dtype=bool)
        keep[band[ok]] = True
        size = np.diff(np.append(new, len(items)))
        first, last = new[keep], (new + size - 1)[keep]
        size = size[keep]
        out: list[tuple[int, int, int, int, int, int]] = []
        before = None
        for d, i, k, lo, hi, m in zip(docs[first].tolist(), items[first].tolist(), keys[first].tolist(), where[first].tolist(), where[last].tolist(), size.tolist()):
            if before == (d, i, k - 1, lo, hi, m):
                d0, i0, low, wide, *ends = out.pop()
                out.append((d0, i0, low, wide + width, *ends))
                before = None
            else:
                out.append((d, i, k * width, 2 * width, lo, hi + Q))
                before = (d, i, k, lo, hi, m)
        return out

    def align(self, doc: np.ndarray, item: int, low: int, wide: int, a: int, b: int) -> tuple[int, int]:
        """(exact words, words within the edit budget) in one diagonal band.

        For every diagonal of the band the equal runs are found; all runs at once are
        extended over an edit to the same diagonal (substitution) or a neighbour
        (insertion, deletion) as long as the budget lasts.
        """
        it = self.texts[item]
        a, b = max(0, a - 64), min(len(doc), b + 64)
        n = b - a
        # one diagonal of no match on either side, one place behind the end
        at = np.arange(a, b)[None, :] - (low + np.arange(-1, wide + 1))[:, None]
        inside = (at >= 0) & (at < len(it))
        inside[0] = inside[-1] = False
        equal = np.zeros((wide + 2, n + 2), dtype=bool)
        equal[:, :n] = inside & (it[np.where(inside, at, 0)] == doc[a:b][None, :])
        place = np.arange(n + 2)
        stop = np.minimum.accumulate(np.where(equal, n + 2, place)[:, ::-1], axis=1)[:, ::-1]
        run = np.where(equal, stop - place, 0)  # length of the equal run that begins here
        spaces = np.append(0, np.cumsum(doc[a:b] == np.uint32(32)))
        opens = equal.copy()
        opens[:, 1:] &= ~equal[:, :-1]
        k, p = np.nonzero(opens)
        if not len(k):
            return 0, 0
        end = p + run[k, p]
        exact = int((spaces[np.minimum(end, n)] - spaces[p]).max()) - 1
        reach, kk, pp = end, k[:, None], end[:, None]
        for _ in range(self.edits):
            kk = np.concatenate([kk, kk - 1, kk + 1], axis=1)
            pp = np.concatenate([pp + 1, pp, pp + 1], axis=1)
            ok = (kk >= 1) & (kk <= wide) & (pp <= n)
            kk, pp = np.clip(kk, 0, wide + 1), np.minimum(pp, n + 1)
            pp = np.where(ok, pp + run[kk, pp], pp)
            reach = np.maximum(reach, np.where(ok, pp, 0).max(axis=1))
            kk = np.where(ok, kk, 0)
        near = int((spaces[np.minimum(reach, n)] - spaces[p]).max()) - 1
        return max(exact, 0), max(near, exact, 0)


class Passage:
    """Documents in comparable form with the q-gram hashes of all their places; made once for all item blocks."""

    def __init__(self, batch: pd.DataFrame) -> None:
        self.ids = batch["doc_id"].tolist()
        self.docs = [codes_of(plain(t)) for t in batch["text"]]
        self.starts = np.append(0, np.cumsum(np.array([len(d) for d in self.docs], dtype=np.int64)))
        whole = np.concatenate(self.docs) if self.docs else np.zeros(0, np.uint32)
        self.hash = qgrams(whole)

    def search(self, index: ItemIndex) -> list[tuple]:
        """(doc_id, item_id, exact_words, near_words) of the verified pairs."""
        hit, place = index.lookup(self.hash)
        if not len(hit):
            return []
        starts, n = self.starts, len(self.docs)
        owner = np.searchsorted(starts, hit, side="right") - 1
        inside = hit + Q <= starts[owner + 1]
        hit, place, owner = hit[inside], place[inside], owner[inside]
        some = (np.bincount(owner, minlength=n) >= int(index.bound.min()))[owner]
        hit, place, owner = hit[some], place[some], owner[some]
        # documents in groups of bounded postings; a document is never cut
        group = (np.cumsum(np.bincount(owner, weights=index.count[place], minlength=n)) // POSTINGS).astype(np.int64)[owner]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for g in np.unique(group):
            own = group == g
            o = owner[own]
            for d, item, low, wide, p, q in index.bands(o, hit[own] - starts[o], place[own]):
                exact, near = index.align(self.docs[d], item, low, wide, p, q)
                e, m = best.get((d, item), (0, 0))
                best[d, item] = (max(e, exact), max(m, near))
        return [(self.ids[d], index.ids[item], e, m) for (d, item), (e, m) in best.items() if m >= index.min_words]


def scan(batch: pd.DataFrame, index: ItemIndex) -> list[tuple]:
    return Passage(batch).search(index)


def leaks(docs: DataFrame, items: DataFrame, edits: int = EDITS, min_words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, exact_words, near_words) of every document that holds a passage.

    exact_words is the longest run of the item's words found unchanged, near_words
    the longest within `edits` character edits; near_words is at least `min_words`.
    Items with fewer words, null texts and null ids give nothing; repeated
    documents count once.
    """
    spark = docs.sparkSession
    known = items.filter("item_id is not null and text is not null")
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_chars))
    id_type = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {id_type}, exact_words int, near_words int"
    shared = []
    for k in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").distinct()
        shared.append(spark.sparkContext.broadcast([tuple(r) for r in own.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes: dict[int, ItemIndex] = {}

        def found(passages: list[Passage]) -> Iterator[pd.DataFrame]:
            for k, items_of in enumerate(shared):
                if k not in indexes:
                    indexes.clear()  # one index is held at a time
                    indexes[k] = ItemIndex(items_of.value, edits, min_words)
                for p in passages:
                    yield pd.DataFrame(p.search(indexes[k]), columns=["doc_id", "item_id", "exact_words", "near_words"])

        held, size = [], 0
        for pdf in batches:
            held.append(Passage(pdf))
            size += int(held[-1].starts[-1])
            if size >= HELD_CHARS or blocks == 1:
                yield from found(held)
                held, size = [], 0
        yield from found(held)

    out = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max("near_words").alias("near_words"))


def p7_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter(F.col("exact_words") >= WORDS).select("doc_id", "item_id")


def p7_items(spark, sf_dir: str) -> DataFrame:
    """(item_id, documents, longest) for every item, leaked or not."""
    n = p7_leaks(spark, sf_dir).filter(F.col("exact_words") >= WORDS).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("exact_words").alias("longest"))
    items = table(spark, sf_dir, "eval_items").select("item_id").filter("item_id is not null").distinct()
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
