"""Repair of text from scanned pages.

Page furniture is known from where equal lines stand: at the edges of pages, and
there again and again. Words broken over lines are joined, across furniture and
pages. Misread words are those that a far more frequent word of the corpus
explains by one edit: all such words are retrieved by walking a trie of the
vocabulary with the Levenshtein automaton of the word (over Hangul letters, with
the glyph merges of scanners), and ranked by the counts of the word pairs they
would form with their neighbours.

The vocabulary is never broadcast whole: an edit leaves the first or the last half
of a word as it is, save two letters, so vocabulary and queries meet in buckets of
those halves and of the word's length, and every bucket has its own trie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from xxhash import xxh64_intdigest

from quirelake.llm.automaton import Automaton, Trie, jamo
from quirelake.plans.lineage import cut
from quirelake.plans.sizes import BROADCAST_ROWS, broadcast_if_small
from quirelake.sources.tables import table

PAGE = ["place", "doc_id", "ord_no"]
#: A word is a misreading of another one that is at least so many times as frequent.
RATIO = 10
#: Occurrences that make a word part of the vocabulary.
KNOWN = 3
#: Share of a word's places at which a candidate must have been seen with a neighbour.
SHARED = 0.1
#: Piece rows of vocabulary and queries that meet in one bucket.
BUCKET_ROWS = 40_000
# Letters as written and as a scanner reads them.
MERGES = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("n", "ri"), ("u", "ii"), ("h", "li"), ("m", "ni"), ("ll", "U"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("li", "h"))
MARKS = "\\-\u00ad\u2010\u2011\u2013\u00ac"
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGENO = re.compile(rf"^(?:[-–—]\s*\d{{1,4}}\s*[-–—]|\d{{1,4}}(?:\s*/\s*\d{{1,4}})?|(?:page|p\.?|쪽|페이지)\s*\d{{1,4}}(?:\s*(?:of|/)\s*\d{{1,4}})?|\d{{1,4}}\s*(?:쪽|페이지|page)|{_ROMAN})$", re.IGNORECASE)
_NUMBER, _DIGIT = re.compile(r"\d+"), re.compile(r"\d")
#: Words that a line of only a page number has at most.
PAGENO_WORDS = 4
_NUMBERED = re.compile(r"^\d{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}\d{1,4}$")
LINE = "place string, doc_id string, ord_no int, line_no int, line string, kind string, kh bigint, key string, edge int, words string, first string, head string"
_MARKS = frozenset("-\u00ad\u2010\u2011\u2013\u00ac")
#: Numbers that may be broadcast at once: 16 MB.
BROADCAST_NUMBERS = 2_000_000


def line_key(line: str) -> str:
    """A line without page number at its ends, blanks collapsed, numbers masked, case off."""
    s = line.strip()
    if s[:1].isdigit() or s[-1:].isdigit():
        s = _NUMBERED.sub("", s)
    s = " ".join(s.split())
    return (_NUMBER.sub("#", s) if _DIGIT.search(s) else s).casefold()


def bare(token: str) -> str:
    """A token without what is neither letter nor digit at its ends."""
    if token.isalnum():
        return token
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while i < j and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def page_lines(place: str, doc_id: str, ord_no: int, text: str) -> list[tuple]:
    """Every line with its kind (blank, pageno, text), its place at an edge and its tokens.

    Edges are the first (1, 2) and last (-1, -2) lines of text, page numbers and
    blanks not counted; 0 is none. A page number stands at an edge of a page,
    anywhere in a section. words: the bare tokens between single blanks. first:
    the first token as it stands. head: the last token before its mark, if the
    line ends in a broken word.
    """
    lines = text.split("\n")
    words = [x.split() for x in lines]
    filled = [i for i, w in enumerate(words) if w]
    outer = set(filled[:3] + filled[-3:])
    kind = {}
    for i in filled:
        number = len(words[i]) <= PAGENO_WORDS and (place == "section" or i in outer) and PAGENO.match(lines[i].strip())
        kind[i] = "pageno" if number else "text"
    body = [i for i in filled if kind[i] == "text"]
    edge = dict(zip(body[::-1], (-1, -2))) | dict(zip(body, (1, 2)))
    out = []
    for i, x in enumerate(lines):
        k = kind.get(i, "blank")
        if k != "text":
            out.append((place, doc_id, ord_no, i + 1, x, k, None, None, 0, None, None, None))
            continue
        key, toks, end = line_key(x), words[i], x.rstrip()
        broken = end[-1] in _MARKS and end[-2:-1].isalpha()
        head = toks[-1].rstrip("".join(_MARKS)) if broken else None
        out.append((place, doc_id, ord_no, i + 1, x, k, xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63), key, edge.get(i, 0), " ".join(map(bare, toks)), toks[0], head))
    return out


def _emit_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            out += page_lines(r.place, r.doc_id, r.ord_no, r.text)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINE.split(", ")])


def scanned_texts(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(place, doc_id, ord_no, text) of both tables, each key once, empty texts left out.

    Of rows that differ under one key the greatest text stands.
    """
    p = pages.select(F.lit("page").alias("place"), "doc_id", F.col("page_num").alias("ord_no"), "text")
    s = sections.select(F.lit("section").alias("place"), "doc_id", F.col("section_ord").alias("ord_no"), F.col("clean_text").alias("text"))
    both = p.unionByName(s).filter("doc_id is not null and ord_no is not null and text is not null and text <> ''")
    return both.groupBy(*PAGE).agg(F.max("text").alias("text"))


_PROSE = r"[.!?]$"
_FIRM = r"(?i)\b(Ltd|Inc|Co|Corp)\.$"


def running_keys(lines: DataFrame) -> DataFrame:
    """(kh, key) of running headers and footers.

    At least 9 in 10 of a key's lines stand at page edges, and it stands there in
    a document that has it twice, or five times at all; or the line in the same
    place of the next page differs in at most two letters. Only keys that stand
    at an edge at all are counted, a document first, so frequent keys are
    pre-aggregated. Sentences need five lines.
    """
    on_page = F.col("place") == "page"
    text = lines.filter("kind = 'text'")
    edges = text.filter("place = 'page' and edge <> 0").select("doc_id", "ord_no", "edge", "kh", "key")
    seen = cut(edges.select("kh").distinct())
    at = text.select("place", "doc_id", "edge", "kh").join(broadcast_if_small(seen, BROADCAST_NUMBERS), "kh", "left_semi")
    by_doc = at.groupBy("kh", "doc_id").agg(F.count_if(on_page).alias("n"), F.count_if(on_page & (F.col("edge") != 0)).alias("e"), F.count(F.lit(1)).alias("all"))
    by_key = by_doc.groupBy("kh").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max(F.when(F.col("e") > 0, F.col("all"))).alias("most"))
    at_edge = by_key.filter((F.col("n") > 0) & (F.col("e") >= 0.9 * F.col("n")))
    at_edge = cut(at_edge.join(edges.groupBy("kh").agg(F.first("key").alias("key")), "kh"))
    prose = F.col("key").rlike(_PROSE) & ~F.col("key").rlike(_FIRM)
    often = at_edge.filter((((F.col("most") >= 2) & ~prose) | (F.col("n") >= 5)) & F.col("key").rlike(r"\p{L}{2}")).select("kh", "key")
    # both lines of such a pair must be edge lines wherever they occur
    own = edges.filter("length(key) >= 8").filter(~prose).join(broadcast_if_small(at_edge.select("kh"), BROADCAST_NUMBERS), "kh", "left_semi")
    later = own.select("doc_id", (F.col("ord_no") - 1).alias("ord_no"), "edge", F.struct("kh", "key").alias("b"))
    alike = own.select("doc_id", "ord_no", "edge", F.struct("kh", "key").alias("a")).join(later, ["doc_id", "ord_no", "edge"]).filter(F.levenshtein("a.key", "b.key", 2) >= 0)
    return often.unionByName(alike.select(F.explode(F.array("a", "b")).alias("x")).select("x.*")).distinct()


def _halves(key: Column, sizes: list[Column]) -> Column:
    """Hashes of the first and the last k characters, for each k of `sizes`."""
    side = lambda k: F.array(F.xxhash64(F.lit("<"), k, F.substr(key, F.lit(1), k)), F.xxhash64(F.lit(">"), k, F.substr(key, F.length(key) - k + 1, k)))
    return F.array_distinct(F.flatten(F.array(*[side(k) for k in sizes])))


@F.pandas_udf(BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    def near(x: str, y: str) -> bool:
        trie = Trie()
        trie.add(jamo(y), y)
        return any(True for _ in trie.within(Automaton(jamo(x), 1, MERGES)))

    return pd.Series([near(x, y) for x, y in zip(a, b)], dtype="bool")


def misread_furniture(lines: DataFrame, running: DataFrame) -> DataFrame:
    """(kh, key) of lines that are one edit away from a running key.

    An edit changes at most two neighbouring characters, so the first or the last
    (n - 2) / 2 of a running key's n characters stand in its misread form. Lines
    are read in place; only those that share such a half are compared.
    """
    n = F.length("key")
    known = running.filter("length(key) >= 7").select(F.col("key").alias("right"), F.explode(_halves(F.col("key"), [F.floor((n - 2) / 2).cast("int")])).alias("half"))
    own = lines.filter("kind = 'text' and length(key) >= 8").select("kh", "key").join(broadcast_if_small(running.select("kh"), BROADCAST_NUMBERS), "kh", "left_anti")
    asked = own.select("kh", "key", F.explode(_halves(F.col("key"), [F.floor((n - d) / 2).cast("int") for d in (3, 2, 1)])).alias("half"))
    pairs = asked.join(broadcast_if_small(known), "half").filter(F.abs(n - F.length("right")) <= 1).select("kh", "key", "right").distinct()
    return pairs.filter(_one_edit("key", "right")).select("kh", "key").distinct()


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def content_lines(lines: DataFrame, running: DataFrame) -> DataFrame:
    """(place, doc_id, ord_no, line_no, words, head, tail, low, high) of text lines that are not furniture.

    head: the first half of a word broken at the end of the line. tail: the other
    half, the first token of the next content line, on the next page if the page
    ends there. Tokens from `low` up to `high` are whole.
    """
    body = lines.filter("kind = 'text'").select(*PAGE, "line_no", "kh", "words", "first", "head").join(broadcast_if_small(running.select("kh"), BROADCAST_NUMBERS), "kh", "left_anti").drop("kh")
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    body = cut(body.withColumns({"nxt": F.lead("first").over(w), "cont": F.coalesce(F.lag(F.col("head").isNotNull()).over(w), F.lit(False)), "top": F.row_number().over(w) == 1}))
    # across pages: the last line of a page meets the first one of the next
    ends = body.filter("place = 'page' and head is not null and nxt is null").select("doc_id", "ord_no", "line_no")
    tops = body.filter("place = 'page' and top").select("doc_id", (F.col("ord_no") - 1).alias("ord_no"), F.col("line_no").alias("there"), F.col("first").alias("over"))
    over = cut(ends.join(tops, ["doc_id", "ord_no"]))
    this = over.select(F.lit("page").alias("place"), "doc_id", "ord_no", "line_no", "over", F.lit(None).cast("boolean").alias("carried"))
    that = over.select(F.lit("page").alias("place"), "doc_id", (F.col("ord_no") + 1).alias("ord_no"), F.col("there").alias("line_no"), F.lit(None).cast("string").alias("over"), F.lit(True).alias("carried"))
    both = this.unionByName(that).groupBy(*PAGE, "line_no").agg(F.max("over").alias("over"), F.max("carried").alias("carried"))
    out = body.join(broadcast_if_small(both), [*PAGE, "line_no"], "left")
    cont = F.col("cont") | F.coalesce("carried", F.lit(False))
    count = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit("")))
    return out.select(*PAGE, "line_no", "words", "head", F.when(F.col("head").isNotNull(), F.coalesce("nxt", "over")).alias("tail"), cont.cast("int").alias("low"), (count - F.col("head").isNotNull().cast("int")).alias("high"))


def whole_tokens(content: DataFrame) -> DataFrame:
    """(place, doc_id, ord_no, line_no, words, pos, word) of unbroken tokens."""
    at = content.select(*PAGE, "line_no", "low", "high", "words", F.posexplode(F.split("words", " ")).alias("pos", "word"))
    return at.filter((F.col("pos") >= F.col("low")) & (F.col("pos") <= F.col("high")) & (F.col("word") != "")).drop("low", "high")


def word_pairs(content: DataFrame) -> DataFrame:
    """(word, after) of every unbroken token that is not the last of its line."""
    w = F.split("words", " ")
    at = content.select("low", "high", F.posexplode(F.arrays_zip(w.alias("word"), F.slice(w, F.lit(2), F.size(w)).alias("after"))).alias("pos", "x"))
    return at.filter((F.col("pos") >= F.col("low")) & (F.col("pos") <= F.col("high"))).select("x.word", "x.after").filter("word <> '' and after is not null")


def may_be_misread(word: Column) -> Column:
    """Words of letters, or Latin ones with one or two digits inside."""
    latin = F.length(F.regexp_replace(word, r"[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(word, r"[^0-9]", ""))
    return (F.length(word) >= 2) & word.rlike(r"\p{L}{2}|\p{L}\d\p{L}") & ((digits == 0) | ((digits <= 2) & (latin >= 3) & ~word.rlike(r"[가-힣]")))


def _half_pieces(word: str, lengths: tuple[int, ...]) -> set[str]:
    """First and last (n - 2) / 2 letters of words of n letters that `word` may come from."""
    out = set()
    for n in lengths:
        k = max(1, (n - 2) // 2)
        out |= {f"<{n} {word[:k]}", f">{n} {word[-k:]}"}
    return out


def _pieces(query: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, n in zip(pdf["word"], pdf["n"]):
                j = jamo(w)
                m = len(j)
                out += [(p, w, n) for p in _half_pieces(j, (m - 1, m, m + 1) if query else (m,))]
            yield pd.DataFrame(out, columns=["piece", "word", "n"])

    return run


def retrieve(vocabulary: DataFrame, queries: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, cand, cand_n): for each query all vocabulary words within one edit.

    Both inputs are (word, n). An entry is kept if it is `ratio` times as frequent
    as the query; queries too frequent for any entry are left out at once.
    """
    kind = "piece string, word string, n bigint"
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    queries = queries.filter(F.greatest(F.col("n"), F.lit(1)) * ratio <= most)
    v = vocabulary.mapInPandas(_pieces(False), kind)
    q = queries.mapInPandas(_pieces(True), kind)
    buckets = max(16, (2 * vocabulary.count() + 4 * queries.count()) // BUCKET_ROWS)
    b = F.pmod(F.xxhash64("piece"), F.lit(buckets)).alias("b")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in {(w, n) for w, n in zip(left["word"], left["n"])}:
            trie.add(jamo(w), (w, n))
        out = []
        for w, n in {(w, n) for w, n in zip(right["word"], right["n"])}:
            for _, (c, cn) in trie.within(Automaton(jamo(w), 1, MERGES)):
                if c != w and cn >= ratio * max(1, n):
                    out.append((w, c, cn))
        return pd.DataFrame(out, columns=["word", "cand", "cand_n"])

    met = v.select("word", "n", b).groupBy("b").cogroup(q.select("word", "n", b).groupBy("b")).applyInPandas(walk, "word string, cand string, cand_n bigint")
    return met.distinct()


def rank_in_context(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """`seen` with one candidate a place: most pairs with its neighbours, then most frequent.

    `seen` has the place, before, after, cand and cand_n; `pairs` (word, after) are
    counted over all tokens, but only those that some candidate would form. A word
    of KNOWN places that hardly ever stands between the neighbours of a candidate
    (less than SHARED of its places) is a word of its own and no misreading of it.
    """
    key = [*PAGE, "line_no", "pos"]
    asked = seen.select(*key, "cand", F.explode(F.array(F.struct(F.col("before").alias("word"), F.col("cand").alias("after")), F.struct(F.col("cand").alias("word"), "after"))).alias("x")).select(*key, "cand", "x.*").filter("word is not null and after is not null")
    need = cut(asked.select("word", "after").distinct())
    have = pairs.join(broadcast_if_small(need, 4 * BROADCAST_ROWS), ["word", "after"], "left_semi").groupBy("word", "after").agg(F.count(F.lit(1)).alias("c"))
    score = asked.join(have, ["word", "after"]).groupBy(*key, "cand").agg(F.sum("c").alias("c"))
    scored = cut(seen.select(*key, "word", "cand", "cand_n").join(score, [*key, "cand"], "left"))
    own = scored.groupBy("word", "cand").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("k")).filter((F.col("n") >= KNOWN) & (F.col("k") < SHARED * F.col("n"))).select("word", "cand")
    scored = scored.join(broadcast_if_small(own), ["word", "cand"], "left_anti")
    best = scored.groupBy(*key, "word").agg(F.max(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "cand_n", "cand")).alias("b"))
    return best.select(*key, "word", F.col("b.cand").alias("right"))


class Repairs:
    """What was found in the texts: lines, running keys, content, words put right."""

    def __init__(self, pages: DataFrame, sections: DataFrame) -> None:
        texts = scanned_texts(pages, sections)
        self.lines = cut(texts.mapInPandas(_emit_lines, LINE))
        clean = cut(running_keys(self.lines))
        self.running = cut(clean.unionByName(misread_furniture(self.lines, clean)).distinct())
        content = cut(content_lines(self.lines, self.running))
        tokens = whole_tokens(content)  # narrow passes over the lines cost less than a stored row a token
        counts = cut(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(may_be_misread(F.col("word"))))
        vocabulary = counts.filter((F.col("n") >= KNOWN) & ~F.col("word").rlike(r"\d"))
        breaks = cut(content.filter("head is not null and tail is not null").select(*PAGE, "line_no", _strip(F.concat("head", "tail")).alias("joined"), _strip(F.concat(F.col("head"), F.lit("-"), F.col("tail"))).alias("dashed")))
        joined = breaks.select(F.col("joined").alias("word")).distinct().join(counts.select("word"), "word", "left_anti").withColumn("n", F.lit(0).cast("long"))
        cands = cut(retrieve(vocabulary, counts.unionByName(joined)))
        # misread words in place
        w = F.split("words", " ")
        seen = tokens.join(broadcast_if_small(cands), "word")
        seen = seen.withColumns({"before": F.when(F.col("pos") > 0, F.try_element_at(w, F.col("pos"))), "after": F.try_element_at(w, F.col("pos") + 2)}).drop("words")
        self.fixed = cut(rank_in_context(cut(seen), word_pairs(content)))
        # broken words: as joined if known, with the mark if that is known, else put right
        known = counts.select("word", "n")
        best = cands.groupBy("word").agg(F.max(F.struct("cand_n", "cand")).alias("c")).select("word", F.col("c.cand").alias("cand"), F.col("c.cand_n").alias("cand_n"))
        b = breaks.join(known.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(known.select(F.col("word").alias("dashed"), F.col("n").alias("nd")), "dashed", "left").join(best.withColumnRenamed("word", "joined"), "joined", "left")
        nj, nd = F.coalesce("nj", F.lit(0)), F.coalesce("nd", F.lit(0))
        word = F.when((nd > nj) & (nd > 0), F.col("dashed")).when(F.col("cand").isNotNull(), F.col("cand")).otherwise(F.col("joined"))
        self.joins = cut(b.select(*PAGE, "line_no", word.alias("word")))
        self.content = content

    def found(self) -> DataFrame:
        """(place, doc_id, ord_no, line_no, noise, word) of every flaw, once each."""
        at = [*PAGE, "line_no"]
        kind = lambda df, noise, word: df.select(*at, F.lit(noise).alias("noise"), word.alias("word"))
        run = self.lines.filter("kind = 'text'").join(broadcast_if_small(self.running.select("kh"), BROADCAST_NUMBERS), "kh", "left_semi")
        out = kind(run, "running", F.lit(""))
        out = out.unionByName(kind(self.lines.filter("kind = 'pageno'"), "pageno", F.lit("")))
        out = out.unionByName(kind(self.joins, "hyphen", F.col("word")))
        # a line is running, a page number or broken once; only words put right may repeat in it
        return out.unionByName(kind(self.fixed, "char", F.col("right")).distinct())

    def paragraphs(self) -> DataFrame:
        """(place, doc_id, ord_no, para_no, text): continuous paragraphs of each page.

        Furniture is gone, words are whole and put right. A blank line ends a
        paragraph, unless only furniture stands between its halves and the first
        half is not a finished sentence. A word broken over pages stands on the
        page where it begins.
        """
        at = [*PAGE, "line_no"]
        fixes = self.fixed.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "right"))).alias("fix"))
        whole = self.content.select(*at, F.lit(True).alias("text"), (F.col("low") > 0).alias("cont"), F.col("head").isNotNull().alias("hyph"))
        rows = self.lines.filter("kind <> 'pageno'").select(*at, "kind", "line").join(whole, at, "left").filter("text or kind = 'blank'")
        rows = rows.join(fixes, at, "left").join(self.joins.withColumnRenamed("word", "whole"), at, "left")
        per_page = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_no", F.when(F.col("text"), F.col("line")).alias("line"), "cont", "hyph", "fix", "whole"))).alias("rows"))
        return per_page.mapInPandas(_reflow, "place string, doc_id string, ord_no int, para_no int, text string")


def _reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for place, doc, ord_no, rows in zip(pdf["place"], pdf["doc_id"], pdf["ord_no"], pdf["rows"]):
            paras, words = [], []
            for r in rows:
                if r["line"] is None:
                    if words and re.search(r"[.!?:。]['\"”’)]?$", words[-1]):
                        paras.append(" ".join(words))
                        words = []
                    continue
                toks = r["line"].split()
                for f in r["fix"] if r["fix"] is not None else ():
                    toks[f["pos"]] = toks[f["pos"]].replace(f["word"], f["right"])
                if r["whole"] is not None and r["hyph"]:
                    toks[-1] = r["whole"]
                if r["cont"]:
                    # the half stands with its word; its end mark stays
                    end = re.search(r"[^\w]+$", toks[0])
                    toks = toks[1:]
                    if end and words:
                        words[-1] += end.group(0)
                words += toks
            if words:
                paras.append(" ".join(words))
            out += [(place, doc, ord_no, k, p) for k, p in enumerate(paras)]
        yield pd.DataFrame(out, columns=["place", "doc_id", "ord_no", "para_no", "text"])


def repairs(spark, sf_dir: str) -> Repairs:
    return Repairs(table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "doc_sections"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return repairs(spark, sf_dir).found()


def p4_paragraphs(spark, sf_dir: str) -> DataFrame:
    return repairs(spark, sf_dir).paragraphs()
