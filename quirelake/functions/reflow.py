"""Hard-wrapped text joined into paragraphs.

A text is read word by word into paragraphs. Some words open a paragraph of their
own (article numbers, notes), some an item of a list; every other line goes on
with the paragraph before it unless that one is finished or full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters from which on a paragraph takes no more lines.
FULL = 80
# Signs of a list, of a note, and of a finished sentence.
SYLLABLES = "가나다라마바사아자차카타파하"
NOTE = "[주]"
CLOSED = (".", ")", "]", ":", '다"', "것")


def is_article(word: str) -> bool:
    """Whether the word is a section number of three parts."""
    parts = word.split("-")
    return len(parts) == 3 and all(p.isdecimal() for p in parts)


def is_item(word: str) -> bool:
    """Whether a line that begins with this word is an item of a list."""
    return word[0] in SYLLABLES and word[1:2] == "." or "①" <= word[0] <= "⑳" or word.startswith(NOTE) or re.match(r"\d+[-.]", word) is not None


def is_inner_item(word: str) -> bool:
    """Whether the word opens an item in the middle of a line, after a closed sentence."""
    head = word[:-1]
    return "①" <= word[0] <= "⑳" or word[-1] == "." and (head.isdecimal() or len(head) == 1 and head in SYLLABLES)


def is_ending(word: str) -> bool:
    """Whether the word is the torn-off end of a Korean predicate."""
    core = word.rstrip(".,\\")
    return 0 < len(core) <= 3 and core[-1] == "다" and all("가" <= c <= "힣" for c in core)


def pieces(line: str, names: frozenset[str]) -> Iterator[tuple[bool, str]]:
    """(whether a paragraph begins, words) of the parts of a line."""
    words, fresh = [], False
    for w in line.split():
        opens = is_article(w) or w.startswith(NOTE) or (w in names and not words)
        if words and (opens or is_inner_item(w) and words[-1][-1] in "다.)]"):
            yield fresh, " ".join(words)
            words = []
        if not words:
            fresh = opens
        words.append(w)
    yield fresh, " ".join(words)


def reflow_text(text: str, division_names: tuple[str, ...] = ()) -> str:
    """Lines joined unless one begins a list item, the one before ends a sentence, or the
    joined line has already 80 characters; at most one blank line; double blanks out.

    `division_names` are headings: a line that is one stands on its own.
    """
    names = frozenset(division_names)
    out: list[str] = []
    alone = True
    for line in text.split("\n"):
        for fresh, part in pieces(line, names):
            last = out[-1] if out else ""
            heading = part in names
            if part and last and "가" <= last[-1] <= "힣" and is_ending(part.split(" ", 1)[0]) and not alone:
                out[-1] = last + part
            elif not part or not last or alone or heading or fresh or is_item(part) or last.endswith(CLOSED) or len(last) >= FULL:
                if last and (fresh or heading):
                    out.append("")
                if part or last:
                    out.append(part)
            else:
                out[-1] = f"{last} {part}"
            alone = heading
    return "\n".join(out).strip()


def reflow(text: Column, division_names: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else reflow_text(t, division_names))

    return run(text)
