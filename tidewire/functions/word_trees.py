"""One search pattern for a long list of words: a prefix tree written as nested groups.

A plain alternation is tried word by word at each place of a text; the tree is tried letter by letter, so the
time doesn't grow with the number of words. What it matches stays the same: of the words that fit at a
place, the one that comes first in the list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

END = ""


def same_letter(letter: str) -> str:
    """One spelling for all letters that a search without regard to case takes for equal."""
    upper = letter.upper()
    lower = (upper if len(upper) == 1 else letter).lower()
    return lower[0] if lower else letter


def _tree(words: list[str], first_wins: bool) -> dict:
    root: dict = {}
    for word in words:
        node, shorter = root, False
        for letter in word:
            shorter = shorter or (first_wins and END in node)
            node = node.setdefault(same_letter(letter), {})
        if not shorter:    # else an earlier word always matches first
            node[END] = {}
    return root


def _written(letter: str) -> str:
    return letter if letter.isalnum() or ord(letter) > 127 else f"\\x{{{ord(letter):x}}}"


def _pattern(root: dict) -> str:
    """Nodes are written from the leaves up, so words of any length are no matter of recursion."""
    done: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(child, False) for key, child in node.items() if key != END]
            continue
        branches = [_written(key) + done[id(child)] for key, child in node.items() if key != END and done[id(child)] is not None]
        if not branches:
            done[id(node)] = "" if END in node else None
        elif len(branches) == 1 and END not in node:
            done[id(node)] = branches[0]
        else:
            done[id(node)] = f"(?:{'|'.join(branches)}){'?' if END in node else ''}"
    return done[id(root)] or ""


def factored(words: list[str], first_wins: bool = True) -> str:
    """A pattern, to be used without regard to case, that finds what ``word1|word2|..`` finds.

    ``first_wins=False`` is for a pattern that goes on after the words, such as a word border: there any of the
    words may turn out to fit, so none is left out.
    """
    if first_wins and "" in words:    # matches everywhere, before all words after it
        before = words[: words.index("")]
        return f"(?:{_pattern(_tree(before, True))})?" if before else ""
    return _pattern(_tree(words, first_wins))


def word_tree(words: Column, first_wins: bool = True) -> Column:
    """``factored`` of an array column; null words are left out. For tables of one row per list.

    It maps single batches: all lists of a row then share one Python worker of their task, where functions of iterators
    would each take their own.
    """

    @F.pandas_udf("string")
    def build(lists: pd.Series) -> pd.Series:
        return pd.Series([factored([w for w in ws if w is not None], first_wins) for ws in lists], dtype=object)

    return build(words)
