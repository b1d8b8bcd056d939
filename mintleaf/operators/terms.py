"""Terms and rules found in one pass over a text, however many there are.

``TermIndex`` holds the words of all terms as a tree: a text is cut into words once, each word asks the tree for the terms
that begin with it, and a term goes on while the next words and what stands between them fit. ``RuleIndex`` takes from each
regular expression a literal that must occur wherever it matches; one automaton over all literals tells the few patterns
that a text can match, and only these are searched, in the order of the rules. Both are built once for each Python worker,
from a table of a checked size, and get their texts in Arrow batches.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a table of terms or rules that are taken to the driver.
MOST_TERMS = 100_000
_WORD = re.compile(r"\w+")
_ASCII_WORD = re.compile(r"\w+", re.ASCII)
_SPACES = frozenset(" \t\n\x0b\f\r")


class TermIndex:
    """(term, label) pairs -> the labels of the terms in a text.

    A term is found without regard to case where no letter, digit or underscore stands right before or after it. A space in
    it stands for any white space, a hyphen for one hyphen or white space; other signs stand for themselves. With ``ascii``
    letters and digits are those of ASCII only.
    """

    def __init__(self, terms: list[tuple[str, int]], ascii: bool = False):
        self.tree: dict = {}
        self.word = _ASCII_WORD if ascii else _WORD
        for term, label in terms:
            node, last = self.tree, None
            term = term.strip().lower()
            words = list(self.word.finditer(term))
            if not words or words[0].start() or words[-1].end() < len(term):
                raise ValueError(f"a term begins and ends with a letter, digit or underscore: {term!r}")
            for word in words:
                gap = " ".join(term[last : word.start()].split(" ")) if last is not None else ""
                node = node.setdefault((" " if gap and not gap.strip() else gap, word[0]) if last is not None else word[0], {})
                last = word.end()
            node.setdefault(None, set()).add(label)
        # the gaps that may follow a word, so that only these are looked up
        self._list_gaps(self.tree)

    def _list_gaps(self, node: dict) -> None:
        gaps = {key[0] for key in node if isinstance(key, tuple)}
        if gaps:
            node[True] = sorted(gaps)
        for key, child in node.items():
            if isinstance(child, dict):
                self._list_gaps(child)

    def labels(self, text: str) -> set[int]:
        found: set[int] = set()
        text = text.lower()
        begun = self.tree.keys() & self.word.findall(text)
        for word in begun:
            found.update(self.tree[word].get(None, ()))
        # only where a term goes on after its first word, the words' places matter
        longer = {word for word in begun if True in self.tree[word]}
        if longer:
            words = list(self.word.finditer(text))
            for k, word in enumerate(words):
                if word[0] in longer:
                    self._follow(text, words, k, self.tree[word[0]], found)
        return found

    def _follow(self, text: str, words: list[re.Match], k: int, node: dict, found: set[int]) -> None:
        open_nodes = [(k, node)]
        while open_nodes:
            k, node = open_nodes.pop()
            found.update(node.get(None, ()))
            if True in node and k + 1 < len(words):
                between, following = text[words[k].end() : words[k + 1].start()], words[k + 1][0]
                for gap in node[True]:
                    child = node.get((gap, following)) if _fits(gap, between) else None
                    if child is not None:
                        open_nodes.append((k + 1, child))


def _fits(gap: str, between: str) -> bool:
    if gap == " ":
        return bool(between) and _SPACES.issuperset(between)
    if "-" not in gap and " " not in gap:
        return gap == between
    return bool(_gap_pattern(gap).fullmatch(between))


@functools.lru_cache(1024)
def _gap_pattern(gap: str) -> re.Pattern:
    space = r"[ \t\n\x0b\f\r]"
    return re.compile(rf"{space}+".join(rf"(?:{space}|-)".join(map(re.escape, part.split("-"))) for part in gap.split(" ")))


# --- rules ----------------------------------------------------------------------


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of groups and classes."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            k = _class_end(pattern, k)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def _class_end(pattern: str, k: int) -> int:
    k += 2 if pattern[k + 1 : k + 2] == "^" else 1
    k += 1  # a bracket in the first place is a member
    while pattern[k] != "]":
        k += 2 if pattern[k] == "\\" else 1
    return k


def _group_end(pattern: str, k: int) -> int:
    depth = 0
    while True:
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            k = _class_end(pattern, k)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return k
        k += 1


def _literal(branch: str) -> str:
    """The longest run of plain characters that every match of the branch holds; empty if there is none for sure."""
    runs, run, k = [""], "", 0
    while k < len(branch):
        c, single = branch[k], False
        if c == "\\":
            k += 1
            c = branch[k]
            if c.isalnum():
                if c not in "bB":
                    c = ""
                else:  # between two characters
                    k += 1
                    continue
            single = bool(c)
        elif c == "[":
            k, c = _class_end(branch, k), ""
        elif c == "(":
            k, c = _group_end(branch, k), ""
        elif c in "^$":
            k += 1
            continue
        elif c in ".":
            c = ""
        else:
            single = True
        after = branch[k + 1 : k + 2]
        if after and after in "?*{":
            runs.append(run)
            run = ""
            k = branch.index("}", k) if after == "{" else k + 1
        elif after == "+":
            runs.append(run + c if single else run)
            run = ""
            k += 1
        elif single:
            run += c
        else:
            runs.append(run)
            run = ""
        k += 1
        while branch[k : k + 1] in ("?", "+") and branch[k - 1 : k] in ("?", "*", "+", "}"):
            k += 1  # a lazy or possessive mark of a repetition
    return max([*runs, run], key=len)


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which any match of a pattern (matched without case) holds at least one; None if that can't be told."""
    whole = pattern
    while whole.startswith("(?:") and _group_end(whole, 0) == len(whole) - 1:
        whole = whole[3:-1]
    if "(?" in whole.replace("(?:", "").replace("(?=", "").replace("(?!", "").replace("(?<=", "").replace("(?<!", ""):
        return None  # flags and the like
    found = [_literal(b).lower() for b in _branches(whole)]
    return found if all(len(x) >= 2 and x.isascii() for x in found) else None


#: Lower case letters that a pattern without case takes for the letters s and i.
_ALSO_ASCII = re.compile("[ſı]")


class RuleIndex:
    """Regular expressions in order -> the first that occurs in a text, without regard to case."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns = [re.compile(p, re.IGNORECASE) for p in patterns]
        self.always: list[int] = []
        holders: dict[str, list[int]] = {}
        for k, pattern in enumerate(patterns):
            for literal in required_literals(pattern) or [""]:
                holders.setdefault(literal, []).append(k)
        self.always = holders.pop("", [])
        self.literals = ahocorasick.Automaton()
        for literal, rules in holders.items():
            self.literals.add_word(literal, rules)
        if holders:
            self.literals.make_automaton()

    def first(self, text: str) -> int | None:
        text = text.lower()
        if _ALSO_ASCII.search(text):
            able = set(range(len(self.patterns)))
        else:
            able = set(self.always)
            if len(self.literals):
                for _, rules in self.literals.iter(text):
                    able.update(rules)
        return next((k for k in sorted(able) if self.patterns[k].search(text)), None)


@functools.lru_cache(8)
def _terms(terms: tuple[tuple[str, int], ...], ascii: bool) -> TermIndex:
    return TermIndex(list(terms), ascii)


@functools.lru_cache(8)
def _rules(patterns: tuple[str, ...]) -> RuleIndex:
    return RuleIndex(list(patterns))


def term_labels(text: Column, terms: list[tuple[str, int]], ascii: bool = False) -> Column:
    """The sorted labels of the terms in a text, as an array of ints; none for null."""
    fixed = tuple(terms)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        index = _terms(fixed, ascii)
        found = [sorted(index.labels(t)) if t else () for t in texts.to_pylist()]
        offsets = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for f in found for x in f], pa.int32()))

    return find(text)


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The number of the first pattern that occurs in a text (without case), or null."""
    fixed = tuple(patterns)

    @F.arrow_udf("int")
    def find(texts: pa.Array) -> pa.Array:
        index = _rules(fixed)
        return pa.array([None if t is None else index.first(t) for t in texts.to_pylist()], pa.int32())

    return find(text)
