"""Many phrase patterns over one text, met in one scan of it.

A scan finds every place where any of the patterns begins and keeps the text from there on, as far as the longest
pattern can reach. Each pattern is then tested at the start of these short excerpts only, so overlapping phrases and
phrases of several patterns at one place are all kept.

That holds for patterns of the form ``\\b(...)`` made of literals, groups, choices, optional parts and sets of
characters: they begin with a word and cannot match more characters than they are written with. Any other
pattern is matched on the text itself, with the same result.

Where most patterns are not in a text, ``met`` and ``first`` are cheaper: a pattern is looked for only in texts that
contain one of the fixed texts which every match of it has, and a text is searched for these byte by byte.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from parcelscope.functions import text as X

PART = r"[^\\\[\](){}*+.^$]|\\[bs]|\((?:\?:)?(?!\?)|\)|\[[^\]\\^]+\]"
BOUNDED = re.compile(rf"\\b\((?:\?:)?(?!\?)(?:{PART})+")
UNIT = re.compile(PART)
WORD = re.compile("[a-z0-9_]", re.IGNORECASE)


def _choices(body: str) -> list[str]:
    """The alternatives of a pattern outside its groups."""
    depth, out = 0, [""]
    for unit in UNIT.findall(body):
        depth += unit.startswith("(") - (unit == ")")
        if unit == "|" and not depth:
            out.append("")
        else:
            out[-1] += unit
    return out


def bounded(pattern: str) -> bool:
    """Whether a pattern can be met by excerpts: one group after a word boundary, each choice in it beginning with a letter or digit."""
    if not BOUNDED.fullmatch(pattern) or len(_choices(pattern)) > 1:
        return False
    depth = 0
    for at, unit in enumerate(UNIT.findall(pattern)[1:], 1):
        depth += unit.startswith("(") - (unit == ")")
        if not depth:
            break
    group = UNIT.findall(pattern)[1 : at + 1]
    if group[-1] != ")":
        return False
    inner = re.sub(r"^\((\?:)?", "", "".join(group[:-1]))
    optional = "".join(UNIT.findall(pattern)[at + 1 :]).startswith("?")
    return not optional and all(WORD.match(c) and not c[1:].startswith("?") for c in _choices(inner))


def _literal(choice: str) -> str:
    """The longest text that every match of a choice contains; empty if none is known."""
    runs, units = [""], UNIT.findall(choice)
    if "|" in units or any(u.startswith("(") for u in units):
        return ""
    for unit, after in zip(units, [*units[1:], ""], strict=True):
        if len(unit) > 1 or unit == "?" or after == "?":
            runs.append("")
        else:
            runs[-1] += unit
    return max(runs, key=len)


def found(text: Column, pattern: str) -> Column:
    """As ``rlike`` of the pattern with Unicode word characters; its choices are first looked for by their fixed text."""
    if not re.fullmatch(f"(?:{PART})+", pattern):
        return text.rlike("(?U)" + pattern)
    hit = F.lit(False)
    for choice in _choices(pattern):
        fixed = _literal(choice)
        if fixed == choice and fixed:
            hit = hit | text.contains(fixed)
        else:
            hit = hit | (text.contains(fixed) & text.rlike("(?U)" + choice))
    return hit


TOKEN = re.compile(r"\\.|\[[^\]]*\]|\((?:\?:)?|\)|\||[?*+]|\{\d+(?:,\d*)?\}|.", re.DOTALL)
ANCHORS = (r"\b", r"\B")
CLASSES = (r"\s", r"\S", r"\d", r"\D", r"\w", r"\W")


def _parsed(pattern: str) -> list[list[tuple]] | None:
    """The alternatives of a pattern, each a list of (kind, content, least number of times); None if it has other syntax."""
    tokens, at = TOKEN.findall(pattern), 0

    def read(inside: bool) -> list[list[tuple]] | None:
        nonlocal at
        out: list[list[tuple]] = [[]]
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == ")":
                return out if inside else None
            if token == "|":
                out.append([])
            elif token[0] == "(":
                if tokens[at : at + 1] == ["?"] or (body := read(True)) is None:
                    return None
                out[-1].append(("group", body, 1))
            elif token[0] == "[" and len(token) > 1:
                if "[" in token[1:] or "&&" in token:
                    return None
                out[-1].append(("gap", token, 1))
            elif token in ANCHORS:
                out[-1].append(("anchor", token, 1))
            elif token in CLASSES or token == ".":
                out[-1].append(("gap", token, 1))
            elif token[0] in "?*+{" and out[-1] and out[-1][-1][0] in ("text", "gap", "group"):
                kind, content, _ = out[-1].pop()
                if tokens[at : at + 1] and tokens[at][0] in "?*+{":
                    return None
                least = 0 if token[0] in "?*" or token.startswith(("{0,", "{0}")) else 1
                out[-1].append(("gap" if kind == "text" else kind, content, least))
            elif len(token) == 1 and token not in "\\[](){}*+?.^$":
                out[-1].append(("text", token, 1))
            else:
                return None
        return None if inside else out

    return read(False)


def _fixed(choices: list[list[tuple]]) -> set[str] | None:
    """Texts of which each match of any of the choices contains one: of each choice the longest run, or those of a group in it."""
    out: set[str] = set()
    for items in choices:
        runs, known = [""], []
        for kind, content, least in items:
            if kind == "text":
                runs[-1] += content
            elif kind != "anchor":
                runs.append("")
                if kind == "group" and least and (inner := _fixed(content)):
                    known.append(inner)
        known += [{run} for run in runs if len(run) > 1]
        if not known:
            return None
        out |= max(known, key=lambda k: (min(map(len, k)), -len(k)))
    return out


def fixed_texts(pattern: str) -> list[str]:
    """Texts of which every match of a pattern contains one; empty if none are known."""
    choices = _parsed(pattern)
    texts = (_fixed(choices) if choices else None) or set()
    return sorted(t for t in texts if not any(o != t and o in t for o in texts))


def _initials(choices: list[list[tuple]]) -> set[str] | None:
    """The characters that a match of the choices may begin with; None if they are not known."""
    out: set[str] = set()
    for items in choices:
        kind, content, least = next((i for i in items if i[0] != "anchor"), ("", "", 0))
        if kind == "text":
            out.add(content)
        elif kind == "group" and least and (inner := _initials(content)):
            out |= inner
        else:
            return None
    return out


def quick(pattern: str) -> str:
    """The pattern with Unicode word characters, tried only where one of its first letters is."""
    choices = _parsed(pattern)
    initials = _initials(choices) if choices else None
    if not initials or not all(WORD.match(c) for c in initials):
        return "(?U)" + pattern
    return f"(?U)(?=[{''.join(sorted(initials))}])(?:{pattern})"


def _split(pattern: str) -> tuple[list[str], str]:
    """The choices of a ``bounded`` pattern's group, and what follows the group."""
    depth, units = 0, UNIT.findall(pattern)
    for at, unit in enumerate(units[1:], 1):
        depth += unit.startswith("(") - (unit == ")")
        if not depth:
            break
    return _choices(re.sub(r"^\((\?:)?", "", "".join(units[1:at]))), "".join(units[at + 1 :])


def _led(choice: str, rest: str) -> str:
    """A choice after a word boundary, its literal beginning put first, as Java looks for that by skipping."""
    head = re.match(r"[a-z0-9 ]*", choice).group()
    if choice[len(head) :].startswith("?"):
        head = head[:-1]
    return rf"(?U){head}(?<=\b{head}){choice[len(head):]}{rest}" if head else rf"(?U)\b(?:{choice}){rest}"


class Phrases:
    """Named patterns over lower-case text; ``excerpts`` once a text, then ``has`` and ``evidence`` by name."""

    def __init__(self, patterns: dict[str, str]):
        self.patterns = patterns
        self.short = [n for n, p in patterns.items() if bounded(p)]
        self.reach = max((len(patterns[n]) for n in self.short), default=0) + 2  # and a look at what follows

    def excerpts(self, text: Column) -> Column:
        """Array of the texts from each place on where a bounded pattern begins."""
        if not self.short:
            return F.array().cast("array<string>")
        begins = "|".join(self.patterns[n].removeprefix(r"\b") for n in self.short)
        place = rf"(?U)(?<![a-z0-9_])\b(?={begins})(?=([\s\S]{{0,{self.reach}}}))"
        return F.regexp_extract_all(text, F.lit(place), F.lit(re.compile(begins).groups + 1))

    def _first(self, name: str) -> str | None:
        return rf"(?U)\A{self.patterns[name]}" if name in self.short else None

    def has(self, name: str, text: Column, excerpts: Column) -> Column:
        """As ``text.has``: whether the pattern is in the text."""
        start = self._first(name)
        if start is None:
            return X.has(text, self.patterns[name])
        return F.coalesce(F.exists(excerpts, lambda e: e.rlike(start)), F.lit(False))

    def words(self, name: str, text: Column, excerpts: Column) -> Column:
        """The first words that match; empty or NULL for none."""
        start = self._first(name)
        if start is None:
            return F.regexp_extract(text, "(?U)" + self.patterns[name], 0)
        return F.regexp_extract(F.get(F.filter(excerpts, lambda e: e.rlike(start)), F.lit(0)), start, 0)

    def evidence(self, name: str, text: Column, excerpts: Column) -> Column:
        """As ``text.evidence``: the first words that match, or NULL."""
        return X.truthy(self.words(name, text, excerpts))

    def met(self, name: str, text: Column) -> Column:
        """As ``text.has``; the pattern is looked for only in texts that contain a fixed text of it."""
        pattern = self.patterns[name]
        if bounded(pattern):
            choices, rest = _split(pattern)
            hits = []
            for choice in choices:
                fixed = fixed_texts(choice)
                there = [text.contains(t) for t in fixed] or [F.lit(True)]
                hits.append(reduce(lambda a, b: a | b, there) & text.rlike(_led(choice, rest)))
            return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))
        hit = text.rlike(quick(pattern))
        if texts := fixed_texts(pattern):
            hit = reduce(lambda a, b: a | b, [text.contains(t) for t in texts]) & hit
        return F.coalesce(hit, F.lit(False))

    def first(self, name: str, text: Column) -> Column:
        """The first words that match, in texts that the pattern is in; empty for none."""
        return F.regexp_extract(text, quick(self.patterns[name]), 0)
