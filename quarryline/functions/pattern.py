"""Structural patterns: code with metavariables, matched against the tree of tokens of a script.

``$NAME`` stands for one expression, the same code wherever it stands again; ``$_`` for any one; ``$$$NAME`` and ``$...``
for any stretch, which may be empty or hold commas. All else is code and must stand as it is, bracket for bracket, in any
layout; strings are equal whatever their quotes. Comments, strings and templates' texts hold no matches.

A metavariable that begins a pattern is a name, a chain of members, calls and indexes, or a bracket; one that ends it goes
to the end of its expression. Of matches at one level that overlap the first holds; in brackets more are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quarryline.functions.script import Code, NotLexed, lex

ONE, MANY = re.compile(r"\$(?:_|[A-Z][A-Z0-9_]*)\Z"), re.compile(r"\$\$\$(?:_|[A-Z][A-Z0-9_]*)?\Z")
#: Names that are no operand, and operators that go on with one.
WORDS = frozenset("return const let var if else for while do switch case throw new function class import export default try catch finally break continue typeof delete void await yield async".split())
Element = tuple


def _plain(code: Code, k: int) -> str:
    text = code.texts[k]
    return '"' + text[1:-1] if code.kinds[k] == "str" else text


def _items(code: Code, first: int, end: int) -> list[int]:
    """Tokens from first up to end, of each bracket only its first."""
    found, k = [], first
    while k < end:
        found.append(k)
        k = code.partner[k] + 1 if code.partner.get(k, -1) > k else k + 1
    return found


def compiled(pattern: str) -> list[Element]:
    """The elements of a pattern: ("one", name), ("many", name), ("in", bracket, elements) and ("token", text)."""
    code = lex(pattern, False)

    def elements(first: int, end: int) -> list[Element]:
        out: list[Element] = []
        items = _items(code, first, end)
        for at, k in enumerate(items):
            text = code.texts[k]
            if out and text == "..." and code.text(k - 1) == "$" and code.starts[k] == code.starts[k - 1] + 1:
                out[-1] = ("many", "")
            elif k in code.partner:
                out.append(("in", text, elements(k + 1, code.partner[k])))
            elif MANY.match(text):
                out.append(("many", text[3:].strip("_")))
            elif ONE.match(text):
                out.append(("one", text[1:] if text != "$_" else ""))
            elif text != ";" or at < len(items) - 1:
                out.append(("token", _plain(code, k)))
        return out

    found = elements(0, len(code.texts))
    if not found or all(kind in ("one", "many") for kind, *_ in found):
        raise NotLexed("a pattern needs some code")
    return found


class Matcher:
    """Matches of one pattern in one script."""

    def __init__(self, code: Code, elements: list[Element]):
        self.code, self.elements = code, elements
        self._levels: dict[int, list[int]] = {}
        self._plain = [_plain(code, k) for k in range(len(code.texts))]

    def _level(self, opened: int) -> list[int]:
        """The items in a bracket; of -1 those of the whole script."""
        if opened not in self._levels:
            self._levels[opened] = _items(self.code, opened + 1, self.code.partner[opened] if opened >= 0 else len(self.code.texts))
        return self._levels[opened]

    def _end(self, k: int) -> int:
        return self.code.partner[k] if self.code.partner.get(k, -1) > k else k

    def _bound(self, bound: dict[str, tuple[int, int]], name: str, first: int, last: int) -> dict[str, tuple[int, int]] | None:
        """The bindings with one more; None if the name stands for other code already."""
        if not name:
            return bound
        if name not in bound:
            return bound | {name: (first, last)}
        a, b = bound[name]
        return bound if b - a == last - first and self._plain[a : b + 1] == self._plain[first : last + 1] else None

    def _chain_end(self, items: list[int], i: int) -> int:
        """After the longest chain of members, calls and indexes that begins at item i; i if none does."""
        code, j = self.code, i
        if code.kinds[items[i]] == "op" and items[i] not in code.partner or code.texts[items[i]] in WORDS:
            return i
        j += 1
        while j < len(items) and not code.breaks_before(items[j]):
            text = code.texts[items[j]]
            if text in (".", "?.") and j + 1 < len(items):
                j += 1 if code.texts[items[j + 1]] in ("(", "[") else 2
            elif text in ("(", "["):
                j += 1
            else:
                break
        return j

    def _runs(self, items: list[int], i: int, leads: bool, ends: bool) -> Iterator[int]:
        """Where the expression that begins at item i can end: after each item up to a separator, the shortest first; if it ends the pattern, only the longest."""
        code, j = self.code, i
        if leads:
            for end in range(i + 1, self._chain_end(items, i) + 1):
                yield end
            return
        while j < len(items):
            text = code.texts[items[j]]
            if code.kinds[items[j]] == "op" and text in (",", ";") or (j > i and code.breaks_before(items[j])):
                break
            j += 1
            if not ends:
                yield j
        if ends and j > i:
            yield j

    def _match(self, elements: list[Element], e: int, items: list[int], i: int, bound: dict, whole: bool) -> Iterator[tuple[int, dict]]:
        """(item after the match, bindings) of elements from e on at items from i on; ``whole``: up to the last item."""
        if e == len(elements):
            if not whole or i == len(items) or (i == len(items) - 1 and self.code.texts[items[i]] in (",", ";")):
                yield i, bound
            return
        kind, value, *inside = elements[e]
        if kind == "many":
            for j in range(i, len(items) + 1):
                got = self._bound(bound, value, items[i] if j > i else 0, self._end(items[j - 1]) if j > i else -1)
                if got is not None:
                    yield from self._match(elements, e + 1, items, j, got, whole)
        elif i < len(items):
            k = items[i]
            if kind == "one":
                top = not whole
                for j in self._runs(items, i, top and e == 0, top and e == len(elements) - 1):
                    got = self._bound(bound, value, k, self._end(items[j - 1]))
                    if got is not None:
                        yield from self._match(elements, e + 1, items, j, got, whole)
            elif kind == "token":
                if self._plain[k] == value and self.code.kinds[k] not in ("template", "markup", "regex"):
                    yield from self._match(elements, e + 1, items, i + 1, bound, whole)
            elif self.code.partner.get(k, -1) > k and self.code.texts[k] == value:
                for _, got in self._match(inside[0], 0, self._level(k), 0, bound, True):
                    yield from self._match(elements, e + 1, items, i + 1, got, whole)

    def _stands(self, first: int, last: int) -> bool:
        """Whether tokens first to last are code of their own: no member of something else, and no head of a function."""
        code = self.code
        lead, after = self.elements[0], code.text(last + 1)
        if code.text(first - 1) in (".", "?.") or (lead[0] in ("token", "one") and code.text(first - 1) in ("function", "class") and code.kinds[first] == "id"):
            return False
        if lead[0] == "one" and first and code.ends_operand(first - 1) and not code.breaks_before(first) and code.text(first - 1) not in (")", "}"):
            return False
        return not (self.elements[-1][:2] == ("in", "(") and (after == "{" or after == "=>") and not code.breaks_before(last + 1))

    def found(self) -> list[tuple[int, int, dict[str, tuple[int, int]]]]:
        """(first token, last token, tokens that names stand for) of all matches, in the order of their first tokens."""
        out, levels = [], [-1, *sorted(k for k, p in self.code.partner.items() if p > k)]
        for opened in levels:
            items, i = self._level(opened), 0
            while i < len(items):
                told = next(((j, bound) for j, bound in self._match(self.elements, 0, items, i, {}, False) if j > i and self._stands(items[i], self._end(items[j - 1]))), None)
                if told:
                    out.append((items[i], self._end(items[told[0] - 1]), told[1]))
                i = told[0] if told else i + 1
        return sorted(out, key=lambda m: m[:2])


def matches(code: Code, elements: list[Element]) -> list[tuple[int, int, int, str, dict[str, str]]]:
    """(place, first line, last line, text, code that names stand for) of each match."""
    end = lambda k: code.starts[k] + len(code.texts[k])
    text = lambda a, b: code.source[code.starts[a] : end(b)] if b >= a else ""
    return [(code.starts[a], code.line(a), code.end_line(b), text(a, b), {n: text(*at) for n, at in bound.items()}) for a, b, bound in Matcher(code, elements).found()]
