"""Tokens of JavaScript and TypeScript, and what stands in them: declarations, imports, calls.

A lexer tells strings, templates, regular expressions, comments and markup from code and pairs all brackets, so that a
stretch of code is a tree: a bracket holds what stands up to its partner. Everything else is read off that tree: where a
function or class ends, which names are exported, what is called. Nothing is evaluated, and types are skipped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

SPACE = re.compile(r"(?:[\s﻿]+|//[^\n  ]*|/\*.*?\*/|(?<![\s\S])#![^\n]*)+", re.S)
#: The same for a source without other ends of lines than \n, which is read faster.
PLAIN_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?\*/|(?<![\s\S])#![^\n]*)+", re.S)
NAME = r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})[\w$‌‍]*+(?:\\u[0-9a-fA-F]{4}[\w$‌‍]*+)*+"
TOKEN = re.compile(
    rf"(?P<id>#?{NAME})"
    r"|(?P<num>0[xXbBoO][0-9a-fA-F_]++n?|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')"
    r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#])",
    re.S,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-zA-Z]*+")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
MARKUP_TAG = re.compile(r"(?:[^<>{}\"'/]|\"[^\"]*+\"|'[^']*+'|/(?!>))*+")
#: Names after which an expression begins, that are called by nothing, and that go on with an expression.
BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new instanceof else do yield await extends default".split())
NO_CALLEE = BEFORE_OPERAND | frozenset("if for while switch catch with function class const let var import export as satisfies is keyof infer asserts async implements constructor".split())
GOES_ON = frozenset("instanceof in of as satisfies".split())
MODIFIERS = frozenset("public private protected static async get set readonly override abstract declare accessor".split())
#: Tokens within which a type, a heritage clause or an import clause must end to be one.
LOOK = 2000
PARTNER = {")": ("(",), "]": ("[",), "}": ("{", "${", "x{")}
OPENING = frozenset("([{")
#: Operators that begin no longer one.
ALONE = frozenset("(){}[],;:~@")
#: Names at which a declaration of symbols, an import or a type begins: all other tokens are passed over.
DECLARES, IMPORTS, TYPES = frozenset(("function", "const", "let", "var")), frozenset(("require", "import", "export")), frozenset(("interface", "type"))


class NotLexed(ValueError):
    """Code whose brackets, strings, templates or comments don't end."""


@dataclass
class Code:
    """Tokens: kind (id, num, str, op, regex, template, markup), text, place and line; of each bracket its partner, of each { whether it holds members of an object."""

    source: str
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)
    objects: set[int] = field(default_factory=set)
    around: list[int] = field(default_factory=list)  # of each token the bracket that it is in, -1 for none

    def __post_init__(self) -> None:
        self._breaks = [m.start() for m in re.finditer("\n", self.source)]
        self._angles: dict[int, int] = {}
        self._last = (-1, -1, -2)  # the expression that was looked at last: first token, last one, the bracket around

    def line(self, k: int) -> int:
        return bisect_right(self._breaks, self.starts[k] - 1) + 1

    def end_line(self, k: int) -> int:
        return bisect_right(self._breaks, self.starts[k] + len(self.texts[k]) - 2) + 1

    def text(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def ends_operand(self, k: int) -> bool:
        """Whether token k can be the last of an expression."""
        if k < 0:
            return False
        kind, text = self.kinds[k], self.texts[k]
        return text in (")", "]", "}", "++", "--") if kind == "op" else not (kind == "id" and text in BEFORE_OPERAND and self.text(k - 1) not in (".", "?."))

    def breaks_before(self, k: int) -> bool:
        """Whether a statement ends between tokens k - 1 and k because a line does."""
        if k >= len(self.texts) or k < 1 or self.line(k) == self.end_line(k - 1) or not self.ends_operand(k - 1):
            return False
        return self.texts[k] in ("{", "@") or (self.kinds[k] != "op" and self.kinds[k] != "template" and self.texts[k] not in GOES_ON)

    def expression_end(self, k: int) -> int:
        """The last token of the expression that begins at k."""
        around = self.around[k] if k < len(self.texts) else -1
        if self._last[0] < k <= self._last[1] and around == self._last[2]:
            return self._last[1]
        at = k
        while at < len(self.texts) and not (at > k and self.breaks_before(at)):
            if at in self.partner and self.partner[at] > at:
                at = self.partner[at]
            elif self.kinds[at] == "op" and self.texts[at] in (",", ";", ")", "]", "}"):
                break
            at += 1
        self._last = (k, at - 1, around)
        return at - 1

    def after_angles(self, k: int) -> int:
        """The token after the type arguments that begin at k, a <; k if they don't end as such. One scan answers for all that open in it."""
        if k not in self._angles:
            held, at = [], k
            while at < len(self.texts) and (held or at == k):
                text = self.texts[at]
                if at in self._angles and at != k:  # what opens there is known
                    if self._angles[at] == at:
                        break
                    at = self._angles[at]
                    continue
                if at in self.partner and self.partner[at] > at:
                    at = self.partner[at]
                elif text == "<":
                    held.append(at)
                elif text == ">":
                    self._angles[held.pop()] = at + 1
                elif self.kinds[at] in ("regex", "template", "markup") or (self.kinds[at] == "op" and text not in (",", ".", "|", "&", "=>", ":", "?", "=", "...", "-", ";")):
                    break
                at += 1
            self._angles |= {h: h for h in held}
        return self._angles[k]

    def after_type(self, k: int, ends: tuple[str, ...]) -> int:
        """The first token from k on, past whole brackets and type arguments, that is in ``ends``; the last one looked at if none is."""
        for _ in range(LOOK):
            if k >= len(self.texts) or self.texts[k] in ends:
                break
            after = self.after_angles(k) if self.texts[k] == "<" else k
            k = after if after > k else self.partner[k] + 1 if self.partner.get(k, -1) > k else k + 1
        return k


def lex(source: str, markup: bool) -> Code:
    """The tokens of a script; ``markup`` says whether a < where an expression begins opens an element."""
    code = Code(source)
    opens: list[int] = []
    elements: list[list[str]] = []  # of each element that is open in an expression, itself and those in it: tag or text
    heads: set[int] = set()  # closing parentheses of if, for, while and with
    at = 0
    space = SPACE if "\u2028" in source or "\u2029" in source else PLAIN_SPACE
    kinds, texts, starts, around = code.kinds, code.texts, code.starts, code.around

    def put(kind: str, text: str, start: int) -> int:
        kinds.append(kind), texts.append(text), starts.append(start), around.append(opens[-1] if opens else -1)
        return len(texts) - 1

    def begins() -> bool:
        """Whether an expression begins here."""
        last = len(texts) - 1
        return not code.ends_operand(last) or last in heads or (code.text(last) == "}" and code.partner.get(last, -1) not in code.objects and code.text(code.partner.get(last, -1)) == "{")

    def template(start: int, begin: int) -> int:
        """From a ` or the } before it to the next ${ or `."""
        end = TEMPLATE.match(source, begin).end()
        if source.startswith("${", end):
            put("template", source[start:end], start)
            opens.append(put("op", "${", end))
            return end + 2
        if not source.startswith("`", end):
            raise NotLexed("template")
        put("template", source[start : end + 1], start)
        return end + 1

    def element(at: int) -> int:
        """On with the innermost element, up to code within it or its end."""
        held = elements[-1]
        while held:
            if held[-1] == "tag":
                at = MARKUP_TAG.match(source, at).end()
                if source.startswith("/>", at):
                    held.pop()
                    at += 2
                    continue
                if source.startswith(">", at):
                    held[-1] = "text"
                    at += 1
                    continue
            else:
                while at < len(source) and source[at] not in "<{":
                    at += 1
                if source.startswith("</", at):
                    at = source.find(">", at) + 1
                    if not at:
                        raise NotLexed("markup")
                    held.pop()
                    continue
                if source.startswith("<", at):
                    held.append("tag")
                    at += 1
                    continue
            if not source.startswith("{", at):
                raise NotLexed("markup")
            opens.append(put("op", "x{", at))
            return at + 1
        elements.pop()
        put("markup", "", at)
        return at

    while at < len(source):
        here = source[at]
        if (here <= " " or here > "~" or here == "/" or here == "#") and (m := space.match(source, at)):
            at = m.end()
            continue
        if here == "`":
            at = template(at, at + 1)
            continue
        if here == "/" and begins():
            if source.startswith("/*", at) or not (m := REGEX.match(source, at)):
                raise NotLexed("regular expression or comment")
            put("regex", m[0], at)
            at = m.end()
            continue
        if here == "<" and markup and begins() and re.match(r"<(?:>|[A-Za-z_$])(?!\w*\s*(?:,|extends\b))", source[at : at + 200]):
            put("markup", "", at)
            elements.append(["tag"])
            at = element(at + 1)
            continue
        if here in ALONE:
            kind, text, end = "op", here, at + 1
        elif m := TOKEN.match(source, at):
            kind, text, end = m.lastgroup, m[0], m.end()
        else:
            raise NotLexed(here)
        if text in PARTNER:
            if not opens or code.texts[opens[-1]] not in PARTNER[text]:
                raise NotLexed(text)
            o = opens.pop()
            k = put("op", text, at)
            code.partner[o], code.partner[k] = k, o
            at = end
            if code.texts[o] == "${":
                at = template(at, at)
            elif code.texts[o] == "x{":
                at = element(at)
            elif text == ")" and code.text(o - 1) in ("if", "for", "while", "with") and code.text(o - 2) not in (".", "?."):
                heads.add(k)
            continue
        k = len(texts)
        kinds.append(kind), texts.append(text), starts.append(at), around.append(opens[-1] if opens else -1)
        at = end
        if text in OPENING:
            opens.append(k)
            before = code.text(k - 1)
            if text == "{" and (before in ("(", ",", "=", ":", "[", "?", "return", "??", "||", "&&", "...", "yield", "await", "default", "in", "of", "typeof") or (before == "{" and k - 1 in code.objects)):
                code.objects.add(k)
    if opens or elements:
        raise NotLexed("end")
    return code


def _string(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def _body(code: Code, k: int) -> int:
    """The { of the body of a function whose parameters end before k; -1 without one (a signature)."""
    if code.text(k) == ":":
        k += 1
        operand = False  # what is before k is a whole type
        for _ in range(LOOK):
            text = code.text(k)
            if text == "{" and operand:
                return k
            if text in ("", ";", ",", "=", ")", "}") or (operand and code.breaks_before(k)):
                return -1
            if text == "<" and (after := code.after_angles(k)) > k:
                k, operand = after, True
                continue
            operand = not (text in ("|", "&", "=>", "?", ":", ".") or (code.kinds[k] == "id" and text in ("is", "keyof", "typeof", "extends", "infer", "asserts", "readonly", "unique")))
            k = code.partner[k] + 1 if code.partner.get(k, -1) > k else k + 1
        return -1
    return k if code.text(k) == "{" else -1


def _arrow(code: Code, k: int) -> int:
    """The => of the arrow function that begins at k; -1 if none does."""
    if code.text(k) == "async" and code.line(k) == code.line(min(k + 1, len(code.texts) - 1)):
        k += 1
    if code.text(k) == "<":
        k = code.after_angles(k)
    if k < len(code.texts) and code.kinds[k] == "id" and code.text(k + 1) == "=>":
        return k + 1
    if code.text(k) != "(":
        return -1
    k = code.partner[k] + 1
    if code.text(k) == ":":
        k = code.after_type(k, ("=>", ";", ",", "=", ")", "}"))
    return k if code.text(k) == "=>" else -1


def _function_end(code: Code, k: int) -> int:
    """The last token of the function expression or arrow function that is all of the expression at k; -1 if that is none."""
    if (arrow := _arrow(code, k)) > 0:
        return code.partner[arrow + 1] if code.text(arrow + 1) == "{" else code.expression_end(arrow + 1)
    f = k + 1 if code.text(k) == "async" else k
    if code.text(f) != "function":
        return -1
    f += 1 + (code.text(f + 1) == "*")
    f += f < len(code.texts) and code.kinds[f] == "id"
    f = code.after_angles(f) if code.text(f) == "<" else f
    if code.text(f) != "(" or (body := _body(code, code.partner[f] + 1)) < 0:
        return -1
    end = code.partner[body]
    return -1 if code.text(end + 1) in ("(", ".", "?.", "[") and not code.breaks_before(end + 1) else end


def _exported_names(code: Code) -> set[str]:
    """Names that export clauses list or exported declarations declare."""
    names: set[str] = set()
    for k, text in enumerate(code.texts):
        if text != "export" or code.kinds[k] != "id" or code.text(k - 1) in (".", "?."):
            continue
        at = k + 1
        while code.text(at) in ("default", "async", "abstract", "declare"):
            at += 1
        if code.text(at) == "{" or (code.text(at) == "type" and code.text(at + 1) == "{"):
            at += code.text(at) == "type"
            names |= {part[0] for part in _clause(code, at)}
        elif code.text(at) in ("function", "class"):
            at += 1 + (code.text(at + 1) == "*")
            if at < len(code.texts) and code.kinds[at] == "id":
                names.add(code.texts[at])
    return names


def _clause(code: Code, k: int) -> list[list[str]]:
    """The names of each entry of an import or export clause that begins at k, a {, without ``type`` and ``as``."""
    parts: list[list[str]] = [[]]
    for at in range(k + 1, code.partner[k]):
        if code.texts[at] == ",":
            parts.append([])
        else:
            parts[-1].append(_string(code.texts[at]) if code.kinds[at] == "str" else code.texts[at])
    parts = [p[1:] if len(p) in (2, 4) and p[0] == "type" else p for p in parts if p]
    return [[p[0], *p[2:3]] for p in parts]


def _types(code: Code) -> list[tuple[int, int]]:
    """Stretches of interfaces and type aliases."""
    found = []
    for k, text in enumerate(code.texts):
        if text not in TYPES or code.kinds[k] != "id" or k + 2 >= len(code.texts) or code.kinds[k + 1] != "id" or code.text(k - 1) in (".", "?.") or code.line(k) != code.line(k + 1):
            continue
        if text == "interface":
            at = k + 2
            for _ in range(LOOK):
                if code.text(at) in ("{", "", ";", "interface", "class", "function"):
                    break
                at = code.after_angles(at) if code.text(at) == "<" and code.after_angles(at) > at else at + 1
            if code.text(at) == "{":
                found.append((k, code.partner[at]))
        elif text == "type" and code.texts[k + 2] in ("=", "<"):
            found.append((k, code.expression_end(k + 2)))
    return found


def _classes(code: Code) -> list[tuple[int, int, str]]:
    """(first token, { of the body, name) of each class."""
    found = []
    for k, text in enumerate(code.texts):
        if text != "class" or code.kinds[k] != "id" or code.text(k - 1) in (".", "?.") or code.text(k + 1) in (":", ",", "}", "=", ")", "(", ";", ""):
            continue
        at, name = k + 1, "anonymous"
        if code.kinds[at] == "id" and code.texts[at] not in ("extends", "implements"):
            name, at = code.texts[at], at + 1
        at = code.after_type(at, ("{", ";", ")", "}", "class", "function", "const"))
        if code.text(at) == "{":
            found.append((k - (code.text(k - 1) == "abstract"), at, name))
    return found


def _declared(code: Code, k: int) -> bool:
    """Whether the function at k stands where a statement begins."""
    before = code.text(k - 1)
    if k == 0 or before in (";", "{", "export", "default", "else", "do"):
        return not (before == "{" and k - 1 in code.objects)
    return code.ends_operand(k - 1) and (before in ("}", ")") or code.breaks_before(k))


def symbols(code: Code) -> list[tuple[str, str, int, int, bool]]:
    """(name, kind, first line, last line, exported) of classes, function declarations and variables that hold a function, in the order of their first tokens."""
    names, found = _exported_names(code), []
    exported = lambda k: code.text(k - 1) == "export" or (code.text(k - 1) == "default" and code.text(k - 2) == "export")
    for k, body, name in _classes(code):
        found.append((k, name, "CLASS", code.line(k), code.end_line(code.partner[body]), exported(k) or name in names))
    for k, text in enumerate(code.texts):
        if text not in DECLARES or code.kinds[k] != "id" or code.text(k - 1) in (".", "?."):
            continue
        if text == "function":
            first = k - (code.text(k - 1) == "async")
            at = k + 1 + (code.text(k + 1) == "*")
            name = code.texts[at] if at < len(code.texts) and code.kinds[at] == "id" else "anonymous"
            at += name != "anonymous"
            at = code.after_angles(at) if code.text(at) == "<" else at
            if code.text(at) == "(" and _declared(code, first) and (body := _body(code, code.partner[at] + 1)) >= 0:
                found.append((first, name, "FUNCTION", code.line(first), code.end_line(code.partner[body]), exported(first) or name in names))
        elif text in ("const", "let", "var"):
            at = k
            while at == k or code.text(at) == ",":
                at += 1
                name = code.texts[at] if at < len(code.texts) and code.kinds[at] == "id" else ""
                first, at = at, code.partner.get(at, at) + 1
                at += code.text(at) == "!"
                if code.text(at) == ":":
                    at = code.after_type(at, ("=", ",", ";", ")", "}"))
                if code.text(at) != "=":
                    continue
                if name and (end := _function_end(code, at + 1)) > 0:
                    found.append((first, name, "FUNCTION", code.line(first), code.end_line(end), exported(k)))
                at = code.expression_end(at + 1) + 1
    return [told for _, *told in sorted(found, key=lambda f: f[0])]


def imports(code: Code, script: bool) -> list[tuple[str, list[str]]]:
    """(source, names) of imports, re-exports (``*`` for all) and, in plain scripts, of require."""
    found = []
    for k, text in enumerate(code.texts):
        if text not in IMPORTS or code.kinds[k] != "id" or code.text(k - 1) in (".", "?."):
            continue
        if text == "require" and script and code.text(k + 1) == "(" and k + 2 < len(code.texts) and code.kinds[k + 2] == "str" and code.text(k - 1) != "new":
            found.append((_string(code.texts[k + 2]), ["*"]))
        elif text in ("import", "export") and code.text(k + 1) not in ("(", ".", ":", "="):
            at, names, all_ = k + 1, [], False
            while at < min(k + LOOK, len(code.texts)) and (code.kinds[at] == "id" or code.texts[at] in ("{", ",", "*")) and not (at > k + 1 and code.breaks_before(at) and code.text(at) not in ("from", "{")):
                if code.texts[at] == "{":
                    names += [p[0] if text == "import" else p[-1] for p in _clause(code, at)]
                    at = code.partner[at]
                all_ |= code.texts[at] == "*"
                at += 1
            if at < len(code.texts) and code.kinds[at] == "str" and (at == k + 1 and text == "import" or code.text(at - 1) == "from"):
                found.append((_string(code.texts[at]), ["*"] if text == "export" and all_ else names))
    return found


class _Callees:
    """Names of what is called, read backwards from an opening parenthesis."""

    def __init__(self, code: Code, script: bool):
        self.code, self.script = code, script
        self._first: dict[int, int] = {}  # of each ) or ] after a call or member, the first token of the whole

    def before_angles(self, k: int) -> int:
        """The token before the type arguments that end at k, a >; k if none do."""
        code, depth, at = self.code, 0, k
        while at >= 0 and k - at < 200:
            if code.texts[at] == ">":
                depth += 1
            elif code.texts[at] == "<":
                depth -= 1
                if not depth:
                    return at - 1 if code.after_angles(at) == k + 1 and at and code.kinds[at - 1] == "id" else k
            elif code.texts[at] in (";", "("):
                return k
            at = code.partner[at] - 1 if at in code.partner and code.partner[at] < at else at - 1
        return k

    def name(self, k: int) -> tuple[str, int, bool]:
        """(dotted name or "", first token, whether ``new`` makes it) of the expression that ends at k; chains are read link by link, and each once."""
        code, parts, bare, called, passed = self.code, [], True, False, []  # parts from the last to the first
        while True:
            kind, text = (code.kinds[k], code.texts[k]) if k >= 0 else ("op", "")
            if k in self._first:
                first = self._first[k]
                bare, called = False, True
                break
            if kind == "op" and text == "?.":
                k -= 1
                continue
            if kind == "op" and text == "!" and code.ends_operand(k - 1):
                bare, k = False, k - 1
                continue
            if kind == "op" and text == ">" and (before := self.before_angles(k)) < k:
                k = before
                continue
            if kind == "id":
                if k > 1 and code.texts[k - 1] in (".", "?."):
                    parts += ["" if text.startswith("#") else text] if bare else []
                    k -= 2
                    continue
                parts += ["" if text in ("this", "import") or (text == "super" and self.script) else text] if bare else []
                first = k
            elif kind == "op" and text == "]":
                first = code.partner[k]
                if code.ends_operand(first - 1) or code.text(first - 1) == "?.":
                    parts += [code.texts[k - 1] if first == k - 2 and code.kinds[k - 1] == "id" else ""] if bare else []
                    k = first - 1
                    continue
            elif kind == "op" and text in (")", "}"):
                first, bare = code.partner[k], False
                at = first - 1
                at = self.before_angles(at) if code.text(at) == ">" else at
                if text == ")" and at >= 0 and (code.text(at) in ("?.", ")", "]", "!") or (code.kinds[at] == "id" and (code.texts[at] not in NO_CALLEE or code.text(at - 1) in (".", "?.")))):
                    passed.append(k)
                    called, k = True, at
                    continue
            else:
                first, bare = max(k, 0), False
                while kind == "template" and first > 0 and not code.texts[first].startswith("`"):
                    first -= 1
            break
        made = code.text(first - 1) == "new"
        first -= made
        self._first |= dict.fromkeys(passed, first)
        name = ""
        for part in reversed(parts):
            name = f"{name}.{part}" if name else part
        return name, first, made and not called


def calls(code: Code, script: bool) -> list[tuple[str, int]]:
    """(dotted callee, line where the call begins), an outer call before those in its callee and arguments."""
    callees, skipped = _Callees(code, script), _types(code)
    bodies = {body for _, body, _ in _classes(code)}
    ends = [0] * (len(code.texts) + 1)
    for a, b in skipped:
        ends[a] += 1
        ends[b + 1] -= 1
    found, depth = [], 0
    for k, text in enumerate(code.texts):
        depth += ends[k]
        if text != "(" or depth or k == 0 or code.kinds[k] != "op":
            continue
        at = k - 1
        if code.texts[at] == "?.":
            at -= 1
        elif code.texts[at] == ">":
            at = callees.before_angles(at)
        if code.texts[at] == "!" or code.breaks_before(k) or not (code.kinds[at] == "id" or code.texts[at] == "]"):
            continue
        member = code.text(at - 1) in (".", "?.")
        if code.kinds[at] == "id" and not member and (code.texts[at] in NO_CALLEE or code.text(at - 1) == "function" or (code.text(at - 1) == "*" and code.text(at - 2) == "function")):
            continue
        after = code.text(code.partner[k] + 1)
        name, first, made = callees.name(at)
        if not name or made or (script and name == "require"):
            continue
        before, holder = code.text(first - 1), code.around[k]
        if holder in bodies and (before in ("{", ";", "}", "*") or (code.ends_operand(first - 1) and before != "@")):
            continue  # a method
        if holder in code.objects and (before in ("{", ",", "*") or before in MODIFIERS) and after in ("{", ":"):
            continue
        found.append((code.starts[first], -k, name, code.line(first)))
    return [(name, line) for *_, name, line in sorted(found)]
