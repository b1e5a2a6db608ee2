"""Name-literal pairs of source and configuration syntax, with constants propagated.

A text is one stream of tokens. A pair begins at a name and a sign (``name = "x"``,
``name: x``, ``"name": "x"``, ``name := 'x'``, ``'name' => 'x'``, ``<name>x</name>``). Its
value goes on through brackets, lists and call arguments, over line ends after a sign or
an operator, and may be joined from literals and earlier names (``a + b``, ``"${a}"``). A
blank line ends every value. A pair keeps its own literals and points to the earlier
pairs its value takes over: memory grows with the text, not with what names stand for.
Lines outside values that have no sign are skipped.
"""

from __future__ import annotations

import re
from collections import Counter, deque

# Last words of functions whose first argument names what they look up.
LOOKUPS = {"config", "env", "environ", "fetch", "get", "getenv", "getproperty", "load", "lookup", "open", "read", "setting"}

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|[0-9]+")
REFERENCE = re.compile(r"\$\{([\w.\-]+)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_][\w.]*)\}|%\(([\w.]+)\)s")
ASSIGNS = re.compile(r"[=:]|</")
_TOKEN = re.compile(
    r"""(?P<gap>(?:[^\S\n]|\\\n)+)
       |(?P<line>\n\s*)
       |(?P<string>(?<!\w)(?:\"{3}(?s:.)*?\"{3}|'{3}(?s:.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))
       |(?P<name>[^\W\d][\w$]*(?:[.\-][^\W\d][\w$]*)*)
       |(?P<op>=>|:=|==|!=|<=|>=|</|[=:,;(){}\[\]<>])
       |(?P<other>.)""",
    re.VERBOSE,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_SIGNS = {"=", ":", ":=", "=>"}
_JOINS = {"+", "|", "?", "or"}
_QUOTES = "\"'`"
_CLOSER = {"(": ")", "[": "]", "{": "}"}


class Pair:
    """A name, the literals in its value as ``(start, end, quoted)``, and the earlier pairs its value takes over."""

    __slots__ = ("name", "literals", "uses")

    def __init__(self, name: str) -> None:
        self.name = name
        self.literals: list[tuple[int, int, bool]] = []
        self.uses: set[Pair] = set()


class _Tokens:
    """Tokens ``(kind, start, end)`` of a text, one after the other; gaps are left out."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.ahead: deque[tuple[str, int, int]] = deque()
        self.unclosed: dict[str, int] = {}  # quote -> end of the line in which nothing closes it

    def peek(self, k: int = 0) -> tuple[str, int, int] | None:
        while len(self.ahead) <= k:
            if self.at >= len(self.text):
                return None
            first = self.text[self.at]
            if first in _QUOTES and self.at < self.unclosed.get(first, 0):
                kind, end = "other", self.at + 1
            else:
                found = _TOKEN.match(self.text, self.at)
                kind, end = found.lastgroup, found.end()
                if kind == "other" and first in _QUOTES and not re.match(r"\w", self.text[self.at - 1 : self.at]):
                    stop = self.text.find("\n", self.at)
                    self.unclosed[first] = len(self.text) if stop < 0 else stop
            if kind != "gap":
                self.ahead.append((kind, self.at, end))
            self.at = end
        return self.ahead[k]

    def value(self, k: int = 0) -> str:
        token = self.peek(k)
        return self.text[token[1] : token[2]] if token else ""

    def skip(self, n: int = 1) -> None:
        for _ in range(n):
            self.ahead.popleft()

    def go(self, at: int) -> None:
        self.ahead.clear()
        self.at = at

    def to_next_sign(self) -> bool:
        """Move to the line of the next sign, from a place outside all values."""
        at = self.ahead[0][1] if self.ahead else self.at
        sign = ASSIGNS.search(self.text, at)
        if sign:
            self.go(max(at, self.text.rfind("\n", at, sign.start()) + 1))
        return sign is not None


class _Open:
    """An open value (no ``closer``) or bracket, and the pair its literals belong to."""

    __slots__ = ("pair", "closer", "wants", "lookup")

    def __init__(self, pair: Pair | None, closer: str = "", lookup: bool = False) -> None:
        self.pair, self.closer, self.lookup = pair, closer, lookup
        self.wants = not closer  # a value without a term yet, or with an operator behind the last one


class _Lexer:
    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, _Tokens(text)
        self.open: list[_Open] = []
        self.brackets: Counter[str] = Counter()
        self.known: dict[str, Pair] = {}
        self.done: list[Pair] = []

    def pairs(self) -> list[Pair]:
        before = "\n"
        while self.open or before != "\n" or self.tokens.to_next_sign():
            token = self.tokens.peek()
            if token is None:
                break
            before = self._step(*token, before)
        while self.open:
            self._close()
        return self.done

    def _close(self) -> None:
        top = self.open.pop()
        if top.closer:
            self.brackets[top.closer] -= 1
        else:
            self.known[top.pair.name] = top.pair
            self.done.append(top.pair)

    def _close_values(self) -> None:
        while self.open and not self.open[-1].closer:
            self._close()

    def _close_bracket(self, closer: str) -> None:
        self._close_values_within(closer)
        if self.open and not self.open[-1].closer:
            self.open[-1].wants = False

    def _close_values_within(self, closer: str) -> None:
        if not self.brackets[closer]:
            self._close_values()
            return
        while self.open[-1].closer != closer:
            self._close()
        self._close()

    def _bracket(self, sign: str, pair: Pair | None, lookup: bool = False) -> None:
        self.brackets[_CLOSER[sign]] += 1
        self.open.append(_Open(pair, _CLOSER[sign], lookup))

    def _known(self, name: str) -> Pair | None:
        return self.known.get(name) or self.known.get(name.rpartition(".")[2])

    def _use(self, pair: Pair, found: re.Match) -> None:
        used = self._known(next(filter(None, found.groups())))
        if used:
            pair.uses.add(used)

    def _string(self, pair: Pair, start: int, end: int) -> None:
        tripled = end - start >= 6 and self.text[start : start + 3] == 3 * self.text[start]
        start, end = (start + 3, end - 3) if tripled else (start + 1, end - 1)
        for found in REFERENCE.finditer(self.text, start, end):
            self._use(pair, found)
        pair.literals.append((start, end, True))

    def _bare(self, pair: Pair, start: int, literal: bool) -> None:
        """A word without quotes: a call, a subscript, an earlier name, or (``literal``) a value."""
        text = self.tokens.value()
        run = _BARE.match(self.text, start)
        if run and not self._known(text):
            text = run.group()
        end = start + len(text)
        self.tokens.go(end)
        follows = self.text[end : end + 1]
        if follows in ("(", "["):
            self.tokens.go(end + 1)
            last = [w.lower() for w in WORDS.findall(text)][-2:]
            lookup = bool(last) and (last[-1] in LOOKUPS or "".join(last) in LOOKUPS)
            self._bracket(follows, pair if follows == "(" else None, lookup)
            return
        reference = REFERENCE.fullmatch(text)
        if reference:
            self._use(pair, reference)
        elif used := self._known(text):
            pair.uses.add(used)
        elif literal:
            pair.literals.append((start, end, False))

    def _begins_pair(self, kind: str, before: str) -> int:
        """How many tokens ``name sign`` takes here; 0: no pair begins."""
        if kind not in ("name", "string"):
            return 0
        n = 2 if kind == "string" and self.tokens.value(1) == "]" else 1
        sign = self.tokens.value(n)
        if sign in _SIGNS:
            follows = self.tokens.peek(n + 1)
            if sign == ":" and follows and follows[0] == "name" and self.tokens.value(n + 2) == "=":
                return n + 3  # a declared type stands between
            return n + 1
        return n + 1 if kind == "name" and sign == ">" and before == "<" else 0

    def _begin(self, kind: str, text: str, taken: int, outer: _Open | None) -> None:
        name = text.strip(_QUOTES) if kind == "string" else text
        pair = Pair(name.rpartition(".")[2])
        if outer:
            outer.pair.uses.add(pair)
        subscript = self.tokens.value(1) == "]"
        self.tokens.skip(taken)
        self._close_values()
        if subscript:
            self._close_bracket("]")
            self._close_values()
        self.open.append(_Open(pair))

    def _line(self, text: str, value: _Open | None) -> None:
        if text.count("\n") > 1:
            while self.open:
                self._close()
        elif value and not value.wants and self.tokens.value() not in _JOINS:
            within = self.open[-2].closer if len(self.open) > 1 else ""
            if within not in (")", "]"):
                self._close_values()

    def _step(self, kind: str, start: int, end: int, before: str) -> str:
        """Handle one token; returns what the next step sees as the token before it."""
        tokens, text = self.tokens, self.text[start:end]
        top = self.open[-1] if self.open else None
        value = top if top and not top.closer else None
        if kind == "line":
            tokens.skip()
            self._line(text, value)
            return "\n"
        # Behind a sign a word is a value, unless it is assigned in its turn.
        wanting = value is not None and value.wants and before != "\n"
        taken = self._begins_pair(kind, before)
        if taken and wanting and not (kind == "name" and tokens.value(1) == "=" and tokens.peek(1)[1] > end):
            taken = 0
        if taken:
            self._begin(kind, text, taken, value if wanting else None)
            return "="
        if kind == "op":
            return self._operator(text, top)
        if value and not value.wants:
            if kind != "string" and text in _JOINS:
                value.wants = True
                tokens.skip()
                return text
            if kind != "string" or before != '"':
                self._close_values()
                return ""  # the same token again, outside the value
        if value:
            value.wants = False
        if kind == "string":
            if top and top.pair and not top.lookup:
                self._string(top.pair, start, end)
            tokens.skip()
            return '"'
        if top and top.pair and text not in _JOINS:
            self._bare(top.pair, start, value is not None)
        else:
            if value:
                value.wants = True  # an operator before the first term, or a second one
            tokens.skip()
        return text

    def _operator(self, text: str, top: _Open | None) -> str:
        if text in _CLOSER:
            if top and not top.closer and (text == "{" or not top.wants):
                self._close_values()
                top = self.open[-1] if self.open else None
            inside = top and text != "{"
            self._bracket(text, top.pair if inside else None, bool(inside and top.lookup))
        elif text in _CLOSER.values():
            self._close_bracket(text)
        else:
            self._close_values()
            if text == "," and self.open:
                self.open[-1].lookup = False
        self.tokens.skip()
        return text


def pairs(text: str) -> list[Pair]:
    """The pairs of a text, in the order in which their values end; time and memory are linear in the text."""
    return _Lexer(text).pairs() if ASSIGNS.search(text) else []
