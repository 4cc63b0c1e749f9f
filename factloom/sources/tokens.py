"""Tokens of TypeScript and JavaScript in one pass: comments, strings, templates with their code, regular expressions and JSX are told apart by what stands before them."""

from __future__ import annotations

import re

#: Words behind which an expression begins.
BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default", "instanceof", "extends"}
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
#: The next token behind white space and comments: a word, number, string or other one. Only what begins with a letter of _SPECIAL takes a closer look.
_TOKEN = re.compile(
    r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+(?:([^\W\d][\w$]*|[$#@][\w$]*)|(\d[\w.]*)|(\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|\+\+|--|\*\*=?|[-+*/%&|^]=|.))", re.S
)
_KINDS, _SPECIAL = " wnsp", frozenset("`/<{}")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_TAG = re.compile(r"<(?P<name>[A-Za-z_$][\w$.:-]*)?")
_IN_TAG = re.compile(r"(?P<end>/?>)|(?P<open>\{)|(?P<s>\"[^\"]*\"?|'[^']*'?)|(?P<a>[^\W\d][\w$:.-]*)|.", re.S)
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_NOT_FEED = re.compile(r"[^\n]")
_CHILD = re.compile(r"[^<{]*")


class Tokens:
    """Parallel lists: kind (w word, n number, s string, t template text, r regular expression, p other, j tag, a attribute, x end of a tag), text, pos, end; match pairs brackets."""

    def __init__(self, text: str, jsx: bool = True):
        self.source, self.jsx = text, jsx
        self.kind: list[str] = []
        self.text: list[str] = []
        self.pos: list[int] = []
        self.end: list[int] = []
        self._read()
        self.match = self._pairs()

    def _add(self, kind: str, a: int, b: int) -> int:
        self.kind.append(kind)
        self.text.append(self.source[a:b])
        self.pos.append(a)
        self.end.append(b)
        return b

    def new_line(self, i: int) -> bool:
        """Whether token i is the first one of its line."""
        return i <= 0 or "\n" in self.source[self.end[i - 1] : self.pos[i]]

    def _operand_next(self) -> bool:
        """Whether an expression may begin here, so that `/` opens a regular expression and `<` a tag."""
        if not self.kind:
            return True
        k, t = self.kind[-1], self.text[-1]
        return t in BEFORE_OPERAND if k == "w" else k == "p" and t not in (")", "]", "}", "++", "--")

    def _template(self, at: int, stack: list[str]) -> int:
        at = self._add("t", at, _TEMPLATE.match(self.source, at).end())
        if self.source.startswith("${", at):
            stack.append("template")
            return self._add("p", at, at + 2)
        return min(at + 1, len(self.source))

    def _read(self) -> None:
        text, n, at, stack = self.source, len(self.source), 0, ["top"]
        kinds, texts, starts, ends, token = self.kind, self.text, self.pos, self.end, _TOKEN.match
        while at < n:
            mode = stack[-1]
            if mode == "children":
                at = _CHILD.match(text, at).end()
                if text.startswith("</", at):
                    shut = text.find(">", at)
                    at = n if shut < 0 else self._add("x", at, shut + 1)
                    stack.pop()
                elif text.startswith("{", at):
                    stack.append("brace")
                    at = self._add("p", at, at + 1)
                elif at < n:
                    at = self._tag(at, stack)
                continue
            if mode == "tag":
                if space := _SPACE.match(text, at):
                    at = space.end()
                    continue
                m = _IN_TAG.match(text, at)
                if m["end"]:
                    stack.pop()
                    if m["end"] == ">":
                        stack.append("children")
                    at = self._add("x", at, m.end())
                elif m["open"]:
                    stack.append("brace")
                    at = self._add("p", at, m.end())
                else:
                    at = self._add("s", at, m.end()) if m["s"] else self._add("a", at, m.end()) if m["a"] else m.end()
                continue
            m = token(text, at)
            if m is None:
                break
            which = m.lastindex
            t, (at, end) = m[which], m.span(which)
            if which == 4 and (c := t[0]) in _SPECIAL:
                if c == "`":
                    at = self._template(at + 1, stack)
                    continue
                if c == "/" and self._operand_next() and (m := _REGEX.match(text, at)):
                    at = self._add("r", at, m.end())
                    continue
                if c == "<" and self.jsx and self._operand_next() and re.match(r"<[A-Za-z_$>]", text[at : at + 2]) and not _GENERIC.match(text, at):
                    at = self._tag(at, stack)
                    continue
                if c == "{":
                    stack.append("brace")
                elif c == "}":
                    at = self._add("p", at, end)
                    if len(stack) > 1 and stack.pop() == "template":
                        at = self._template(at, stack)
                    continue
            kinds.append(_KINDS[which])
            texts.append(t)
            starts.append(at)
            ends.append(end)
            at = end

    def _tag(self, at: int, stack: list[str]) -> int:
        stack.append("tag")
        return self._add("j", at, _TAG.match(self.source, at).end())

    def _pairs(self) -> list[int]:
        """For each bracket the token of its other half; brackets without one stand for the end or the start."""
        n, out, open_ = len(self.text), [-1] * len(self.text), []
        closes = {")": "(", "]": "[", "}": "{"}
        for i, (k, t) in enumerate(zip(self.kind, self.text)):
            if k != "p":
                continue
            if t in ("(", "[", "{", "${"):
                open_.append(i)
            elif t in closes:
                while open_ and self.text[open_[-1]][-1] != closes[t]:
                    out[open_.pop()] = i
                if open_:
                    out[i] = open_[-1]
                    out[open_.pop()] = i
        for i in open_:
            out[i] = n - 1
        return out

    def _gaps(self) -> list[tuple[int, int, str]]:
        """(from, to, "") of what stands between tokens, but for single blanks and line feeds; tags' texts and comments among it."""
        text = self.source
        return [(e, p, "") for e, p in zip([0, *self.end], [*self.pos, len(text)]) if p - e > 1 or (p > e and text[e] not in " \n")]

    def blanked(self, strings: bool = True) -> str:
        """The source with comments, template and tag text and regular expressions (and strings) as blanks; places and line feeds stay."""
        text, out, at, blank = self.source, [], 0, _NOT_FEED.sub
        hidden = "trs" if strings else "tr"
        for p, e, k in sorted(self._gaps() + [(p, e, k) for k, p, e in zip(self.kind, self.pos, self.end) if k in hidden]):
            t = text[p:e]
            edge = "" if not k or k == "t" or e - p < 2 else '"' if k == "r" and strings else t[0]
            out += text[at:p], edge, blank(" ", t[len(edge) : len(t) - len(edge)]), edge
            at = e
        return "".join(out) + text[at:]
