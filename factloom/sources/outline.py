"""The nodes of one source file: declarations with their extents, parameters, members, type references, calls, JSX tags, returns, `any` and `as`.

A light reader of TypeScript and JavaScript, run inside Spark tasks, one file at a time: tokens.py tells code from comments, strings, tags' texts and regular
expressions and matches brackets, then heads of declarations are found. There is no grammar and no type checker. Every step is linear in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from factloom.sources.tokens import Tokens

#: Types that are no references, and helpers whose arguments are.
BASIC_TYPES = ["string", "number", "boolean", "any", "void", "null", "undefined", "object", "unknown", "never", "bigint", "symbol", "Function", "Date", "RegExp", "Error", "Array", "Map", "Set", "Promise"]
UTILITY_TYPES = [
    "Omit", "Pick", "Partial", "Required", "Readonly", "Record", "Exclude", "Extract", "NonNullable", "Parameters", "ReturnType", "InstanceType", "ThisParameterType", "OmitThisParameter",
    "ThisType", "Uppercase", "Lowercase", "Capitalize", "Uncapitalize",
]
_BASIC = {t.lower() for t in BASIC_TYPES}
_HEAD = re.compile(
    r"(?=[acdefiltv])(?<![\w$.])(export\s+)?(default\s+)?((?:declare\s+|abstract\s+|async\s+)*)(const\s+enum|function\s*\*?|class|interface|type|enum|const|let|var)(?:\s+|(?=[{\[(]))([\w$]+(?=\s*[=<:;({,\n!]|\s+(?:extends|implements|in|of)\b|\s*$)|[{\[])?"
)
_RETURN = re.compile(r"return\b(?<![\w$.]return)")
_REFERENCE = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[\w$]+)*)")
_OPEN, _CLOSE = "([{", ")]}"
_JOINED, _CONTINUED = set("=,+-*/|&?:(<[{.!%^~"), set(".|&?:+*/=,")
_ENDING = re.compile(r"[()\[\]{};\n]")
#: Brackets and the separators that pieces() is asked for.
_PARTED = {x: re.compile(rf"[()\[\]{{}}<>{x}]") for x in (",", ";,\n")}
_BLANK, _ANGLES = re.compile(r"\s*"), re.compile(r"(?<=[\w$])<")
#: Words that tell what the next braces are.
_COMING = frozenset(["class", "enum", "interface", "import", "export", "function", "const", "let", "var", "default", "from"])
#: Words that name nothing, those that head a parenthesis without calling, and tokens behind which `any` is a type.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split())
_NOT_CALLED = RESERVED | {"await", "yield", "async", "of", "let"}
_TYPE_NEXT = {":", "as", "satisfies", "is", "keyof", "readonly", "extends", "|", "&", "=>"}
_MODIFIERS = {"public", "private", "protected", "static", "override", "abstract", "async", "get", "set", "*"}


def _angles(code: str, m: re.Match) -> list[int]:
    """Places of the angles of type arguments that open at m, or none where a comparison does."""
    depth, out = 0, []
    for i in range(m.end() - 1, min(len(code), m.end() + 400)):
        c = code[i]
        if c == "<" or (c == ">" and code[i - 1] != "="):
            depth += 1 if c == "<" else -1
            out.append(i)
            if not depth:
                return out
        elif c in ";" or (c == "=" and code[i + 1 : i + 2] != ">"):
            return []
    return []


def closing(code: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the end; for short texts."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] in _OPEN) - (code[i] in _CLOSE)
        if not depth:
            return i
    return len(code)


def pieces(code: str, separators: str) -> list[tuple[int, int]]:
    """(from, to) of the parts of code between separators that stand in no bracket."""
    out, depth, start = [], 0, 0
    angles = {x for m in _ANGLES.finditer(code) for x in _angles(code, m)} if "<" in code else ()
    for m in _PARTED[separators].finditer(code):
        i, c = m.start(), m[0]
        if c in _OPEN or (c == "<" and i in angles):
            depth += 1
        elif c in _CLOSE or (c == ">" and i in angles):
            depth -= 1
        elif c in separators and depth <= 0:
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(code))]


def statement_end(code: str, at: int) -> int:
    """Where a variable statement or type alias ends: at a semicolon, or at a line feed that cannot be inside it."""
    depth, seen, before = 0, at, ""
    for m in _ENDING.finditer(code, at):
        i, c = m.start(), m[0]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth < 0:
                return i
        elif depth:
            continue
        elif c == ";":
            return i
        else:
            # The last letter before the line feed that is not blank.
            before, seen = code[seen:i].rstrip()[-1:] or before, i
            after = _BLANK.match(code, i).end()
            if before not in _JOINED and code[after : after + 1] not in _CONTINUED:
                return i
    return len(code)


def pattern_names(pattern: str) -> list[str]:
    """Names that a destructuring pattern binds."""
    out = []
    for x, y in pieces(pattern.strip()[1:-1], ","):
        part = pattern.strip()[1:-1][x:y].strip().removeprefix("...").strip()
        if part.startswith(("{", "[")):
            out += pattern_names(part[: closing(part, 0) + 1])
            continue
        name, colon, rest = part.partition(":")
        rest = rest.strip()
        if colon and rest.startswith(("{", "[")):
            out += pattern_names(rest[: closing(rest, 0) + 1])
        else:
            found = re.match(r"[\w$]+", rest if colon else name)
            out += [found.group()] if found else []
    return out


def references(text: str, own: str) -> list[str]:
    """Types that a type text refers to: neither basic nor helpers, keys or `own`."""
    out = []
    for m in _REFERENCE.finditer(text):
        name, after = m.group(1), text[m.end() :].lstrip()
        if after.startswith(":") or after.startswith("?:") or name.split(".")[0].lower() in _BASIC or name in UTILITY_TYPES or name == own:
            continue
        if name in ("keyof", "typeof", "readonly", "extends", "infer", "is", "in", "as", "true", "false", "asserts", "unique", "new") or name[0].isdigit():
            continue
        out.append(name)
    return list(dict.fromkeys(out))


def members(body: str) -> list[tuple[str, str]]:
    """(name, type text) of an interface or object type."""
    out = []
    for x, y in pieces(body, ";,\n"):
        m = re.match(r"\s*(?:readonly\s+)?(\[[^\]]*\]|[\w$\"']+)\s*\??\s*(:|\()", body[x:y])
        if m:
            out.append((m.group(1).strip("\"'"), body[x:y][m.end() - (m.group(2) == "(") :].strip()))
    return out


def parameters(text: str) -> list[dict]:
    """name, type, optional, rest, default of each parameter."""
    out = []
    for x, y in pieces(text, ","):
        part = text[x:y].strip()
        if not part:
            continue
        head, _, default = part.partition("=") if "=>" not in part.split("=")[0] + "=" else (part, "", "")
        rest = head.startswith("...")
        head = head.removeprefix("...").strip()
        cut = closing(head, 0) + 1 if head[:1] in "{[" else len(re.match(r"[\w$]*\??", head).group())
        name, kind = head[:cut].strip(), head[cut:].strip().removeprefix(":").strip()
        out.append({"name": name.rstrip("?"), "type": kind, "optional": str(name.endswith("?") or bool(default)).lower(), "rest": str(rest).lower(), "default": default.strip()})
    return out


class Syntax:
    """What needs the tokens around: calls, tags, `any` and `as`. A parenthesis or keyword is judged by a few tokens before and behind it and by the kind of braces it stands in."""

    def __init__(self, tokens: Tokens, taken: set[int]):
        self.tokens, self.T, self.K, self.match = tokens, tokens.text, tokens.kind, tokens.match
        self.n, self.angles = len(self.T), {}
        self.heads = {i for i, p in enumerate(tokens.pos) if p in taken} if taken else set()
        self.around = self._braces()

    def t(self, i: int) -> str:
        return self.T[i] if 0 <= i < self.n else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.n and self.K[i] == "w"

    def member(self, i: int) -> bool:
        return self.t(i - 1) in (".", "?.") and self.K[i - 1] == "p"

    def _braces(self) -> list[str]:
        """For each token the kind of the innermost braces around it: block, class, type, names (of an import or export) or object."""
        out, stack, coming = [], ["block"], ""
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k == "p" and t == "}" and len(stack) > 1:
                stack.pop()
            out.append(stack[-1])
            if k == "w":
                if t not in _COMING or self.member(i) or self.t(i + 1) == ":":
                    continue
                if t in ("class", "enum") or (t == "interface" and self.is_word(i + 1)):
                    coming = {"enum": "object", "interface": "type"}.get(t, t)
                elif t in ("import", "export") and self.t(i + 1 + (self.t(i + 1) == "type")) in ("{", "*") or (t == "import" and self.t(i + 1) != "("):
                    coming = "names"
                elif t in ("function", "const", "let", "var", "default", "from"):
                    coming = ""
            elif k in "ps" and t[0] in ";'\"":
                coming = coming if t != ";" and coming != "names" else ""
            if k == "p" and t in ("{", "${"):
                before = self.t(i - 1)
                kind = coming or ("block" if before in (")", "=>", ";", "}", "{", "", "else", "do", "try", "finally") else "type" if before == ":" and stack[-1] in ("class", "type") else "object")
                stack.append(kind)
                coming = ""
        return out

    def type_arguments(self, i: int) -> int:
        """The `<` of type arguments that close with the `>` at i, or -1."""
        if i not in self.angles:
            depth, j = 0, i
            while j >= max(0, i - 200):
                t = self.t(j)
                depth += (t == ">") - (t == "<")
                if t in (";", "&&", "||") or (self.K[j] == "p" and t in ("{", "(") and self.match[j] > i):
                    break
                if not depth:
                    self.angles[i] = j if self.is_word(j - 1) else -1
                    return self.angles[i]
                j -= 1
            self.angles[i] = -1
        return self.angles[i]

    def operand_start(self, j: int) -> tuple[int, bool]:
        """First token of the operand whose last token is j, and whether it holds a call."""
        crossed = False
        while j >= 0:
            t = self.t(j)
            if self.K[j] == "p" and t == "!":
                j -= 1
                continue
            if self.K[j] == "p" and t == ">" and self.type_arguments(j) >= 0:
                j = self.type_arguments(j) - 1
                continue
            if self.K[j] == "p" and t in (")", "]") and 0 <= self.match[j] < j:
                crossed, j = crossed or t == ")", self.match[j]
                before = j - 1 - (self.t(j - 1) == "?.")
                if (self.is_word(before) and (self.t(before) not in _NOT_CALLED or self.member(before))) or self.t(before) in (")", "]", "!", ">") and self.K[before] == "p" and (self.t(before) != ">" or self.type_arguments(before) >= 0):
                    j = before
                    continue
            elif self.K[j] == "p" and t == "}" and 0 <= self.match[j] < j:
                j = self.match[j]
            elif self.K[j] == "t":
                while self.t(j - 1) == "}" and self.t(self.match[j - 1]) == "${":
                    j = self.match[j - 1] - 1
            elif self.member(j):
                j -= 2
                continue
            break
        return max(j, 0), crossed

    def calls(self):
        """(first, last token of what is called, its `(`)."""
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k != "p" or t != "(" or not i or i in self.heads or self.match[i] < i:
                continue
            last = i - 1 - (self.t(i - 1) == "?.")
            if self.t(last) == ">" and self.type_arguments(last) >= 0:
                last = self.type_arguments(last) - 1
            before, after = self.t(last), self.t(self.match[i] + 1)
            named = self.is_word(last)
            if not (named or before in (")", "]", "!") or self.K[last] == "t") or (named and before in _NOT_CALLED and not self.member(last)) or after == "=>":
                continue
            if before == "!" and not (self.is_word(last - 1) or self.t(last - 1) in (")", "]")) or self.around[i] == "type" or self.t(last - 1) in ("function", "*") and self.t(last - 2) in ("function", ")", "") or self.t(last - 1) == "function":
                continue
            if (named or before == "]") and not self.member(last) and self.around[i] in ("class", "object"):
                key = self.match[last] if before == "]" else last
                lead = self.t(key - 1)
                # A method, getter or setter: at the start of a member, with a body or a type behind it.
                if (lead in _MODIFIERS | {"{", ",", ";", "}"} or self.tokens.new_line(key) and lead not in _JOINED) and after in ("{", ":", ";"):
                    continue
            first, crossed = self.operand_start(last)
            if self.t(first - 1) == "new":
                if not crossed:
                    continue
                first -= 1
            yield first, last, i

    def chain(self, first: int, last: int) -> list[str]:
        """The names of a.b.c; whatever else stands at its head as text."""
        out: list[str] = []
        while last > first and self.is_word(last) and self.member(last):
            out.append(self.T[last])
            last -= 2
        return [self.tokens.source[self.tokens.pos[first] : self.tokens.end[last]].strip(), *out[::-1]]

    def tags(self):
        return (i for i, k in enumerate(self.K) if k == "j" and len(self.T[i]) > 1)

    def attributes(self, i: int) -> tuple[list[str], list[str], int]:
        """Names of attributes, spread values, and the end of the tag at i."""
        names, spread, j = [], [], i + 1
        while j < self.n and self.K[j] != "x":
            if self.K[j] == "a":
                names.append(self.T[j])
            elif self.K[j] == "p" and self.T[j] == "{" and self.match[j] > j:
                if self.t(j + 1) == "...":
                    spread.append(self.tokens.source[self.tokens.pos[j + 2] : self.tokens.pos[self.match[j]]].strip())
                j = self.match[j]
            j += 1
        return names, spread, self.tokens.end[min(j, self.n - 1)]

    def any_types(self):
        if "any" not in self.T:
            return
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k != "w" or t != "any" or self.member(i) or self.t(i + 1) in (":", ".", "(") or (self.t(i + 1) == "?" and self.t(i + 2) == ":"):
                continue
            before = self.t(i - 1)
            if before in _TYPE_NEXT:
                yield i
            elif before in ("<", ",", "(", "[", "=") and (before != "<" or self.t(i + 1) in (">", ",", "[", "|", "&")) and self._in_type(i):
                yield i

    def _in_type(self, i: int) -> bool:
        """Behind `<`, a comma, bracket or `=`: whether type arguments, a tuple or group in a type, or the default of an alias or parameter stand around."""
        depth = 0
        for j in range(i - 1, max(-1, i - 60), -1):
            t = self.t(j)
            if self.K[j] == "p" and t in (")", "]", "}", ">"):
                depth += 1
            elif self.K[j] == "p" and t in ("(", "[", "{", "<"):
                if depth:
                    depth -= 1
                elif t == "<":
                    return self.is_word(j - 1) or self.t(j - 1) in ("=", "(", ":")
                else:
                    return t != "{" and self.t(j - 1) in _TYPE_NEXT | {"<"} or (t in ("(", "[") and self.t(j - 1) == "=" and self._in_type(j))
            elif not depth and t == "type" and self.t(i - 1) in ("=", "(", "[", ","):
                return self.is_word(j + 1)
            elif not depth and t in (";", "=>"):
                return False
        return False

    def assertions(self):
        """(first token of the operand, the `as`) of every assertion."""
        if "as" not in self.T:
            return
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k != "w" or t != "as" or not i or self.around[i] == "names":
                continue
            operand = self.K[i - 1] in "nstrx" or self.t(i - 1) in (")", "]", "}", "!") or (self.is_word(i - 1) and (self.t(i - 1) not in _NOT_CALLED or self.member(i - 1)))
            if operand and i + 1 < self.n and (self.K[i + 1] in "wst" and self.t(i + 1) not in ("in", "of", "as") or self.t(i + 1) in ("{", "[", "(", "-")):
                first = self.operand_start(i - 1)[0]
                while self.t(first - 1) in ("as", "satisfies") and first > 1:
                    first = self.operand_start(first - 2)[0]
                yield first, i


def nodes(text: str, jsx: bool = True) -> list[dict]:
    """All nodes in order of their place. parent is the place of the smallest declaration around, -1 at the top. Calls, variables, parameters and tags carry no text: it would be stored once for each level."""
    tokens = Tokens(text, jsx)
    plain, code = tokens.blanked(strings=False), tokens.blanked()
    pairs = {tokens.pos[i]: tokens.pos[j] for i, j in enumerate(tokens.match) if j > i}
    closed_at = lambda at: pairs.get(at, len(code))
    lines = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(lines, at - 1) + 1
    out: list[dict] = []

    def add(kind: str, name: str, at: int, end: int, exported: bool = False, **more: str) -> None:
        first = line(at)
        begin = lines[first - 2] + 1 if first > 1 else 0
        out.append({"kind": kind, "name": name, "pos": at, "end": end, "start_line": first, "end_line": line(max(at, end - 1)), "start_column": at - begin + 1, "exported": exported, "more": more})

    taken: set[int] = set()
    for m in _HEAD.finditer(code):
        word, name, at = " ".join(m.group(4).split()), m.group(5), m.start()
        exported, default = m.group(1) is not None, m.group(2) is not None
        kind = {"const enum": "enum", "function*": "function", "function *": "function", "const": "variable", "let": "variable", "var": "variable"}.get(word, word)
        if name is None and not (default or kind == "function"):
            continue
        if kind == "type" and code[(after := _BLANK.match(code, m.end()).end()) : after + 1] not in ("=", "<"):
            continue
        if kind in ("function", "class", "interface", "enum"):
            if kind == "function":
                opened = code.find("(", m.end() - 1)
                closed = closed_at(opened) if opened >= 0 else m.end()
                taken.add(opened)
                body = code.find("{", closed)
                semi = code.find(";", closed)
                end = closed_at(body) + 1 if body >= 0 and (semi < 0 or body < semi) else closed + 1
                shown = name or ("default" if default else "")
                add(kind, shown, at, end, exported, default=str(default).lower(), returns=code[closed + 1 : body].strip().removeprefix(":").strip() if body > 0 else "")
                for p in parameters(plain[opened + 1 : closed]):
                    add("parameter", p["name"], opened + 1, closed, **{k: v for k, v in p.items() if k != "name"})
            else:
                body = code.find("{", m.end() - (name is None))
                end = closed_at(body) + 1 if body >= 0 else m.end()
                add(kind, name or "default", at, end, exported, default=str(default).lower())
                heritage = re.match(r"[^{]*?\bextends\s+([^{]*)", code[m.end() : body]) if body > 0 else None
                for r in references(heritage.group(1), name or "") if heritage else []:
                    add("reference", r, at, end, place="extends")
                if kind == "interface":
                    for member, typed in members(code[body + 1 : end - 1]):
                        add("member", member, body, end, type=typed)
                        for r in references(typed, name):
                            add("reference", r, body, end, place=member)
        elif kind == "type":
            end = statement_end(code, code.find("=", m.end() - 1))
            body = code[code.find("=", m.end() - 1) + 1 : end]
            add(kind, name, at, end, exported, default="false")
            inside = members(body.strip()[1:-1]) if body.strip().startswith("{") else []
            for place, typed in inside or [("", body)]:
                if place:
                    add("member", place, at, end, type=typed)
                for r in references(typed, name):
                    add("reference", r, at, end, place=place)
        else:
            end = statement_end(code, m.start(5))
            body = code[m.start(5) : end]
            for x, y in pieces(body, ","):
                part, base = body[x:y], m.start(5) + x
                # Declarators of one statement stand side by side.
                own_end = m.start(5) + y
                left, equals, right = part.partition("=") if not part.strip().startswith(("{", "[")) else (part.strip()[: closing(part.strip(), 0) + 1], *part.strip()[closing(part.strip(), 0) + 1 :].partition("=")[1:])
                right = right.strip().rstrip(";").strip()
                source = right if re.fullmatch(r"[^\W\d][\w$]*(\.[\w$]+)*|\$[\w$]*(\.[\w$]+)*", right) else ""
                function = bool(re.match(r"(async\s*)?(function\b|\([^)]*\)\s*(:[^=]+)?=>|[\w$]+\s*=>)", right))
                names = pattern_names(left) if left.strip().startswith(("{", "[")) else re.findall(r"^\s*([\w$]+)", left)
                for n in names:
                    add("variable", n, at if x == 0 else base + len(part) - len(part.lstrip()), own_end, exported, source=source, function=str(function).lower(), type=left.partition(":")[2].strip() if len(names) == 1 else "", declared=word)
                if function and len(names) == 1 and "(" in right:
                    opened = plain.find("(", base + part.index("="))
                    for p in parameters(plain[opened + 1 : closed_at(opened)]):
                        add("parameter", p["name"], opened + 1, closed_at(opened), **{k: v for k, v in p.items() if k != "name"})
    syntax = Syntax(tokens, taken)
    for first, last, opened in syntax.calls():
        chain, shut = syntax.chain(first, last), tokens.match[opened]
        argument = text[tokens.end[opened] : tokens.pos[shut]]
        cut = pieces(code[tokens.end[opened] : tokens.pos[shut]], ",")[0][1] if len(argument) < 2000 else 2000
        add("call", ".".join(chain), tokens.pos[first], tokens.end[shut], argument=argument[:cut].strip(), chain="\x1f".join(chain))
    for i in syntax.tags():
        attributes, spread, end = syntax.attributes(i)
        add("jsx", tokens.text[i][1:], tokens.pos[i], end, attributes=",".join(attributes), spread=",".join(spread))
    for i in syntax.any_types():
        add("any", "", tokens.end[i - 1] if i else 0, tokens.end[i])
    for m in _RETURN.finditer(code):
        add("return", "", m.start(), statement_end(code, m.start()))
    for first, i in syntax.assertions():
        add("as", "", tokens.end[first - 1] if first else 0, tokens.end[i + 1])
    out.sort(key=lambda n: (n["pos"], -n["end"]))
    stack: list[dict] = []
    for i, n in enumerate(out):
        while stack and stack[-1]["end"] < n["end"]:
            stack.pop()
        n["id"], n["parent"], n["depth"] = i, stack[-1]["id"] if stack else -1, len(stack)
        first, last = n["start_line"] - 1, n["pos"]
        n["text"] = text[(lines[first - 1] + 1 if first else 0) : (lines[first] if first < len(lines) else len(text))].strip() if n["kind"] in ("any", "as") else text[last : n["end"]] if n["kind"] not in ("call", "variable", "parameter", "jsx") else ""
        if n["kind"] in ("function", "class", "interface", "type", "enum", "variable"):
            stack.append(n)
    return out
