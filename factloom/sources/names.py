"""Names of a file: its scopes, the names that these bind, and every place where a name is used, read off the tokens. Which use belongs to which binding is for joins (operators/binding.py)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.sources.outline import RESERVED, Syntax
from factloom.sources.tokens import Tokens

#: Rows of a batch that a task gives.
BATCH_ROWS = 20_000
_ROW = "path string, id long, kind string, name string, more string, pos long, end long, line int, column int"
#: Words of the language that stand before a name without being one, and such that name nothing anywhere.
_LEADING = {"type", "interface", "enum", "namespace", "declare", "abstract", "async", "await", "yield", "of", "as", "satisfies", "static", "readonly", "get", "set", "implements", "public", "private", "protected", "keyof", "infer", "is", "asserts", "unique", "override", "from", "let"}
_BINDING = frozenset(["function", "class", "interface", "enum", "type", "namespace", "const", "let", "var", "import", "export"])
_NOTHING = RESERVED | {"this", "super", "null", "true", "false", "undefined", "any", "string", "number", "boolean", "unknown", "never", "bigint", "symbol"}


class Names(Syntax):
    """rows: (kind scope | binding | use, name, more, pos, end). A scope's name is file, block, function or class; a binding's more tells how it binds. Every binding is a use too."""

    def __init__(self, text: str, jsx: bool = True):
        super().__init__(Tokens(text, jsx), set())
        self.rows = [("scope", "file", "", 0, len(text) + 1)]
        self.silent: set[int] = set()
        self._scopes()
        self._bindings()
        self._uses()

    def scope(self, kind: str, i: int, end: int) -> None:
        self.rows.append(("scope", kind, "", self.tokens.pos[i], end))

    def next_statement(self, i: int) -> bool:
        """Whether the word at i begins a line that does not carry the one before on."""
        return self.K[i] == "w" and self.tokens.new_line(i) and (self.K[i - 1] != "p" or self.T[i - 1] in (")", "]", "}")) and self.T[i] not in ("instanceof", "in", "of", "as", "satisfies")

    def body_end(self, i: int) -> int:
        """Where the statement or expression that begins with token i ends: its braces, or the first comma, semicolon, closing bracket or new line outside of brackets."""
        start = i
        while i < self.n:
            if self.K[i] == "p" and self.T[i] in (")", "]", "}", ",", ";") or (i > start and self.next_statement(i)):
                break
            if self.K[i] == "p" and self.match[i] > i:
                i = self.match[i]
                if i > start and self.t(i) == "}" and self.t(start) == "{":
                    return self.tokens.end[i]
            i += 1
        return self.tokens.end[max(start, i - 1)] if start < self.n else self.tokens.end[-1]

    def _scopes(self) -> None:
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k == "w" and self.t(i + 1) == "=>" and not self.member(i) and self.t(i - 1) != ":":
                self.scope("function", i, self.body_end(i + 2))
                self.bound(i, i + 1, "parameter")
            if k != "p" or t not in ("(", "{") or self.match[i] <= i:
                continue
            shut = self.match[i]
            after = shut + 1
            if t == "{":
                # The braces of a body belong to its function or class already; another scope in between changes nothing.
                inside = self.around[i + 1] if i + 1 < self.n else "block"
                if inside in ("block", "class", "type"):
                    self.scope({"type": "class"}.get(inside, inside), i, self.tokens.end[shut])
                continue
            before = i - 1
            if self.t(before) == ">" and self.type_arguments(before) >= 0:
                before = self.type_arguments(before) - 1
            lead = self.t(before)
            if lead in ("for", "catch") and not self.member(before):
                self.scope("block", i, self.body_end(after) if after < self.n else self.tokens.end[shut])
                if lead == "catch":
                    self.bound(i + 1, shut, "parameter")
                continue
            if self.t(after) == ":":  # a type, up to the body
                j = after + 1
                while j < self.n and self.t(j) not in ("=>", ";", ",", ")", "=") and not (self.t(j) == "{" and j > after + 1 and self.t(j - 1) not in ("|", "&", ":")):
                    j = self.match[j] + 1 if self.K[j] == "p" and self.match[j] > j else j + 1
                after = j if self.t(j) in ("=>", "{") else after
            arrow = self.t(after) == "=>" and not (self.around[i] == "type")
            named = self.is_word(before) and (lead == "function" or self.t(before - 1) in ("function", "*")) or lead == "*"
            method = self.around[i] in ("class", "object") and self.is_word(before) and self.t(after) in ("{", ":") and lead not in ("if", "while", "switch", "with")
            if arrow or named or method:
                first = before if named and self.t(before - 1) in ("function", "*") and self.t(before) != "function" else i
                self.scope("function", i, self.body_end(after + 1 if arrow else after) if self.t(after) in ("=>", "{") else self.tokens.end[shut])
                self.bound(i + 1, shut, "parameter")
                if method:
                    self.silent.add(first - 1 if first == i else first)

    def bound(self, i: int, stop: int, kind: str) -> int:
        """Binds the names of a list of patterns from token i on; gives where it ended."""
        braces, wanted = [], True
        while i < stop:
            t = self.T[i]
            if self.K[i] == "p":
                if wanted and t in ("{", "["):
                    braces.append((self.match[i], t))
                elif braces and i == braces[-1][0]:
                    braces.pop()
                    wanted = False
                elif t == ",":
                    wanted = True
                elif t in (":", "=") and not (wanted and t == ":"):
                    # A type or default: up to the next comma of this list.
                    end = braces[-1][0] if braces else stop
                    i += 1
                    while i < end and self.t(i) != "," and not (t == ":" and self.t(i) == "=" and not braces):
                        if kind in ("const", "let", "var") and not braces and (self.t(i) in (";", "of", "in") or self.next_statement(i)):
                            return i
                        i = self.match[i] + 1 if self.K[i] == "p" and self.match[i] > i else self._behind_types(i)
                    continue
                elif t == ";" or (t in (")", "}", "]") and not braces):
                    return i
            elif self.K[i] == "w" and wanted and not self.t(i).startswith("@"):
                if braces and braces[-1][1] == "{" and self.t(i + 1) == ":":
                    self.silent.add(i)
                    i += 2
                    continue
                if not (t in ("public", "private", "protected", "readonly", "override") and self.is_word(i + 1)):
                    self.bind(i, kind)
                    wanted = False
            elif kind in ("const", "let", "var") and not wanted and not braces and self.K[i] == "w":
                return i
            i += 1
        return i

    def _behind_types(self, i: int) -> int:
        """The next token, with the type arguments that open at i left behind."""
        if self.t(i) == "<" and self.is_word(i - 1):
            depth, j = 0, i
            while j < min(self.n, i + 60):
                depth += (self.t(j) == "<") - (self.t(j) == ">")
                if not depth:
                    return j + 1
                j += 1
        return i + 1

    def bind(self, i: int, kind: str) -> None:
        self.rows.append(("binding", self.T[i], kind, self.tokens.pos[i], self.tokens.end[i]))

    def _bindings(self) -> None:
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k != "w" or t not in _BINDING or self.member(i):
                continue
            name = i + 1 + (self.t(i + 1) == "*")
            if t in ("function", "class", "interface", "enum", "type", "namespace") and self.is_word(name) and self.t(name) not in ("extends", "implements", "from", "in", "of", "as") and (t != "type" or self.t(name + 1) in ("=", "<")):
                if self.around[i] != "names":
                    self.bind(name, t)
            elif t in ("const", "let", "var") and self.t(i + 1) != "enum" and self.around[i] not in ("object", "type"):
                self.bound(i + 1, self.n, t)
            elif t == "import" and self.t(i + 1) not in ("(", "."):
                j = i + 1 + (self.t(i + 1) == "type" and self.t(i + 2) not in ("from", ",", "="))
                while j < self.n and self.K[j] != "s" and self.t(j) not in (";", "=", "from"):
                    if self.t(j) in ("as", "type") and self.is_word(j + 1):
                        self.silent.add(j)
                    elif self.is_word(j) and self.t(j + 1) == "as":
                        self.silent.add(j)
                    elif self.is_word(j):
                        self.bind(j, "import")
                    j += 1
            elif t == "export" and self.t(i + 1 + (self.t(i + 1) == "type")) == "{":
                opened = i + 1 + (self.t(i + 1) == "type")
                foreign = self.t(self.match[opened] + 1) == "from"
                self.silent.update(j for j in range(opened, self.match[opened]) if foreign or self.t(j) == "as" or self.t(j - 1) == "as")

    def _uses(self) -> None:
        for i, (k, t) in enumerate(zip(self.K, self.T)):
            if k == "j" and (t[1:2].isupper() or "." in t):
                head = t[1:].split(".")[0]
                self.rows.append(("use", head, "tag", self.tokens.pos[i] + 1, self.tokens.pos[i] + 1 + len(head)))
            if k != "w" or t in _NOTHING or i in self.silent or self.member(i):
                continue
            before, after, inside = self.t(i - 1), self.t(i + 1), self.around[i]
            if t in _LEADING and self.is_word(i + 1) and not self.tokens.new_line(i + 1):
                continue
            starts = before in ("{", ",", ";", "}") or before in ("readonly", "static", "public", "private", "protected", "get", "set", "async", "*") or self.tokens.new_line(i)
            key = after == ":" or (after == "?" and self.t(i + 2) in (":", "("))
            if starts and (inside == "object" and after in (":", "=") or inside in ("class", "type") and (key or after in ("(", "=", ";", "!", "<"))):
                continue
            if inside == "block" and after == ":" and before in (";", "{", "}", "") and t not in ("default",):
                continue  # a label
            if key and before in ("(", ",", "[") and self.t(i - 1) != "?" and inside == "type":
                continue  # a parameter of a function type
            self.rows.append(("use", t, "", self.tokens.pos[i], self.tokens.end[i]))


def names(files: DataFrame) -> DataFrame:
    """One row per scope, binding and use of each file (path, content); id numbers a file's rows, line and column are 1-based."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    labels = [x.split()[0] for x in _ROW.split(", ")]

    def run(it):
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=labels)
        for batch in it:
            columns = [[] for _ in labels]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = content or ""
                rows = sorted(Names(text, not path.endswith(".ts")).rows, key=lambda r: (r[3], -r[4], r[0]))
                line, at, begin = 1, 0, 0
                for nth, (kind, name, more, pos, end) in enumerate(rows):
                    lines = text.count("\n", at, pos)
                    line, begin, at = line + lines, text.rfind("\n", at, pos) + 1 if lines else begin, pos
                    for c, v in zip(columns, (path, nth, kind, name, more, pos, end, line, pos - begin + 1)):
                        c.append(v)
                if len(columns[0]) >= BATCH_ROWS:
                    yield made(columns)
                    columns = [[] for _ in labels]
            yield made(columns)

    return files.select("path", "content").mapInArrow(run, _ROW)
