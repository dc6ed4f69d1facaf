"""Declarations and calls of Go files, by a scanner of their tokens.

One row per declaration, import and call; names are resolved afterwards by
joins. Types of variables come from receivers, parameters, var declarations and
composite literals of the same function. Where a type is that of a field, of an
element that is ranged over or of a call's result, the row of a call has a chain of
steps to it, which joins with the rows of fields and results follow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_tokens = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<rune>'(?:[^'\\\n]|\\.)+')|(?P<name>[^\W\d]\w*)|(?P<num>\.?\d(?:[\w.]|[eEpP][+-])*)|(?P<op>&&|\|\||:=|\.\.\.|<-|[^\s\w\"'`])", re.S)
_closing = {"(": ")", "[": "]", "{": "}"}
_escapes = re.compile(r"\\([abfnrtv\\'\"])")
_plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}

KINDS = ["file", "row", "pkg", "name", "recv", "line", "end_line", "exported", "cyclomatic", "fingerprint", "alias", "target", "owner", "receiver", "method", "values", "args", "http", "route_type", "prefix", "echo", "chain"]
SCHEMA = "file string, row string, pkg string, name string, recv string, line int, end_line int, exported boolean, cyclomatic int, fingerprint string, alias string, target string, owner string, receiver string, method string, values array<string>, args array<string>, http boolean, route_type string, prefix string, echo boolean, chain array<string>"


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    end: int


class GoSyntaxError(ValueError):
    """A file that does not scan; indexing stops with it."""


def scan(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _tokens.match(source, at)
        if m is None:
            raise GoSyntaxError(f"unexpected character at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup or "", m[0], m.start(), m.end()))
        at = m.end()
    return out


def literal(token: Token) -> str:
    if token.text[0] == "`":
        return token.text[1:-1]
    return _escapes.sub(lambda m: _plain.get(m[1], m[1]), token.text[1:-1])


def matching(tokens: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    stack = []
    for k in range(at, len(tokens)):
        text = tokens[k].text
        if tokens[k].kind != "op":
            continue
        if text in _closing:
            stack.append(_closing[text])
        elif stack and text == stack[-1]:
            stack.pop()
            if not stack:
                return k
    raise GoSyntaxError("unbalanced brackets")


def split(tokens: list[Token], start: int, stop: int) -> list[tuple[int, int]]:
    """Ranges between the commas of the outermost level."""
    parts, at, k = [], start, start
    while k < stop:
        if tokens[k].text in _closing and tokens[k].kind == "op":
            k = matching(tokens, k)
        elif tokens[k].text == ",":
            parts.append((at, k))
            at = k + 1
        k += 1
    return [p for p in [*parts, (at, stop)] if p[0] < p[1]]


def type_name(tokens: list[Token]) -> str:
    """``pkg.T`` or ``T`` of a type expression; blank for other types."""
    words = [t.text for t in tokens if t.text not in ("*", "&", "...")]
    if words[:1] and re.match(r"\w", words[0]) and words[0] not in ("func", "map", "chan", "struct", "interface"):
        return ".".join([words[0], words[2]]) if words[1:2] == ["."] and len(words) > 2 else words[0]
    return ""


def deep_type(tokens: list[Token]) -> tuple[int, str]:
    """How often the elements are to be taken, and ``pkg.T`` or ``T``; blank for other types."""
    depth, k = 0, 0
    while k < len(tokens):
        text = tokens[k].text
        if text == "...":
            depth, k = depth + 1, k + 1
        elif text == "[":
            depth, k = depth + 1, matching(tokens, k) + 1
        elif text == "map" and k + 1 < len(tokens):
            depth, k = depth + 1, matching(tokens, k + 1) + 1
        elif text == "chan":
            depth, k = depth + 1, k + 1
        elif text in ("*", "&", "<-"):
            k += 1
        else:
            break
    return depth, type_name(tokens[k:])


def dotted(tokens: list[Token]) -> str:
    """``a.b.c`` if that is all there is."""
    text = "".join(t.text for t in tokens)
    return text if re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*", text) else ""


class File:
    """One file's rows."""

    def __init__(self, path: str, source: str):
        self.path, self.source, self.tokens = path, source, scan(source)
        self.lines = [m.start() for m in re.finditer("\n", source)]
        self.imports: dict[str, str] = {}
        self.pkg = ""
        self.rows: list[dict] = []
        self.results: dict[str, str] = {}
        self.deep: dict[str, list[str]] = {}  # chains of the variables of a function

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.lines, at) + 1

    def add(self, row: str, **fields) -> None:
        self.rows.append({"file": self.path, "row": row, "pkg": self.pkg, **fields})

    def read(self) -> list[dict]:
        t, k = self.tokens, 0
        if len(t) < 2 or t[0].text != "package":
            raise GoSyntaxError(f"{self.path}: no package clause")
        self.pkg = t[1].text
        self.add("package", name=self.pkg, line=self.line(t[0].at))
        functions = []
        k = 2
        while k < len(t):
            text = t[k].text
            if text == "import" and t[k].kind == "name":
                k = self.read_imports(k)
            elif text == "func" and t[k].kind == "name":
                k, function = self.read_function(k)
                functions.append(function)
            elif text == "type" and t[k].kind == "name":
                k = self.read_types(k)
            elif text in _closing and t[k].kind == "op":
                k = matching(t, k)
            k += 1
        for function in functions:
            self.read_body(*function)
        return self.rows

    def read_imports(self, k: int) -> int:
        t = self.tokens
        start, stop = (k + 2, matching(t, k + 1)) if t[k + 1].text == "(" else (k + 1, next(j for j in range(k + 1, len(t)) if t[j].kind == "str") + 1)
        alias = ""
        for j in range(start, stop):
            if t[j].kind == "str":
                path = literal(t[j])
                parts = path.split("/")
                plain = parts[-2] if len(parts) > 1 and re.fullmatch(r"v\d+", parts[-1]) else parts[-1]
                self.imports[alias or plain] = path
                self.add("import", alias=alias or plain, target=path, line=self.line(t[j].at))
                alias = ""
            elif t[j].text != ";":
                alias = t[j].text
        return stop - (0 if t[k + 1].text == "(" else 1)

    def read_types(self, k: int) -> int:
        """Fields of the structures that a declaration, or a group of them, names; returns its last place."""
        t = self.tokens
        group = t[k + 1].text == "("
        j, last = k + 1 + group, matching(t, k + 1) if group else None
        while j < (last if group else min(k + 2, len(t))):
            name, at = t[j], j + 1
            if at < len(t) and t[at].text == "[" and t[at + 1].kind == "name":  # type parameters
                at = matching(t, at) + 1
            if name.kind == "name" and at + 1 < len(t) and t[at].text == "struct" and t[at + 1].text == "{":
                stop = matching(t, at + 1)
                for a, b in self.lines_of(at + 2, stop):
                    self.read_field(name.text, t[a:b])
                if not group:
                    return stop
                j = stop
            elif t[j].text in _closing and t[j].kind == "op":
                j = matching(t, j)
            j += 1
        return last if group else k + 1

    def lines_of(self, start: int, stop: int) -> list[tuple[int, int]]:
        """Ranges between line ends and semicolons of the outermost level."""
        t, out, at, k = self.tokens, [], start, start
        while k < stop:
            if k > at and (t[k].text == ";" or "\n" in self.source[t[k - 1].end : t[k].at]):
                out.append((at, k))
                at = k + (t[k].text == ";")
            if t[k].text in _closing and t[k].kind == "op":
                k = matching(t, k)
            k += 1
        return [r for r in [*out, (at, stop)] if r[0] < r[1]]

    def read_field(self, owner: str, part: list[Token]) -> None:
        part = part[:-1] if part[-1].kind == "str" else part
        if not part:
            return
        words = [x.text for x in part]
        if len(part) == 1 or words[0] == "*" or words[1] == ".":  # embedded
            self.add("field", name=owner, alias=words[-1], target=self.typed(part), line=self.line(part[0].at))
            return
        k = 0
        while k + 2 < len(part) and words[k + 1] == ",":
            k += 2
        for name in words[: k + 1 : 2]:
            self.add("field", name=owner, alias=name, target=self.typed(part[k + 1 :]), line=self.line(part[0].at))

    def typed(self, tokens: list[Token]) -> str:
        """``import path|type|depth``, blank if it can't be told."""
        depth, name = deep_type(tokens)
        package, _, plain = name.rpartition(".")
        if not name or (package and package not in self.imports):
            return ""
        return f"{self.imports.get(package, '')}|{plain}|{depth}"

    def parameters(self, start: int, stop: int) -> dict[str, str]:
        """Types of named parameters; ``a, b T`` gives both."""
        found, waiting = {}, []
        self.deep = {}
        for a, b in split(self.tokens, start, stop):
            part = self.tokens[a:b]
            if len(part) == 1 and part[0].kind == "name":
                waiting.append(part[0].text)
            elif part[0].kind == "name" and part[1].text != ".":
                for name in [*waiting, part[0].text]:
                    found[name] = type_name(part[1:])
                    if not found[name] and self.typed(part[1:]):
                        self.deep[name] = ["t|" + self.typed(part[1:])]
                waiting = []
        return found

    def read_function(self, k: int) -> tuple[int, tuple]:
        t, start = self.tokens, k
        recv, types = "", {}
        k += 1
        if t[k].text == "(":
            stop = matching(t, k)
            inner = t[k + 1 : stop]
            recv = type_name(inner[1:] if len(inner) > 1 and inner[0].kind == "name" and inner[1].text not in (".", "[") else inner)
            if len(inner) > 1 and inner[0].kind == "name":
                types[inner[0].text] = recv
            k = stop + 1
        name = t[k].text
        k += 1
        if t[k].text == "[":
            k = matching(t, k) + 1
        stop = matching(t, k)
        types |= self.parameters(k + 1, stop)
        k = stop + 1
        first_result = k
        while k < len(t) and t[k].text != "{" and not (t[k].kind == "name" and t[k].text == "func" and "\n" in self.source[t[k - 1].end : t[k].at]):
            if t[k].text in ("interface", "struct") and t[k + 1].text == "{":
                k = matching(t, k + 1)
            elif t[k].text in ("(", "["):
                k = matching(t, k)
            elif "\n" in self.source[t[k - 1].end : t[k].at]:
                break  # a declaration without a body
            k += 1
        result = t[first_result:k]
        deep = self.deep
        told = [t[a:b] for a, b in split(t, first_result + 1, matching(t, first_result))] if result and result[0].text == "(" else [result] if result else []
        named = any(len(p) > 1 and p[0].kind == "name" and (p[1].kind == "name" or p[1].text == "*" or [x.text for x in p[1:3]] == ["[", "]"]) for p in told)
        if result and result[0].text == "(":
            result = [x for a, b in split(t, first_result + 1, matching(t, first_result))[:1] for x in t[a:b]]
        body = k < len(t) and t[k].text == "{"
        end = matching(t, k) if body else k - 1
        label = f"{recv}.{name}" if recv else name
        for i, part in enumerate(told):
            if target := self.typed(part[1:] if named and len(part) > 1 else part):
                self.add("result", name=label, alias=str(i), target=target, line=self.line(t[start].at))
        if not recv:
            self.results[name] = type_name(result)
        tokens = t[k : end + 1] if body else []
        words = [x.text for x in tokens if x.kind in ("name", "op")]
        typed = sum(1 for a, b, c, d in zip(words, words[1:], words[2:], words[3:], strict=False) if (a, b, c, d) == (".", "(", "type", ")"))
        cyclomatic = 1 + sum(w in ("if", "for", "select", "case", "&&", "||") for w in words) + typed
        text = self.source[t[start].at : t[end].end]
        self.add("func", name=label, recv=recv, line=self.line(t[start].at), end_line=self.line(t[end].at), exported=name[:1].isupper(), cyclomatic=cyclomatic, fingerprint=hashlib.sha1(text.encode()).hexdigest())
        return end, (label, types, k, end if body else k, deep)

    def read_body(self, label: str, types: dict[str, str], start: int, stop: int, deep: dict[str, list[str]]) -> None:
        t, prefixes = self.tokens, {}
        chain: dict[int, str] = {}  # route prefixes of calls, by the place of their closing bracket
        for k in range(start + 1, stop):
            if t[k].kind != "name":
                continue
            if t[k].text == "var" and t[k + 1].kind == "name":
                types[t[k + 1].text] = type_name(t[k + 2 : k + 6])
            if t[k + 1].text == ":=":
                types[t[k].text] = self.value_type(k + 2)
                self.follow(k, stop, types, deep)
            if t[k + 1].text not in ("(", "[") or t[k].text in ("func", "if", "for", "switch", "return", "range", "case", "select", "go", "defer", "map", "chan"):
                continue
            at = k + 1
            if t[at].text == "[":
                at = matching(t, at) + 1
                if at >= stop or t[at].text != "(":
                    continue
            close = matching(t, at)
            first = k
            while first >= 2 and t[first - 1].text == "." and t[first - 2].kind == "name":
                first -= 2
            chained = t[first - 1].text == "."
            if first >= 1 and t[first - 1].text == "func":
                continue
            receiver = "" if chained else dotted(t[first : k - 1]) if k > first else ""
            arguments = split(t, at + 1, close)
            values = [literal(t[a]) for a, b in arguments if b == a + 1 and t[a].kind == "str" and len(t[a].text) > 2]
            names = ["func" if t[a].text == "func" else self.descriptor(dotted(t[a:b]), types) for a, b in arguments]
            root = receiver.split(".")[0]
            before = chain.get(first - 2, "") if chained else prefixes.get(receiver, "")
            method = t[k].text
            if method == "Group":
                segment = next((v for v in values if v.startswith("/")), "")
                chain[close] = join_route(before, segment) if segment else before
                if t[first - 1].text in (":=", "=") and t[first - 2].kind == "name":
                    prefixes[t[first - 2].text] = chain[close]
            typed = types.get(root, "") if receiver == root else ""
            echo = typed.split(".")[-1] in ("Echo", "Group") and "labstack/echo" in self.imports.get(typed.split(".")[0], "")
            if echo:
                path = next((i for i, (a, b) in enumerate(arguments) if b == a + 1 and t[a].kind == "str" and literal(t[a]).startswith("/")), None)
                names = names[path + 1 : path + 2] if path is not None else []
            target = "" if chained else self.descriptor(f"{receiver}.{method}" if receiver else method, types)
            steps = []
            if receiver and not chained and not target and root not in self.imports:
                base = deep.get(root) or ([f"t|{self.imports.get(types[root].rpartition('.')[0], '')}|{types[root].rpartition('.')[2]}|0"] if types.get(root) else None)
                steps = [*base, *(f"f|{x}" for x in receiver.split(".")[1:])] if base else []
            self.add("call", owner=label, chain=steps, name=method, receiver=receiver, method=method, target=target, values=values, args=[n for n in names if n], http=self.imports.get(receiver) == "net/http", route_type=typed.split(".")[-1], prefix=before, echo=echo, line=self.line(t[k].at))

    def follow(self, k: int, stop: int, types: dict[str, str], deep: dict[str, list[str]]) -> None:
        """Chains of the variables that end at ``k``, before ``:=``."""
        t, names = self.tokens, [k]
        while names[0] >= 2 and t[names[0] - 1].text == "," and t[names[0] - 2].kind == "name":
            names.insert(0, names[0] - 2)
        ranged = t[k + 2].text == "range"
        chain = self.chain_of(k + 2 + ranged, stop, types, deep)
        for i, at in enumerate(names):
            name = t[at].text
            deep.pop(name, None)
            if not chain or name == "_" or (types.get(name) and len(names) == 1):
                continue
            if ranged:
                if i == 1:
                    deep[name], types[name] = [*chain, "e"], ""
            elif chain[-1].startswith(("c|", "p|")):
                deep[name], types[name] = [*chain[:-1], chain[-1].rpartition("|")[0] + f"|{i}"], ""
            elif len(names) == 1:
                deep[name], types[name] = chain, ""

    def chain_of(self, k: int, stop: int, types: dict[str, str], deep: dict[str, list[str]]) -> list[str]:
        """Steps to the type of the expression at ``k``, as far as it is names, calls and indices; empty for others."""
        t = self.tokens
        while t[k].text in ("&", "*"):
            k += 1
        if t[k].kind != "name":
            return []
        root, chain = t[k].text, []
        k += 1
        if root in deep:
            chain = list(deep[root])
        elif types.get(root):
            package, _, plain = types[root].rpartition(".")
            chain = [f"t|{self.imports.get(package, '')}|{plain}|0"]
        elif root in self.imports and root not in types and t[k].text == "." and t[k + 2].text == "(":
            chain, k = [f"p|{self.imports[root]}|{t[k + 1].text}|0"], matching(t, k + 2) + 1
        elif t[k].text == "(" and root not in types:
            chain, k = [f"p||{root}|0"], matching(t, k) + 1
        else:
            return []
        while k < stop and "\n" not in self.source[t[k - 1].end : t[k].at]:
            if t[k].text == "." and t[k + 1].kind == "name":
                if t[k + 2].text == "(":
                    chain.append(f"c|{t[k + 1].text}|0")
                    k = matching(t, k + 2) + 1
                else:
                    chain.append(f"f|{t[k + 1].text}")
                    k += 2
            elif t[k].text == "[":
                end = matching(t, k)
                if all(x.text != ":" for x in t[k:end]):  # a slice of it has its type
                    chain.append("e")
                k = end + 1
            elif t[k].text in ("{", ";", ",", ")", "}"):
                break
            else:
                return []
        return chain

    def value_type(self, k: int) -> str:
        """Type of what a variable is set to: a composite literal or a call of a function of this file."""
        t = self.tokens
        if t[k].text == "&":
            k += 1
        words = [x.text for x in t[k : k + 4]]
        if words[1:2] == ["{"]:
            return words[0]
        if words[1:2] == ["."] and words[3:4] == ["{"]:
            return f"{words[0]}.{words[2]}"
        return self.results.get(words[0], "") if words[1:2] == ["("] else ""

    def descriptor(self, name: str, types: dict[str, str]) -> str:
        """``import path|type|function`` that a dotted name may mean; blank if it can't be told."""
        parts = name.split(".") if name else []
        if len(parts) == 1:
            return f"||{parts[0]}"
        if len(parts) != 2:
            return ""
        if typed := types.get(parts[0]):
            package, _, plain = typed.rpartition(".")
            return f"{self.imports.get(package, '') if package else ''}|{plain}|{parts[1]}"
        if parts[0] in types:
            return ""
        return f"{self.imports[parts[0]]}||{parts[1]}" if parts[0] in self.imports else f"|{parts[0]}|{parts[1]}"


def join_route(prefix: str, route: str) -> str:
    return f"/{prefix.strip('/')}/{route.removeprefix('/')}" if prefix else route


def declarations(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` from (path, content); a file that does not scan is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}.get(t, pa.string())) for n, t in (x.split() for x in SCHEMA.split(", "))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = File(path, content).read()
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in KINDS} for r in rows], schema=schema)

    return files.select("path", "content").mapInArrow(read, SCHEMA)


