"""Declarations and facts of one Java source text, in plain Python.

Declarations are parsed by descent over tokens; bodies are walked once for
calls, local variables, references to fields, thrown and asserted exceptions.
Generics, annotations, records, sealed types, text blocks, pattern matching and
contextual keywords are read; what isn't Java is a ParseFailure.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class ParseFailure(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # id, num, str, text, char, op
    text: str
    line: int
    column: int


_TOKEN = re.compile(
    r'(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""[ \t]*\n.*?(?<!\\)""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<char>\'(?:[^\'\\\n]|\\.)+\')'
    r"|(?P<num>(?:0[xXbB][0-9a-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?))|(?P<id>[^\W\d]\w*|\$[\w$]*)(?P<more>[\w$]*)"
    r"|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||[<=!+\-*/&|^%]=|<<=|[{}()\[\];,.@=<>!~?:+\-*/&|^%])",
    re.S,
)
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected "
    "public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
) | PRIMITIVES
ASSERTS = ("assertThrows", "expectThrows", "expectException")


def tokens(source: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            if source[at] == "\x1a":
                break
            raise ParseFailure(f"line {line}: unexpected {source[at]!r}")
        if m.lastgroup != "space":
            kind = "id" if m.lastgroup == "more" else m.lastgroup
            out.append(Token(kind, m[0], line, at - start + 1))
        breaks = m[0].count("\n")
        if breaks:
            line += breaks
            start = at + m[0].rindex("\n") + 1
        at = m.end()
    return out


def slashed(name: str) -> str:
    return name.replace(".", "/")


def bare(t: str) -> str:
    """A type without type arguments, arrays and varargs."""
    while (less := re.sub(r"<[^<>]*>", "", t)) != t:
        t = less
    return t.replace("[]", "").replace("...", "").strip()


class Reader:
    def __init__(self, file: str, source: str, enum_members: bool = False):
        self.file, self.t, self.i, self.enum_members = file, tokens(source), 0, enum_members
        self.end = Token("op", "", self.t[-1].line if self.t else 1, 1)
        self.package, self.imports = "", []
        self.rows: dict[str, list[dict]] = {k: [] for k in ("nodes", "edges", "call_sites", "values", "exceptions", "field_refs", "files", "type_mentions", "bodies")}
        self.fields: dict[str, dict[str, str]] = {}  # class -> field -> type

    # --- tokens -----------------------------------------------------------------------------
    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else self.end

    def at(self, *texts: str, k: int = 0) -> bool:
        p = self.peek(k)
        return p.text in texts and p.kind in ("op", "id")

    def take(self, *texts: str) -> Token:
        p = self.peek()
        if texts and not (p.text in texts and p.kind in ("op", "id")):
            raise ParseFailure(f"line {p.line}: expected {' or '.join(texts)}, found {p.text!r}")
        if not p.text:
            raise ParseFailure("unexpected end of file")
        self.i += 1
        return p

    def name(self) -> Token:
        p = self.peek()
        if p.kind != "id" or p.text in KEYWORDS:
            raise ParseFailure(f"line {p.line}: expected a name, found {p.text!r}")
        self.i += 1
        return p

    def skip(self, opening: str, closing: str) -> tuple[int, int]:
        """Past a bracketed part; the places of its inner tokens."""
        self.take(opening)
        start, depth = self.i, 1
        while depth:
            p = self.take()
            if p.kind == "op":
                depth += (p.text == opening) - (p.text == closing)
        return start, self.i - 1

    def dotted(self) -> str:
        parts = [self.name().text]
        while self.at(".") and self.peek(1).kind == "id" and self.peek(1).text not in KEYWORDS:
            self.i += 1
            parts.append(self.name().text)
        return ".".join(parts)

    def type(self) -> str:
        """A type as written, spaces only after commas."""
        self.annotations()
        if self.at("?"):
            self.take()
            if self.at("extends", "super"):
                word = self.take().text
                return f"? {word} {self.type()}"
            return "?"
        p = self.peek()
        out = self.take().text if p.text in PRIMITIVES else self.name().text
        while True:
            if self.at("<"):
                out += self.arguments()
            elif self.at(".") and (self.peek(1).kind == "id" or self.at("@", k=1)):
                self.take()
                self.annotations()
                out += "." + self.name().text
            else:
                break
        while True:
            self.annotations()
            if self.at("[") and self.at("]", k=1):
                self.i += 2
                out += "[]"
            else:
                break
        return out

    def arguments(self) -> str:
        self.take("<")
        parts = []
        while not self.at(">"):
            one = self.type()
            while self.at("&", "extends", "super"):
                word = self.take().text
                one += f" {word} {self.type()}"
            parts.append(one)
            if self.at(","):
                self.take()
            elif not self.at(">"):
                raise ParseFailure(f"line {self.peek().line}: no end of type arguments")
        self.take(">")
        return "<" + ", ".join(parts) + ">"

    def annotations(self) -> None:
        while self.at("@") and not self.at("interface", k=1):
            self.take()
            self.dotted()
            if self.at("("):
                self.skip("(", ")")

    def modifiers(self) -> list[str]:
        found = []
        while True:
            self.annotations()
            if self.at("non") and self.at("-", k=1) and self.at("sealed", k=2):
                self.i += 3
                found.append("non-sealed")
            elif self.peek().text in MODIFIERS and self.peek().kind == "id" and not (self.at("sealed") and not (self.peek(1).kind == "id")) and not (self.at("default") and self.at(":", "->", k=1)):
                found.append(self.take().text)
            else:
                return sorted(set(found))

    # --- rows --------------------------------------------------------------------------------
    def resolved(self, t: str | None) -> str | None:
        """A type's qualified name by text alone: dotted and primitive names stay, then an import that ends in it, else the own package."""
        if not t:
            return None
        t = bare(t)
        if "." in t or t in PRIMITIVES or t == "var":
            return t
        fit = next((i for i in self.imports if i.endswith("." + t)), None)
        return fit or (f"{self.package}.{t}" if self.package else t)

    def node(self, kind: str, node_id: str, name: str, qn: str, first: Token, **given) -> str:
        last = self.t[self.i - 1]
        self.rows["nodes"].append({"id": node_id, "type": kind, "name": name, "qualified_name": qn, "file": self.file, "start": {"line": first.line, "column": first.column}, "end": {"line": last.line, "column": last.column + len(last.text) - 1}, **given})
        return node_id

    def edge(self, src: str, dst: str, kind: str, **props: str) -> None:
        self.rows["edges"].append({"src": src, "dst": dst, "type": kind, "props": props or None})

    def mention(self, node_id: str, *types: str | None) -> None:
        for t in types:
            for part in re.findall(r"[A-Za-z_$][\w$.]*", t or ""):
                if part not in PRIMITIVES and part not in ("extends", "super", "var"):
                    self.rows["type_mentions"].append({"node_id": node_id, "type_name": part, "file": self.file})

    # --- declarations ----------------------------------------------------------------------------
    def unit(self) -> None:
        mark = self.i
        self.annotations()
        if self.at("package"):
            first = self.take()
            self.package = self.dotted()
            self.take(";")
            self.node("PACKAGE", "pkg:" + slashed(self.package), self.package, self.package, first)
        else:
            self.i = mark
        while self.at("import", ";"):
            if self.take().text == "import":
                static = self.at("static") and bool(self.take())
                what = self.dotted()
                if self.at("."):
                    self.take(".")
                    self.take("*")
                    what += ".*"
                self.take(";")
                self.imports.append(what if not static else what)
        self.rows["files"].append({"file": self.file, "package": self.package, "imports": self.imports})
        while self.peek().text:
            if self.at(";"):
                self.take()
            elif self.at("module", "open") and self.peek(1).kind == "id" and not self.at("class", "interface", k=1):
                return  # a module declaration
            else:
                mods = self.modifiers()
                if not self.declared(mods, None, ()):
                    raise ParseFailure(f"line {self.peek().line}: expected a declaration, found {self.peek().text!r}")
        for cls, method_id, key, start, stop, params in self.rows.pop("bodies"):
            Body(self, cls, method_id, key, params).walk(start, stop)

    def declared(self, mods: list[str], outer: str | None, around: tuple[str, ...]) -> bool:
        """A type declaration, if one begins here."""
        p, nxt = self.peek(), self.peek(1)
        if self.at("@") and self.at("interface", k=1):
            self.i += 2
            self.name()
            self.skip("{", "}")  # annotation types make no rows
            return True
        if p.kind != "id" or nxt.kind != "id" or nxt.text in KEYWORDS or p.text not in ("class", "interface", "enum", "record"):
            return False
        if p.text == "record" and not (self.at("(", k=2) or self.at("<", k=2)):
            return False
        kind = self.take().text
        name = self.name().text
        qn = f"{outer}${name}" if outer and kind != "enum" else f"{self.package}.{name}" if self.package else name
        if self.at("<"):
            self.arguments()
        if kind == "record":
            self.skip("(", ")")
        parents: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        while self.at(*parents):
            word = self.take().text
            parents[word].append(self.type())
            while self.at(","):
                self.take()
                parents[word].append(self.type())
        interface = kind == "interface"
        base = {"enum": "java.lang.Enum", "record": "java.lang.Record"}.get(kind) or (None if interface else self.resolved(next(iter(parents["extends"]), None)))
        faces = [self.resolved(t) for t in (parents["extends"] if interface else []) + parents["implements"]]
        cid, row = "cls:" + slashed(qn), len(self.rows["nodes"])
        self.node("INTERFACE" if interface else "CLASS", cid, name, qn, p, modifiers=mods, superclass=base, interfaces=faces, is_interface=interface, is_enum=kind == "enum")
        self.mention(cid, *parents["extends"], *parents["implements"])
        self.fields.setdefault(qn, {})
        self.take("{")
        if kind == "enum":
            self.constants(qn, cid, name, (*around, qn))
        while not self.at("}"):
            self.member(qn, cid, name, (*around, qn), interface, kind != "enum" or self.enum_members)
        last = self.take("}")
        self.rows["nodes"][row]["end"] = {"line": last.line, "column": last.column}
        return True

    def constants(self, qn: str, cid: str, name: str, around: tuple[str, ...]) -> None:
        while not self.at(";", "}"):
            self.annotations()
            p = self.name()
            self.field(qn, cid, p, name, ["final", "public", "static"])
            if self.at("("):
                start, stop = self.skip("(", ")")
                self.literals(qn, p.text, start, stop)
            if self.at("{"):
                self.take("{")
                while not self.at("}"):
                    self.member(qn, cid, name, around, False, True)
                self.take("}")
            if self.at(","):
                self.take()
        if self.at(";"):
            self.take()

    def member(self, qn: str, cid: str, cls: str, around: tuple[str, ...], interface: bool, keep: bool) -> None:
        if self.at(";"):
            self.take()
            return
        first = self.peek()
        if self.at("{") or self.at("static") and self.at("{", k=1):
            if self.at("static"):
                self.take()
            self.skip("{", "}")  # an initialiser belongs to no method
            return
        mods = self.modifiers()
        if self.declared(mods, qn, around):
            return
        if self.at("<"):
            self.arguments()
            self.annotations()
        if self.peek().text == cls and self.at("(", "{", k=1):  # a constructor, compact ones of records too
            name, returns, ctor = self.take().text, "void", True
        else:
            returns, ctor = self.type(), False
            name = self.name().text
        if ctor or self.at("("):
            self.method(qn, cid, name, returns, ctor, mods, first, interface, keep)
            return
        self.i -= 1
        while True:
            p, t = self.name(), returns
            while self.at("["):
                self.take()
                self.take("]")
                t += "[]"
            start = self.i
            if self.at("="):
                self.take()
                start = self.i
                self.initialiser()
            if keep:
                self.field(qn, cid, p, t, sorted({*mods, "public", "static", "final"}) if interface else mods)
                self.literals(qn, p.text, start, self.i)
            if not self.at(","):
                break
            self.take()
        self.take(";")

    def initialiser(self) -> None:
        """Past an expression: to the comma or semicolon outside all brackets."""
        while not self.at(",", ";"):
            if self.at("("):
                self.skip("(", ")")
            elif self.at("{"):
                self.skip("{", "}")
            elif self.at("["):
                self.skip("[", "]")
            elif self.at("<"):
                mark = self.i
                try:
                    self.arguments()
                    if not self.at("(", ".", ">", ",", ";", ")", "::", "["):
                        raise ParseFailure("no type arguments")
                except ParseFailure:
                    self.i = mark + 1
            else:
                self.take()

    def field(self, qn: str, cid: str, p: Token, t: str, mods: list[str]) -> None:
        q = f"{qn}.{p.text}"
        self.fields[qn][p.text] = t
        fid = self.node("FIELD", "fld:" + slashed(q), p.text, q, p, modifiers=mods, is_static="static" in mods, is_final="final" in mods, data_type=t, owner=qn)
        self.edge(cid, fid, "HAS_FIELD")
        self.mention(fid, t)

    def literals(self, qn: str, name: str, start: int, stop: int) -> None:
        for p in self.t[start:stop]:
            value = p.text[1:-1] if p.kind == "str" else p.text if p.kind in ("num", "char", "text") or p.text == "null" else ""
            if value.strip() and len(value) <= 200:
                self.rows["values"].append({"value": value, "class_fqn": qn, "field_name": name, "file": self.file, "line": p.line})

    def method(self, qn: str, cid: str, name: str, returns: str, ctor: bool, mods: list[str], first: Token, interface: bool, keep: bool) -> None:
        params: list[tuple[Token, str]] = []
        if self.at("("):
            self.take("(")
            while not self.at(")"):
                self.modifiers()
                t = self.type()
                self.annotations()
                if self.at("..."):
                    self.take()
                if self.at("this"):  # a receiver parameter
                    self.take()
                else:
                    p = self.name()
                    while self.at("["):
                        self.take()
                        self.take("]")
                        t += "[]"
                    params.append((p, t))
                if self.at(","):
                    self.take()
            self.take(")")
        while self.at("["):
            self.take()
            self.take("]")
            returns += "[]"
        thrown = []
        if self.at("throws"):
            self.take()
            thrown.append(self.type())
            while self.at(","):
                self.take()
                thrown.append(self.type())
        body = None
        if self.at("{"):
            body = self.skip("{", "}")
        else:
            if self.at("default"):
                self.initialiser()
            self.take(";")
        if not keep:
            return
        if interface and body is None and "abstract" not in mods:
            mods = sorted({*mods, "abstract"})
        signature = f"{name}({','.join(t for _, t in params)})"
        key = f"{qn}.{name}#{signature}"
        mid = self.node("METHOD", "mth:" + slashed(f"{qn}.{name}") + "#" + signature, name, key, first, modifiers=mods, signature=signature, return_type=returns, is_constructor=ctor, is_static="static" in mods, thrown=thrown, owner=qn)
        self.edge(cid, mid, "HAS_METHOD")
        self.mention(mid, None if ctor else returns, *thrown)
        if body is not None:
            for k, (p, t) in enumerate(params):
                pid = self.node("PARAMETER", f"par:{slashed(key)}:{k}", p.text, f"{key}.{p.text}", p, data_type=t, position=k, owner=key)
                self.edge(mid, pid, "HAS_PARAMETER", index=str(k))
                self.mention(pid, t)
            self.rows["bodies"].append((qn, mid, key, *body, {p.text: t for p, t in params}))


class Body:
    """One walk over a method's tokens. Anonymous and local classes belong to the method around them."""

    def __init__(self, r: Reader, cls: str, method_id: str, key: str, params: dict[str, str]):
        self.r, self.t, self.cls, self.method_id, self.key = r, r.t, cls, method_id, key
        self.scopes: list[dict[str, str | None]] = [dict(params)]
        self.calls: set = set()
        self.used: set = set()

    def local(self, name: str) -> bool:
        return any(name in s for s in self.scopes)

    def symbol(self, name: str) -> str | None:
        """The type of a local name, else of a field of this class or of those around it."""
        for s in reversed(self.scopes):
            if name in s:
                return s[name] and bare(s[name])
        cls = self.cls
        while cls:
            if name in self.r.fields.get(cls, {}):
                return bare(self.r.fields[cls][name])
            cls = cls.rpartition("$")[0]
        return None

    def op(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind in ("op", "id") and self.t[k].text in texts

    def back(self, k: int, opening: str, closing: str) -> int:
        """The place of the bracket that t[k] closes."""
        depth = 0
        while k >= 0:
            if self.t[k].kind == "op":
                depth += (self.t[k].text == closing) - (self.t[k].text == opening)
                if not depth:
                    return k
            k -= 1
        return -1

    def walk(self, start: int, stop: int) -> None:
        for k in range(start, stop):
            p = self.t[k]
            if p.kind == "op":
                if p.text == "{":
                    self.scopes.append({})
                elif p.text == "}" and len(self.scopes) > 1:
                    self.scopes.pop()
                elif p.text == "->":
                    self.lambda_names(k)
                continue
            if p.kind != "id":
                continue
            if p.text == "new":
                self.creation(k)
            elif p.text == "throw" and self.op(k + 1, "new"):
                self.exception(self.type_at(k + 2)[0], p.line, False)
            elif p.text not in KEYWORDS:
                if self.op(k + 1, "("):
                    if not self.created(k):
                        self.call(k)
                else:
                    self.name(k, stop)
            if p.text in PRIMITIVES or p.text not in KEYWORDS:
                self.variable(k, stop)

    def type_at(self, k: int) -> tuple[str, int]:
        """(type as written, the place after it); '' where none begins."""
        mark, self.r.i = self.r.i, k
        try:
            return self.r.type(), self.r.i
        except ParseFailure:
            return "", k
        finally:
            self.r.i = mark

    def created(self, k: int) -> bool:
        """Whether t[k] ends the type of a `new`."""
        while self.op(k - 1, ".") and self.t[k - 2].kind == "id":
            k -= 2
        return self.op(k - 1, "new")

    def site(self, receiver: str | None, name: str, ctor: bool, line: int) -> None:
        if (receiver, name, ctor) not in self.calls:
            self.calls.add((receiver, name, ctor))
            self.r.rows["call_sites"].append({"caller_id": self.method_id, "caller_class": self.cls, "receiver_type": receiver, "method_name": name, "is_constructor": ctor, "file": self.r.file, "line": line})

    def creation(self, k: int) -> None:
        t, after = self.type_at(k + 1)
        if t and self.op(after, "("):
            simple = bare(t).rpartition(".")[2]
            self.site(simple, simple, True, self.t[k].line)

    def call(self, k: int) -> None:
        p, at = self.t[k], k - 1
        if self.op(at, ">") and self.op(self.back(at, "<", ">") - 1, "."):  # explicit type arguments
            at = self.back(at, "<", ">") - 1
        receiver = self.receiver(at - 1) if self.op(at, ".") else None
        self.site(receiver, p.text, False, p.line)
        if p.text in ASSERTS:
            end = k + 2
            while end < len(self.t) and not self.op(end, ",", ")", "("):
                end += 1
            if self.op(end - 1, "class") and self.op(end - 2, "."):
                self.exception("".join(x.text for x in self.t[k + 2 : end - 2]), p.line, True)

    def receiver(self, k: int) -> str | None:
        """The declared type of what ends at t[k], as far as text tells."""
        p = self.t[k]
        if p.kind == "id" and p.text == "this" and not self.op(k - 1, "."):
            return self.cls
        if p.kind == "id" and p.text not in KEYWORDS:
            found = self.symbol(p.text)
            return found if self.op(k - 1, ".") or self.local(p.text) else found or p.text
        if self.op(k, ")"):
            k = self.back(k, "(", ")") - 1
            if self.op(k, ">"):
                k = self.back(k, "<", ">") - 1
            if k >= 0 and self.t[k].kind == "id" and self.created(k):
                return self.t[k].text
        return None

    def exception(self, name: str, line: int, asserted: bool) -> None:
        if name:
            self.r.rows["exceptions"].append({"method_qn": self.key, "exception_name": bare(name).rpartition(".")[2], "file": self.r.file, "line": line, "is_assertion": asserted})

    def name(self, k: int, stop: int) -> None:
        """A name that may refer to a field: f, this.f or Class.f."""
        p = self.t[k]
        if not self.op(k - 1, "."):
            if self.local(p.text):
                return
            scope = None
        elif self.op(k - 2, "this") and not self.op(k - 3, "."):
            scope = "this"
        elif self.t[k - 2].kind == "id" and self.t[k - 2].text not in KEYWORDS and not self.op(k - 3, ".") and not self.local(self.t[k - 2].text):
            scope = self.t[k - 2].text
        else:
            return
        cls = self.cls
        while scope is None and p.text not in self.r.fields.get(cls, {}) and "$" in cls:
            cls = cls.rpartition("$")[0]
        if scope is None and p.text not in self.r.fields.get(cls, {}):
            cls = self.cls  # perhaps an inherited field
        if (scope, p.text) not in self.used:
            self.used.add((scope, p.text))
            self.r.rows["field_refs"].append({"class_fqn": cls, "scope": scope, "name": p.text, "method_qn": self.key, "file": self.r.file, "line": p.line})

    def variable(self, k: int, stop: int) -> None:
        """A local variable, if its type begins at t[k]."""
        before = self.t[k - 1]
        pattern = before.text == "instanceof"
        if not (pattern or before.text in ("{", "}", ";", "(", "final", ":", "->", "|", ")", "case") or before.kind == "id" and self.op(k - 2, "@")):
            return
        t, after = self.type_at(k)
        if not t or after >= stop or self.t[after].kind != "id" or self.t[after].text in KEYWORDS:
            return
        if not (pattern or before.text == "case" or self.op(after + 1, "=", ";", ":", ",", ")", "[")):
            return
        while True:
            p = self.t[after]
            known = t
            if t == "var" and self.op(after + 1, "=") and self.op(after + 2, "new"):
                known = self.type_at(after + 3)[0] or t
            # the scope of a for, try or catch is its parenthesis: kept until the block around it ends
            self.scopes[-1][p.text] = known
            vid = f"var:{re.sub(r'[/:\\ ]', '_', self.r.file)}:{self.key}:{p.text}"
            if not any(n["id"] == vid for n in self.r.rows["nodes"][-64:]):
                at, self.r.i = self.r.i, after + 1
                self.r.node("VARIABLE", vid, p.text, f"{self.key}.{p.text}", p, data_type=t, is_final=False, owner=self.key)
                self.r.i = at
                self.r.mention(vid, t)
            if pattern or before.text in ("(", "case", "|", "->"):
                return
            mark, self.r.i = self.r.i, after + 1
            try:
                if self.op(self.r.i, "="):
                    self.r.i += 1
                    self.r.initialiser()
                more = self.r.i
            except ParseFailure:
                return
            finally:
                self.r.i = mark
            if not (self.op(more, ",") and more + 1 < stop and self.t[more + 1].kind == "id" and self.op(more + 2, "=", ";", ",")):
                return
            after = more + 1

    def lambda_names(self, k: int) -> None:
        """Names before an arrow hide fields."""
        if self.t[k - 1].kind == "id" and self.t[k - 1].text not in KEYWORDS:
            self.scopes[-1].setdefault(self.t[k - 1].text, None)
        elif self.op(k - 1, ")"):
            for j in range(self.back(k - 1, "(", ")") + 1, k - 1):
                if self.t[j].kind == "id" and self.op(j + 1, ",", ")") and self.t[j].text not in KEYWORDS:
                    self.scopes[-1].setdefault(self.t[j].text, None)


def read(file: str, source: str, enum_members: bool = False) -> dict[str, list[dict]]:
    """Rows of each kind; ParseFailure where the text isn't Java or is nested too deeply to read."""
    try:
        r = Reader(file, source, enum_members)
        r.unit()
        return r.rows
    except RecursionError:
        raise ParseFailure("nested too deeply") from None
