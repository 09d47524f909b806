"""Symbols and edges of curly-bracket languages, by a bracket stack.

A lexer that knows a language's strings and comments gives words, marks and
comments with their lines. One pass keeps a stack of open brackets and the words
since the last boundary (the header). A curly bracket opens the scope that its
header declares, or an unnamed one; closing it ends the symbol. So a symbol has
its last line, its owner (the enclosing type) and the comment before it, and
calls belong to the enclosing function. Time is linear in the text; text that
ends within a scope ends the scope with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, repeat
from typing import NamedTuple

ESCAPED = r'"(?:\\.|[^"\\\n])*"'
CHARACTER = r"'(?:\\.|[^'\\\n])*'"
BLOCK = r"/\*.*?\*/"
LINE = r"//[^\n]*"


@dataclass(frozen=True)
class Language:
    """How a language is written: ``text`` matches strings, ``doc`` comments that
    document; ``lines`` says that a line's end can end a statement."""

    name: str
    text: str
    comment: str = f"{LINE}|{BLOCK}"
    doc: str = r"/\*\*"
    lines: bool = False
    types: tuple[str, ...] = ()
    #: Words before a bracket that are no calls.
    plain: tuple[str, ...] = ("if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "super", "this", "sizeof", "await", "yield", "function", "func", "fn", "match", "in", "of", "typeof", "using", "lock", "fixed", "foreach", "nameof", "range", "make")


LANGUAGES = {
    "go": Language("go", rf"`[^`]*`|{ESCAPED}|{CHARACTER}", doc="//|/\\*", lines=True),
    "rs": Language("rust", r'b?r(?P<hashes>#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n\']+|\\\'|[^\'\\\n])\'', doc=r"///|/\*\*", types=("struct", "enum", "trait", "union")),
    "java": Language("java", rf'"""(?:\\.|.)*?"""|{ESCAPED}|{CHARACTER}', types=("class", "interface", "enum", "record")),
    "cs": Language("csharp", rf'\$?@\$?"(?:""|[^"])*"|\$?{ESCAPED}|{CHARACTER}', doc=r"///|/\*\*", types=("class", "interface", "struct", "record", "enum")),
    "ts": Language("typescript", rf"`(?:\\.|[^`\\])*`|{ESCAPED}|{CHARACTER}|(?<=[=(,:]) ?/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*", lines=True, types=("class", "interface", "enum")),
    "php": Language("php", rf'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', comment=rf"{LINE}|#(?!\[)[^\n]*|{BLOCK}", types=("class", "interface", "trait", "enum")),
}
#: What goes on with the statement of the line before.
CONTINUES = ("{", ".", "?", ":", "=", "=>", "|", "&", ",", ")", "extends", "implements")
#: Attributes of test methods.
TESTS = {"java": ("Test", "ParameterizedTest"), "csharp": ("Fact", "Test", "Theory", "TestMethod", "TestCase")}


#: Marks that open, close or end something; all other tokens only lengthen a header.
TURNS = frozenset("()[]{};")


class Token(NamedTuple):
    kind: str  # word, mark, text, number, note (a comment), line (an end)
    text: str
    line: int


@dataclass
class Symbol:
    kind: str
    name: str
    line_start: int
    line_end: int
    signature: str
    owner: str | None
    docstring: str


@dataclass
class Scope:
    """An open bracket, and for curly ones what they hold."""

    mark: str
    kind: str = "block"
    name: str | None = None
    symbol: Symbol | None = None
    header: list[Token] | None = None  # of the statement around, when the bracket closes


@dataclass
class Outline:
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)  # source, target, type


@lru_cache
def lexer(language: Language) -> re.Pattern:
    return re.compile(rf"{language.comment}|{language.text}|[^\W\d][\w$]*|\$\w+|\n|\d[\w.]*|=>|->|::|[^\s\w]", re.S)


def kind_of(word: str) -> str:
    """The kind of what the lexer matched, told by its ends."""
    first = word[0]
    if first == "\n":
        return "line"
    if first.isalnum() or first == "_":
        return "number" if first.isdecimal() else "text" if word[-1] in "\"'#" else "word"
    if len(word) == 1:
        return "mark"
    if first == "/":
        return "note" if word[1] in "/*" else "text"
    if first == "$":
        return "text" if word[-1] == '"' else "word"
    return "note" if first == "#" else "text" if first in "\"'`@ " else "mark"


class Known(dict):
    """Results by word, bounded: most words of a file have been seen before."""

    def __init__(self, made: Callable[[str], object], most: int = 20_000, longest: int = 40):
        self.made, self.most, self.longest = made, most, longest

    def __missing__(self, word: str):
        out = self.made(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


KINDS, LINE_ENDS = Known(kind_of), Known(lambda word: word.count("\n"))


def tokens(text: str, language: Language) -> list[Token]:
    """All tokens, made by built-in functions only, as there are hundreds a file."""
    found = lexer(language)
    words = [m[0] for m in found.finditer(text)] if found.groups else found.findall(text)
    kinds = list(map(KINDS.__getitem__, words))
    if "#" in words and "#" in language.comment:  # a comment, unless it opens an attribute
        kinds = ["note" if w == "#" and after != "[" else k for k, w, after in zip(kinds, words, [*words[1:], ""])]
    lines = accumulate(map(LINE_ENDS.__getitem__, words), initial=1)
    return list(map(tuple.__new__, repeat(Token), zip(kinds, words, lines)))


def cleaned(notes: list[Token], language: Language) -> str:
    """The text of the comments before a declaration, on one line."""
    out = []
    for n in notes:
        if re.match(language.doc, n.text):
            for x in re.sub(r"^(/\*+|//[/!]?)|\*/$", "", n.text).split("\n"):
                out.append(x.strip().lstrip("*").strip())
    return " ".join(x for x in out if x)


def top_level(header: list[Token], opened: str = "(<[", closed: str = ")>]") -> list[tuple[int, Token]]:
    """Places and tokens of a header outside its brackets."""
    depth, out = 0, []
    for i, t in enumerate(header):
        if t.kind == "mark" and t.text in closed and depth:
            depth -= 1
        elif not depth:
            out.append((i, t))
        if t.kind == "mark" and t.text in opened:
            depth += 1
    return out


def names_after(header: list[Token], word: str, until: tuple[str, ...] = ()) -> list[str]:
    """Last parts of the names listed after a word, without type arguments."""
    out, on, part = [], False, None
    for _, t in top_level(header):
        if t.text == word:
            on = True
        elif on and t.text in until:
            break
        elif on and t.kind == "word":
            part = t.text
        elif on and t.text == "," and part:
            out.append(part)
            part = None
    return out + ([part] if part else [])


def word_before_bracket(header: list[Token]) -> int | None:
    """Place of the name in ``... name(...)`` or ``... name<T>(...)``, if no ``=`` comes first."""
    if not any([t.text == "(" for t in header]):
        return None
    flat = top_level(header)
    for k, (i, t) in enumerate(flat):
        if t.text in ("=", "=>", "{"):
            return None
        if t.text == "(":
            before = [x for x in flat[:k] if x[1].text != "<"]
            return before[-1][0] if before and before[-1][1].kind == "word" else None
    return None


def attributes(header: list[Token], language: Language) -> tuple[list[str], list[Token]]:
    """Names of the attributes before a declaration, and the header without them."""
    names, i = [], 0
    if header and header[0].text not in ("@", "[", "#"):
        return names, header
    while i < len(header):
        t = header[i]
        if language.name in ("java", "typescript") and t.text == "@" and i + 1 < len(header) and header[i + 1].text != "interface":
            i += 2
            while i + 1 < len(header) and header[i].text == ".":
                i += 2
            names.append(header[i - 1].text)
        elif language.name in ("csharp", "php") and t.text in "[#" or language.name == "rust" and t.text == "#":
            i += t.text == "#"
            if i + 1 < len(header):
                names += [x.text for _, x in top_level(header[i + 1 :]) if x.kind == "word"][:1]
        else:
            break
        if i < len(header) and header[i].text in "([":
            depth = 0
            while i < len(header):
                depth += (header[i].text in "([") - (header[i].text in ")]")
                i += 1
                if not depth:
                    break
    return names, header[i:]


class Reader:
    """One pass over a file's tokens."""

    def __init__(self, path: str, text: str, language: Language):
        self.path, self.language, self.out = path, language, Outline()
        self.stack: list[Scope] = [Scope("")]
        self.header: list[Token] = []
        self.notes: list[Token] = []
        stem = re.sub(r"\.\w+$", "", path.rpartition("/")[2])
        tested = re.fullmatch(r"(\w+?)(?:Tests?|IT|Spec)|Tests?(\w+)", stem)
        self.tested = tested and (tested[1] or tested[2])
        self.last_line = 1
        pending, found = False, tokens(text, language)
        for t in found:
            kind, word, line = t
            if kind == "line":
                pending = language.lines
                continue
            if pending and self.header and self.stack[-1].mark not in ("(", "[") and self.ends(t):
                self.statement(body=False)
            if kind == "note":
                if not self.header:
                    self.notes.append(t)
                continue
            pending = False
            if kind == "mark" and word in TURNS:
                self.last_line = line
                self.take(t)
            else:
                self.header.append(t)
        if found:
            self.last_line = found[-1].line + found[-1].text.count("\n")
        if self.header:
            self.statement(body=False)
        for s in self.stack:
            if s.symbol:
                s.symbol.line_end = max(s.symbol.line_end, self.last_line)

    def ends(self, following: Token) -> bool:
        """Whether a line's end before ``following`` ends the statement."""
        last = self.header[-1]
        open_end = last.kind == "mark" and last.text not in (")", "]", "}", "+", "-")
        return not open_end and following.text not in CONTINUES

    def inner(self, *kinds: str) -> Scope | None:
        return next((s for s in reversed(self.stack) if s.kind in kinds), None)

    def take(self, t: Token) -> None:
        """One of the marks ``TURNS``."""
        here = self.stack[-1]
        group = self.language.name == "go" and t.text == "(" and here.mark != "(" and len(self.header) == 1 and self.header[0].text in ("type", "import")
        if group:
            self.stack.append(Scope("group", "group", self.header[0].text))
            self.header = []
        elif t.text in ("(", "["):
            if t.text == "(":
                self.call()
            self.stack.append(Scope(t.text))
            self.header.append(t)
        elif t.text in (")", "]"):
            if here.mark == "group":
                if self.header:
                    self.statement(body=False)
                self.stack.pop()
            else:
                if here.mark in ("(", "["):
                    self.stack.pop()
                self.header.append(t)
        elif t.text == "{":
            self.open(t)
        elif t.text == "}":
            self.close(t)
        elif here.mark not in ("(", "["):
            self.statement(body=False)
        else:
            self.header.append(t)

    def call(self) -> None:
        """``name(`` within a function."""
        if not self.header or self.header[-1].kind != "word" or not (f := self.inner("function")):
            return
        name, before = self.header[-1].text, self.header[-2].text if len(self.header) > 1 else ""
        if name not in self.language.plain and before not in ("new", "function", "func", "fn", "class", "@") and name != f.name or name == f.name and before == ".":
            self.out.edges.append((f.name or "", name, "calls"))

    def open(self, t: Token) -> None:
        here, header = self.stack[-1], self.header
        if header and (self.lists_names(header) or here.kind == "names"):
            self.stack.append(Scope("{", "names"))
            header.append(t)
            return
        if here.mark in ("(", "["):
            self.stack.append(Scope("{", header=header))
            self.header, self.notes = [], []
            return
        scope = self.statement(body=True) or Scope("{")
        scope.mark = "{"
        if not scope.symbol and scope.kind == "block" and header and header[-1].text in ("=", "=>", ",", ":", "return"):
            scope.header = header
        self.stack.append(scope)

    def lists_names(self, header: list[Token]) -> bool:
        """Whether a curly bracket after the header holds imported names."""
        words = [x.text for x in header]
        return words[0] == "import" or words == ["export"] or "use" in words[:5] and words[-1] in ("::", "\\")

    def close(self, t: Token) -> None:
        if self.stack[-1].kind == "names":
            self.stack.pop()
            self.header.append(t)
            return
        if self.header and self.stack[-1].mark == "{":
            self.statement(body=False)
        while len(self.stack) > 1:
            scope = self.stack.pop()
            if scope.symbol:
                scope.symbol.line_end = t.line
            if scope.mark == "{":
                self.header = [*scope.header, t] if scope.header is not None else []
                break
        else:
            self.header = []
        self.notes = []

    def statement(self, body: bool) -> Scope | None:
        """What the header declares; the header is used up."""
        header, self.header = self.header, []
        notes, self.notes = self.notes, []
        marks, rest = attributes(header, self.language)
        if not rest:
            return None
        here = self.stack[-1]
        found = getattr(self, self.language.name)(rest, body, here)
        if not found:
            return None
        kind, name, scope_kind, *receiver = found
        if kind is None:
            return Scope("{", scope_kind, name)
        owner = receiver[0] if receiver else getattr(self.inner("type", "impl"), "name", None)
        prefix = "".join(f"@{m} " if self.language.name in ("java", "typescript") else f"[{m}] " for m in marks)
        signature = prefix + re.sub(r" ?([.(),;<>\[\]:]) ?", r"\1", " ".join(x.text for x in rest)).replace(",", ", ").strip()
        first = rest[0] if self.language.name == "rust" else header[0]
        symbol = Symbol(kind, name, first.line, self.last_line if body else header[-1].line, signature[:400], owner, cleaned(notes, self.language))
        self.out.symbols.append(symbol)
        if kind == "method" and self.tested and set(marks) & set(TESTS.get(self.language.name, ())):
            self.out.edges.append((self.tested, name, "tested_by"))
        return Scope("{", scope_kind, name, symbol)

    def edge(self, source: str, names: list[str], kind: str) -> None:
        self.out.edges.extend((source, n, kind) for n in names)

    def declared(self, header: list[Token], words: tuple[str, ...]) -> tuple[str, str] | None:
        """(keyword, name) of the first of ``words`` that a name follows."""
        if not any([t.text in words for t in header]):
            return None
        flat = [t for _, t in top_level(header)]
        for a, b in zip(flat, flat[1:]):
            if a.text in ("=", "("):
                return None
            if a.kind == "word" and a.text in words and b.kind == "word" and b.text not in words:
                return a.text, b.text
        return None

    def member(self, header: list[Token], here: Scope) -> tuple[str, str, str] | None:
        """A method or constructor of the type around."""
        at = word_before_bracket(header) if here.kind == "type" else None
        if at is None or header[at].text in self.language.plain:
            return None
        name = header[at].text
        if name == here.name:
            return "constructor", name, "function"
        return ("method", name, "function") if at else None

    def java(self, header: list[Token], body: bool, here: Scope):
        if header[0].text == "import":
            names = [t.text for t in header if t.kind == "word"]
            self.edge(self.path, names[-1:], "imports")
            return None
        if [t.text for t in header if t.text in ("@", "interface")][:2] == ["@", "interface"]:
            return "annotation", names_after(header, "interface")[0], "type"
        if body and (found := self.declared(header, self.language.types)):
            kind, name = found
            self.edge(name, names_after(header, "extends", ("implements", "permits")), "extends")
            self.edge(name, names_after(header, "implements", ("permits",)), "implements")
            return kind, name, "type"
        return self.member(header, here)

    def csharp(self, header: list[Token], body: bool, here: Scope):
        first = header[0].text
        if first == "using" and here.kind != "function" and not body:
            names = [t.text for t in header if t.kind == "word"]
            self.edge(self.path, names[-1:], "imports")
            return None
        if first == "namespace":
            name = "".join(t.text for t in header[1:])
            scope = Scope("{", "namespace", name)
            if not body:  # of the whole file
                self.out.symbols.append(Symbol("namespace", name, header[0].line, self.last_line, f"namespace {name}", None, ""))
                self.stack[0].symbol = self.out.symbols[-1]
                return None
            return "namespace", name, scope.kind
        if found := self.declared(header, self.language.types):
            kind, name = found
            bases = names_after(header, ":", ("where",))
            if kind == "interface":
                self.edge(name, bases, "extends")
            else:
                own = bases[:1] if bases and not re.match(r"I[A-Z]", bases[0]) else []
                self.edge(name, own, "extends")
                self.edge(name, bases[len(own) :], "implements")
            return kind, name, "type"
        if here.kind != "type":
            return None
        if found := self.member(header, here):
            return found
        flat = [t for _, t in top_level(header)]
        texts = [t.text for t in flat]
        cut = texts.index("=>") if "=>" in texts else len(flat) if body else 0
        if cut >= 2 and flat[cut - 1].kind == "word" and not {"=", "(", "event", "operator"} & set(texts[:cut]):
            return "property", flat[cut - 1].text, "block"
        return None

    def typescript(self, header: list[Token], body: bool, here: Scope):
        words = [t.text for t in header]
        if words[0] == "import":
            self.edge(self.path, [t.text.strip("'\"`") for t in header if t.kind == "text"][-1:], "imports")
            return None
        if body and (found := self.declared(header, self.language.types)):
            kind, name = found
            self.edge(name, names_after(header, "extends", ("implements",)), "extends")
            self.edge(name, names_after(header, "implements"), "implements")
            return kind, name, "type"
        if found := self.declared(header, ("type",)):
            if "=" in words and here.kind != "function":
                return "type", found[1], "block"
        if body and (found := self.declared([t for t in header if t.text != "*"], ("function",))):
            return "function", found[1], "function"
        if words[0] in ("const", "let", "var", "export") and "=" in words:
            at = words.index("=")
            value = words[at + 1 :]
            if header[at - 1].kind == "word" and at and (words[-1] == "=>" or "=>" in words or "function" in value[:2]):
                name = next(t.text for t in header if t.kind == "word" and t.text not in ("export", "const", "let", "var", "default"))
                return "function", name, "function"
        if body and here.kind == "type" and (at := word_before_bracket(header)) is not None and words[at] not in self.language.plain:
            return "function", words[at], "function"
        return None

    def go(self, header: list[Token], body: bool, here: Scope):
        words = [t.text for t in header]
        if here.kind == "group":
            header, words = [Token("word", here.name, header[0].line), *header], [here.name, *words]
        if words[0] == "import":
            self.edge(self.path, [t.text.strip('"`') for t in header if t.kind == "text"], "imports")
            return None
        if words[0] == "type" and len(words) > 2 and header[1].kind == "word":
            kind = next((k for k in ("struct", "interface") if k in words[2:]), "type")
            return kind, words[1], "type"
        if words[0] == "func" and here.kind != "function":
            if words[1:2] == ["("] and ")" in words:
                close = words.index(")")
                receiver = [t.text for t in header[2:close] if t.kind == "word"]
                if close + 1 < len(header) and header[close + 1].kind == "word":
                    return "method", header[close + 1].text, "function", (receiver[1:2] or receiver[:1] or [None])[0]
            elif len(words) > 2 and header[1].kind == "word":
                return "function", words[1], "function"
        return None

    def rust(self, header: list[Token], body: bool, here: Scope):
        words = [t.text for t in header]
        if "use" in words[:4] and not body:
            self.edge(self.path, [a.text for a, b in zip(header, [*header[1:], None]) if a.kind == "word" and a.text not in ("pub", "use", "crate", "self", "super", "as") and (b is None or b.text in (",", "}"))], "imports")
            return None
        if words[0] in ("impl", "unsafe") and "impl" in words[:2] and body:
            names = [t.text for _, t in top_level(header) if t.kind == "word" and t.text not in ("impl", "unsafe", "dyn")]
            names = names[: names.index("where")] if "where" in names else names
            if "for" in names:
                at = names.index("for")
                self.edge(names[-1], names[at - 1 : at], "implements")
            return None, (names or ["impl"])[-1], "impl"
        if found := self.declared(header, ("fn",)):
            return "method" if here.kind == "impl" else "function", found[1], "function"
        if found := self.declared(header, self.language.types):
            kind, name = found
            if kind == "trait":
                self.edge(name, [n for n in names_after(header, ":", ("where",)) if n != name], "extends")
            return kind, name, "type"
        return None

    def php(self, header: list[Token], body: bool, here: Scope):
        words = [t.text for t in header]
        if words[0] == "use" and here.kind != "function" and not body:
            names = [t.text for t in header if t.kind == "word"]
            self.edge(self.path if here.kind != "type" else here.name, names[-1:], "imports" if here.kind != "type" else "uses")
            return None
        if body and (found := self.declared(header, self.language.types)):
            kind, name = found
            self.edge(name, names_after(header, "extends", ("implements",)), "extends")
            self.edge(name, names_after(header, "implements"), "implements")
            return kind, name, "type"
        if found := self.declared(header, ("function",)):
            return "method" if here.kind == "type" else "function", found[1], "function"
        return None


def outline(path: str, text: str, extension: str) -> Outline:
    return Reader(path, text, LANGUAGES[extension]).out
