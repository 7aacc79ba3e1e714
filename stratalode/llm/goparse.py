"""Lexer with resumable states and local grammar for Go.

Same conventions as ``jsparse``; the lexer inserts the semicolons of the Go
specification, so no line breaks appear among the token kinds.
"""

from __future__ import annotations

import re

from .jsparse import Bad

KEYWORDS = {
    w: w
    for w in "break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var".split()
}
SEMI_AFTER = frozenset(["ID", "0", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_TOKEN = re.compile(
    r"""[ \t\r]*(?:
    (?P<w>[^\W\d]\w*)
    |(?P<nl>\n\s*)
    |(?P<c>//[^\n]*)
    |(?P<b>/\*)
    |(?P<s>"(?:[^"\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<n>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?)i?(?!\w))
    |(?P<o>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.])
    |(?P<r>`)
    |(?P<e>$)
    |(?P<x>[\s\S]))""",
    re.X,
)
START = ("code", False)
#: value: whether a line break ends a statement here
ENTRY = tuple((m, v) for m in ("code", "block", "raw") for v in (False, True))


def lex(text: str, state=START, first: bool = True) -> tuple[tuple | None, list[str]]:
    mode, value = state
    out: list[str] = []
    add = out.append
    pos = 1 if first and text.startswith("﻿") else 0
    while True:
        if mode == "block":
            close = text.find("*/", pos)
            if value and "\n" in text[pos : close if close >= 0 else len(text)]:
                add(";")
                value = False
            if close < 0:
                return ("block", value), out
            pos, mode = close + 2, "code"
        elif mode == "raw":
            close = text.find("`", pos)
            if close < 0:
                return ("raw", False), out
            add("s")
            pos, mode, value = close + 1, "code", True
        for m in _TOKEN.finditer(text, pos):
            kind = m.lastgroup
            if kind == "w":
                k = KEYWORDS.get(m[kind], "ID")
                add(k)
                value = k in SEMI_AFTER
            elif kind == "nl":
                if value:
                    add(";")
                    value = False
            elif kind == "o":
                t = m[kind]
                add(t)
                value = t in SEMI_AFTER
            elif kind == "s" or kind == "n":
                add("s" if kind == "s" else "0")
                value = True
            elif kind == "b" or kind == "r":
                pos, mode = m.end(), "block" if kind == "b" else "raw"
                break
            elif kind == "x":
                return None, out
            elif kind == "e":
                return ("code", value), out
        else:
            return ("code", value), out


PAIR = {"(": ")", "[": "]", "{": "}"}
CLOSE = frozenset(PAIR.values())
BINARY = frozenset(["||", "&&", "==", "!=", "<", "<=", ">", ">=", "+", "-", "|", "^", "*", "/", "%", "<<", ">>", "&", "&^"])
ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])
UNARY = frozenset(["+", "-", "!", "^", "*", "&", "<-", "~"])


class Parser:
    def __init__(self, kinds: list[str]):
        self.t = [*kinds, ";", "EOF", "EOF", "EOF"] if kinds and kinds[-1] in SEMI_AFTER else [*kinds, "EOF", "EOF", "EOF"]
        self.i = 0
        self.lev = 0  # below 0: a composite literal of a bare type name would be read as a block

    def eat(self, k):
        if self.t[self.i] == k:
            self.i += 1
            return True
        return False

    def need(self, k):
        if self.t[self.i] != k:
            raise Bad
        self.i += 1

    def semi(self):
        if self.t[self.i] in (")", "}"):
            return
        self.need(";")

    def attempt(self, f, *a):
        at, lev = self.i, self.lev
        try:
            f(*a)
            return True
        except Bad:
            self.i, self.lev = at, lev
            return False

    def file(self):
        while self.eat(";"):
            pass
        self.need("package")
        self.need("ID")
        self.need(";")
        while self.t[self.i] == "import":
            self.import_()
        self.declarations()

    def declarations(self):
        while self.t[self.i] != "EOF":
            if self.eat(";"):
                continue
            self.declaration()

    def declaration(self):
        if self.t[self.i] == "func":
            self.func_decl()
            self.need(";")
        elif self.t[self.i] in ("var", "const", "type"):
            self.gen_decl()
            self.need(";")
        else:
            raise Bad

    def import_(self):
        self.need("import")
        if self.eat("("):
            while not self.eat(")"):
                self.import_spec()
                self.semi()
        else:
            self.import_spec()
        self.need(";")

    def import_spec(self):
        self.eat(".") or self.eat("ID")
        self.need("s")

    def gen_decl(self):
        k = self.t[self.i]
        self.i += 1
        f = {"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[k]
        if self.eat("("):
            lev, self.lev = self.lev, 0
            while not self.eat(")"):
                f()
                self.semi()
            self.lev = lev
        else:
            f()

    def ids(self):
        self.need("ID")
        while self.eat(","):
            self.need("ID")

    def var_spec(self):
        self.ids()
        if self.eat("="):
            self.exprs()
            return
        self.type()
        if self.eat("="):
            self.exprs()

    def const_spec(self):
        self.ids()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.exprs()

    def type_spec(self):
        self.need("ID")
        if self.t[self.i] == "[" and self.t[self.i + 1] == "ID" and self.t[self.i + 2] != "]":
            if self.attempt(self.type_params_then_type):
                return
        self.eat("=")
        self.type()

    def type_params_then_type(self):
        self.type_params()
        self.eat("=")
        self.type()

    def type_params(self):
        self.need("[")
        while not self.eat("]"):
            self.ids()
            self.constraint()
            if self.t[self.i] != "]":
                self.need(",")

    def constraint(self):
        self.eat("~")
        self.type()
        while self.eat("|"):
            self.eat("~")
            self.type()

    def func_decl(self):
        self.need("func")
        if self.t[self.i] == "(":
            self.params()
        self.need("ID")
        if self.t[self.i] == "[":
            self.type_params()
        self.signature()
        if self.t[self.i] == "{":
            self.body()

    def body(self):
        lev, self.lev = self.lev, 0
        self.block()
        self.lev = lev

    def signature(self):
        self.params()
        if self.t[self.i] == "(":
            self.params()
        elif self.t[self.i] in ("ID", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def params(self):
        self.need("(")
        named = typed = 0
        while not self.eat(")"):
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "...":
                self.i += 2
                self.type()
                named += 1
            elif self.eat("..."):
                self.type()
                typed += 1
            else:
                self.type()
                if self.t[self.i] not in (",", ")"):
                    if self.t[self.i - 1] not in ("ID",) and self.t[self.i - 1] != "]":
                        raise Bad
                    self.eat("...")
                    self.type()
                    named += 1
                else:
                    typed += 1
            if self.t[self.i] != ")":
                self.need(",")

    def type(self):
        k = self.t[self.i]
        if k == "ID":
            self.i += 1
            if self.eat("."):
                self.need("ID")
            if self.t[self.i] == "[" and self.t[self.i + 1] not in ("]", "0", "..."):
                self.attempt(self.type_args)
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    lev, self.lev = self.lev, 0
                    self.expr()
                    self.lev = lev
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.struct()
        elif k == "interface":
            self.i += 1
            self.interface()
        else:
            raise Bad

    def type_args(self):
        self.need("[")
        self.type()
        while self.eat(","):
            if self.t[self.i] == "]":
                break
            self.type()
        self.need("]")

    def struct(self):
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "*" or self.t[self.i] == "ID" and self.t[self.i + 1] in (".", ";", "}", "s"):
                self.eat("*")
                self.need("ID")
                if self.eat("."):
                    self.need("ID")
                if self.t[self.i] == "[":
                    self.type_args()
            elif self.t[self.i] == "ID" and self.t[self.i + 1] == "[" and self.attempt(self.embedded_generic):
                pass
            else:
                self.ids()
                self.type()
            self.eat("s")
            self.semi()

    def embedded_generic(self):
        self.need("ID")
        self.type_args()
        if self.t[self.i] not in (";", "}", "s"):
            raise Bad

    def interface(self):
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            self.semi()

    def block(self):
        self.need("{")
        self.stmts()
        self.need("}")

    def stmts(self):
        while self.t[self.i] not in ("}", "case", "default"):
            if self.t[self.i] == "EOF":
                raise Bad
            if self.eat(";"):
                continue
            self.statement()
            self.semi()

    def statement(self):
        k = self.t[self.i]
        if k in ("var", "const", "type"):
            return self.gen_decl()
        if k == "{":
            return self.block()
        if k == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.exprs()
            return
        if k in ("break", "continue", "goto"):
            self.i += 1
            if k == "goto":
                self.need("ID")
            else:
                self.eat("ID")
            return
        if k == "fallthrough":
            self.i += 1
            return
        if k in ("go", "defer"):
            self.i += 1
            self.expr()
            if self.t[self.i - 1] != ")":
                raise Bad
            return
        if k == "if":
            return self.if_()
        if k == "for":
            return self.for_()
        if k == "switch":
            return self.switch()
        if k == "select":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if not self.eat("default"):
                    self.need("case")
                    self.simple()
                self.need(":")
                self.stmts()
            return
        if k == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            if self.t[self.i] not in ("}", ";"):
                self.statement()
            return
        self.simple()

    def simple(self, ranged=False):
        """Returns 'range' for a range clause."""
        if ranged and self.eat("range"):
            self.expr()
            return "range"
        self.exprs()
        k = self.t[self.i]
        if k in ASSIGN:
            self.i += 1
            if ranged and k in ("=", ":=") and self.eat("range"):
                self.expr()
                return "range"
            if k == ":=" and self.t[self.i] == "EOF":
                raise Bad
            self.exprs()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expr()
        return None

    def if_(self):
        self.need("if")
        lev, self.lev = self.lev, -1
        if self.t[self.i] == ";":
            self.i += 1
            self.expr()
        else:
            self.simple()
            if self.eat(";"):
                self.simple()
        self.lev = lev
        self.block()
        if self.eat("else"):
            if self.t[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_(self):
        self.need("for")
        lev, self.lev = self.lev, -1
        if self.t[self.i] != "{":
            kind = None
            if self.t[self.i] != ";":
                kind = self.simple(True)
            if kind is None and self.eat(";"):
                if self.t[self.i] != ";":
                    self.expr()
                self.need(";")
                if self.t[self.i] != "{":
                    self.simple()
        self.lev = lev
        self.block()

    def switch(self):
        self.need("switch")
        lev, self.lev = self.lev, -1
        if self.t[self.i] != "{":
            if self.t[self.i] != ";":
                self.simple()
            if self.eat(";") and self.t[self.i] != "{":
                self.simple()
        self.lev = lev
        self.need("{")
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                self.type_or_expr()
                while self.eat(","):
                    self.type_or_expr()
            self.need(":")
            self.stmts()

    def type_or_expr(self):
        if not self.attempt(self.expr):
            self.type()

    def exprs(self):
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self):
        self.unary()
        while self.t[self.i] in BINARY:
            self.i += 1
            self.unary()

    def unary(self):
        while self.t[self.i] in UNARY:
            if self.t[self.i] == "<-" and self.t[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self):
        k = self.t[self.i]
        literal = False
        if k in ("0", "s"):
            self.i += 1
        elif k == "ID":
            self.i += 1
            literal = True
        elif k == "(":
            lev, self.lev = self.lev, 0
            self.i += 1
            self.type_or_expr()
            self.need(")")
            self.lev = lev
        elif k == "func":
            self.i += 1
            self.signature()
            if self.t[self.i] == "{":
                self.body()
        elif k in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            if self.t[self.i] == "{":
                self.literal()
            elif self.t[self.i] not in ("(", ")", ",", "}", ";", ":"):
                raise Bad
        else:
            raise Bad
        while True:
            k = self.t[self.i]
            if k == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need("ID")
            elif k == "[":
                lev, self.lev = self.lev, 0
                self.index()
                self.lev = lev
            elif k == "(":
                lev, self.lev = self.lev, 0
                self.i += 1
                while not self.eat(")"):
                    self.type_or_expr()
                    self.eat("...")
                    if self.t[self.i] != ")":
                        self.need(",")
                self.lev = lev
                literal = False
            elif k == "{" and literal and self.lev >= 0:
                self.literal()
                literal = False
            else:
                return

    def index(self):
        self.need("[")
        colons = 0
        if self.t[self.i] == ":":
            pass
        else:
            self.type_or_expr()
            while self.eat(","):
                if self.t[self.i] == "]":
                    break
                self.type()
        while self.eat(":"):
            colons += 1
            if self.t[self.i] not in ("]", ":"):
                self.expr()
        if colons > 2:
            raise Bad
        self.need("]")

    def literal(self):
        lev, self.lev = self.lev, 0
        self.need("{")
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if self.t[self.i] != "}":
                self.need(",")
        self.lev = lev

    def element(self):
        if self.t[self.i] == "{":
            self.literal()
        else:
            self.expr()


def statements(kinds: list[str]) -> list[list[str]]:
    """Top-level declarations: cut after each semicolon at bracket depth 0."""
    out, start, depth = [], 0, 0
    for i, k in enumerate(kinds):
        if k in PAIR:
            depth += 1
        elif k in CLOSE:
            depth -= 1
        elif k == ";" and depth == 0:
            out.append(kinds[start : i + 1])
            start = i + 1
    if start < len(kinds):
        out.append(kinds[start:])
    return out


def parses(kinds: list[str]) -> bool:
    """A whole file."""
    try:
        p = Parser(kinds)
        p.file()
        return True
    except (Bad, IndexError):
        return False
    except RecursionError:
        return True


def declaration_parses(kinds: list[str]) -> bool:
    try:
        p = Parser(kinds)
        p.declarations()
        return True
    except (Bad, IndexError):
        return False
    except RecursionError:
        return True
