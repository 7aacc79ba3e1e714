"""Lexer with resumable states and local statement grammar for ECMAScript modules and TypeScript.

The lexer turns text into token kinds: identifiers become ``ID``, numbers
``0``, strings ``'s'``, regular expressions ``re``; keywords, contextual
keywords and punctuation stay themselves, ``\\n`` marks a line break.  Names and values are
not needed to judge syntax, so equal shapes share one parse (see ``Grammar``).

Lexer states are tuples ``(mode, value, stack)``: mode is ``code``, ``block``,
``tmpl``, ``'`` or ``"``; value tells whether the last token ended an operand
(so that ``/`` divides); stack holds, for every template substitution that is
open, the number of braces open inside it.
"""

from __future__ import annotations

import re

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)
CONTEXTUAL = frozenset(
    "let async await of get set static from as type interface namespace module declare abstract readonly public "
    "private protected override implements is asserts infer keyof unique satisfies yield global accessor out target meta constructor".split()
)
WORDS = {w: w for w in RESERVED | CONTEXTUAL}
VALUE_END = frozenset(["ID", "0", "s", "re", "`)", ")", "]", "}", "this", "super", "null", "true", "false"]) | CONTEXTUAL

_TOKEN = re.compile(
    r"""[ \t\f\v ﻿\r]*(?:
    (?P<w>(?:[A-Za-z_$ª-‧‪-\U0010ffff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍ª-῿]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)
    |(?P<nl>[\n  ]\s*)
    |(?P<c>//[^\n  ]*)
    |(?P<b>/\*)
    |(?P<s>'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*")
    |(?P<n>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:[0-9](?:_?[0-9])*(?:n|\.?(?:[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9]+)?)|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?))(?![\w$]))
    |(?P<p>\#[A-Za-z_$ª-\U0010ffff][\w$]*)
    |(?P<o>\.\.\.|=>|===|!==|==|!=|<=|>=|<<=|<<|\*\*=|\*\*|\+\+|--|\+=|-=|\*=|%=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|&=|\|=|\^=|\?\.(?![0-9])|[{}()\[\];,<>+\-*%&|^!~?:=.@/`])
    |(?P<e>$)
    |(?P<x>[\s\S]))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TMPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BADID = re.compile(r"[‐-⁞←-⯿　-〄〈-〠！-／：-＠´·×÷«»�]")
_TAIL = {"'": re.compile(r"(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*(')?"), '"': re.compile(r'(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*(")?')}

START = ("code", False, ())
#: Entry states for which a later chunk of a file is summarised; any other state makes the file be lexed in one piece.
ENTRY = tuple(
    [(m, v, s) for m in ("code", "block") for v in (False, True) for s in ((), (0,), (1,))]
    + [("tmpl", False, s) for s in ((), (0,), (1,))]
    + [("'", False, ()), ('"', False, ())]
)


def lex(text: str, state=START, first: bool = True, other: bool = False) -> tuple[tuple | None, list[str]]:
    """Exit state (None: a character or literal that no token fits) and token kinds of ``text``.

    Whether a slash after ``)`` or ``}`` divides or begins a regular expression depends
    on what these close.  It is read as division after ``)`` and as the other after
    ``}``; with ``other`` the reverse.
    """
    mode, value, stack = state
    stack = list(stack)
    out: list[str] = []
    add = out.append
    pos, end = 0, len(text)
    if first and text.startswith("#!"):
        pos = text.find("\n")
        if pos < 0:
            return state, out
    while True:
        if mode == "block":
            close = text.find("*/", pos)
            if "\n" in text[pos : close if close >= 0 else end]:
                add("\n")
            if close < 0:
                return ("block", value, tuple(stack)), out
            pos, mode = close + 2, "code"
        elif mode == "tmpl":
            pos = _TMPL.match(text, pos).end()
            if pos >= end or text[pos] == "\\":
                return ("tmpl", False, tuple(stack)), out
            if text[pos] == "`":
                add("`)")
                pos, mode, value = pos + 1, "code", True
            else:
                add("${")
                stack.append(0)
                pos, mode, value = pos + 2, "code", False
        elif mode != "code":
            m = _TAIL[mode].match(text, pos)
            if not m[1]:
                return ((mode, False, tuple(stack)) if m.end() >= end else None), out
            add("s")
            pos, mode, value = m.end(), "code", True
        # code
        for m in _TOKEN.finditer(text, pos):
            kind = m.lastgroup
            if kind == "w":
                w = m[kind]
                if w in WORDS:
                    k = WORDS[w]
                    value = k in VALUE_END
                    if out and out[-1] in (".", "?."):
                        k, value = "ID", True
                    add(k)
                else:
                    if not w.isascii() and _BADID.search(w):
                        return None, out
                    add("ID")
                    value = True
            elif kind == "nl":
                if not out or out[-1] != "\n":
                    add("\n")
            elif kind == "o":
                t = m[kind]
                if t == "{":
                    if stack:
                        stack[-1] += 1
                    value = False
                elif t == "}":
                    if stack:
                        if stack[-1] == 0:
                            stack.pop()
                            add("}$")
                            pos, mode = m.end(), "tmpl"
                            break
                        stack[-1] -= 1
                    value = False  # a block; after an object literal a division is rare and handled by the retry below
                elif t == "/":
                    if other and out and out[-1] in (")", "}"):
                        value = out[-1] == "}"
                    if value:
                        value = False
                    else:
                        r = _REGEX.match(text, m.start("o"))
                        if not r:
                            if out and out[-1] == "}":
                                add("/")
                                continue
                            return None, out
                        add("re")
                        value, pos = True, r.end()
                        break
                    if text.startswith("=", m.end()):
                        add("/=")
                        pos = m.end() + 1
                        break
                elif t == "`":
                    add("`(")
                    pos, mode = m.end(), "tmpl"
                    break
                elif t == ")" or t == "]":
                    value = True
                elif t == "++" or t == "--":
                    pass
                else:
                    value = False
                add(t)
            elif kind == "s":
                add("s")
                value = True
            elif kind == "n":
                add("0")
                value = True
            elif kind == "p":
                add("#p")
                value = True
            elif kind == "b":
                pos, mode = m.end(), "block"
                break
            elif kind == "x":
                c = m[kind]
                if c in "'\"":
                    t = _TAIL[c].match(text, m.start("x") + 1)
                    if t.end() >= end and text.endswith(("\\", "\\\n")):
                        return (c, False, tuple(stack)), out
                return None, out
            elif kind == "e":
                return ("code", value, tuple(stack)), out
        else:
            return ("code", value, tuple(stack)), out


class Bad(Exception):
    pass


PAIR = {"(": ")", "[": "]", "{": "}", "${": "}$", "`(": "`)"}
CLOSE = frozenset(PAIR.values())
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="])
BINARY = frozenset(["+", "-", "*", "/", "%", "**", "<<", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^", "&&", "||", "??", "instanceof"])
UNARY = frozenset(["+", "-", "!", "~", "typeof", "void", "delete"])
MODIFIER = frozenset(["public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "accessor", "async"])


class Parser:
    """Recursive descent over token kinds; raises Bad where no production fits."""

    def __init__(self, kinds: list[str], ts: bool):
        self.t: list[str] = []
        self.nl: list[bool] = []
        new = True
        for k in kinds:
            if k == "\n":
                new = True
            else:
                self.t.append(k)
                self.nl.append(new)
                new = False
        self.n = len(self.t)
        self.t.append("EOF")
        self.nl.append(True)
        self.i = 0
        self.ts = ts
        self.typed_arrows = True
        self.ambient = False
        self.close: dict[int, int] = {}
        stack = []
        for i, k in enumerate(self.t):
            if k in PAIR:
                stack.append(i)
            elif k in CLOSE:
                if not stack or PAIR[self.t[stack[-1]]] != k:
                    raise Bad
                self.close[stack.pop()] = i
        if stack:
            raise Bad

    # helpers
    def eat(self, k):
        if self.t[self.i] == k:
            self.i += 1
            return True
        return False

    def need(self, k):
        if self.t[self.i] != k:
            raise Bad
        self.i += 1

    def is_name(self, k):
        return k == "ID" or k in CONTEXTUAL

    def name(self):
        if not self.is_name(self.t[self.i]):
            raise Bad
        self.i += 1

    def any_name(self):
        k = self.t[self.i]
        if not (k == "ID" or k in WORDS):
            raise Bad
        self.i += 1

    def semi(self):
        if self.eat(";"):
            return
        if self.t[self.i] in ("}", "EOF") or self.nl[self.i]:
            return
        raise Bad

    def attempt(self, f, *a):
        at = self.i
        try:
            f(*a)
            return True
        except Bad:
            self.i = at
            return False

    # statements
    def program(self):
        while self.i < self.n:
            self.statement(True)

    def block(self):
        self.need("{")
        while not self.eat("}"):
            if self.i >= self.n:
                raise Bad
            self.statement(False)

    def statement(self, top=False):
        t, i = self.t, self.i
        k, k1 = t[i], t[i + 1] if i < self.n else "EOF"
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return
        if k == "ID" and k1 == ":":
            self.i += 2
            return self.statement()
        if k in ("var", "const") or k == "let" and (self.is_name(k1) or k1 in "[{"):
            if self.ts and k == "const" and k1 == "enum":
                self.i += 1
                return self.enum()
            self.i += 1
            self.declarators(False, k == "const" and not self.ambient)
            return self.semi()
        if k == "function" or k == "async" and k1 == "function" and not self.nl[i + 1]:
            return self.function(True)
        if k == "class":
            return self.klass(True)
        if k == "@":
            self.decorators()
            if self.eat("export"):
                self.eat("default")
            if self.ts:
                self.eat("abstract")
            return self.klass(False)
        if k == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.eat("else"):
                self.statement()
            return
        if k == "for":
            return self.for_()
        if k == "while":
            self.i += 1
            self.paren()
            return self.statement()
        if k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.eat(";")
            return
        if k in ("return", "throw"):
            if k == "return" and top:
                raise Bad
            self.i += 1
            if k == "return" and (self.t[self.i] in (";", "}", "EOF") or self.nl[self.i]):
                return self.semi()
            if k == "throw" and self.nl[self.i]:
                raise Bad
            self.expression()
            return self.semi()
        if k in ("break", "continue"):
            self.i += 1
            if not self.nl[self.i] and self.is_name(self.t[self.i]):
                self.i += 1
            return self.semi()
        if k == "debugger":
            self.i += 1
            return self.semi()
        if k == "try":
            self.i += 1
            self.block()
            some = False
            if self.eat("catch"):
                some = True
                if self.eat("("):
                    self.binding()
                    if self.ts and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                some = True
                self.block()
            if not some:
                raise Bad
            return
        if k == "switch":
            self.i += 1
            self.paren()
            self.need("{")
            defaults = 0
            while not self.eat("}"):
                if self.eat("default"):
                    defaults += 1
                    if defaults > 1:
                        raise Bad
                else:
                    self.need("case")
                    self.expression()
                self.need(":")
                while self.t[self.i] not in ("case", "default", "}"):
                    if self.i >= self.n:
                        raise Bad
                    self.statement()
            return
        if k == "import" and k1 not in ("(", "."):
            if not top:
                raise Bad
            return self.import_()
        if k == "export":
            if not top:
                raise Bad
            return self.export()
        if self.ts and k in ("type", "interface", "namespace", "module", "declare", "abstract", "enum", "global") and self.attempt(self.ts_declaration):
            return
        self.expression()
        self.semi()

    def ts_declaration(self):
        k = self.t[self.i]
        if k == "enum":
            return self.enum()
        nxt = self.t[self.i + 1]
        if k == "type" and self.is_name(nxt) and not self.nl[self.i + 1]:
            self.i += 2
            self.type_params()
            self.need("=")
            self.type()
            return self.semi()
        if k == "interface" and self.is_name(nxt):
            self.i += 2
            self.type_params()
            if self.eat("extends"):
                self.type_list()
            return self.object_type()
        if k in ("namespace", "module") and (self.is_name(nxt) or nxt == "s") and not self.nl[self.i + 1]:
            self.i += 2
            while self.eat("."):
                self.name()
            if self.t[self.i] != "{" and nxt == "s":
                return self.semi()
            return self.namespace_body()
        if k == "global" and nxt == "{":
            self.i += 1
            return self.namespace_body()
        if k == "abstract" and nxt == "class":
            self.i += 1
            return self.klass(True)
        if k == "declare" and not self.nl[self.i + 1] and (nxt in ("const", "let", "var", "function", "class", "abstract", "enum", "async") or nxt in ("type", "interface", "namespace", "module", "global")):
            self.i += 1
            was, self.ambient = self.ambient, True
            self.statement(True)
            self.ambient = was
            return
        raise Bad

    def namespace_body(self):
        self.need("{")
        while not self.eat("}"):
            if self.i >= self.n:
                raise Bad
            self.statement(True)

    def enum(self):
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] == "s":
                self.i += 1
            else:
                self.any_name()
            if self.eat("="):
                self.assignment()
            if self.t[self.i] != "}":
                self.need(",")

    def declarators(self, no_in, must=False):
        while True:
            pattern = self.t[self.i] in ("[", "{")
            self.binding()
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment(no_in)
            elif (pattern or must) and not (no_in and (self.t[self.i] in ("of", "in"))):
                raise Bad
            if not self.eat(","):
                return

    def binding(self):
        k = self.t[self.i]
        if k == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("..."):
                    self.name()
                else:
                    key = self.t[self.i]
                    if key == "[":
                        self.i += 1
                        self.assignment()
                        self.need("]")
                        self.need(":")
                        self.binding()
                    elif key in ("s", "0"):
                        self.i += 1
                        self.need(":")
                        self.binding()
                    else:
                        self.any_name()
                        if self.eat(":"):
                            self.binding()
                        elif key in RESERVED:
                            raise Bad
                    if self.eat("="):
                        self.assignment()
                if self.t[self.i] != "}":
                    self.need(",")
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if self.t[self.i] != "]":
                    self.need(",")
        else:
            self.name()

    def paren(self):
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self):
        self.i += 1
        self.eat("await")
        self.need("(")
        k, k1 = self.t[self.i], self.t[self.i + 1]
        if k != ";":
            if k in ("var", "const") or k == "let" and (self.is_name(k1) or k1 in "[{"):
                self.i += 1
                self.declarators(True, k == "const")
            else:
                self.expression(True)
            if self.t[self.i] in ("of", "in"):
                of = self.t[self.i] == "of"
                self.i += 1
                self.assignment() if of else self.expression()
                self.need(")")
                return self.statement()
        self.need(";")
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")
        if self.t[self.i] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def function(self, named):
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.is_name(self.t[self.i]):
            self.i += 1
        elif named:
            raise Bad
        self.signature()
        if self.ts and self.t[self.i] != "{":
            return self.semi()
        self.block()

    def signature(self):
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()

    def params(self):
        self.need("(")
        while not self.eat(")"):
            if self.t[self.i] == "@":
                self.decorators()
            rest = self.eat("...")
            if self.ts:
                while self.t[self.i] in ("public", "private", "protected", "readonly", "override") and (self.is_name(self.t[self.i + 1])):
                    self.i += 1
                if not self.eat("this"):
                    self.binding()
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if self.eat("="):
                self.assignment()
            if rest and self.t[self.i] != ")":
                raise Bad
            if self.t[self.i] != ")":
                self.need(",")

    def decorators(self):
        while self.eat("@"):
            self.unary_tail()

    def klass(self, named):
        self.need("class")
        if self.is_name(self.t[self.i]) and self.t[self.i] != "implements":
            self.i += 1
        if self.ts:
            self.type_params()
        if self.eat("extends"):
            self.unary_tail()
            if self.ts:
                self.attempt(self.type_args)
        if self.ts and self.eat("implements"):
            self.type_list()
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            self.member()

    def member(self):
        if self.t[self.i] == "@":
            self.decorators()
        if self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.i += 1
            return self.block()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        while self.t[self.i] in (MODIFIER if self.ts else ("static", "async", "accessor")) and self.t[self.i + 1] not in ends and not (self.t[self.i] == "async" and self.nl[self.i + 1]):
            self.i += 1
        gen = self.eat("*")
        accessor = False
        if not gen and self.t[self.i] in ("get", "set") and self.t[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.t[self.i + 1] == "*"):
            self.i += 1
            accessor = True
        if self.ts and self.t[self.i] == "[" and self.is_name(self.t[self.i + 1]) and self.t[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            return self.semi()
        self.key()
        if self.ts:
            self.eat("?") or self.eat("!")
        if self.t[self.i] == "(" or self.t[self.i] == "<":
            self.signature()
            if self.ts and self.t[self.i] != "{":
                return self.semi()
            return self.block()
        if gen or accessor:
            raise Bad
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.assignment()
        self.semi()

    def key(self):
        k = self.t[self.i]
        if k == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif k in ("s", "0", "#p") or k == "ID" or k in WORDS:
            self.i += 1
        else:
            raise Bad

    def import_(self):
        self.need("import")
        if self.eat("s"):
            self.attributes()
            return self.semi()
        if self.ts and self.t[self.i] == "type" and (self.t[self.i + 1] in "{*" or self.is_name(self.t[self.i + 1]) and not (self.t[self.i + 1] == "from" and self.t[self.i + 2] == "s")):
            self.i += 1
        if self.is_name(self.t[self.i]):
            self.i += 1
            if self.ts and self.eat("="):
                self.assignment()
                return self.semi()
            if not self.eat(","):
                return self.from_()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.from_()

    def from_(self):
        self.need("from")
        self.need("s")
        self.attributes()
        self.semi()

    def attributes(self):
        if self.t[self.i] == "with" and self.t[self.i + 1] == "{":
            self.i += 1
            self.object()

    def specifiers(self):
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.t[self.i] == "type" and self.t[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            self.eat("s") or self.any_name()
            if self.eat("as"):
                self.eat("s") or self.any_name()
            if self.t[self.i] != "}":
                self.need(",")

    def export(self):
        self.need("export")
        k = self.t[self.i]
        if k == "default":
            self.i += 1
            k, k1 = self.t[self.i], self.t[self.i + 1]
            if k == "function" or k == "async" and k1 == "function":
                return self.function(False)
            if k == "class":
                return self.klass(False)
            if self.ts and (k == "abstract" and k1 == "class" or k == "interface" and self.is_name(k1)):
                return self.ts_declaration()
            self.assignment()
            return self.semi()
        if k == "*":
            self.i += 1
            if self.eat("as"):
                self.eat("s") or self.any_name()
            return self.from_()
        if self.ts and k == "type" and self.t[self.i + 1] in "{*":
            self.i += 1
            if self.eat("*"):
                if self.eat("as"):
                    self.any_name()
                return self.from_()
            k = "{"
        if k == "{":
            self.specifiers()
            if self.t[self.i] == "from":
                return self.from_()
            return self.semi()
        if self.ts and k == "=":
            self.i += 1
            self.assignment()
            return self.semi()
        if self.ts and k == "import":
            return self.import_()
        if k in ("var", "const", "let", "function", "class", "async", "@") or self.ts and k in ("type", "interface", "namespace", "module", "declare", "abstract", "enum"):
            if k == "async" and self.t[self.i + 1] != "function":
                raise Bad
            at = self.i
            self.statement(False)
            if self.ts and k in ("type", "interface", "namespace", "module", "declare", "abstract", "enum") and self.i == at:
                raise Bad
            return
        raise Bad

    # expressions
    def expression(self, no_in=False):
        self.assignment(no_in)
        while self.eat(","):
            self.assignment(no_in)

    def assignment(self, no_in=False):
        t, i = self.t, self.i
        k = t[i]
        if k == "yield" and t[i + 1] not in ("=>", "=", ".", "("):
            self.i += 1
            if self.eat("*"):
                return self.assignment(no_in)
            if t[self.i] in (")", "]", "}", ",", ";", ":", "EOF", "in", "of", "}$") or self.nl[self.i]:
                return
            return self.assignment(no_in)
        if k == "async" and not self.nl[i + 1]:
            if self.is_name(t[i + 1]) and t[i + 2] == "=>":
                self.i += 3
                return self.arrow_body(no_in)
            if t[i + 1] in ("(", "<"):
                self.i += 1
                if self.arrow(no_in):
                    return
                self.i = i
        elif (k == "ID" or k in CONTEXTUAL) and t[i + 1] == "=>" and not self.nl[i + 1]:
            self.i += 2
            return self.arrow_body(no_in)
        elif k == "(" or k == "<" and self.ts:
            if self.arrow(no_in):
                return
        target = self.conditional(no_in)
        if self.t[self.i] in ASSIGN:
            if not target:
                raise Bad
            self.i += 1
            self.assignment(no_in)
        elif self.t[self.i] == ">" and self.t[self.i + 1] in (">", ">="):
            raise Bad

    def arrow(self, no_in):
        at = self.i
        if self.t[at] == "(":
            j = self.close[at]
            after = self.t[j + 1]
            if after != "=>" and not (self.ts and self.typed_arrows and after == ":"):
                return False
        try:
            if self.ts:
                self.type_params()
            self.params()
            if self.ts and self.eat(":"):
                self.return_type()
            if self.nl[self.i]:
                raise Bad
            self.need("=>")
        except Bad:
            self.i = at
            return False
        self.arrow_body(no_in)
        return True

    def arrow_body(self, no_in):
        if self.t[self.i] == "{":
            self.block()
        else:
            self.assignment(no_in)

    def conditional(self, no_in):
        target = self.binary(no_in)
        if self.eat("?"):
            at = self.i
            try:
                self.assignment()
                self.need(":")
            except Bad:
                if not self.ts:
                    raise
                # a ? (b) : c => d: what was read as the result type of an arrow is the other branch
                self.i, was, self.typed_arrows = at, self.typed_arrows, False
                self.assignment()
                self.typed_arrows = was
                self.need(":")
            self.assignment(no_in)
            return False
        return target

    def binary(self, no_in):
        if self.t[self.i] == "#p" and self.t[self.i + 1] == "in":
            self.i += 1
            target = False
        else:
            target = self.unary()
        while True:
            k = self.t[self.i]
            if k in BINARY:
                self.i += 1
                if k == ">":
                    while self.t[self.i] == ">":
                        self.i += 1
                    if self.t[self.i] == ">=" and self.t[self.i - 1] == ">":
                        self.i += 1
                        self.assignment(no_in)
                        return False
            elif k == "in" and not no_in:
                self.i += 1
            elif self.ts and k in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not (k == "as" and self.eat("const")):
                    self.type()
                continue
            else:
                return target
            target = False
            self.unary()

    def unary(self):
        k = self.t[self.i]
        if k in UNARY:
            self.i += 1
            self.unary()
            return False
        if k in ("++", "--"):
            self.i += 1
            if not self.unary():
                raise Bad
            return False
        if k == "await" and self.t[self.i + 1] not in (")", ",", ";", "=", ".", "=>", "EOF", "}", "]") and not (self.t[self.i + 1] in BINARY and self.t[self.i + 1] not in UNARY):
            self.i += 1
            self.unary()
            return False
        if self.ts and k == "<":
            self.i += 1
            self.type()
            self.need(">")
            self.unary()
            return False
        target = self.unary_tail()
        if self.t[self.i] in ("++", "--") and not self.nl[self.i]:
            if not target:
                raise Bad
            self.i += 1
            return False
        return target

    def unary_tail(self):
        target = self.primary()
        while True:
            k = self.t[self.i]
            if k == ".":
                self.i += 1
                if not self.eat("#p"):
                    self.any_name()
                target = True
            elif k == "?.":
                self.i += 1
                if self.t[self.i] == "(":
                    self.arguments()
                elif self.t[self.i] == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                elif not self.eat("#p"):
                    self.any_name()
                target = False
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                target = True
            elif k == "(":
                self.arguments()
                target = False
            elif k == "`(":
                self.template()
                target = False
            elif self.ts and k == "!" and not self.nl[self.i]:
                self.i += 1
                target = True
            elif self.ts and k == "<":
                at = self.i
                if not (self.attempt(self.type_args) and self.t[self.i] in ("(", "`(", ")", "]", ",", ";", ".", "?.", ":", "EOF", "}", "=", "==", "===")):
                    self.i = at
                    return target
                target = False
            else:
                return target

    def arguments(self):
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.t[self.i] != ")":
                self.need(",")

    def template(self):
        self.need("`(")
        while not self.eat("`)"):
            self.need("${")
            self.expression()
            self.need("}$")

    def primary(self):
        k = self.t[self.i]
        if k == "ID":
            self.i += 1
            return True
        if k in ("0", "s", "re", "this", "null", "true", "false"):
            self.i += 1
            return False
        if k == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return True
        if k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.t[self.i] != "]":
                    self.need(",")
            return True
        if k == "{":
            self.object()
            return True
        if k == "`(":
            self.template()
            return False
        if k == "function" or k == "async" and self.t[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.eat("async")
            self.need("function")
            self.eat("*")
            if self.is_name(self.t[self.i]):
                self.i += 1
            self.signature()
            self.block()
            return False
        if k in ("class", "@"):
            if k == "@":
                self.decorators()
            self.klass(False)
            return False
        if k == "new":
            self.i += 1
            if self.eat("."):
                self.any_name()
                return False
            self.new_target()
            return False
        if k == "super":
            self.i += 1
            if self.t[self.i] not in (".", "[", "("):
                raise Bad
            return False
        if k == "import":
            self.i += 1
            if self.t[self.i] == "(":
                self.arguments()
            else:
                self.need(".")
                self.any_name()
            return False
        if k in CONTEXTUAL:
            self.i += 1
            return True
        raise Bad

    def new_target(self):
        if self.t[self.i] == "new":
            self.i += 1
            if self.eat("."):
                self.any_name()
            else:
                self.new_target()
        else:
            self.primary()
        while True:
            k = self.t[self.i]
            if k == ".":
                self.i += 1
                if not self.eat("#p"):
                    self.any_name()
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif self.ts and k == "<" and self.attempt(self.type_args):
                pass
            else:
                break
        if self.t[self.i] == "(":
            self.arguments()

    def object(self):
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                ends = (",", ":", "(", "}", "=", "<")
                gen = False
                if self.t[self.i] == "async" and self.t[self.i + 1] not in ends and not self.nl[self.i + 1]:
                    self.i += 1
                gen = self.eat("*")
                accessor = False
                if not gen and self.t[self.i] in ("get", "set") and self.t[self.i + 1] not in ends:
                    self.i += 1
                    accessor = True
                k = self.t[self.i]
                if k == "#p":
                    raise Bad
                self.key()
                if self.t[self.i] == "(" or self.ts and self.t[self.i] == "<":
                    self.signature()
                    self.block()
                elif accessor or gen:
                    raise Bad
                elif self.eat(":"):
                    self.assignment()
                elif self.is_name(k):
                    if self.eat("="):
                        self.assignment()
                else:
                    raise Bad
            if self.t[self.i] != "}":
                self.need(",")

    # types
    def type_params(self):
        if not self.eat("<"):
            return
        while not self.eat(">"):
            while self.t[self.i] in ("const", "in", "out") and (self.is_name(self.t[self.i + 1])):
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if self.t[self.i] != ">":
                self.need(",")

    def type_args(self):
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.need(">")

    def type_list(self):
        self.type_ref()
        while self.eat(","):
            self.type_ref()

    def type_ref(self):
        self.any_name()
        while self.eat("."):
            self.any_name()
        if self.t[self.i] == "<":
            self.type_args()

    def return_type(self):
        if self.t[self.i] == "asserts" and (self.is_name(self.t[self.i + 1]) or self.t[self.i + 1] == "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if (self.is_name(self.t[self.i]) or self.t[self.i] == "this") and self.t[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.type()

    def type(self):
        k = self.t[self.i]
        if k == "<" or k == "new" or k == "abstract" and self.t[self.i + 1] == "new" or k == "(":
            at = self.i
            if self.attempt(self.function_type):
                return
            self.i = at
        self.union()
        if self.t[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.union()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()
        elif self.t[self.i] == "extends" and self.nl[self.i]:
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self):
        self.eat("abstract")
        self.eat("new")
        self.type_params()
        self.params()
        self.need("=>")
        self.return_type()

    def union(self):
        self.eat("|") or self.eat("&")
        self.postfix_type()
        while self.t[self.i] in ("|", "&"):
            self.i += 1
            if self.t[self.i] in ("(", "new", "<") and self.attempt(self.function_type):
                return
            self.postfix_type()

    def postfix_type(self):
        k = self.t[self.i]
        if k in ("keyof", "unique", "readonly", "infer") and (self.t[self.i + 1] not in (",", ">", ")", "]", "}", ";", "|", "&", "=", "[", ".", "EOF") or k in ("keyof", "readonly") and self.t[self.i + 1] == "["):
            self.i += 1
            if k == "infer":
                self.name()
                if self.t[self.i] == "extends":
                    at = self.i
                    self.i += 1
                    self.union()
                    if self.t[self.i] == "?":
                        self.i = at
                return
            return self.postfix_type()
        if k == "typeof":
            self.i += 1
            if self.t[self.i] == "import":
                self.i += 1
                self.arguments()
            else:
                self.any_name()
            while self.eat("."):
                self.eat("#p") or self.any_name()
            if self.t[self.i] == "<" and not self.nl[self.i]:
                self.attempt(self.type_args)
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.is_name(self.t[self.i]) and (self.t[self.i + 1] == ":" or self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if self.t[self.i] != "]":
                    self.need(",")
        elif k == "{":
            self.object_type()
        elif k in ("s", "0", "true", "false", "null", "void", "this"):
            self.i += 1
        elif k == "-" and self.t[self.i + 1] == "0":
            self.i += 2
        elif k == "`(":
            self.i += 1
            while not self.eat("`)"):
                self.need("${")
                self.type()
                self.need("}$")
        elif k == "import":
            self.i += 1
            self.arguments()
            while self.eat("."):
                self.any_name()
            if self.t[self.i] == "<":
                self.type_args()
        elif k == "ID" or k in CONTEXTUAL:
            self.type_ref()
        else:
            raise Bad
        while self.t[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def object_type(self):
        self.need("{")
        while not self.eat("}"):
            if self.t[self.i] in ("+", "-"):
                self.i += 1
            ends = ("(", ":", "?", ";", ",", "}", "<")
            while self.t[self.i] in ("readonly", "get", "set") and self.t[self.i + 1] not in ends and not self.nl[self.i + 1]:
                self.i += 1
            if self.t[self.i] == "new" and self.t[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.t[self.i] in ("(", "<"):
                self.signature()
            else:
                if self.t[self.i] == "[" and self.is_name(self.t[self.i + 1]) and self.t[self.i + 2] in (":", "in"):
                    self.i += 3
                    self.type()
                    if self.eat("as"):
                        self.type()
                    self.need("]")
                else:
                    self.key()
                if self.t[self.i] in ("+", "-") and self.t[self.i + 1] == "?":
                    self.i += 1
                self.eat("?")
                if self.t[self.i] in ("(", "<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if self.t[self.i] != "}" and not self.nl[self.i]:
                if not (self.eat(";") or self.eat(",")):
                    raise Bad
            else:
                self.eat(";") or self.eat(",")


SURE = frozenset("import export function class const var if for while switch try".split())


def statements(kinds: list[str]) -> list[list[str]]:
    """Cut at bracket depth 0 after ``;``, and after ``}`` where a line begins with a word that cannot continue an expression."""
    out, start, depth, n = [], 0, 0, len(kinds)
    for i, k in enumerate(kinds):
        if k in PAIR:
            depth += 1
        elif k in CLOSE:
            depth -= 1
            if depth == 0 and k == "}" and i + 2 < n and kinds[i + 1] == "\n" and kinds[i + 2] in SURE:
                out.append(kinds[start : i + 1])
                start = i + 1
        elif k == ";" and depth == 0:
            out.append(kinds[start : i + 1])
            start = i + 1
    if start < n:
        out.append(kinds[start:])
    return out


def parses(kinds: list[str], ts: bool) -> bool:
    try:
        Parser(kinds, ts).program()
        return True
    except (Bad, IndexError):
        return False
    except RecursionError:  # nesting beyond the interpreter's stack: brackets and tokens were sound, so it stays unflagged
        return True
