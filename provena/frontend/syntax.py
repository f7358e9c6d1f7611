"""R source text to a syntax tree: a tokenizer and a precedence parser of the language's public grammar, with places in characters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"[ \t\f\r\u00a0]+|#[^\n]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?[Li]?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[Li]?")
_NAME = re.compile(r"(?:[^\W\d_]|\.(?![0-9]))[\w.]*")
_RAW = re.compile(r"""[rR](["'])(-*)([(\[{])""")
_OPERATORS = re.compile(r"%[^%\n]*%|<<-|->>|:::|\|>|<-|->|<=|>=|==|!=|&&|\|\||::|:=|\[\[|[-+*/^<>=!&|~?:$@()\[\]{},;\\]")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{1,2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{1,4}|U[0-9a-fA-F]{1,8}|[0-7]{1,3}|.)", re.S)
KEYWORDS = frozenset(("function", "if", "else", "for", "while", "repeat", "break", "next", "in"))
CONSTANTS = frozenset(("TRUE", "FALSE", "NULL", "NA", "NaN", "Inf", "NA_integer_", "NA_real_", "NA_character_"))
#: Binding powers of binary operators, weakest first: left and right.
POWERS = {"?": (1, 2), "=": (6, 5), ":=": (8, 7), "<-": (8, 7), "<<-": (8, 7), "->": (9, 10), "->>": (9, 10), "~": (11, 12), "||": (13, 14), "|": (13, 14), "&&": (15, 16), "&": (15, 16), "==": (19, 20), "!=": (19, 20), "<": (19, 20), ">": (19, 20), "<=": (19, 20), ">=": (19, 20), "+": (21, 22), "-": (21, 22), "*": (23, 24), "/": (23, 24), "%%": (25, 26), "|>": (25, 26), ":": (27, 28), "^": (32, 31)}
UNARY = {"-": 29, "+": 29, "!": 17, "~": 12, "?": 2}


class SyntaxProblem(ValueError):
    """The text is no program; ``args`` hold what was expected and where."""


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Node:
    """``kind``: name, string, number, constant, call, index, member, access, binary, unary, assign, function, if, for, while, repeat,
    block, paren, jump or missing. ``value`` holds a name, an operator or a literal; ``names`` those of arguments or parameters."""

    kind: str
    start: int
    end: int
    value: str | None = None
    parts: list[Node] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU" and len(x) > 1:
            return chr(int(x[1:].strip("{}"), 16))
        return chr(int(x, 8)) if x[0] in "01234567" and x != "0" else _ESCAPES.get(x, x)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, size = 0, len(text)
    while at < size:
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c == "\n":
            out.append(Token("newline", c, at, at + 1))
            at += 1
        elif m := _RAW.match(text, at):
            close = _CLOSES[m[3]] + m[2] + m[1]
            end = text.find(close, m.end())
            if end < 0:
                raise SyntaxProblem("end of raw string", at)
            out.append(Token("string", text[m.end() : end], at, end + len(close)))
            at = end + len(close)
        elif c in "\"'`":
            end = at + 1
            while end < size and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            if end >= size:
                raise SyntaxProblem("end of string", at)
            out.append(Token("name" if c == "`" else "string", _unescaped(text[at + 1 : end]), at, end + 1))
            at = end + 1
        elif m := _NUMBER.match(text, at) if c.isdigit() or c == "." else None:
            out.append(Token("number", m[0], at, m.end()))
            at = m.end()
        elif m := _NAME.match(text, at):
            word = m[0]
            out.append(Token("keyword" if word in KEYWORDS else "constant" if word in CONSTANTS else "name", word, at, m.end()))
            at = m.end()
        elif m := _OPERATORS.match(text, at):
            out.append(Token("op", m[0], at, m.end()))
            at = m.end()
        else:
            raise SyntaxProblem("a token", at)
    out.append(Token("end", "", size, size))
    return out


class Parser:
    """Newlines end expressions except inside parentheses and brackets, and where an operator or a clause must go on."""

    def __init__(self, text: str):
        self.tokens, self.at, self.inside = tokens(text), 0, 0

    def peek(self, skip: bool = False) -> Token:
        k = self.at
        while (skip or self.inside) and self.tokens[k].kind == "newline":
            k += 1
        if skip or self.inside:
            self.at = k
        return self.tokens[k]

    def take(self, text: str | None = None, skip: bool = False) -> Token:
        token = self.peek(skip)
        if text is not None and (token.text != text or token.kind == "string"):
            raise SyntaxProblem(text, token.start)
        self.at += 1
        return token

    def is_op(self, token: Token, *texts: str) -> bool:
        return token.kind == "op" and token.text in texts

    def program(self) -> Node:
        parts = self._sequence("end")
        return Node("block", 0, self.tokens[-1].end, "program", parts)

    def _sequence(self, stop: str) -> list[Node]:
        parts = []
        while True:
            token = self.peek(skip=True)
            if token.kind == "end" if stop == "end" else self.is_op(token, stop):
                return parts
            if self.is_op(token, ";"):
                self.take()
                continue
            parts.append(self.expression(0))
            token = self.tokens[self.at]
            if not (token.kind in ("newline", "end") or self.is_op(token, ";", stop)):
                raise SyntaxProblem("end of expression", token.start)

    def expression(self, least: int, no_equals: bool = False) -> Node:
        left = self._prefix()
        while True:
            token = self.peek()
            op = "%%" if token.kind == "op" and token.text.startswith("%") else token.text
            if token.kind != "op" or op not in POWERS or no_equals and op == "=":
                return left
            lower, upper = POWERS[op]
            if lower < least:
                return left
            self.take()
            self.peek(skip=True)
            right = self.expression(upper, no_equals)
            if op in ("<-", "<<-", "=", ":="):
                left = Node("assign", left.start, right.end, op, [left, right])
            elif op in ("->", "->>"):
                left = Node("assign", left.start, right.end, "<-" if op == "->" else "<<-", [right, left])
            elif op == "|>":
                if right.kind != "call":
                    raise SyntaxProblem("a call behind |>", right.start)
                left = Node("call", left.start, right.end, None, [right.parts[0], left, *right.parts[1:]], [None, *right.names])
            else:
                left = Node("binary", left.start, right.end, token.text, [left, right])

    def _prefix(self) -> Node:
        token = self.peek()
        if token.kind == "op" and token.text in UNARY:
            self.take()
            self.peek(skip=True)
            inner = self.expression(UNARY[token.text])
            return Node("unary", token.start, inner.end, token.text, [inner])
        return self._postfix(self._primary())

    def _postfix(self, left: Node) -> Node:
        while True:
            token = self.peek()
            if token.kind != "op":
                return left
            if token.text == "(":
                parts, names, end = self._arguments(")")
                left = Node("call", left.start, end, None, [left, *parts], names)
            elif token.text in ("[[", "["):
                parts, names, end = self._arguments("]", twice=token.text == "[[")
                left = Node("index", left.start, end, token.text, [left, *parts], names)
            elif token.text in ("$", "@"):
                self.take()
                self.peek(skip=True)
                right = self._primary()
                left = Node("member", left.start, right.end, token.text, [left, right])
            elif token.text in ("::", ":::") and left.kind in ("name", "string"):
                self.take()
                right = self.take()
                if right.kind not in ("name", "string", "constant"):
                    raise SyntaxProblem("a name", right.start)
                left = Node("access", left.start, right.end, token.text, [left, Node("name", right.start, right.end, right.text)])
            else:
                return left

    def _arguments(self, close: str, twice: bool = False) -> tuple[list[Node], list[str | None], int]:
        self.take()
        self.inside, was = 1, self.inside
        parts: list[Node] = []
        names: list[str | None] = []
        while True:
            token = self.peek()
            if self.is_op(token, close):
                break
            if self.is_op(token, ","):
                parts.append(Node("missing", token.start, token.start))
                names.append(None)
            else:
                name, begin = None, self.at
                if token.kind in ("name", "string", "constant"):
                    self.take()
                    if self.is_op(self.peek(), "="):
                        self.take()
                        name = token.text
                    else:
                        self.at = begin
                after = self.peek()
                if name is not None and self.is_op(after, ",", close):
                    parts.append(Node("missing", after.start, after.start))
                else:
                    parts.append(self.expression(0, no_equals=True))
                names.append(name)
            token = self.peek()
            if self.is_op(token, ","):
                self.take()
                if self.is_op(self.peek(), close) and close == "]":
                    parts.append(Node("missing", self.peek().start, self.peek().start))
                    names.append(None)
            elif not self.is_op(token, close):
                raise SyntaxProblem(close, token.start)
        end = self.take(close).end
        if twice:
            end = self.take("]").end
        self.inside = was
        return parts, names, end

    def _primary(self) -> Node:
        token = self.take()
        if token.kind in ("name", "string", "number", "constant"):
            return Node(token.kind, token.start, token.end, token.text)
        if self.is_op(token, "("):
            self.inside, was = 1, self.inside
            inner = self.expression(0)
            end = self.take(")").end
            self.inside = was
            return Node("paren", token.start, end, None, [inner])
        if self.is_op(token, "{"):
            self.inside, was = 0, self.inside
            parts = self._sequence("}")
            end = self.take("}", skip=True).end
            self.inside = was
            return Node("block", token.start, end, "{", parts)
        if token.text == "function" and token.kind == "keyword" or self.is_op(token, "\\"):
            return self._function(token)
        if token.kind == "keyword":
            return self._clause(token)
        raise SyntaxProblem("an expression", token.start)

    def _function(self, token: Token) -> Node:
        self.peek(skip=True)
        self.take("(")
        self.inside, was = 1, self.inside
        parts: list[Node] = []
        names: list[str | None] = []
        while not self.is_op(self.peek(), ")"):
            name = self.take()
            if name.kind != "name":
                raise SyntaxProblem("a parameter", name.start)
            names.append(name.text)
            if self.is_op(self.peek(), "="):
                self.take()
                parts.append(self.expression(0, no_equals=True))
            else:
                parts.append(Node("missing", name.start, name.end))
            if not self.is_op(self.peek(), ")"):
                self.take(",")
        self.take(")")
        self.inside = was
        self.peek(skip=True)
        body = self.expression(7)
        return Node("function", token.start, body.end, None, [*parts, body], names)

    def _condition(self) -> Node:
        self.peek(skip=True)
        self.take("(")
        self.inside, was = 1, self.inside
        inner = self.expression(0)
        self.take(")")
        self.inside = was
        self.peek(skip=True)
        return inner

    def _clause(self, token: Token) -> Node:
        if token.text in ("break", "next"):
            return Node("jump", token.start, token.end, token.text)
        if token.text == "repeat":
            self.peek(skip=True)
            body = self.expression(7)
            return Node("repeat", token.start, body.end, None, [body])
        if token.text == "while":
            condition, body = self._condition(), self.expression(7)
            return Node("while", token.start, body.end, None, [condition, body])
        if token.text == "for":
            self.peek(skip=True)
            self.take("(")
            self.inside, was = 1, self.inside
            name = self.take()
            self.take("in")
            over = self.expression(0)
            self.take(")")
            self.inside = was
            self.peek(skip=True)
            body = self.expression(7)
            return Node("for", token.start, body.end, name.text, [over, body])
        if token.text == "if":
            condition, then = self._condition(), self.expression(7)
            k = self.at
            while self.tokens[k].kind == "newline":
                k += 1
            # at top level a newline ends the clause; the tree is the same where one follows in a block
            if self.tokens[k].kind == "keyword" and self.tokens[k].text == "else":
                self.at = k + 1
                self.peek(skip=True)
                other = self.expression(7)
                return Node("if", token.start, other.end, None, [condition, then, other])
            return Node("if", token.start, then.end, None, [condition, then])
        raise SyntaxProblem("an expression", token.start)


def parse(text: str) -> Node:
    """The program of a text; raises ``SyntaxProblem``. Trees nested deeper than Python's stack are problems too."""
    try:
        return Parser(text).program()
    except RecursionError:
        raise SyntaxProblem("less nesting", 0) from None
