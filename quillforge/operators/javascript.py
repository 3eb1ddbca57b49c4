"""JavaScript and TypeScript source as tokens with matched brackets, and the top-level units in it.

The scan knows strings, templates with code in them, comments, regular expressions
and elements (JSX), so that a brace or a quote in any of them is no code. Units are
read from the tokens outside of all brackets: no expression is parsed, only where
statements, heads and bodies begin and end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

_WORD = re.compile(r"[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*|\d[\w.]*")
_SIGN = re.compile(r"=>|\?\.|\.\.\.|&&=?|\|\|=?|\?\?=?|[=!]==?|\+\+|--|.", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_STRING = {"'": re.compile(r"'(?:\\.|[^'\\\n])*'", re.S), '"': re.compile(r'"(?:\\.|[^"\\\n])*"', re.S)}
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z_$][\w$.:-]*)?")
_IN_TAG = re.compile(r"(?:[^{\"'>/]|/(?!>))*")
#: What looks like an element but begins the type parameters of a function.
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=|>\s*\()")
#: After these words an expression begins.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())
_PARTNER = {")": "(", "]": "[", "}": "{"}
_STARTS = frozenset("import export function class const let var async abstract declare interface type enum namespace if for while switch try return throw".split())


@dataclass(slots=True)
class Token:
    kind: str  # word, sign, string, template, regex, text (of an element), comment
    text: str
    start: int
    end: int
    fresh: bool  # the first of its line
    depth: int  # brackets around it
    partner: int = -1  # of a bracket, where it has one


class _Scan:
    def __init__(self, src: str):
        self.src, self.out, self.fresh, self.depth = src, [], True, 0
        self.code(0, False)

    def put(self, kind: str, start: int, end: int, text: str | None = None) -> int:
        self.out.append(Token(kind, self.src[start:end] if text is None else text, start, end, self.fresh, self.depth))
        self.fresh = False
        return end

    def value_next(self) -> bool:
        """Whether an expression may begin here, by the token before."""
        last = next((t for t in reversed(self.out) if t.kind != "comment"), None)
        if last is None:
            return True
        return last.text in _BEFORE_VALUE if last.kind == "word" else last.kind == "sign" and last.text not in (")", "]", "}", "++", "--")

    def nested(self, at: int, width: int) -> int:
        """The code in braces that begin at a place."""
        mine = len(self.out)
        self.put("sign", at, at + width, "{")
        self.depth += 1
        at = self.code(at + width, True)
        self.depth = self.out[mine].depth
        if at <= len(self.src) and self.src[at - 1 : at] == "}":
            self.out[mine].partner = len(self.out)
            self.put("sign", at - 1, at)
            self.out[-1].partner = mine
        return at

    def template(self, at: int) -> int:
        while at < len(self.src):
            end = _TEMPLATE.match(self.src, at).end()
            self.put("template", at, end)
            if not self.src.startswith("${", end):
                return end + 1
            at = self.nested(end, 2)
        return at

    def element(self, at: int) -> int:
        """An element with all in it."""
        src, inside = self.src, 0
        while at < len(src):
            m = _TAG.match(src, at)
            if m:
                self.put("text", at, m.end())
                at = m.end()
                while at < len(src):  # the tag
                    at = _IN_TAG.match(src, at).end()
                    c = src[at : at + 1]
                    if c == "{":
                        at = self.nested(at, 1)
                    elif c in ("'", '"'):
                        end = src.find(c, at + 1)
                        at = len(src) if end < 0 else end + 1
                    else:
                        break
                alone = src.startswith("/>", at)
                at += 2 if alone else 1
                inside += -1 if m[1] else 0 if alone else 1
                if inside <= 0:
                    return at
            elif src[at] == "{":
                at = self.nested(at, 1)
            else:
                end = re.compile(r"[^<{]*|<").match(src, at).end()
                at = self.put("text", at, max(end, at + 1))
        return at

    def is_element(self, at: int) -> bool:
        m = _TAG.match(self.src, at)
        if m[1] or not self.value_next() or (not m[2] and not self.src.startswith("<>", at)) or _TYPE_PARAMETERS.match(self.src, at):
            return False
        # without an end it is a type: <T>value
        return self.src.find(f"</{m[2] or ''}", at) >= 0 or bool(re.compile(r"<[\w$.:-]+(?:[^{}\"'<>]|\"[^\"]*\"|'[^']*'|\{[^{}]*\})*/>").match(self.src, at))

    def code(self, at: int, inner: bool) -> int:
        """Code up to the end or, if inner, past the brace that closes it."""
        src, out, open_ = self.src, self.out, []
        base = self.depth
        while at < len(src):
            c = src[at]
            if c.isspace():
                self.fresh |= c == "\n"
                at += 1
            elif src.startswith("//", at):
                end = src.find("\n", at)
                at = self.put("comment", at, len(src) if end < 0 else end)
            elif src.startswith("/*", at):
                end = src.find("*/", at + 2)
                at = self.put("comment", at, len(src) if end < 0 else end + 2)
            elif c in _STRING and (m := _STRING[c].match(src, at)):
                at = self.put("string", at, m.end())
            elif c == "`":
                at = self.template(at + 1)
            elif m := _WORD.match(src, at):
                at = self.put("word", at, m.end())
            elif c == "/" and self.value_next() and (m := _REGEX.match(src, at)):
                at = self.put("regex", at, m.end())
            elif c == "<" and self.is_element(at):
                at = self.element(at)
            elif c in "([{":
                open_.append(len(out))
                at = self.put("sign", at, at + 1)
                self.depth += 1
            elif c in ")]}":
                if c == "}" and inner and not any(out[o].text == "{" for o in open_):
                    return at + 1
                while open_ and out[open_[-1]].text != _PARTNER[c]:  # a bracket without a partner is passed over
                    open_.pop()
                if open_:
                    mine = open_.pop()
                    self.depth = out[mine].depth
                    out[mine].partner = len(out)
                    at = self.put("sign", at, at + 1)
                    out[-1].partner = mine
                else:
                    self.depth = base
                    at = self.put("sign", at, at + 1)
            else:
                at = self.put("sign", at, _SIGN.match(src, at).end())
        return at


def tokens(src: str) -> list[Token]:
    """All tokens, comments included, in order."""
    return _Scan(src).out


class _Units:
    """Units and imports of a file, statement by statement."""

    def __init__(self, src: str):
        self.src = src
        self.ends = [m.start() for m in re.finditer("\n", src)]
        self.all = tokens(src)
        self.units: list[dict] = []
        self.imports: list[str] = []
        self.code = [i for i, t in enumerate(self.all) if t.kind != "comment"]
        self.place = {i: n for n, i in enumerate(self.code)}
        n = 0
        while n < len(self.code):
            n = max(self.statement(n), n + 1)

    # n is a place among the tokens of code, t(n) the token there

    def t(self, n: int) -> Token:
        return self.all[self.code[n]] if 0 <= n < len(self.code) else Token("end", "", len(self.src), len(self.src), True, 0)

    def past(self, n: int) -> int:
        """The place after a token or, for an opening bracket, after its partner."""
        to = self.t(n).partner
        return self.place[to] + 1 if to >= 0 and n < len(self.code) and to > self.code[n] else n + 1

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def doc(self, n: int) -> str | None:
        """The comment right before a token, if it is a documentation comment, without its stars."""
        i = self.code[n]
        before = self.all[i - 1] if i else None
        if before is None or before.kind != "comment" or not before.text.startswith("/**"):
            return None
        lines = (x.strip().lstrip("*").strip() for x in before.text[3:].removesuffix("*/").split("\n"))
        return "\n".join(x for x in lines if x) or None

    def add(self, kind: str, name: str, span: int, body: int, end: int) -> None:
        """A unit from token `span` whose body begins at token `body` and ends before place `end`."""
        stop = self.t(end - 1).end
        self.units.append({"unit_type": kind, "name": name, "line_start": self.line(self.t(span).start), "line_end": self.line(max(stop - 1, 0)), "signature": self.src[self.t(span).start : self.t(body).start].rstrip(), "docstring": self.doc(span)})

    def next_statement(self, n: int) -> int:
        """The next place outside of all brackets where a statement may begin."""
        while n < len(self.code):
            n = self.past(n)
            a, b = self.t(n - 1), self.t(n)
            if b.depth == 0 and b.kind == "word" and b.text in _STARTS and (a.text in (";", "}") or b.fresh) and not (a.kind == "sign" and a.text not in (";", "}", ")", "]", "++", "--")):
                return n
        return n

    def statement(self, n: int) -> int:
        start = self.t(n)
        if start.text == "import" and self.t(n + 1).text not in ("(", "."):
            m = n + 1
            while m < len(self.code) and self.t(m).kind != "string" and self.t(m).text != ";" and not (self.t(m).fresh and self.t(m).text in _STARTS and self.t(m).depth == 0 and self.t(m - 1).text != ","):
                m = self.past(m)
            if self.t(m).kind == "string":
                self.imports.append(self.t(m).text[1:-1])
                return m + 1
            return m
        if start.text == "export":
            m = n + 1 + (self.t(n + 1).text == "default")
            return self.declaration(m, n)
        return self.declaration(n, n)

    def declaration(self, n: int, span: int) -> int:
        word, after = self.t(n), self.t(n + 1)
        if word.kind != "word":
            return self.next_statement(n)
        if word.text == "function" or (word.text == "async" and after.text == "function"):
            name = n + 1 + (word.text == "async")
            if self.t(name).kind != "word":  # a generator, or without a name
                return self.next_statement(n)
            body = self.body_after(name + 1)
            if body is None:
                return self.next_statement(name)
            self.add("function", self.t(name).text, span, body, self.past(body))
            return self.past(body)
        if word.text == "class" and after.kind == "word" and after.text not in ("extends", "implements"):
            body = self.class_body(n + 2)
            if body is None:
                return self.next_statement(n)
            self.add("class", after.text, span, body, self.past(body))
            self.methods(after.text, body)
            return self.past(body)
        if word.text in ("const", "let", "var"):
            return self.declared(n + 1, span)
        return self.next_statement(n)

    def body_after(self, n: int) -> int | None:
        """The body of a function whose type parameters or parameters begin at a place; none for a bare signature."""
        while self.t(n).text not in ("(", ""):
            n += 1
        return self.block_after_type(self.past(n)) if self.t(n).text else None

    def block_after_type(self, n: int) -> int | None:
        """The brace of a body, past a return type if there is one."""
        if self.t(n).text == "{":
            return n
        if self.t(n).text != ":":
            return None
        n = self.past_type(n + 1, ("{", ";"))
        return n if self.t(n).text == "{" else None

    def past_type(self, n: int, stops: tuple[str, ...]) -> int:
        """The place of the first of `stops` that is not part of a type; braces after a sign that wants a type are."""
        angle, wants = 0, True
        while n < len(self.code):
            t = self.t(n)
            if t.text == "<":
                angle, wants = angle + 1, True
            elif t.text == ">":
                angle, wants = max(0, angle - 1), False
            elif t.text in stops and not angle and not (wants and t.text == "{"):
                return n
            else:
                wants = t.kind == "sign" and t.text in (":", "|", "&", ",", "=>", "?", "(", "[") or t.text in ("is", "keyof", "typeof", "extends", "readonly", "asserts")
                n = self.past(n)
                continue
            n += 1
        return n

    def past_angles(self, n: int) -> int:
        """The place after the type parameters that begin at a place."""
        angle = 0
        while n < len(self.code) and self.t(n).text != ";":
            angle += (self.t(n).text == "<") - (self.t(n).text == ">")
            n = self.past(n)
            if not angle:
                break
        return n

    def class_body(self, n: int) -> int | None:
        """The brace of a class's body: the first that no type parameter or bracket holds."""
        while n < len(self.code) and self.t(n).text != "{":
            n = self.past_angles(n) if self.t(n).text == "<" else self.past(n)
        return n if self.t(n).text == "{" else None

    def methods(self, owner: str, body: int) -> None:
        n, end = body + 1, self.past(body) - 1
        while n < end:
            span = n
            while self.t(n).text == "@":  # decorators stand before a method
                n += 2
                while self.t(n).text == ".":
                    n += 2
                n = self.past(n) if self.t(n).text == "(" else n
                span = n
            while self.t(n).text in ("static", "async", "get", "set", "public", "private", "protected", "override", "readonly", "*") and self.t(n + 1).text not in ("(", "=", ";", ":", "?", "!", "<"):
                n += 1
            name, past = n, self.past(n)
            after = past
            if self.t(after).text == "<":
                after = self.past_angles(after)
            inner = None
            if self.t(after).text == "(" and (self.t(name).kind in ("word", "string") or self.t(name).text == "["):
                inner = self.block_after_type(self.past(after))
            if inner is not None and inner < end:
                self.add("function", f"{owner}.{self.src[self.t(name).start : self.t(past - 1).end]}", span, inner, self.past(inner))
                n = self.past(inner)
            else:  # a field, a signature, a static block
                n = self.past(name)
                while n < end and self.t(n - 1).text not in (";", "}") and not (self.t(n).fresh and self.t(n - 1).text not in ("=", ",", "=>", ":", "|", "&", "(", "?")):
                    n = self.past(n)

    def declared(self, n: int, span: int) -> int:
        """The functions among the names that a declaration gives values."""
        while n < len(self.code):
            name = n
            n = self.past(n)
            if self.t(n).text in (":", "!"):
                n = self.past_type(n + 1, ("=", ",", ";"))
            if self.t(n).text != "=":
                if self.t(n).text != ",":
                    return n
                n += 1
                continue
            value = n + 1
            body = self.function_body(value)
            if body is not None and self.t(body).text == "{":
                end = self.past(body)
            else:
                end = self.expression_end(value if body is None else body)
            if body is not None:
                self.add("function", self.src[self.t(name).start : self.t(self.past(name) - 1).end], span, body, end)
            n = self.expression_end(end) if end < len(self.code) and self.t(end).text not in (",", ";") and not self.t(end).fresh else end
            if self.t(n).text != ",":
                return n
            n += 1
        return n

    def function_body(self, n: int) -> int | None:
        """Where the body of the function that a value is begins; none if it is no function, or a generator."""
        if self.t(n).text == "async" and not self.t(n + 1).fresh:
            n += 1
        if self.t(n).text == "function":
            if self.t(n + 1).text == "*":
                return None
            return self.body_after(n + 1)
        if self.t(n).text == "<":
            n = self.past_angles(n)
        if self.t(n).text == "(":
            n = self.past(n)
            if self.t(n).text == ":":
                n = self.past_type(n + 1, ("=>", ";", "="))
        elif self.t(n).kind == "word" and self.t(n + 1).text == "=>":
            n += 1
        else:
            return None
        return n + 1 if self.t(n).text == "=>" else None

    def expression_end(self, n: int) -> int:
        """The place after an expression that begins or goes on at a place."""
        depth = self.t(n).depth
        while n < len(self.code) and self.t(n).text not in (",", ";"):
            n = self.past(n)
            a, b = self.t(n - 1), self.t(n)
            if b.depth < depth or (b.fresh and not (a.kind == "sign" and a.text not in (")", "]", "}", "++", "--")) and not (b.kind == "sign" and b.text not in ("{", "@", "++", "--")) and b.text not in ("in", "of", "instanceof", "as", "satisfies") and b.kind not in ("template", "text")):
                return n
        return n

    def requires(self) -> list[str]:
        """Arguments of require(...) anywhere, where exactly one of them is a string."""
        out = []
        for n in range(len(self.code)):
            if self.t(n).text == "require" and self.t(n).kind == "word" and self.t(n + 1).text == "(" and self.t(n - 1).text not in (".", "?.", "function"):
                m, end, strings = n + 2, self.past(n + 1) - 1, []
                while m < end:
                    alone = self.t(m - 1).text in ("(", ",") and self.t(m + 1).text in (")", ",")
                    strings += [self.t(m).text[1:-1]] if self.t(m).kind == "string" and alone else []
                    m = self.past(m)
                out += strings if len(strings) == 1 else []
        return out


def parse(src: str) -> tuple[list[dict], list[str]]:
    """The units of a file below the module, and what it imports: first the import statements, then what it requires, in order."""
    found = _Units(src)
    return found.units, [*found.imports, *found.requires()]
