"""Go bodies as rows: what gives a name a value, where names are used, and the calls, with what is said of their arguments.

A row says only what stands in the text, and where: places are numbers of tokens in the body. An event is a declaration, an assignment or the taking of an
address; it says from where to where the name is seen, which block runs it as a whole, and what the value shows of itself: a declared type, a literal of a
type, new, names that are read or called, or a sum of literals and names. Which event a use meets is found by joins (operators/gocalls).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from factgraph.sources.golang import _KEYWORDS, _PAIRS, Function, GoFile, Token, _closing

_ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=", "++", "--"}


def split(run: list[Token], sign: str = ",") -> list[list[Token]]:
    """Parts between signs outside brackets; an empty run has none, and a closing sign ends no part."""
    parts, depth = [[]], 0
    for t in run:
        if t.kind == "sign" and t.text in "([{":
            depth += 1
        elif t.kind == "sign" and t.text in _PAIRS:
            depth -= 1
        if depth == 0 and t.text == sign and t.kind in ("sign", "semicolon"):
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def is_name(t: Token) -> bool:
    return t.kind == "name" and t.text not in _KEYWORDS


def type_text(run: list[Token]) -> str:
    """A type as one word, such as *sql.DB; func for any function, nothing for what is neither a name nor a pointer to one."""
    if run and run[0].text == "func":
        return "func"
    words = [t.text for t in run]
    stars = 1 if words[:1] == ["*"] else 0
    plain = words[stars:]
    fits = len(plain) in (1, 3) and is_name(run[stars]) and (len(plain) == 1 or plain[1] == "." and is_name(run[stars + 2]))
    return "".join(words) if fits else ""


def chain(run: list[Token]) -> list[str] | None:
    """Names joined by dots, or None."""
    ok = len(run) % 2 == 1 and all(is_name(t) if i % 2 == 0 else t.text == "." for i, t in enumerate(run))
    return [t.text for t in run[::2]] if ok else None


def unquoted(t: Token) -> str | None:
    if t.text[0] == "`":
        return t.text[1:-1].replace("\r", "")
    try:
        return ast.literal_eval(t.text) if t.text[0] == '"' else None
    except (SyntaxError, ValueError):
        return None


def parts(run: list[Token]) -> list[dict] | None:
    """An expression as a sum of string literals and names, each with its lines; None for any other."""
    while len(run) > 2 and run[0].text == "(" and _closing(run, 0) == len(run) - 1:
        run = run[1:-1]
    out: list[dict] = []
    for term in split(run, "+"):
        if len(term) > 2 and term[0].text == "(":
            inner = parts(term)
            if inner is None:
                return None
            out += inner
        elif len(term) == 1 and term[0].kind == "string" and (text := unquoted(term[0])) is not None:
            out.append({"text": text, "line": term[0].line, "last": term[0].last_line})
        elif len(term) == 1 and is_name(term[0]):
            out.append({"name": term[0].text, "line": term[0].line, "last": term[0].last_line, "at": term[0].at})
        else:
            return None
    return out if out and len(out) - 1 == sum(t.text == "+" for t in run) else None


def shown_type(run: list[Token]) -> str:
    """What an expression shows of its type: a type's word, or call or read with the names of what is called or read."""
    if chain(run):
        return "read " + ".".join(chain(run))
    if len(run) > 2 and run[-1].text == "}":
        opened = next((i for i in range(len(run)) if run[i].text == "{" and _closing(run, i) == len(run) - 1), 0)
        head = run[:opened]
        return "*" + type_text(head[1:]) if head and head[0].text == "&" and type_text(head[1:]) else type_text(head)
    if len(run) > 2 and run[-1].text == ")":
        opened = next((i for i in range(len(run)) if run[i].text == "(" and _closing(run, i) == len(run) - 1), 0)
        called = chain(run[:opened])
        if called == ["new"]:
            inner = type_text(run[opened + 1 : -1])
            return "*" + inner if inner else ""
        return "call " + ".".join(called) if called else ""
    return ""


def parameters(run: list[Token]) -> list[tuple[str, str]]:
    """(name or '', type) of a parameter list; names that share a type come first."""
    found = []
    listed = split(run)
    named = any(len(p) > 1 and is_name(p[0]) and p[1].text not in (".", "[") for p in listed)
    waiting: list[str] = []
    for p in listed:
        if named and len(p) == 1:
            waiting.append(p[0].text)
        elif named:
            found += [(n, type_text(p[1:])) for n in (*waiting, p[0].text)]
            waiting = []
        else:
            found.append(("", type_text(p)))
    return found


def signature(f: Function) -> tuple[list[tuple[str, str]], list[str], list[Token], bool]:
    """Parameters with the receiver first, result types, the body, and whether the function has type parameters."""
    run, at, own = f.run, 1, []
    generic = False
    if run[at].text == "(":
        end = _closing(run, at)
        inside = run[at + 1 : end]
        generic = any(t.text == "[" for t in inside)
        own = [(inside[0].text, f.receiver)] if len(inside) > 1 and is_name(inside[0]) and is_name(inside[1]) or len(inside) > 2 and inside[1].text == "*" else []
        at = end + 1
    at += 1
    if at < len(run) and run[at].text == "[":
        generic, at = True, _closing(run, at) + 1
    end = _closing(run, at)
    own += parameters(run[at + 1 : end])
    rest = run[end + 1 :]
    if rest and rest[0].text == "(":
        close = _closing(rest, 0)
        named, rest = parameters(rest[1:close]), rest[close + 1 :]
        return own + [(n, t) for n, t in named if n], [t for _, t in named], rest, generic
    opened = next((i for i in range(len(rest)) if rest[i].text == "{" and _closing(rest, i) == len(rest) - 1), len(rest))
    return own, [type_text(rest[:opened])] if opened else [], rest[opened:], generic


def signature_params(f: Function) -> list[str]:
    """The types of the parameters, without the receiver."""
    at = 1 if f.run[1].text != "(" else _closing(f.run, 1) + 1
    at += 1
    at = _closing(f.run, at) + 1 if f.run[at].text == "[" else at
    return [t for _, t in parameters(f.run[at + 1 : _closing(f.run, at)])]


ALWAYS = 1 << 30


@dataclass(frozen=True)
class Place:
    """Where a run of statements stands: until where its names are seen, which block runs as a whole, what may run again, and in which function literal."""

    until: int
    block: tuple[int, int]
    later: tuple[tuple[int, int, int], ...] = ()
    closure: int | None = None


@dataclass
class Flow:
    """The events and uses of a body. later holds what may bring a later event to an earlier use: (since, first, last), meaning that events between first
    and last count where what the use would see otherwise came before since."""

    body: list[Token]
    events: list[dict] = field(default_factory=list)
    uses: list[tuple[Token, Place]] = field(default_factory=list)
    jumps: bool = False

    def __post_init__(self) -> None:
        self.body = [replace(t, at=i) for i, t in enumerate(self.body)]
        self.close, open_ = {}, []
        for i, t in enumerate(self.body):
            if t.kind == "sign" and t.text in "([{":
                open_.append(i)
            elif t.kind == "sign" and t.text in _PAIRS and open_:
                self.close[open_.pop()] = i
        self.seen: dict[int, set[str]] = {}

    def event(self, name: str, at: int, place: Place, declares: bool, shown: str = "", parts_: list[dict] | None = None, nth: int = 0, opaque: bool = False, first: int | None = None) -> None:
        if name == "_":
            return
        known = self.seen.setdefault(place.until, set())
        declares = declares and name not in known
        if declares:
            known.add(name)
        self.events.append({"name": name, "at": at, "until": place.until, "from": place.block[0], "to": place.block[1], "closure": place.closure, "declares": declares, "type": shown, "parts": parts_, "nth": nth, "opaque": opaque, "first": first})

    def given(self, name: str, run: list[Token], at: int, place: Place, declares: bool, nth: int = 0, alone: bool = True) -> None:
        """The value of an expression; the nth result of a call that gives several."""
        shown = shown_type(run) if run else ""
        self.event(name, at, place, declares, shown if alone or shown.startswith("call ") else "", parts(run) if run and alone else None, nth, first=run[0].at if shown.startswith(("call ", "read ")) else None)

    def opening(self, at: int, end: int) -> int:
        """The first brace from at that opens a block; in a head, only literals of a slice's or map's type have braces of their own."""
        while at < end:
            k = at - 1
            while self.body[k].kind == "name" or self.body[k].text in (".", "*"):
                k -= 1
            literal = self.body[k].text == "]" and k + 1 < at and self.body[k + 1].text != "."
            if self.body[at].text == "{" and not literal and self.body[at - 1].text not in ("struct", "interface"):
                break
            at = self.close.get(at, at) + 1
        return at

    def scan(self, a: int, b: int, place: Place) -> None:
        i = a
        while i < b:
            t = self.body[i]
            word = t.text if t.kind == "name" else ""
            if word in ("if", "for", "switch", "select"):
                i = self.controlled(i, b, word, place)
                continue
            if word == "func" and i + 1 < b and self.body[i + 1].text == "(":
                end = self.close.get(i + 1, b)
                start = end + 1
                while start < b and self.body[start].text not in ("{", ";", ",", ")", "=", ":=", "}"):
                    start = self.close.get(start, start) + 1
                if start < b and self.body[start].text == "{":
                    close = self.close[start]
                    inner = Place(close, (start, close), (*place.later, (i, i, ALWAYS)), i)
                    for name, shown in parameters(self.body[i + 2 : end]):
                        if name:
                            self.event(name, i, inner, True, shown)
                    self.scan(start + 1, close, inner)
                    i = close + 1
                    continue
            if t.text == "{" and (i == a or self.body[i - 1].kind == "semicolon" or self.body[i - 1].text in ("{", "}", ";", ":")) and self.body[i - 1].text != ":=" and (i == a or self.body[i - 1].text != ":" or place.block[0] == i):
                close = self.close[i]
                self.scan(i + 1, close, replace(place, until=close))
                i = close + 1
                continue
            self.one(i, a, b, place)
            if is_name(t) and (i == 0 or self.body[i - 1].text != "."):
                self.uses.append((t, place))
            i += 1

    def one(self, i: int, a: int, b: int, place: Place) -> None:
        """What a single token does to names."""
        body, t = self.body, self.body[i]
        if t.text == "goto" and t.kind == "name":
            self.jumps = True
        elif t.text == "&" and i + 1 < b and is_name(body[i + 1]) and (i == 0 or body[i - 1].text in ("(", ",", "=", ":=", "return", "{", ":")) and (i + 2 >= b or body[i + 2].text not in ("{", ".")):
            self.event(body[i + 1].text, i, place, False, opaque=True)
        elif t.kind == "name" and t.text in ("var", "const", "type") and i + 1 < b:
            listed = body[i + 2 : self.close[i + 1]] if body[i + 1].text == "(" else statement(body[:b], i + 1)
            for spec in split(listed, ";"):
                at = next((k for k, x in enumerate(spec) if x.text == "="), len(spec))
                left, right = split(spec[:at]), split(spec[at + 1 :])
                declared = type_text(left[-1][1:]) if left else ""
                for k, p in enumerate(left):
                    value = right[k] if len(right) == len(left) else right[0] if len(right) == 1 else []
                    if not is_name(p[0]):
                        continue
                    if t.text == "var" and not declared and len(left[-1]) == 1:
                        self.given(p[0].text, value, spec[-1].at, place, True, k, len(right) == len(left))
                    else:
                        self.event(p[0].text, spec[-1].at, place, True, declared if t.text == "var" else "", parts(value) if value and len(right) == len(left) and t.text != "type" else None)
        elif t.text in _ASSIGNS or t.text == ":=":
            back = i
            while back > a and not (body[back - 1].kind == "semicolon" or body[back - 1].text in ("{", "}", ";", "case", "range", ":", "go", "defer") or body[back - 1].text == "(" and self.close.get(back - 1, 0) > i):
                back -= 1
            left, run = split(body[back:i]), statement(body[:b], i + 1)
            right = split(run) if t.text in ("=", ":=") else []
            for k, p in enumerate(left):
                if len(p) == 1 and is_name(p[0]):
                    value = right[k] if len(right) == len(left) else right[0] if len(right) == 1 else []
                    self.given(p[0].text, value, run[-1].at if run else i, place, t.text == ":=", k, len(right) == len(left))

    def controlled(self, i: int, b: int, word: str, place: Place) -> int:
        """An if, for, switch or select: its head's names are seen to its end, its blocks run or do not; the place after it."""
        body = self.body
        start = self.opening(i + 1, b)
        if start >= b:
            return i + 1
        close = self.close[start]
        end = close + 1
        while word == "if" and end + 1 < b and body[end].text == "else":
            end = self.close.get(self.opening(end + 1, b), b) + 1
        again = (*place.later, (i, i, end)) if word == "for" else place.later
        head = replace(place, until=end, later=again, block=(i, end) if word == "for" else place.block)
        self.scan(i + 1, start, head)
        if word in ("switch", "select"):
            at = start + 1
            while at < close:
                colon = at + 1
                while colon < close and body[colon].text != ":":
                    colon = self.close.get(colon, colon) + 1
                following = colon + 1
                while following < close and not (body[following].kind == "name" and body[following].text in ("case", "default")):
                    following = self.close.get(following, following) + 1
                own = replace(head, until=following, block=(at, following))
                self.scan(at + 1, colon, own)
                self.scan(colon + 1, following, own)
                at = following
            return end
        self.scan(start + 1, close, replace(head, until=close, block=(start, close)))
        at = close + 1
        while at < end:  # else
            if at + 1 < end and body[at + 1].text == "if":
                self.scan(at + 1, end, replace(head, block=(at, end)))
                return end
            self.scan(at + 2, self.close[at + 1], replace(head, until=self.close[at + 1], block=(at + 1, self.close[at + 1])))
            at = self.close[at + 1] + 1
        return end


def flow(own: list[tuple[str, str]], body: list[Token]) -> Flow:
    """The events of a body, those of parameters and named results first, and the uses of the names that it declares."""
    found = Flow(body)
    outer = Place(len(body), (-1, len(body) + 1))
    for n, shown in own:
        if n:
            found.event(n, -1, outer, True, shown)
    found.scan(1, len(body) - 1, outer)
    names = {e["name"] for e in found.events if e["declares"]}
    found.uses = [(t, p) for t, p in found.uses if t.text in names]
    return found


def statement(body: list[Token], at: int) -> list[Token]:
    """The tokens from at to the end of their statement, or to the block that follows it."""
    depth, end = 0, at
    while end < len(body):
        t = body[end]
        if depth == 0 and (t.kind == "semicolon" or t.text == ";" or t.kind == "sign" and t.text in _PAIRS):
            break
        if depth == 0 and t.text == "{" and end > at and body[end - 1].kind != "name" and body[end - 1].text not in (".", "]", "struct", "interface"):
            break
        depth += (t.kind == "sign" and t.text in "([{") - (t.kind == "sign" and t.text in _PAIRS)
        end += 1
    return body[at:end]


def specified(spec: list[Token]) -> list[tuple[str, str]]:
    """(name, what is shown of its type) of a var, const or type specification."""
    at = next((i for i, t in enumerate(spec) if t.text == "="), len(spec))
    left, right = split(spec[:at]), split(spec[at + 1 :])
    if not left or not is_name(left[0][0]):
        return []
    declared = type_text(left[-1][1:])
    listed = [p[0].text for p in left]
    if declared or len(left[-1]) > 1:
        return [(n, declared) for n in listed]
    return [(n, shown_type(right[k]) if len(right) == len(listed) else shown_type(right[0]) if len(right) == 1 and shown_type(right[0]).startswith("call ") else "") for k, n in enumerate(listed)]


def calls(body: list[Token]) -> Iterator[dict]:
    """Each call: what is called as a chain of names or None, its lines, and its arguments."""
    for i, t in enumerate(body):
        if t.text != "(" or t.kind != "sign" or i == 0 or not (is_name(body[i - 1]) or body[i - 1].text in (")", "]", "}")):
            continue
        if body[i - 1].text == "}" and (body[i - 1].line != t.line or body[i - 1].kind != "sign"):
            continue
        start = i - 1
        while start >= 2 and body[start - 1].text == "." and is_name(body[start - 2]) and is_name(body[start]):
            start -= 2
        called = chain(body[start:i]) if is_name(body[i - 1]) else None
        if called and start >= 1 and body[start - 1].text in (".", "func"):
            called = None if body[start - 1].text == "." else called
            if body[start - 1].text == "func":
                continue
        end = _closing(body, i)
        args = [{"parts": parts(a), "chain": argument(a), "first": first_name(a), "line": a[0].line, "last": a[-1].last_line} for a in split(body[i + 1 : end])]
        yield {"chain": called, "tail": body[i - 1].text if is_name(body[i - 1]) else "", "line": body[start].line, "last": body[end].last_line if end < len(body) else t.last_line, "at": start, "args": args}


def first_name(run: list[Token]) -> int | None:
    """Where the names of what is passed on begin."""
    if not run or argument(run) is None or argument(run)[0] == "{}":
        return None
    if argument(run)[0] == "()":
        return run[next(i for i in range(len(run)) if run[i].text == "(" and _closing(run, i) == len(run) - 1) + 1].at
    return run[1 if run[0].text == "&" else 0].at


def argument(run: list[Token]) -> list[str] | None:
    """The names of what is passed on: of a function, of a variable by value or address, or of what http.HandlerFunc wraps."""
    called = chain(run[1:] if run and run[0].text == "&" else run)
    if called:
        return called
    if len(run) > 2 and run[-1].text == ")":
        opened = next((i for i in range(len(run)) if run[i].text == "(" and _closing(run, i) == len(run) - 1), 0)
        inner = chain(run[opened + 1 : -1])
        if inner and chain(run[:opened]) and run[opened - 1].text == "HandlerFunc":
            return ["()", *chain(run[:opened]), *inner]
    shown = shown_type(run)
    return ["{}", shown] if shown and not shown.startswith("call ") else None


def globals_of(file: GoFile) -> Iterator[tuple[str, str, dict]]:
    """(kind, name, detail) of each type, variable and constant at the top level; constants repeat the last expression of their block."""
    for run in file.declared:
        block = run[2:-1] if len(run) > 1 and run[1].text == "(" else run[1:]
        last: list[list[Token]] = []
        for spec in split(block, ";"):
            if not is_name(spec[0]):
                continue
            if run[0].text == "type":
                alias = 2 if len(spec) > 1 and spec[1].text == "=" else 1
                fields = {}
                if len(spec) > alias and spec[alias].text == "struct":
                    for member in split(spec[alias + 2 : -1], ";"):
                        member = [t for t in member if t.kind != "string"]
                        kind = type_text(split(member)[-1][1:]) if member else ""
                        fields |= {p[0].text: kind for p in split(member) if len(member) > 1 and is_name(p[0])} if kind else {}
                generic = alias == 1 and len(spec) > 1 and spec[1].text == "[" and len(spec) > 2 and is_name(spec[2]) and _closing(spec, 1) > 3
                lines = {"line": spec[0].line, "last": spec[-1].last_line}
                yield "type", spec[0].text, {"fields": fields, "type": type_text(spec[alias:]), "alias": alias == 2} | lines | ({"generic": True} if generic else {})
                continue
            at = next((i for i, t in enumerate(spec) if t.text == "="), len(spec))
            right = split(spec[at + 1 :]) or (last if run[0].text == "const" else [])
            last = right
            if run[0].text == "var":
                for k, (name, shown) in enumerate(specified(spec)):
                    yield "var", name, {"type": shown, "nth": k if len(split(spec[at + 1 :])) < len(split(spec[:at])) else 0}
            else:
                for k, p in enumerate(split(spec[:at])):
                    yield "const", p[0].text, {"parts": parts(right[k]) if k < len(right) else None}
