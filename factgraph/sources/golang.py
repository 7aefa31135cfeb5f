"""What Go source says, file by file: packages, imports, functions and methods with their lines, types with their fields, globals, and in bodies the names
and the calls. Nothing is resolved here: what a name or a call means takes all files of a package, and is found by joins (operators/gocalls).

The text is cut into tokens by one pattern, semicolons are put in where a line ends a statement, and declarations are cut at semicolons outside brackets.
"""

from __future__ import annotations

import posixpath
import re
import urllib.parse
from dataclasses import dataclass

from factgraph.sources.documents import DocumentError

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<string>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')
    |(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.VERBOSE | re.DOTALL,
)
_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GENERATED = re.compile(r"// Code generated .* DO NOT EDIT\.")
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    last_line: int
    at: int | None = None  # its number in a body


def tokens(text: str) -> tuple[list[Token], list[Token]]:
    """The text's tokens, with the semicolons that line ends stand for, and its comments; DocumentError for what is no Go token."""
    out: list[Token] = []
    comments: list[Token] = []
    at, line = 0, 1

    def end_line() -> None:
        if out and (out[-1].kind in ("string", "number") or out[-1].text in _ENDS or out[-1].kind == "name" and out[-1].text not in _KEYWORDS):
            out.append(Token("semicolon", ";", out[-1].last_line, out[-1].last_line))

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DocumentError(f"no Go token at line {line}")
        at, kind, word = m.end(), m.lastgroup, m[0]
        token = Token(kind, word, line, line + word.count("\n"))
        line = token.last_line
        if kind == "newline":
            line = token.line + 1
            end_line()
        elif kind in ("line", "block"):
            comments.append(token)
            if "\n" in word:
                end_line()
        elif kind != "space":
            out.append(token)
    end_line()
    return out, comments


@dataclass
class Function:
    name: str
    receiver: str
    line: int
    last_line: int
    run: list[Token]


@dataclass
class GoFile:
    package: str
    package_line: int
    imports: list[tuple[str, str, int]]  # (name or '', path, line)
    functions: list[Function]
    constraints: list[Token]
    generated: bool
    declared: list[list[Token]]  # types, variables and constants


def declarations(listed: list[Token]) -> list[list[Token]]:
    """Runs of tokens up to each semicolon outside brackets; DocumentError where brackets don't pair."""
    done, run, open_ = [], [], []
    for t in listed:
        if t.kind == "sign" and t.text in "([{":
            open_.append(t.text)
        elif t.kind == "sign" and t.text in _PAIRS:
            if not open_ or open_.pop() != _PAIRS[t.text]:
                raise DocumentError(f"unpaired {t.text} at line {t.line}")
        if t.text == ";" and not open_:
            done += [run] if run else []
            run = []
        else:
            run.append(t)
    if open_:
        raise DocumentError(f"unclosed {open_[-1]}")
    return done + ([run] if run else [])


def _closing(run: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(run)):
        depth += (run[i].kind == "sign" and run[i].text in "([{") - (run[i].kind == "sign" and run[i].text in _PAIRS)
        if depth == 0:
            return i
    return len(run)


def _function(run: list[Token]) -> Function:
    at, receiver = 1, ""
    if len(run) > 1 and run[1].text == "(":
        end = _closing(run, 1)
        inside = [t.text for t in run[2:end] if t.text not in "()"]
        inside = inside[: inside.index("[")] if "[" in inside else inside
        names = [t for t in inside if t.isidentifier()]
        receiver = ("*" if "*" in inside else "") + (names[-1] if names else "?")
        at = end + 1
    if len(run) <= at or run[at].kind != "name" or run[at].text in _KEYWORDS:
        raise DocumentError(f"a function without a name at line {run[0].line}")
    return Function(run[at].text, receiver, run[0].line, run[-1].last_line, run)


def _imports(run: list[Token]) -> list[tuple[str, str, int]]:
    body = run[2:-1] if len(run) > 1 and run[1].text == "(" else run[1:]
    found, name = [], ""
    for t in body:
        if t.kind == "string":
            found.append((name, t.text[1:-1], t.line))
            name = ""
        elif t.text != ";":
            name = t.text
    return found


def parse(text: str) -> GoFile:
    listed, comments = tokens(text)
    runs = declarations(listed)
    if not runs or runs[0][0].text != "package" or len(runs[0]) != 2 or runs[0][1].kind != "name":
        raise DocumentError("a Go file begins with its package")
    found = GoFile(runs[0][1].text, runs[0][1].line, [], [], [c for c in comments if c.text.startswith(("//go:build ", "// +build "))], False, [])
    found.generated = any(c.kind == "line" and c.line < runs[0][0].line and _GENERATED.fullmatch(c.text.rstrip("\r")) for c in comments)
    for run in runs[1:]:
        head = run[0].text
        if head == "import":
            found.imports += _imports(run)
        elif head == "func":
            found.functions.append(_function(run))
        elif head in ("type", "var", "const"):
            found.declared.append(run)
        else:
            raise DocumentError(f"no Go declaration at line {run[0].line}")
    return found


def escaped(path: str) -> str:
    return urllib.parse.quote(path, safe="$&+=:@")


def package_key(path: str, package: str) -> str:
    return f"go_package:{escaped(posixpath.dirname(path) or '.')}:{package}"


def function_keys(path: str, file: GoFile) -> list[tuple[str, str, Function]]:
    """(key, qualified name, function): a key survives moves of lines; the line is in it only for init and for names declared again in the file."""
    seen: set[str] = set()
    out = []
    for f in file.functions:
        name = ".".join(x for x in (file.package, f.receiver, f.name) if x)
        symbol = f"{f.receiver.lstrip('*')}.{f.name}"
        key = f"go_function:{escaped(path)}:{name}"
        out.append((f"{key}:{f.line}" if f.name == "init" or symbol in seen else key, name, f))
        seen.add(symbol)
    return out
