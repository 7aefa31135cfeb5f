"""Tables that SQL text declares: one recursive pattern cuts the text into pieces, statements are rebuilt from them, and an anchored pattern reads each."""

from __future__ import annotations

import regex

# Pieces that may hold a semicolon which ends nothing. Comments nest; a quote is doubled to be itself; only ' knows backslashes; bodies are between equal tags.
_PIECES = regex.compile(
    r"""
    (?P<line> --[^\n]*\n? )
  | (?P<block> (?P<nest> /\* (?: (?!/\*|\*/). | (?&nest) )*+ (?: \*/ | \Z ) ) )
  | (?P<quoted> ' (?: \\. | '' | [^'] )*+ (?: ' | \Z ) | " (?: "" | [^"] )*+ (?: " | \Z ) | ` (?: `` | [^`] )*+ (?: ` | \Z ) | \[ (?: \]\] | [^\]] )*+ (?: \] | \Z ) )
  | (?P<body> \$ (?P<tag> [A-Za-z0-9_]* ) \$ (?: (?! \$(?P=tag)\$ ) . )*+ (?: \$(?P=tag)\$ | \Z ) )
  | (?P<end> ; )
  | (?P<other> [^-/'"`\[$;]++ | . )
    """,
    regex.VERBOSE | regex.DOTALL,
)
_EXECUTABLE = ("/*!", "/*M!", "/*m!")
_PART = r'(?:[A-Za-z_][A-Za-z0-9_$]*|"[A-Za-z_][A-Za-z0-9_$]*"|`[A-Za-z_][A-Za-z0-9_$]*`|\[[A-Za-z_][A-Za-z0-9_$]*\])'
_CREATE = regex.compile(rf"\s*CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_PART}(?:\s*\.\s*{_PART})*)\s*\(", regex.IGNORECASE | regex.ASCII)


def statements(text: str) -> list[str]:
    """The text's statements without comments and bodies; one with an executable comment is left out."""
    done, parts, known = [], [], True
    for m in _PIECES.finditer(text):
        if m.group("line") is not None:
            parts.append(" ")
        elif m.group("block") is not None:
            known = known and not m[0].startswith(_EXECUTABLE)
            parts.append(" ")
        elif m.group("body") is not None:
            parts.append("''")
        elif m.group("end") is not None:
            done += ["".join(parts)] if known else []
            parts, known = [], True
        else:
            parts.append(m[0])
    return done + (["".join(parts)] if known else [])


def tables(text: str) -> list[tuple[str, str, str]]:
    """(name, canonical name, locator) of each table declared with its columns, in order; plain CREATE TABLE only, not AS SELECT or OR REPLACE."""
    found = []
    for statement in statements(text):
        if m := _CREATE.match(statement):
            parts = [p.strip().strip('`"[]') for p in m[1].split(".")]
            found.append((parts[-1], ".".join(parts), f"CREATE TABLE {m[1].strip()}"))
    return found
