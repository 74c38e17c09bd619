"""Comments, literals and blanked code of a source text, for Go, Java, Python, TypeScript and JavaScript."""

from __future__ import annotations

import re
from dataclasses import dataclass

_STR = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'

TOKENS = {
    "python": re.compile(r"#[^\n]*|(?:\b[rRuUbBfFtT]{1,2})?(?:" + _TRIPLE + r"|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _STR + ")", re.S),
    "go": re.compile(_C + r"|`[^`]*(?:`|\Z)|" + _STR, re.S),
    "java": re.compile(_C + "|" + _TRIPLE + "|" + _STR, re.S),
    # A slash opens a regular expression only where a value may begin.
    "script": re.compile(_C + r"|`(?:\\.|[^`\\])*(?:`|\Z)|" + _STR + r"|(?<=[=(,:;!&|?{}\[+])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S),
}

#: File endings. Fixed values.
LANGUAGE_OF = {"py": "python", "pyi": "python", "go": "go", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}


def language_of(file: str | None, language: str | None) -> str | None:
    """By the file's ending, else as recorded; None where neither says."""
    by_name = LANGUAGE_OF.get((file or "").rsplit(".", 1)[-1].lower()) if file and "." in file else None
    return by_name or ((language or "").strip().lower() or None)


def normalise(content: str) -> str:
    """Without byte order mark; every line end is one newline, so line numbers stay."""
    return content.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")


@dataclass(slots=True)
class Token:
    kind: str  # line, block, doc, string
    start: int
    end: int


def scan(text: str, language: str) -> tuple[list[Token], str]:
    """Comments and literals in order, and the text with them blanked (line breaks and length stay)."""
    rx = TOKENS["script" if language in ("typescript", "javascript") else language]
    tokens, parts, at = [], [], 0
    for m in rx.finditer(text):
        s, e = m.span()
        body = m.group()
        if body.startswith(("//", "#")) and (language == "python") == (body[0] == "#"):
            kind = "line"
        elif body.startswith("/*") and language != "python":
            kind = "doc" if body.startswith("/**") and len(body) > 4 else "block"
        else:
            kind = "string"
        tokens.append(Token(kind, s, e))
        parts.append(text[at:s])
        parts.append(" " * (e - s) if "\n" not in body else re.sub(r"[^\n]", " ", body))
        at = e
    parts.append(text[at:])
    return tokens, "".join(parts)
