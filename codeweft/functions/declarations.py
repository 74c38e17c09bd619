"""Where functions are declared in Go, Java, Python, TypeScript and JavaScript code whose comments and literals are blanked."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(slots=True)
class Function:
    name: str
    at: int  # offset of the declared name
    start: int  # offset of the declaration, annotations left out
    head: int  # offset where it may begin at the earliest: end of the statement before
    end: int  # offset after the signature
    params: tuple[str, ...] = ()


_BRACKET = re.compile(r"[()\[\]{}]")


def close_of(code: str, at: int) -> int:
    """Offset of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m.group() in "([{" else -1
        if depth <= 0:
            return m.start()
    return len(code)


def _param_names(inside: str, language: str) -> tuple[str, ...]:
    names, depth, part = [], 0, ""
    for ch in inside + ",":
        if ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth -= 1
        if ch == "," and depth <= 0:
            words = re.findall(r"[A-Za-z_$][\w$]*", re.split(r"[=:]", part)[0] if language != "java" else part)
            if words:
                names.append(words[-1] if language == "java" else words[0])
            part = ""
        else:
            part += ch
    return tuple(names)


_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)", re.M)
_GO_FUNC = re.compile(r"^[ \t]*func[ \t]*(?:\([^)]*\)[ \t]*)?([^\W\d]\w*)[ \t]*(?=[\[(])", re.M)


def _python(code: str) -> Iterator[Function]:
    for m in _PY_DEF.finditer(code):
        at = m.end()
        while at < len(code) and code[at] not in "([:\n":
            at += 1
        inside = ""
        while at < len(code) and code[at] in "([":
            close = close_of(code, at)
            inside = code[at + 1 : close] if code[at] == "(" else inside
            at = close + 1
            while at < len(code) and code[at] in " \t":
                at += 1
        depth = 0
        while at < len(code) and (code[at] != ":" or depth):
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(code[at], 0)
            at += 1
        yield Function(m.group(1), m.start(1), m.start() + len(m.group()) - len(m.group().lstrip()), m.start(), min(at + 1, len(code)), _param_names(inside, "python"))


def _go(code: str) -> Iterator[Function]:
    for m in _GO_FUNC.finditer(code):
        at, inside = m.end(), ""
        while at < len(code) and code[at] in "[(":
            close = close_of(code, at)
            inside, last = code[at + 1 : close], code[at]
            at = close + 1
            if last == "(":
                break
        yield Function(m.group(1), m.start(1), m.start() + len(m.group()) - len(m.group().lstrip()), m.start(), at, _param_names(inside, "go"))


_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "new", "throw", "else", "do", "try", "synchronized", "with", "super", "this", "await", "typeof", "assert", "yield", "case", "delete", "in", "of", "instanceof", "void"}
_TYPE = re.compile(r"(?:^|[^\w.@])(?:class|interface|enum|record|@interface|namespace|module)\s+[\w$]+")
_ANONYMOUS = re.compile(r"\bnew\s+[\w.<>,\s]+\([^{}]*\)\s*$")
_SCRIPT_FUNCTION = re.compile(r"((?:\b(?:export|default|async|declare)\s+)*)\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?=[<(])")
_ASSIGNED = re.compile(
    r"((?:\bexport\s+)?\b(?:const|let|var)\s+|(?<![\w$.])(?:module\s*\.\s*)?exports\s*\.\s*)([A-Za-z_$][\w$]*)\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=(?![=>])\s*"
    r"(?:async\b\s*)?(?:function\b\s*\*?\s*[\w$]*\s*\(|(?:<[^>]*>\s*)?\(|[A-Za-z_$][\w$]*\s*=>)"
)
_PROPERTY_ARROW = re.compile(r"((?:\b(?:public|private|protected|static|readonly|override)\s+)*)([A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=(?!=)\s*(?:async\b\s*)?(?:\([^;]*\)\s*(?::[^=;]*)?|[A-Za-z_$][\w$]*\s*)=>\s*$")
_CALLABLE = re.compile(r"#?([A-Za-z_$][\w$]*)\s*(<[^()]*>\s*)?\(")
_MODIFIERS = re.compile(r"(?:(?:\b(?:public|private|protected|static|async|readonly|abstract|override|get|set|final|synchronized|native|default|strictfp|declare)\b|\*)\s*)+$")
_STRUCTURE = re.compile(r"[{}();\[\]]")


def _assigned_function(head: str, m: re.Match, braced: bool) -> bool:
    """Whether what is assigned is a function: the keyword, or an arrow after the parameters."""
    if "function" in m.group()[m.end(2) - m.start() :] or m.group().endswith("=>"):
        return True
    at = m.end() - 1
    rest = head[close_of(head, at) + 1 :].lstrip()
    return rest.startswith("=>") or (rest.startswith(":") and "=>" in rest)


def _in_head(head: str, base: int, context: str, language: str, braced: bool) -> Function | None:
    """The function a statement declares, if it declares one. ``head`` is its text up to the brace or semicolon."""
    if language != "java":
        found = None
        for m in _SCRIPT_FUNCTION.finditer(head):
            found = (m, m.start(1) if m.group(1) else m.start())
        # only a declaration whose parameters end the statement's head opens this brace
        if found and (braced or context != "class"):
            m, start = found
            open_at = head.find("(", m.end())
            if open_at >= 0:
                return Function(m.group(2), base + m.start(2), base + start, base, base + close_of(head, open_at) + 1, _param_names(head[open_at + 1 : close_of(head, open_at)], language))
        last = None
        for m in _ASSIGNED.finditer(head):
            if _assigned_function(head, m, braced):
                last = m
        if last:
            open_at = head.find("(", last.end(2))
            inside = head[open_at + 1 : close_of(head, open_at)] if open_at >= 0 else ""
            return Function(last.group(2), base + last.start(2), base + last.start(), base, base + len(head), _param_names(inside, language))
        if context == "class" and (m := _PROPERTY_ARROW.search(head)):
            return Function(m.group(2), base + m.start(2), base + m.start(), base, base + len(head))
    if context != "class":
        return None
    at = 0
    while m := _CALLABLE.search(head, at):
        open_at = m.end() - 1
        close = close_of(head, open_at)
        before = head[: m.start()].rstrip()
        if before.endswith(("@", ".")):
            at = close + 1
            continue
        rest = head[close + 1 :].strip()
        if m.group(1) in _NOT_NAMES or "=" in re.sub(r"@[\w.]+\s*\([^()]*\)", "", before):
            return None
        if language == "java":
            typed = re.search(r"[\w$>\]]\s*$", _MODIFIERS.sub("", before + " ").rstrip()) and re.search(r"[\w$\]>]$", before)
            bare = re.sub(r"@[\w.]+(\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?", " ", before)
            if not typed or not _MODIFIERS.sub("", bare.strip() + " ").strip() or re.search(r"\b(return|new|throw|else)\s*$", bare) or not re.fullmatch(r"(throws\b[^;{]*|default\b.*)?", rest, re.S):
                return None
            start = len(head) - len(head.lstrip())
        else:
            if not braced and not rest.startswith(":") and rest:
                return None
            if rest and not rest.startswith(":"):
                at = close + 1
                continue
            mods = _MODIFIERS.search(head[: m.start()])
            start = mods.start() if mods else m.start()
        return Function(m.group(1), base + m.start(1), base + _after_annotations(head, start), base, base + close + 1, _param_names(head[open_at + 1 : close], language))
    return None


_ANNOTATION = re.compile(r"\s*@(?!interface\b)[\w.$]+(?:\s*(\())?")


def _after_annotations(head: str, start: int) -> int:
    at = start
    while m := _ANNOTATION.match(head, at):
        at = close_of(head, m.start(1)) + 1 if m.group(1) else m.end()
    return at + len(head[at:]) - len(head[at:].lstrip())


def _braced(code: str, language: str) -> Iterator[Function]:
    """One pass over brackets; a statement's head runs from the end of the one before to its brace or semicolon."""
    stack: list[tuple[str, int]] = []  # what a brace opened; where the head around it began if it stays open
    parens, head, contexts = 0, 0, ["file"]
    for m in _STRUCTURE.finditer(code):
        ch, at = m.group(), m.start()
        if ch in "([":
            parens += 1
            stack.append((ch, parens))
        elif ch in ")]":
            if stack and stack[-1][0] in "([":
                stack.pop()
                parens -= 1
        elif ch == ";" and not parens:
            if (f := _in_head(code[head:at], head, contexts[-1], language, False)) and (contexts[-1] == "class" or language != "java"):
                yield f
            head = at + 1
        elif ch == "{":
            if parens:
                # a body inside brackets (a callback, an object): its own statements, the outer head goes on after it
                stack.append(("p{", head))
                contexts.append("block")
                stack.append(("save", parens))
                parens = 0
            else:
                text = code[head:at]
                f = _in_head(text, head, contexts[-1], language, True)
                if f:
                    yield f
                contexts.append("function" if f else "class" if _TYPE.search(text) or _ANONYMOUS.search(text) else "block")
                stack.append(("{", 0))
            head = at + 1
        elif ch == "}":
            while stack and stack[-1][0] in "([":
                stack.pop()
            parens = 0
            if language != "java" and (f := _in_head(code[head:at], head, contexts[-1], language, False)):
                yield f
            if stack:
                kind, held = stack.pop()
                contexts.pop()
                head = at + 1
                if kind == "save":
                    parens = held
                    head = stack.pop()[1]
            else:
                head = at + 1
    if language != "java" and (f := _in_head(code[head:], head, contexts[-1], language, False)):
        yield f


def functions(code: str, language: str) -> list[Function]:
    if language == "python":
        return list(_python(code))
    if language == "go":
        return list(_go(code))
    seen: dict[int, Function] = {}
    for f in _braced(code, language):
        seen.setdefault(f.at, f)
    return sorted(seen.values(), key=lambda f: f.at)
