"""TypeScript / JavaScript and Java sources: definitions, imports, calls and heritage by one pass over blanked code.

Strings and comments are blanked (line ends stay; what stands in ``${}`` of a template is code), brackets are matched
once, and a rule table of each language finds where declarations begin; their parameter lists and bodies are found by the
matched brackets, whatever they nest. One sweep in the order of places with a stack of open braces and declarations then
tells what stands in what, so a file costs time in proportion to its length. Rows are those of ``parsers.FACTS``. What
rules can't see (types inferred, calls through computed names) is left to the resolution passes.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .parsers import _rows

_MARK = re.compile(r"//|/\*|[\"'`{}]")
_STRING = {'"': re.compile(r'"(?:\\.|[^"\\\n])*"?', re.S), "'": re.compile(r"'(?:\\.|[^'\\\n])*'?", re.S)}
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_CALL = re.compile(r"(?<![\w$.@])(new\s+)?((?:[A-Za-z_$][\w$]*\s*\??\.\s*)*[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]|&?]{0,200}>)?\(")
#: Words that stand before a parenthesis without being called.
_NO_CALL = frozenset("if for while switch catch function return typeof super constructor await do else new synchronized try throw case in of instanceof void delete async".split())
_TYPES = r"(?:<[^<>{}()]*(?:<[^<>{}()]*>[^<>{}()]*)*>)?"
_TYPE_HEADS = {
    "typescript": re.compile(rf"\b(class|interface|enum)\s+(\w+)\s*{_TYPES}(?:\s+extends\s+([\w.,\s]+?{_TYPES}))?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{{"),
    "java": re.compile(rf"\b(class|interface|enum|record)\s+(\w+)\s*{_TYPES}(?:\s*\([^)]*\))?(?:\s+extends\s+([\w.,\s<>]+?))?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{{"),
}
#: Where a function begins, up to the parenthesis of its parameters; or an arrow behind one bare parameter.
_FUNCTIONS = {
    "typescript": [
        re.compile(rf"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*{_TYPES}\("),
        re.compile(rf"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:{_TYPES}\(|(?P<bare>[A-Za-z_$][\w$]*)\s*=>)"),
    ],
    "java": [],
}
_METHODS = {
    "typescript": re.compile(rf"(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*(?:\*\s*)?(?P<name>[\w$#]+)(?:\s*\??\s*{_TYPES}|\s*(?::[^=\n;]+)?=\s*(?P<arrow>(?:async\s*)?{_TYPES}))\(", re.M),
    "java": re.compile(rf"(?:^|(?<=[{{;}}]))[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:{_TYPES}\s*)?(?P<type>[\w.]+{_TYPES}(?:\[\])*\s+)?(?P<name>\w+)\s*\(", re.M),
}
_LABELS = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Record"}
_GENERIC = re.compile(r"(?<=\w)<[\w\s,.\[\]|&?<>]{0,300}>")
_BRACKETS, _EMPTY = re.compile(r"[()\[\]{},]"), re.compile(r"\s*\)")
_COLON, _TYPE_STOP, _ARROW, _GAP = re.compile(r"\s*:\s*"), re.compile(r"=>|[{};\n(\[]"), re.compile(r"\s*=>\s*"), re.compile(r"\s*")
_EXPRESSION, _SIGNATURE, _THROWS = re.compile(r"[(\[{]|[;,)\]}]|\n(?!\s*[.?:&|+*/=-])"), re.compile(r"[ \t]*(?:[;\n}]|\Z)"), re.compile(r"\s*throws\s+[\w.,\s]+")
_CLOSING = {")": "(", "]": "[", "}": "{"}


def _blanked(text: str) -> str:
    """The text with blanks for comments and inside of strings; templates are blank but for the code in their ``${}``."""
    out, at, holes, template = [], 0, [], False
    blank = lambda piece: re.sub(r"[^\n]", " ", piece)
    while at < len(text):
        if template:
            end = _TEMPLATE.match(text, at).end()
            opened = text.startswith("${", end)
            out.append(blank(text[at:end]) + ("  " if opened else text[end : end + 1]))
            at, template = end + (2 if opened else 1), False
            if opened:
                holes.append(0)
            continue
        m = _MARK.search(text, at)
        if not m:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        mark, at = m[0], m.end()
        if mark == "//":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
        elif mark == "/*":
            end = text.find("*/", at)
            end = len(text) if end < 0 else end + 2
        elif mark in _STRING:
            end = _STRING[mark].match(text, m.start()).end()
            out.append(mark + blank(text[at : end - 1]) + text[max(at, end - 1) : end])
            at = end
            continue
        elif mark == "`":
            out.append(mark)
            template = True
            continue
        else:
            end, inside = at, bool(holes)
            if inside and mark == "}" and holes[-1] == 0:
                holes.pop()
                template = True
            else:
                if inside:
                    holes[-1] += 1 if mark == "{" else -1
                out.append(mark)
                continue
        out.append(blank(text[m.start() : end]))
        at = end
    return "".join(out)


def _matched(code: str) -> tuple[dict[int, int], dict[int, int]]:
    """Place of each opening bracket -> place of its closing one (the end of the text if it has none), and of each
    parenthesis -> how many things stand in it."""
    plain = _GENERIC.sub(lambda m: m[0].replace(",", " "), code)
    ends, counts, stack = {}, {}, []
    for m in _BRACKETS.finditer(plain):
        sign, at = m[0], m.start()
        if sign == ",":
            if stack and stack[-1][0] == "(" and not _EMPTY.match(plain, at + 1):  # a comma before the end adds nothing
                counts[stack[-1][1]] += 1
        elif sign in "([{":
            stack.append((sign, at))
            if sign == "(":
                counts[at] = int(not _EMPTY.match(plain, at + 1))
        elif any(s == _CLOSING[sign] for s, _ in stack[-3:]):  # a bracket that was never closed ends here too
            while stack[-1][0] != _CLOSING[sign]:
                ends[stack.pop()[1]] = at
            ends[stack.pop()[1]] = at
    return ends | dict.fromkeys((at for _, at in stack), len(code)), counts


def _imports(text: str, language: str):
    if language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*)\s*;", text, re.M):
            yield m.start(1), m[1], m[2], m[2]
        return
    for m in re.finditer(r"^\s*(?:import|export)\s+(?:type\s+)?([^'\"\n;]*?)\s*\bfrom\s+['\"]([^'\"]+)['\"]", text, re.M):
        named = re.search(r"\{([^}]*)\}", m[1])
        for part in (named[1].split(",") if named else []):
            words = re.sub(r"^\s*type\s+", "", part).split()
            if words:
                yield m.start(1), m[2], words[-1], words[0]
        for star, name in re.findall(r"(?:^|,)\s*(\*\s+as\s+)?([\w$]+)\s*(?=,|$)", re.sub(r"\{[^}]*\}", "", m[1])):
            yield m.start(1), m[2], name, "*" if star else "default"
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", text):
        yield m.start(), m[2], m[1], "*"


def _result_type(code: str, at: int, ends: dict[int, int]) -> tuple[str | None, int]:
    """A type behind a parameter list (``: type``), and the place behind it: an arrow, a body or the end of the line."""
    m = _COLON.match(code, at)
    if not m:
        return None, at
    at = begin = m.end()
    while True:
        found = _TYPE_STOP.search(code, at)
        if not found:
            return code[begin:].strip() or None, len(code)
        before = code[max(begin, found.start() - 20) : found.start()].rstrip()
        if found[0] in "([" or found[0] == "{" and (not before or before[-1] in "<,|&>" and (before[-1] != ">" or before.endswith("=>"))):
            at = min(len(code), ends.get(found.start(), len(code)) + 1)  # a tuple, a function or an object as a type
            if found[0] == "(" and (arrow := _ARROW.match(code, at)):
                at = arrow.end()
            continue
        return code[begin : found.start()].strip() or None, found.start()


def _body(code: str, at: int, ends: dict[int, int], arrow: bool, known: dict[int, int]) -> int | None:
    """The end of what follows a parameter list: of a block, of an arrow's expression, or of a mere signature (None: nothing of these)."""
    lead = (_ARROW if arrow else _GAP).match(code, at)
    if not lead:
        return None
    at = lead.end()
    if code.startswith("{", at):
        return ends[at]
    if not arrow:
        return None
    passed, end = [], len(code)  # known: where an expression ends that has this bracket; each is looked for once
    while found := _EXPRESSION.search(code, at):
        place = found.start()
        if found[0] not in "([{" or place in known:
            end = known.get(place, place)
            break
        passed.append(place)
        at = ends[place] + 1
    known.update(dict.fromkeys(passed, end))
    return end


def brace_facts(text: str, language: str) -> list[tuple]:
    """(kind, name, owner, start, end, detail, count), in the order of places."""
    code = _blanked(text)
    (ends, counts), breaks = _matched(code), [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(breaks, at - 1) + 1 if at else 1
    found: list[tuple[int, tuple]] = []
    events: list[tuple] = [(m.start(), 0, m[0]) for m in re.finditer(r"[{}]", code)]  # (place, order, what, ...)
    bodies, heads, known = {}, set(), {}
    for m in _TYPE_HEADS[language].finditer(code):
        bodies[m.end() - 1] = m[2]
        found.append((m.start(), (_LABELS[m[1]], m[2], None, line(m.start()), line(ends[m.end() - 1]), None, None)))
        for kind, listed in (("EXTENDS", m[3]), ("IMPLEMENTS", m[4])):
            bases = [b.split("<")[0].strip() for b in re.sub(r"<[^<>]*>", "", listed or "").split(",")]
            found += [(m.start(), ("heritage", b, m[2], line(m.start()), line(m.start()), kind, k)) for k, b in enumerate(bases) if b]
    for number, pattern in enumerate(_FUNCTIONS[language]):
        for m in pattern.finditer(code):
            opened = m.end() - 1
            if m.groupdict().get("bare"):
                kind, after, count = None, code.index("=>", m.end("bare")), 1
            else:
                kind, after = _result_type(code, ends[opened] + 1, ends)
                count = counts[opened]
            end = _body(code, after, ends, number == 1, known)
            if end is not None:
                heads.add(m.start("name"))
                found.append((m.start(), ("Function", m["name"], None, line(m.start()), line(end), kind, count)))
                events.append((m.start(), 1, "function", end, m["name"]))
    for m in _METHODS[language].finditer(code):
        if m["name"] not in _NO_CALL - {"constructor"} and m.start("name") not in heads and (m.groupdict().get("type") or "").strip() not in ("return", "new", "throw", "else"):
            events.append((m.start("name"), 1, "method", m))
    for m in _CALL.finditer(code):
        name = re.sub(r"\s|\?", "", m[2])
        if name.split(".")[0] not in _NO_CALL - {"super"} and name != "super":
            events.append((m.start(), 2, "call", m, name))
    open_braces: list[int] = []
    holders: list[tuple[int, str]] = []  # end and name of the functions around
    for at, _, what, *rest in sorted(events, key=lambda e: e[:2]):
        while holders and holders[-1][0] < at:
            holders.pop()
        if what == "{":
            open_braces.append(at)
        elif what == "}":
            if open_braces:
                open_braces.pop()
        elif what == "function":
            holders.append((rest[0], rest[1]))
        elif what == "method" and open_braces and open_braces[-1] in bodies:  # directly in a type's braces
            m, owner = rest[0], bodies[open_braces[-1]]
            arrow, name, close = m.groupdict().get("arrow") is not None, m["name"], ends[m.end() - 1]
            kind, after = (m.groupdict().get("type") or "").strip() or None, close + 1
            if language == "typescript":
                kind, after = _result_type(code, after, ends)
            elif thrown := _THROWS.match(code, after):
                after = thrown.end()
            end = _body(code, after, ends, arrow, known)
            if end is None and (arrow or not _SIGNATURE.match(code, after)):
                continue
            end = after if end is None else end
            heads.add(at)
            holders.append((end, f"{owner}.{name}"))
            found.append((m.start(), ("Constructor" if name in ("constructor", owner) else "Method", name, owner, line(at), line(end), kind, counts[m.end() - 1])))
        elif what == "call" and rest[0].start(2) not in heads:
            m, name = rest
            form = "constructor" if m[1] else "member" if "." in name else "free"
            found.append((at, ("call", name, holders[-1][1] if holders else None, line(at), line(at), form, counts[m.end() - 1])))
    for at, module, local, exported in _imports(text, language):
        found.append((at, ("import", module, local, line(at), line(at), exported, 0)))
    return [fact for _, fact in sorted(found, key=lambda f: (f[0], f[1][0] != "Class"))]


def parse_typescript(files: DataFrame) -> DataFrame:
    """Facts of (path, content) rows in TypeScript or JavaScript."""
    return _rows(files, lambda text: brace_facts(text, "typescript"))


def parse_java(files: DataFrame) -> DataFrame:
    return _rows(files, lambda text: brace_facts(text, "java"))
