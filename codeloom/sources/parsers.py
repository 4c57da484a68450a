"""Per-file parsers that regular expressions over columns can't express: Python, COBOL, JCL.

Each is a mapInPandas over (path, content) that emits tagged rows, one pass per file. Files are spread over all cores
first: a table that is one split of a few MB may hold hours of parsing.
A file that can't be parsed gives a single row of kind ``error``.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, kind string, name string, owner string, startLine int, endLine int, detail string, count int"


def _rows(files: DataFrame, parse) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out.extend((path, *fact) for fact in parse(content or ""))
                except (SyntaxError, ValueError, RecursionError) as error:
                    out.append((path, "error", type(error).__name__, None, None, None, None, None))
            frame = pd.DataFrame(out, columns=["path", "kind", "name", "owner", "startLine", "endLine", "detail", "count"])
            for c in ("startLine", "endLine", "count"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return files.select("path", "content").repartition(tasks, "path").mapInPandas(run, FACTS)


def python_facts(text: str) -> list[tuple]:
    """(kind, name, owner, start, end, detail, count): definitions, imports, calls, heritage, accesses of one module."""
    out: list[tuple] = []

    def dotted(node) -> str:
        if isinstance(node, ast.Attribute):
            return f"{dotted(node.value)}.{node.attr}"
        return node.id if isinstance(node, ast.Name) else ""

    def visit(node, owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            here, cls = owner, in_class
            if isinstance(child, ast.ClassDef):
                out.append(("Class", child.name, owner, child.lineno, child.end_lineno, None, None))
                for k, base in enumerate(child.bases):
                    if name := dotted(base):
                        out.append(("heritage", name, child.name, child.lineno, child.lineno, "EXTENDS", k))
                here, cls = child.name, True
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                total = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs)
                returns = dotted(child.returns) if child.returns is not None else None
                out.append(("Method" if in_class else "Function", child.name, owner, child.lineno, child.end_lineno, returns, total - (1 if in_class else 0)))
                here, cls = f"{owner}.{child.name}" if owner else child.name, False
            elif isinstance(child, ast.Import):
                out.extend(("import", n.name, n.asname or n.name.split(".")[0], child.lineno, child.lineno, None, 0) for n in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out.extend(("import", module, n.asname or n.name, child.lineno, child.lineno, n.name, child.level) for n in child.names)
            elif isinstance(child, ast.Call):
                if name := dotted(child.func):
                    form = "member" if isinstance(child.func, ast.Attribute) else "free"
                    out.append(("call", name, owner, child.lineno, child.end_lineno, form, len(child.args) + len(child.keywords)))
            elif isinstance(child, ast.Assign) and not owner:
                out.extend(("Variable", t.id, None, child.lineno, child.end_lineno, None, None) for t in child.targets if isinstance(t, ast.Name))
            visit(child, here, cls)

    visit(ast.parse(text), None, False)
    return out


_COBOL = {
    "program": re.compile(r"^\s*PROGRAM-ID\.?\s+([A-Z0-9-]+)", re.I),
    "division": re.compile(r"^\s*([A-Z-]+)\s+DIVISION\b", re.I),
    "section": re.compile(r"^\s{0,11}([A-Z0-9-]+)\s+SECTION\s*\.", re.I),
    "paragraph": re.compile(r"^\s{0,4}([A-Z0-9][A-Z0-9-]*)\s*\.\s*$", re.I),
    "data": re.compile(r"^\s*(\d{2})\s+([A-Z0-9-]+)(?:\s+PIC(?:TURE)?\s+(?:IS\s+)?([^\s.]+))?", re.I),
    "perform": re.compile(r"\bPERFORM\s+([A-Z0-9-]+)(?:\s+(?:THRU|THROUGH)\s+([A-Z0-9-]+))?", re.I),
    "call": re.compile(r"""\bCALL\s+['"]([A-Z0-9$#@_-]+)['"]""", re.I),
    "copy": re.compile(r"""\bCOPY\s+['"]?([A-Z0-9$#@_-]+)""", re.I),
    "select": re.compile(r"\bSELECT\s+(?:OPTIONAL\s+)?([A-Z0-9-]+)\s+ASSIGN\s+(?:TO\s+)?['\"]?([A-Z0-9-]+)", re.I),
    "exec": re.compile(r"\bEXEC\s+(SQL|CICS)\s+(\w+)", re.I),
}
_LOOP_WORDS = {"UNTIL", "VARYING", "WITH", "TIMES", "TEST", "FOREVER"}


def cobol_code(line: str, free: bool) -> str:
    """The code part of a source line: comments out, columns 8-72 in fixed format."""
    if free:
        return "" if line.lstrip().startswith("*>") else line.split("*>")[0]
    if len(line) > 6 and line[6] in "*/":
        return ""
    return line[7:72] if len(line) > 7 else ""


def cobol_facts(text: str) -> list[tuple]:
    """Program, divisions, sections, paragraphs, data items, PERFORM, CALL, COPY, files and EXEC blocks of one source."""
    lines = text.splitlines()
    free = any(re.match(r"\s*>>SOURCE\s+FORMAT\s+(IS\s+)?FREE", x, re.I) for x in lines[:20]) or not any(len(x) > 7 and x[:6].strip().isdigit() or x[:7].isspace() for x in lines[:200])
    out: list[tuple] = []
    program = division = paragraph = None
    for number, raw in enumerate(lines, 1):
        code = cobol_code(raw, free)
        if not code.strip():
            continue
        if m := _COBOL["program"].match(code):
            program = m[1].upper()
            out.append(("Module", program, None, number, number, None, None))
        elif m := _COBOL["division"].match(code):
            division = m[1].upper()
            out.append(("division", division, program, number, number, None, None))
        elif m := _COBOL["section"].match(code):
            paragraph = m[1].upper()
            out.append(("Namespace", paragraph, program, number, number, division, None))
        elif division == "PROCEDURE" and (m := _COBOL["paragraph"].match(code)) and not m[1].isdigit():
            paragraph = m[1].upper()
            out.append(("Function", paragraph, program, number, number, None, None))
        elif division == "DATA" and (m := _COBOL["data"].match(code)):
            out.append(("Property", m[2].upper(), program, number, number, m[3], int(m[1])))
        for kind in ("perform", "call", "copy", "select", "exec"):
            for m in _COBOL[kind].finditer(code):
                name = m[1].upper()
                if kind == "perform" and name in _LOOP_WORDS:
                    continue
                out.append((kind, name, paragraph or program, number, number, m[2].upper() if m.lastindex and m.lastindex > 1 and m[2] else None, None))
    return out


def expand_copies(text: str, books: dict[str, str], depth: int = 10, active: frozenset = frozenset()) -> str:
    """COPY members replaced by their text, REPLACING applied, cycles and unknown members left as they are."""

    def insert(match: re.Match) -> str:
        name = match[1].upper()
        if depth == 0 or name in active or name not in books:
            return match[0]
        body = books[name]
        for old, new in re.findall(r"==\s*(.*?)\s*==\s+BY\s+==\s*(.*?)\s*==", match[2] or "", re.I | re.S):
            body = re.sub(rf"(?<![A-Z0-9-]){re.escape(old)}(?![A-Z0-9-])", lambda _, new=new: new, body, flags=re.I)
        return expand_copies(body, books, depth - 1, active | {name})

    return re.sub(r"""\bCOPY\s+['"]?([A-Z0-9$#@_-]+)['"]?(\s+REPLACING\s+.*?)?\s*\.""", insert, text, flags=re.I | re.S)


def jcl_facts(text: str) -> list[tuple]:
    """Jobs, steps with program or procedure, and datasets of one JCL member; continuation lines are joined."""
    joined: list[tuple[int, str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        if line.startswith("//*") or not line.startswith("//"):
            continue
        if joined and re.match(r"//\s+\S", line) and joined[-1][1].rstrip().endswith(","):
            joined[-1] = (joined[-1][0], joined[-1][1].rstrip() + line[2:].strip())
        else:
            joined.append((number, line))
    out: list[tuple] = []
    job = step = None
    for number, line in joined:
        m = re.match(r"//(\S*)\s+(JOB|EXEC|DD|PROC|INCLUDE|SET)\b\s*(.*)", line)
        if not m:
            continue
        name, verb, rest = m[1], m[2], m[3]
        if verb == "JOB":
            job = name
            out.append(("job", name, None, number, number, None, None))
        elif verb == "EXEC":
            step = name
            program = re.search(r"\bPGM=([A-Z0-9$#@]+)", rest)
            procedure = re.match(r"(?:PROC=)?([A-Z0-9$#@]+)", rest)
            out.append(("step", name, job, number, number, program[1] if program else procedure[1] if procedure else None, 1 if program else 0))
        elif verb == "DD":
            if dataset := re.search(r"\bDSN(?:AME)?=([A-Z0-9$#@.&()+-]+)", rest):
                disposition = re.search(r"\bDISP=\(?(\w+)", rest)
                out.append(("dataset", dataset[1], step, number, number, disposition[1] if disposition else None, None))
    return out


def parse_python(files: DataFrame) -> DataFrame:
    return _rows(files, python_facts)


def parse_cobol(files: DataFrame, copybooks: DataFrame | None = None, max_copybook_bytes: int = 64 << 20) -> DataFrame:
    """Facts of COBOL sources, copybooks (name, content) expanded. Those go to every task, so more than the bound is an error."""
    if copybooks is None:
        return _rows(files, cobol_facts)
    from pyspark.sql import functions as F

    size = copybooks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    if size > max_copybook_bytes:
        raise ValueError(f"copybooks hold {size} bytes, more than {max_copybook_bytes}; raise max_copybook_bytes or pass those in use")
    books = {r["name"].upper(): r["content"] for r in copybooks.select("name", "content").collect()}
    return _rows(files, lambda text: cobol_facts(expand_copies(text, books)))


def parse_jcl(files: DataFrame) -> DataFrame:
    return _rows(files, jcl_facts)
