"""Extractors: source text to entity rows, batch by batch.

Every extractor gives rows of one shape: (path, entity, name, qualified_name, line_start, line_end, detail, kind, caller, body,
node_hash). entity is function, class, import, call, variable or override. Python is parsed by its own parser; other languages by a table
of patterns over text whose comments and strings are blanked, with blocks found by braces or `end`.
"""

from __future__ import annotations

import ast
import hashlib
import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import dialect

MODULE = "<module>"
#: Seconds that one file may take.
SECONDS = 10.0
#: Longest value of a variable, deepest nesting that is followed.
VALUE, DEPTH = 200, 500
COLUMNS = ("path", "entity", "name", "qualified_name", "line_start", "line_end", "detail", "kind", "caller", "body", "node_hash")
SCHEMA = "path string, entity string, name string, qualified_name string, line_start long, line_end long, detail string, kind string, caller string, body string, node_hash string"
_TYPES = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 5


@dataclass
class Rows:
    """Collects entity rows of one file."""

    path: str
    out: list[tuple] = field(default_factory=list)

    def add(self, entity: str, name: str, start: int, end: int | None = None, *, qualified: str | None = None, detail: str | None = None, kind: str | None = None, caller: str | None = None, body: str | None = None) -> None:
        mark = hashlib.sha256(body.encode()).hexdigest() if body is not None else None
        self.out.append((self.path, entity, name, qualified, start, end or start, detail, kind, caller, body, mark))


def _python(text: str, rows: Rows) -> None:
    lines = text.split("\n")

    def source(node: ast.AST) -> str:
        return ast.get_source_segment(text, node) or "\n".join(lines[node.lineno - 1 : node.end_lineno])  # type: ignore[attr-defined]

    def walk(node: ast.AST, owner: str | None, caller: str, depth: int) -> None:
        if depth > DEPTH:
            return
        for child in ast.iter_child_nodes(node):
            inner_owner, inner_caller = owner, caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                qualified = f"{owner}.{child.name}" if owner else child.name
                kind = "async" if isinstance(child, ast.AsyncFunctionDef) else None
                rows.add("function", child.name, child.lineno, child.end_lineno, qualified=qualified, detail=ast.unparse(child.args), kind=kind, body=source(child))
                inner_owner, inner_caller = None, child.name
            elif isinstance(child, ast.ClassDef):
                rows.add("class", child.name, child.lineno, child.end_lineno, detail=", ".join(map(ast.unparse, child.bases)) or None, body=source(child))
                inner_owner = child.name
            elif isinstance(child, ast.Import):
                for a in child.names:
                    rows.add("import", a.asname or a.name, child.lineno, detail=a.name, kind="import")
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    rows.add("import", a.asname or a.name, child.lineno, detail="." * child.level + (child.module or ""), kind="from")
            elif isinstance(child, ast.Call):
                target = child.func
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                if name:
                    rows.add("call", name, child.lineno, caller=caller)
            if isinstance(node, ast.Module) and isinstance(child, (ast.Assign, ast.AnnAssign)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        rows.add("variable", t.id, child.lineno, detail=(ast.unparse(child.value)[:VALUE] if child.value else None))
            walk(child, inner_owner, inner_caller, depth + 1)

    walk(ast.parse(text), None, MODULE, 0)


@dataclass(frozen=True)
class Language:
    """Patterns of a language; each names its groups name, args, bases, module as it has them."""

    functions: str
    classes: str
    imports: tuple[tuple[str, str], ...]
    variables: str | None = None
    separator: str = "."
    comment: str = r"//[^\n]*|/\*.*?\*/"
    blocks: str = "braces"
    not_calls: str = "if for while switch catch return sizeof function func fn def class new await typeof match loop guard"


_ID = r"[A-Za-z_$][\w$]*"
#: What declarations look like.
LANGUAGES = {
    "rust": Language(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>{_ID})[^(;{{]*(?P<args>\([^)]*\))", rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?P<bases>struct|enum|trait|mod|impl)\s+(?:<[^>]*>\s*)?(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_ID})", (("use", r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<module>[^;]+);"),), rf"(?m)^[ \t]*(?:pub\s+)?(?:static|const|let)\s+(?:mut\s+)?(?P<name>{_ID})[^=;]*=\s*(?P<value>[^;\n]*)", "::"),
    "go": Language(rf"(?m)^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>{_ID})(?:\[[^\]]*\])?(?P<args>\([^)]*\))", rf"(?m)^type\s+(?P<name>{_ID})\s+(?P<bases>struct|interface|\w+)", (("import", r'(?m)^import\s+(?:\w+\s+)?"(?P<module>[^"]+)"'), ("import", r'(?m)^[ \t]+(?:\w+\s+)?"(?P<module>[\w./-]+)"\s*$')), rf"(?m)^(?:var|const)\s+(?P<name>{_ID})[^=\n]*(?:=\s*(?P<value>[^\n]*))?"),
    "java": Language(rf"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?[\w<>\[\],.? ]+\s+(?P<name>{_ID})\s*(?P<args>\([^)]*\))\s*(?:throws\s+[\w., ]+)?\s*\{{", rf"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<name>{_ID})(?P<bases>[^{{;]*)", (("static", r"(?m)^import\s+static\s+(?P<module>[\w.*]+)\s*;"), ("import", r"(?m)^import\s+(?!static)(?P<module>[\w.*]+)\s*;")), rf"(?m)^[ \t]+(?:(?:public|protected|private|static|final)\s+)+[\w<>\[\],.]+\s+(?P<name>{_ID})\s*(?:=\s*(?P<value>[^;]*))?;"),
    "javascript": Language(rf"(?m)(?:\bfunction\s*\*?\s*(?P<name>{_ID})\s*|\b(?:const|let|var)\s+(?P<name2>{_ID})\s*=\s*(?:async\s*)?(?:function\s*)?(?=\([^)]*\)\s*(?:=>|\{{))|^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*(?P<name3>(?!(?:if|for|while|switch|catch|function|return)\b){_ID})\s*(?=\([^)]*\)\s*\{{))(?P<args>\([^)]*\))", rf"(?m)\bclass\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>[\w.$]+))?", (("from", r"""(?m)^\s*import\s+[^'"]*from\s+['"](?P<module>[^'"]+)['"]"""), ("import", r"""(?m)^\s*import\s+['"](?P<module>[^'"]+)['"]"""), ("import", r"""\brequire\(\s*['"](?P<module>[^'"]+)['"]\s*\)""")), rf"(?m)^(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?P<value>[^\n;]*)"),
    "php": Language(rf"(?m)\bfunction\s+&?\s*(?P<name>{_ID})\s*(?P<args>\([^)]*\))", rf"(?m)^[ \t]*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(?P<name>{_ID})(?P<bases>[^{{]*)", (("use", r"(?m)^\s*use\s+(?P<module>[\w\\]+)[^;]*;"), ("require", r"""\brequire(?:_once)?\s*\(?\s*['"](?P<module>[^'"]+)['"]"""), ("include", r"""\binclude(?:_once)?\s*\(?\s*['"](?P<module>[^'"]+)['"]""")), rf"(?m)^\s*\$(?P<name>{_ID})\s*=\s*(?P<value>[^;\n]*)", "::", r"//[^\n]*|#[^\n]*|/\*.*?\*/"),
    "c": Language(rf"(?m)^(?!\s*(?:if|for|while|switch|return|else)\b)[\w*&:<>,~ \t]+?[\s*&](?:(?P<owner>{_ID})::)?(?P<name>~?{_ID})\s*(?P<args>\([^;{{)]*\))\s*(?:const\s*)?(?:noexcept\s*)?\{{", rf"(?m)^[ \t]*(?:typedef\s+)?(?:struct|union|enum|class)(?:\s+class)?\s+(?P<name>{_ID})(?:\s*:\s*(?P<bases>[^{{;]+))?\s*\{{", (("include", r"""(?m)^\s*#\s*include\s+[<"](?P<module>[^>"]+)[>"]"""),), None, "::"),
    "csharp": Language(rf"(?m)^[ \t]*(?:(?:public|protected|private|internal|static|virtual|override|abstract|async|sealed|partial)\s+)*[\w<>\[\],.?]*\s*(?<![.\w])(?P<name>~?(?!(?:if|for|foreach|while|switch|catch|using|lock)\b){_ID})\s*(?:<[^>]*>)?\s*(?P<args>\([^)]*\))\s*(?:where[^{{]*)?(?:\{{|=>)", rf"(?m)^[ \t]*(?:(?:public|protected|private|internal|static|abstract|sealed|partial)\s+)*(?:class|interface|struct|enum|record)\s+(?P<name>{_ID})(?:<[^>]*>)?(?:\s*:\s*(?P<bases>[^{{\n]+))?", (("using", r"(?m)^\s*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;"),), rf"(?m)^[ \t]+(?:(?:public|protected|private|internal|static|readonly|const)\s+)+[\w<>\[\],.?]+\s+(?P<name>{_ID})\s*(?:=\s*(?P<value>[^;]*))?;"),
    "ruby": Language(r"(?m)^[ \t]*def\s+(?P<self>self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)(?P<args>\([^)]*\))?", r"(?m)^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*)(?:\s*<\s*(?P<bases>[\w:]+))?", (("require_relative", r"""(?m)^\s*require_relative\s+['"](?P<module>[^'"]+)['"]"""), ("require", r"""(?m)^\s*require\s+['"](?P<module>[^'"]+)['"]"""), ("load", r"""(?m)^\s*load\s+['"](?P<module>[^'"]+)['"]""")), r"(?m)^\s*(?P<name>[A-Za-z_]\w*)\s*=(?!=)\s*(?P<value>[^\n]*)", "#", r"#[^\n]*", "end"),
    "swift": Language(rf"(?m)^[ \t]*(?:(?:public|private|internal|open|fileprivate|static|class|override|mutating|@\w+)\s+)*(?:func\s+(?P<name>{_ID})|(?P<name2>init|deinit))(?:<[^>]*>)?\??\s*(?P<args>\([^)]*\))?", rf"(?m)^[ \t]*(?:(?:public|private|internal|open|final|indirect)\s+)*(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b)(?P<name>{_ID})(?:\s*:\s*(?P<bases>[^{{]+))?", (("import", r"(?m)^\s*import\s+(?:\w+\s+)?(?P<module>[\w.]+)\s*$"),), rf"(?m)^[ \t]*(?:(?:public|private|static|lazy|weak)\s+)*(?:let|var)\s+(?P<name>{_ID})[^=\n{{]*(?:=\s*(?P<value>[^\n]*))?"),
}
LANGUAGES["typescript"] = Language(
    LANGUAGES["javascript"].functions.replace(r"\)\s*(?:=>|\{", r"\)\s*(?::[^={]+)?(?:=>|\{").replace(r"\)\s*\{))", r"\)\s*(?::[^{;]+)?\{))"),
    rf"(?m)\b(?:abstract\s+)?(?P<what>class|interface|type|enum)\s+(?P<name>{_ID})(?:<[^>]*>)?(?P<bases>\s+(?:extends|implements)[^{{]+)?",
    LANGUAGES["javascript"].imports,
    LANGUAGES["javascript"].variables,
)
LANGUAGES["cpp"] = LANGUAGES["c"]


def _blank(text: str, comment: str) -> str:
    """The text with comments and the insides of strings as spaces: places stay, braces in them don't count."""
    token = re.compile(rf"(?s)({comment})|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
    keep = lambda s: re.sub(r"[^\n]", " ", s)
    return token.sub(lambda m: keep(m[0]) if m[1] else m[0][0] + keep(m[0][1:-1]) + m[0][-1], text)


def _end(text: str, at: int, blocks: str) -> int:
    """Where the block that begins after `at` ends; the end of the line if there is none."""
    if blocks == "end":
        depth = 0
        for m in re.finditer(r"(?m)^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?=[^\n]*$)|^[ \t]*end\b", text[at:]):
            depth += -1 if m[0].strip() == "end" else 1
            if depth == 0:
                return at + m.end()
        return len(text)
    line = text.find("\n", at)
    first, stop = text.find("{", at), text.find(";", at)
    if first < 0 or (0 <= stop < first):
        return line if line >= 0 else len(text)
    depth = 0
    for m in re.finditer(r"[{}]", text[first:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return first + m.end()
    return len(text)


def _group(m: re.Match[str], *names: str) -> str | None:
    return next((m[n] for n in names if n in m.re.groupindex and m[n]), None)


def _patterns(language: str) -> Callable[[str, Rows], None]:
    spec = LANGUAGES[language]

    def run(text: str, rows: Rows) -> None:
        bare = _blank(text, spec.comment)
        starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        from bisect import bisect_right

        line = lambda at: bisect_right(starts, at)
        start_of = lambda m: m.start() + len(m[0]) - len(m[0].lstrip())
        classes, functions = [], []
        for m in re.finditer(spec.classes, bare):
            at, end = start_of(m), _end(bare, m.start() if spec.blocks == "end" else m.end() - (m[0][-1:] == "{"), spec.blocks)
            bases, what = (_group(m, "bases") or "").strip() or None, _group(m, "what")
            if language == "rust" and bases in ("struct", "impl"):
                if bases == "impl":
                    classes.append((at, end, m["name"]))
                    continue
                bases = None
            if what == "interface":
                bases = f"interface {bases or ''}".strip()
            rows.add("class", m["name"], line(at), line(end - 1), detail=bases, body=text[at:end])
            classes.append((at, end, m["name"]))
        for m in re.finditer(spec.functions, bare):
            name = _group(m, "name", "name2", "name3")
            if name is None:
                continue
            at = start_of(m)
            end = _end(bare, m.start() if spec.blocks == "end" else m.end() - (m[0][-1:] == "{"), spec.blocks)
            inside = [c for c in classes if c[0] < at < c[1]]
            owner = _group(m, "owner") or (inside[-1][2] if inside else None)
            mark = "." if _group(m, "self") else spec.separator
            rows.add("function", name, line(at), line(end - 1), qualified=f"{owner}{mark}{name}" if owner else name, detail=_group(m, "args"), body=text[at:end])
            functions.append((at, end, name, m.end()))
        imported: list[tuple[int, int]] = []
        for kind, pattern in spec.imports:
            for m in re.finditer(pattern, text):
                if bare[m.start() : m.end()].strip() and not any(a <= m.start() < b for a, b in imported):
                    module = m["module"].strip()
                    rows.add("import", re.split(r"[/.:\\]+", module.rstrip("*;"))[-1] or module, line(start_of(m)), detail=module, kind=kind)
                    imported.append((m.start(), m.end()))
        skip = set(spec.not_calls.split())
        declared = {(a, n) for a, _, n, _ in functions}
        for m in re.finditer(r"([A-Za-z_$][\w$]*[?!]?)\s*\(", bare):
            inside = [f for f in functions if f[0] <= m.start() < f[1]]
            head = any(f[0] <= m.start() < f[3] and f[2] == m[1] for f in functions)
            if m[1] not in skip and not head and (m.start(), m[1]) not in declared and m[1] not in ("require", "require_once", "include", "include_once"):
                rows.add("call", m[1], line(m.start()), caller=inside[-1][2] if inside else MODULE)
        if spec.variables:
            for m in re.finditer(spec.variables, bare):
                value = text[m.start("value") : m.end("value")].strip()[:VALUE] if _group(m, "value") else None
                rows.add("variable", m["name"], line(start_of(m)), detail=value)

    return run


class _Page(HTMLParser):
    """Elements of a page: ids, forms, fields, style classes, links and inline scripts."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    SOURCES = frozenset("img iframe video audio source embed".split())

    def __init__(self, text: str, rows: Rows) -> None:
        super().__init__(convert_charrefs=False)
        self.text, self.rows = text, rows
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.open: list[tuple[str, int, int, str | None]] = []
        self.inline: tuple[str, int] | None = None

    def place(self) -> tuple[int, int]:
        line, column = self.getpos()
        return line, self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line, at = self.place()
        held = {k: v or "" for k, v in attrs}
        for name in held.get("class", "").split():
            self.rows.add("variable", f"class:{name}", line, detail=tag)
        if tag == "a" and held.get("href"):
            self.rows.add("import", held["href"], line, detail=held["href"], kind="link")
        elif tag == "link" and held.get("href"):
            self.rows.add("import", held["href"], line, detail=held["href"], kind=held.get("rel") or "stylesheet")
        elif tag == "script" and held.get("src"):
            self.rows.add("import", held["src"], line, detail=held["src"], kind="script")
        elif tag in self.SOURCES and held.get("src"):
            self.rows.add("import", held["src"], line, detail=held["src"], kind=tag)
        elif tag in ("script", "style"):
            self.inline = (tag, line)
        if tag in ("input", "select", "textarea") and held.get("name"):
            self.rows.add("variable", held["name"], line, detail=(held.get("value") or held.get("type") or None))
        if tag == "form":
            self.rows.add("function", f"form_{held.get('id') or held.get('name') or line}", line, detail=held.get("action"), body=self.get_starttag_text())
        if tag in self.VOID:
            if held.get("id"):
                self.rows.add("class", held["id"], line, detail=tag, body=self.get_starttag_text())
        else:
            self.open.append((tag, line, at, held.get("id") or None))

    def handle_endtag(self, tag: str) -> None:
        line, at = self.place()
        close = self.text.find(">", at) + 1 or len(self.text)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for name, first, begin, id_ in self.open[k:]:
                    if id_:
                        self.rows.add("class", id_, first, line, detail=name, body=self.text[begin:close])
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.inline and data.strip():
            tag, line = self.inline
            self.rows.add("function", f"inline_{tag}_{line}", line, line + data.count("\n"), body=data)
        self.inline = None


def _html(text: str, rows: Rows) -> None:
    page = _Page(text, rows)
    page.feed(text)
    page.close()
    for tag, line, at, id_ in page.open:
        if id_:
            rows.add("class", id_, line, text.count("\n") + 1, detail=tag, body=text[at:])


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(text: str, rows: Rows) -> None:
    """Metadata objects: the object itself as a class, its attributes as variables with their types."""
    if "<MetaDataObject" not in text[:500]:
        return
    for top in ElementTree.fromstring(text):
        find = lambda node, name: next((x for x in node.iter() if local(x.tag) == name), None)
        name = find(top, "Name")
        rows.add("class", (name.text or "") if name is not None else "", 1, text.count("\n") + 1, detail=local(top.tag), body=text)
        for node in top.iter():
            if local(node.tag) in ("Attribute", "Dimension", "Resource"):
                own, kind = find(node, "Name"), find(node, "Type")
                if own is not None:
                    rows.add("variable", own.text or "", 1, detail=" ".join(kind.itertext()).strip() if kind is not None else None, kind=local(node.tag))


EXTRACTORS: dict[str, Callable[[str, Rows], None]] = {"python": _python, "html": _html, "xml": _xml, "bsl": dialect.module} | {name: _patterns(name) for name in LANGUAGES}


def extract_text(path: str, language: str, text: str | None) -> list[tuple]:
    """Entity rows of one file; none if its language is unknown, it is binary, it can't be parsed or it takes longer than SECONDS."""
    run = EXTRACTORS.get(language)
    if run is None or text is None or "\0" in text[:8000]:
        return []
    rows = Rows(path)
    try:
        with _within(SECONDS):
            run(text, rows)
    except (SyntaxError, ValueError, RecursionError, ElementTree.ParseError, TimeoutError):
        return []
    return rows.out


@contextmanager
def _within(seconds: float) -> Iterator[None]:
    """TimeoutError when the time is up. Only a main thread can be interrupted; workers run extractors in theirs."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(number: int, frame: object) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(files: DataFrame) -> DataFrame:
    """Entity rows of (path, language, content), file by file in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                rows = [r for args in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in extract_text(*args)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=list(COLUMNS))

    return files.select("path", "language", F.col("content")).mapInArrow(run, SCHEMA)


def entity(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind."""
    return rows.filter(F.col("entity") == kind)
