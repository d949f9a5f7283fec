"""Chunking of texts and extraction of spans and symbols: table functions over (key, text)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from spanloom.runtime import row_batches


def _table(rows: DataFrame, key: str, text: str, each, schema: str, extra: str | None = None) -> DataFrame:
    cols = [key, text, *([extra] if extra else [])]
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}"
    return rows.select(*cols).mapInArrow(row_batches(key, text, each, kinds, extra), kinds)


def fill(parts: list[str], most: int, cost: int) -> list[list[str]]:
    """Consecutive parts in bins: a part opens a new bin if it would exceed ``most``; each costs its length and ``cost``."""
    out, used = [], 0
    for p in parts:
        size = len(p) + cost
        if not out or used + size - (cost if cost == 2 else 0) > most:
            out.append([])
            used = 0
        out[-1].append(p)
        used += size
    return out


def line_pages(rows: DataFrame, key: str = "id", text: str = "text", most: int = 1000) -> DataFrame:
    """(key, page, content): whole lines, up to ``most`` characters (one longer line is a page)."""
    return _table(rows, key, text, lambda t: [(i, "\n".join(p)) for i, p in enumerate(fill(t.split("\n"), most, 1))], "page int, content string")


def windows(t: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of character windows, cut back to the last newline beyond 60 %, each starting ``overlap`` before the last end."""
    out, a = [], 0
    while a < len(t):
        b = min(len(t), a + most)
        if b < len(t) and (nl := t.rfind("\n", a, b)) > a + 0.6 * most:
            b = nl
        if t[a:b].strip():
            out.append((a, b))
        if b >= len(t):
            break
        a = max(a + 1, b - overlap)
    return out


def char_windows(rows: DataFrame, key: str = "id", text: str = "text", most: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, start, end, content)"""
    return _table(rows, key, text, lambda t: [(a, b, t[a:b]) for a, b in windows(t, most, overlap)], "start int, end int, content string")


_HEAD, _FENCE = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"^\s*(```|~~~)")


def sections_of(t: str) -> list[tuple[str, str, int, int, str]]:
    """(path, title, start_line, end_line, content) of a Markdown text; lines count from 1, headings in fences are text."""
    out, stack, body, start, fence = [], [], [], 1, None

    def close(end: int) -> None:
        if "\n".join(body).strip():
            out.append((" > ".join(h for _, h in stack), stack[-1][1] if stack else "", start, end, "\n".join(body)))

    lines = t.split("\n")
    for n, line in enumerate(lines, 1):
        f = _FENCE.match(line)
        if f and fence in (None, f[1]):
            fence = None if fence else f[1]
        h = None if fence or f else _HEAD.match(line)
        if h:
            close(n - 1)
            while stack and stack[-1][0] >= len(h[1]):
                stack.pop()
            stack.append((len(h[1]), h[2]))
            body, start = [], n
        body.append(line)
    close(len(lines))
    return out


def markdown_sections(rows: DataFrame, key: str = "id", text: str = "text", most: int = 2500) -> DataFrame:
    """(key, path, slug, start_line, end_line, content): sections, long ones in parts cut at blank lines, with slugs unique per text."""

    def each(t: str):
        used: set[str] = set()
        for path, title, a, b, content in sections_of(t):
            parts = [content] if len(content) <= most else ["\n\n".join(p) for p in fill(re.split(r"\n\n+", content), most, 2)]
            base = slug = re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", title.lower()))
            n = 0
            while slug in used:
                n += 1
                slug = f"{base}-{n}"
            used.add(slug)
            for i, c in enumerate(parts, 1):
                yield (path if len(parts) == 1 else f"{path} (part {i})".strip()), slug, a, b, c

    return _table(rows, key, text, each, "path string, slug string, start_line int, end_line int, content string")


def regex_hits(rows: DataFrame, pattern: str, key: str = "id", text: str = "text", most: int = 20) -> DataFrame:
    """(key, start, end, start_line, end_line, hit) of a text's first ``most`` matches; an invalid pattern gives one row with its error."""
    try:
        p = re.compile(pattern)
    except re.error as e:
        message = f"invalid pattern: {e}"
        return _table(rows, key, text, lambda t: [(-1, -1, 0, 0, message)], "start int, end int, start_line int, end_line int, hit string")

    def each(t: str):
        for n, m in enumerate(p.finditer(t)):
            if n >= most:
                break
            yield m.start(), m.end(), t.count("\n", 0, m.start()) + 1, t.count("\n", 0, m.end()) + 1, m[0][:200]

    return _table(rows, key, text, each, "start int, end int, start_line int, end_line int, hit string")


def fences(t: str) -> int:
    """Paired fences of code."""
    return len(re.findall(r"(?s)(?:^|[\s:,(){}\[\]])```[\w-]*\s*\n.*?```", t))


SPAN = "symbol string, kind string, start_line int, end_line int, doc string"


def python_spans(t: str) -> list[tuple[str, str, int, int, str]]:
    """Classes, functions and methods of Python source at any depth, with dotted scopes; none if it does not parse."""
    try:
        tree = ast.parse(t)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, todo = [], [(tree, "")]
    while todo:
        node, scope = todo.pop()
        for c in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(c, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                inner = f"{scope}.{c.name}" if scope else c.name
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                first = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                out.append((inner, kind, first, c.end_lineno, (ast.get_docstring(c) or "").split("\n")[0][:200]))
            todo.append((c, inner))
    return sorted(out, key=lambda r: (r[2], r[0]))


#: How other languages open a definition; blocks are followed by braces (an approximation of their grammars).
OPENERS = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("method", r"^\s+(?:async\s+|static\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;]*\)\s*\{")],
    "go": [("type", r"^type\s+(\w+)\s+(?:struct|interface)"), ("method", r"^func\s+\([^)]*?\*?(\w+)\)\s+(\w+)"), ("function", r"^func\s+(\w+)")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+|final\s+|abstract\s+|static\s+)*(?:class|enum|record)\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+)+[\w<>\[\], ]*?(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w, ]+)?\{")],
}
OPENERS["typescript"] = OPENERS["tsx"] = [*OPENERS["javascript"], ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")]


def brace_spans(t: str, language: str) -> list[tuple[str, str, int, int, str]]:
    rules = [(k, re.compile(p)) for k, p in OPENERS[language]]
    lines, out, scopes, depth = t.split("\n"), [], [], 0
    for n, line in enumerate(lines, 1):
        code = re.sub(r"//.*$|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "", line)
        hit = next(((k, m) for k, p in rules if (m := p.match(line))), None)
        if hit:
            k, m = hit
            name = ".".join(m.groups()) if k == "method" and len(m.groups()) > 1 else m[1]
            path = ".".join([*(s[1] for s in scopes if s[0] in ("class", "interface")), name])
            scopes.append((k, name, depth, n, path))
        depth += code.count("{") - code.count("}")
        while scopes and (depth <= scopes[-1][2]) and ("}" in code or ";" in code):
            k, _, _, a, path = scopes.pop()
            out.append((path, k, a, n, ""))
    out += [(path, k, a, len(lines), "") for k, _, _, a, path in scopes]
    return sorted(out, key=lambda r: (r[2], r[0]))


def spans(rows: DataFrame, key: str = "id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, symbol, kind, start_line, end_line, doc): by language; Markdown sections; a whole file as one module otherwise."""

    def each(t: str, lang: str | None):
        if lang == "python":
            return python_spans(t)
        if lang in OPENERS:
            return brace_spans(t, lang)
        if lang == "markdown":
            return [((p if len(p) <= 100 else p[:97] + "...") or "intro", "section", a, b, "") for p, _, a, b, _ in sections_of(t)]
        return [("", "module", 1, t.count("\n") + 1, "")]

    return _table(rows, key, text, each, SPAN, language)


def symbol_at(span_rows: DataFrame, points: DataFrame, key: str = "id") -> DataFrame:
    """(key, line, symbol): the innermost span that covers each (key, line)."""
    from pyspark.sql import functions as F

    j = points.join(span_rows, key).filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    return j.groupBy(key, "line").agg(F.max(F.struct("start_line", "symbol"))["symbol"].alias("symbol"))


def python_graph(t: str, module: str) -> list[tuple[str, str, str, str]]:
    """(what, a, edge, b): entities as ('entity', id, kind, lines) and relations as ('relation', src, CALLS / EXTENDS / IMPORTS, dst)."""
    try:
        tree = ast.parse(t)
    except (SyntaxError, ValueError, RecursionError):
        return []
    names: dict[str, str] = {}
    out: list[tuple[str, str, str, str]] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            names |= {a.asname or a.name.split(".")[0]: a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            names |= {a.asname or a.name: f"{n.module or ''}.{a.name}".strip(".") for a in n.names}
    out += [("relation", f"mod:{module}", "IMPORTS", f"mod:{x}") for x in sorted(set(names.values()))]
    local = {n.name for n in tree.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)}

    def full(e: ast.expr) -> str | None:
        if isinstance(e, ast.Name):
            return f"{module}.{e.id}" if e.id in local else names.get(e.id, e.id)
        if isinstance(e, ast.Attribute):
            head = full(e.value)
            return f"{head}.{e.attr}" if head else e.attr
        return None

    def visit(node: ast.AST, scope: str) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(c, ast.ClassDef)
                ident = f"{scope}.{c.name}"
                src = ("type:" if is_class else "sym:") + ident
                out.append(("entity", src, "class" if is_class else "method" if isinstance(node, ast.ClassDef) else "function", f"{c.lineno}-{c.end_lineno}"))
                for b in c.bases if is_class else []:
                    if to := full(b):
                        out.append(("relation", src, "EXTENDS", f"type:{to}"))
                visit(c, ident)
            else:
                if isinstance(c, ast.Call) and scope != module and (to := full(c.func)):
                    out.append(("relation", f"sym:{scope}", "CALLS", f"sym:{to}"))
                visit(c, scope)

    visit(tree, module)
    return out


def schema_graph(rows: DataFrame, key: str = "module", text: str = "text", extract=python_graph) -> DataFrame:
    """(key, what, a, edge, b) of sources, distinct; ``extract`` is python_graph or script_graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *r) for k, t in zip(b[key], b[text], strict=True) if t for r in extract(t, k)]
            yield pd.DataFrame(out, columns=[key, "what", "a", "edge", "b"])

    return rows.select(key, text).mapInPandas(run, f"{key} string, what string, a string, edge string, b string").distinct()


def skeleton(t: str) -> str:
    """Python source with bodies cut to signatures, imports and first docstring lines; as it is if it does not parse."""
    try:
        tree = ast.parse(t)
    except (SyntaxError, ValueError, RecursionError):
        return t

    class Cut(ast.NodeTransformer):
        def _cut(self, n):
            doc = ast.get_docstring(n)
            n.body = [*([ast.Expr(ast.Constant(doc.split("\n")[0]))] if doc else []), ast.Expr(ast.Constant(...))]
            return n

        visit_FunctionDef = visit_AsyncFunctionDef = _cut

    tree.body = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef | ast.Assign | ast.AnnAssign)]
    return ast.unparse(ast.fix_missing_locations(Cut().visit(tree)))


def context_hits(rows: DataFrame, pattern: str, key: str = "id", text: str = "text", most: int = 20) -> DataFrame:
    """(key, nth, line, hit): the first ``most`` matches of a Java pattern in each text, JVM-side; a match's line is counted in what lies before it.

    Texts are cut at their matches: what precedes the n-th match is the n first pieces and the matches between them.
    """
    from pyspark.sql import functions as F

    t = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias(key), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_m"), F.split(F.col(text), pattern).alias("_p"))
    t = t.filter(F.size("_m") > 0)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    h = t.select(key, "_p", F.posexplode(F.slice("_m", 1, most)).alias("nth", "hit"), "_m")
    before = F.concat(F.array_join(F.slice("_p", F.lit(1), F.col("nth") + 1), ""), F.array_join(F.slice("_m", F.lit(1), F.col("nth")), ""))
    return h.select(key, "nth", (breaks(before) + 1).alias("line"), F.substring("hit", 1, 200).alias("hit"))


def listing(symbols: DataFrame, scope: str = "", symbol: str = "symbol") -> DataFrame:
    """The rows whose symbol is directly in a scope; without one, those of the top level."""
    from pyspark.sql import functions as F

    dots = F.size(F.split(F.col(symbol), r"\.")) - 1
    return symbols.filter(F.col(symbol).startswith(f"{scope}.") & (dots == scope.count(".") + 1) if scope else dots == 0)


_IMPORT = re.compile(r"""^\s*(?:import|export)\b[^'"\n;]*?\bfrom\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""", re.M)
_BASES = re.compile(r"\b(?:class|interface)\s+(\w+)(?:<[^{]*?>)?\s+extends\s+([\w.$]+(?:\s*,\s*[\w.$]+)*)")
_CALL = re.compile(r"(\w+)\s*(?:<[\w\s,]*>)?\(")
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "constructor", "import", "require"}


def script_graph(t: str, module: str) -> list[tuple[str, str, str, str]]:
    """The same as ``python_graph`` for TypeScript and JavaScript, from lines and braces: imports, classes, interfaces, type aliases, functions and methods; bases; calls
    by name (of a member call, the property's)."""
    out = [("relation", f"mod:{module}", "IMPORTS", f"mod:{x}") for x in sorted({a or b or c for a, b, c in _IMPORT.findall(t)})]
    found = brace_spans(t, "typescript")
    for name, kind, a, b, _ in found:
        out.append(("entity", f"{'sym' if kind in ('function', 'method') else 'type'}:{module}.{name}", kind, f"{a}-{b}"))
    for name, bases in _BASES.findall(t):
        out += [("relation", f"type:{module}.{name}", "EXTENDS", f"type:{x.strip()}") for x in bases.split(",")]
    for n, line in enumerate(t.split("\n"), 1):
        code = re.sub(r"//.*$|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "", line)
        inside = [s for s in found if s[1] in ("function", "method") and s[2] <= n <= s[3]]
        if inside:
            scope = max(inside, key=lambda s: s[2])
            head = scope[2] == n and scope[0].split(".")[-1]
            out += [("relation", f"sym:{module}.{scope[0]}", "CALLS", f"sym:{c}") for c in _CALL.findall(code) if c not in _NOT_CALLED and c != head]
    return out


def source_chunks(t: str, most: int = 1000, header: int = 240, overlap: int = 100) -> list[tuple[str, str, int, int, int]]:
    """(role, symbol, depth, start, end) of Python source, in characters: definitions of up to ``most`` characters whole; of larger ones a header, what they define, and the
    stretches between in windows. Source that does not parse is cut in windows."""
    try:
        tree = ast.parse(t)
    except (SyntaxError, ValueError, RecursionError):
        return [("fallback", "", 0, a, b) for a, b in windows(t, most, overlap)]
    lines = [0]
    for x in t.split("\n"):
        lines.append(lines[-1] + len(x) + 1)
    out: list[tuple[str, str, int, int, int]] = []

    def stretch(role: str, symbol: str, depth: int, a: int, b: int) -> None:
        out.extend((role, symbol, depth, a + x, a + y) for x, y in windows(t[a:b], most, overlap))

    todo: list[tuple] = [("node", tree, "", 0, 0, len(t))]
    while todo:
        what, node, symbol, depth, a, b = todo.pop()
        if what != "node":
            stretch(what, symbol, depth, a, b)
            continue
        if b - a <= most:
            if t[a:b].strip():
                out.append(("whole", symbol, depth, a, b))
            continue
        at, next_ = a, []
        if node is not tree:
            out.append(("header", symbol, depth, a, min(b, a + header)))
            at = min(b, a + header)
        for c in node.body:
            if isinstance(c, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                x, y = lines[min([c.lineno, *(d.lineno for d in c.decorator_list)]) - 1], min(len(t), lines[c.end_lineno])
                if x > at:
                    next_.append(("gap", c, symbol, depth, at, x))
                next_.append(("node", c, f"{symbol}.{c.name}".strip("."), depth + 1, x, y))
                at = max(at, y)
        if b > at:
            next_.append(("remainder", node, symbol, depth, at, b))
        todo += reversed(next_)
    return out


def ast_chunks(rows: DataFrame, key: str = "id", text: str = "text", most: int = 1000) -> DataFrame:
    """(key, ordinal, role, symbol, depth, start, end, content): see ``source_chunks``; null and empty texts give none."""
    each = lambda t: [(i, r, s, d, a, b, t[a:b]) for i, (r, s, d, a, b) in enumerate(source_chunks(t, most))]
    return _table(rows, key, text, each, "ordinal int, role string, symbol string, depth int, start int, end int, content string")


def skeletons(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, skeleton) of Python sources."""
    return _table(rows, key, text, lambda t: [(skeleton(t),)], "skeleton string")
