"""Functions of paths: globs, extensions, weights."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a case-sensitive glob in which ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; a glob that ends in ``/`` is a directory prefix."""
    tests = [path.startswith(g) if g.endswith("/") else path.rlike(glob_regex(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def best_weight(path: Column, weights: dict[str, int], default: int) -> Column:
    """The highest weight of the globs that match."""
    hits = [F.when(path.rlike(glob_regex(g)), w) for g, w in weights.items()]
    return F.coalesce(F.greatest(*hits, F.lit(None).cast("int")), F.lit(default))


def first_glob(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose glob matches."""
    out = F.lit(default)
    for g, v in reversed(rules):
        out = F.when(path.rlike(glob_regex(g)), v).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


#: Extensions that count as code and as documents in scoring.
CODE = [".py", ".ts", ".js", ".rs", ".go", ".c", ".cpp", ".h", ".tsx", ".jsx", ".vue", ".rb", ".java", ".kt", ".swift"]
DOCS = [".md", ".rst", ".txt"]


def priority(path: Column) -> Column:
    """Queue priority by extension: 3 for code, 7 for documents, 5 otherwise."""
    e = extension(path)
    return F.when(e.isin(".py", ".rs", ".go", ".js", ".ts", ".c", ".cpp", ".java"), 3).when(e.isin(*DOCS), 7).otherwise(5)


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(test_|_test\.|\.test\.|tests/|__tests__|spec\.)")


def provenance(path: Column) -> Column:
    return F.when(is_test(path), "test").when(extension(path).isin(*DOCS), "docs").otherwise("code")


#: Language by extension.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".py": "python", ".go": "go",
    ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".hh": "cpp", ".rs": "rust", ".sh": "bash", ".bash": "bash",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".sql": "sql", ".md": "markdown", ".markdown": "markdown",
}
#: Extensions of code files in evaluations.
CODE_FILES = [
    ".py", ".ts", ".js", ".rs", ".go", ".c", ".cpp", ".h", ".hpp", ".java", ".scala", ".kt", ".swift", ".rb", ".php", ".sh", ".bash", ".yaml", ".yml", ".json",
    ".toml", ".xml", ".html", ".css", ".scss", ".sql", ".lua", ".pl", ".pm", ".r", ".m", ".fs", ".fsi", ".hs", ".ex", ".exs", ".erl", ".hrl", ".clj", ".cljs",
    ".lisp", ".scm", ".el", ".vim", ".zsh", ".fish", ".bat", ".cmd", ".ps1",
]


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE_FILES)


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))
