"""Lexers and function extraction: state machines, so they run as Arrow-batched functions over files.

strip() blanks comments and the contents of strings. As in the rules' compatible mode, a template's
`${` is never closed by `}` and newlines inside templates are blanked, so later lines move up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.workers import in_small_batches

# fixed values: characters after which a slash begins a regular expression
BEFORE_REGEX = frozenset("( = : [ ! & | ? { } ; , < > + - * % ~ ^".split())
JS_MARK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`|/", re.S)
JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[gimsuyvd]*", re.S)
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z|\\\Z)", re.S)
PY_MARK = re.compile(r"#[^\n]*|(\"\"\"|''')(?:\\.|(?!\1).)*(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|\n|\Z)|'(?:\\.|[^'\\\n])*(?:'|\n|\Z)", re.S)
ESCAPED_BREAK = re.compile(r"\\\n")
NOT_BREAK = re.compile(r"[^\n]")


def _blank(s: str) -> str:
    """Spaces for all but newlines; an escaped newline is blanked too."""
    return NOT_BREAK.sub(" ", ESCAPED_BREAK.sub("  ", s))


def strip_js(src: str) -> str:
    out, at, last = [], 0, ""
    while at < len(src):
        m = JS_MARK.search(src, at)
        if not m:
            out.append(src[at:])
            break
        code, mark = src[at : m.start()], m.group()
        out.append(code)
        last = code.rstrip()[-1:] or last
        at = m.end()
        if mark == "/":
            literal = JS_REGEX.match(src, m.start())
            begins = not last or last in BEFORE_REGEX or (last == "n" and src[max(0, m.start() - 7) : m.start()].endswith("return"))
            if begins and literal:
                out.append(_blank(literal.group()))
                at, last = literal.end(), "x"
            else:
                out.append("/")
                last = "/"
        elif mark == "`":
            end = TEMPLATE.match(src, at)
            out.append(" " * (end.end() - m.start()))
            at = end.end()
        elif mark.startswith("//"):
            out.append(" " * len(mark))
        elif mark.startswith("/*"):
            out.append(NOT_BREAK.sub(" ", mark))
        else:
            out.append(_blank(mark))
    return "".join(out)


def strip_python(src: str) -> str:
    return PY_MARK.sub(lambda m: _blank(m.group()), src)


#: Marks of Python, else what stands between them. Groups are possessive: they never give back, so the matcher needs no stack however long a text is.
PY_TOKENS = r"(?s)#[^\n]*+|(\"\"\"|''')(?:\\.|(?!\1).)*+(?:\1|\z)|\"(?:\\.|[^\"\\\n])*+(?:\"|\n|\z)|'(?:\\.|[^'\\\n])*+(?:'|\n|\z)|[^#\"']++|."


def stripped_python(raw: Column) -> Column:
    """What strip_python gives, without Python: the text's tokens, marks blanked, put together again."""
    tokens = F.regexp_extract_all(raw, F.lit(PY_TOKENS), F.lit(0))
    blank = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\\n", "  "), r"[^\n]", " ")
    # a quote alone that isn't the last token has no end: a backslash ends the text
    mark = lambda x, i: x.rlike("^[#\"']") & ((F.char_length(x) > 1) | (x == "#") | (i == F.size(tokens) - 1))
    return F.array_join(F.transform(tokens, lambda x, i: F.when(mark(x, i), blank(x)).otherwise(x)), "")


def strip(raw: Column, analysis: Column) -> Column:
    """The code of raw for its kind of analysis. Whether a slash divides hangs on all code before it, so JavaScript's lexer is Python; texts of Python never go there."""

    in_small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def lexed(texts: pd.Series) -> pd.Series:
        return texts.map(strip_js, na_action="ignore")

    python = analysis == "python"
    return F.when(python, stripped_python(F.when(python, raw))).otherwise(lexed(F.when(~F.coalesce(python, F.lit(False)), raw)))


PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+([A-Za-z0-9_]+)\s*\(")
PY_BRANCH = re.compile(r"\b(?:if|elif|for|while|except|and|or)\b", re.A)


def _indent(line: str) -> int:
    return len(line[: len(line) - len(line.lstrip())].replace("\t", "    "))


def python_functions(code: str) -> Iterator[tuple]:
    """(line, name, complexity, length, nesting) of functions with three lines of body or more."""
    nested: list[tuple] = []

    def close(indent: int) -> Iterator[tuple]:
        while nested and indent <= nested[-1][1]:
            name, own, start, body = nested.pop()
            if len(body) >= 3:
                deepest = max(map(_indent, body))
                yield start, name, 1 + len(PY_BRANCH.findall("\n".join(body))), len(body), max(0, floor((deepest - own - 4) / 4 + 0.5) + 1)

    for number, line in enumerate(code.split("\n"), 1):
        if line.strip():
            indent, d = _indent(line), PY_DEF.match(line)
            yield from close(indent)
            if d:
                nested.append((d[2], indent, number, []))
            elif nested:
                nested[-1][3].append(line)
    yield from close(-1)


# fixed values: how functions begin, and words that are no names
JS_HEADS = (r"\bfunction\s*\*?\s*([A-Za-z0-9_$]+)\s*\(", r"\b([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?(?:function\s*)?\(", r"\b([A-Za-z0-9_$]+)\s*:\s*(?:async\s*)?(?:function\s*)?\(", r"(?m)^[\t ]+(?:export\s+)?(?:abstract\s+)?(?:static\s+)?(?:async\s+)?([A-Za-z0-9_$]+)\s*\(")
NO_NAMES = frozenset("if for while switch catch return function new else do try".split())
JS_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?", re.A)
PAIRS = {"(": ")", "{": "}", "[": "]"}


def _partners(code: str) -> dict[int, int]:
    """The place of the closer of every opener, each kind of bracket by itself."""
    waiting: dict[str, list[int]] = {")": [], "}": [], "]": []}
    out = {}
    for m in re.finditer(r"[(){}\[\]]", code):
        c = m.group()
        if c in PAIRS:
            waiting[PAIRS[c]].append(m.start())
        elif waiting[c]:
            out[waiting[c].pop()] = m.start()
    return out


def _body(code: str, at: int, partner: dict[int, int]) -> int | None:
    """Where a body begins after the parameters: at its brace or its arrow; return types are passed over."""
    space = re.compile(r"\s*")
    at = space.match(code, at).end()
    if code[at : at + 1] != ":":
        return at if code[at : at + 1] == "{" or code[at : at + 2] == "=>" else None
    token = re.compile(r"[{(\[\])};]|=>")
    at += 1
    while m := token.search(code, at):
        c = m.group()
        if c == "=>":
            return m.start()
        if c in ")}];" or m.start() not in partner:
            return None
        at = partner[m.start()] + 1
        after = space.match(code, at).end()
        if c == "{" and not (code[after : after + 1] in ("{", ";") or code[after : after + 2] == "=>"):
            return m.start()
    return None


def js_functions(code: str) -> Iterator[tuple]:
    """(line, name, complexity, length, nesting): brace bodies of three lines or more; of an arrow, the rest of its line."""
    partner, seen = _partners(code), set()
    count = lambda text: 1 + len(JS_BRANCH.findall(text.replace("?.", ".").replace("??", "?")))
    for kind, head in enumerate(JS_HEADS):
        for m in re.finditer(head, code, re.A):
            close = partner.get(m.end() - 1)
            begin = None if m[1] in NO_NAMES or close is None else _body(code, close + 1, partner)
            if begin is None or begin in seen:
                continue
            line = code.count("\n", 0, m.start()) + 1
            if code[begin] == "{":
                if begin in partner:
                    seen.add(begin)
                    body = code[begin : partner[begin]]
                    depth = deepest = 0
                    for c in re.findall(r"[{}]", body):
                        depth += 1 if c == "{" else -1
                        deepest = max(deepest, depth)
                    if body.count("\n") >= 2:
                        yield line, m[1], count(body), body.count("\n") + 1, deepest
            elif kind < 3:
                seen.add(begin)
                body = code[begin:].split("\n", 1)[0]
                if len(body.strip()) > 10:
                    yield line, m[1], count(body), 1, 0




def functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, name, complexity, length, nesting) for files (repo_id, path, code, analysis)."""

    in_small_batches(files.sparkSession)

    @F.pandas_udf("array<struct<line:int,name:string,complexity:int,length:int,nesting:int>>")
    def found(code: pd.Series, kinds: pd.Series) -> pd.Series:
        keys = ("line", "name", "complexity", "length", "nesting")
        return pd.Series([[dict(zip(keys, f, strict=True)) for f in (python_functions(c) if k == "python" else js_functions(c))] for c, k in zip(code, kinds, strict=True)])

    code = files.where(F.col("analysis").isin("js", "python") & F.col("code").isNotNull())
    return code.select("repo_id", "path", F.explode(found("code", "analysis")).alias("f")).select("repo_id", "path", "f.*")
