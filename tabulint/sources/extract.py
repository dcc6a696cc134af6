"""Symbols, calls, routes and client calls from source files.

One row per fact, tagged by `rel`.  Python goes through its own parser; the other
languages through declaration and call patterns, with a scope stack kept by braces.
A file whose front end fails gives one ParseFailure row and stops nothing.
"""

from __future__ import annotations

import ast
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """rel string, path string, lang string, id string, name string, full_name string, kind string, visibility string, line_start int, line_end int,
    parent_id string, param_count int, is_entry_point boolean, hash string, normalized_hash string, caller_id string, callee_name string, target_kind string, verb string, route string, seq long"""
FIELDS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
VERBS = {"get", "post", "put", "patch", "delete"}
# Receivers that register routes and that send requests.
ROUTERS = {"app", "router", "r", "e", "g", "api", "server", "mux", "blueprint", "bp", "Route"}
CLIENTS = {"axios", "http", "client", "requests", "httpx", "session", "Http", "reqwest", "$http", "api"}
_DECLARE = {
    "Php": [("Class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)"), ("Function", r"^\s*(?:(public|protected|private|static|final|abstract)\s+)*function\s+&?(\w+)\s*\(([^)]*)")],
    "JavaScript": [("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)"), ("Function", r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)"), ("Function", r"^\s*(export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"), ("Method", r"^\s+(?:(public|private|protected|static|async)\s+)*(?!if|for|while|switch|catch|return|function)(\w+)\s*\(([^)]*)\)\s*(?::[^{]+)?\{")],
    "Go": [("Class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("Function", r"^func\s+(?:(\([^)]*\))\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)")],
    "Java": [("Class", r"^\s*(?:(?:public|protected|private|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("Method", r"^\s+(?:@\w+\s+)*(?:(public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(([^)]*)\)")],
    "Rust": [("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("Class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("Function", r"^\s*(pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)[^(]*\(([^)]*)")],
}
_DECLARE["TypeScript"] = _DECLARE["JavaScript"]
_PATTERNS = {lang: [(k, re.compile(p)) for k, p in rules] for lang, rules in _DECLARE.items()}
_CALL = re.compile(r"((?:\$?\w+(?:->|::|\.|\\))*\$?\w+)\s*\(")
_NOT_CALLS = {"if", "for", "foreach", "while", "switch", "return", "function", "catch", "match", "fn", "func", "new", "sizeof", "array", "isset", "empty", "unset", "echo", "print", "list", "def", "class", "elif", "and", "or", "not", "in", "is", "super", "await", "typeof"}
_QUOTED = re.compile(r"""^\s*['"`]([^'"`]*)['"`]""")


def short_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def erased(text: str) -> str:
    """Source with comments dropped and identifiers and numbers made alike."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*|#[^\n]*", "", text, flags=re.S)
    return re.sub(r"\s+", " ", re.sub(r"\b\d\w*\b", "0", re.sub(r"\b[A-Za-z_]\w*\b", lambda m: m[0] if m[0] in _NOT_CALLS else "v", text))).strip()


class Facts:
    def __init__(self, path: str, lang: str):
        self.path, self.lang, self.rows, self.seq = path, lang, [], 0

    def put(self, rel: str, **fields) -> dict:
        self.seq += 1
        row = dict.fromkeys(FIELDS) | {"rel": rel, "path": self.path, "lang": self.lang, "seq": self.seq} | fields
        self.rows.append(row)
        return row

    def symbol(self, name: str, kind: str, start: int, parent: dict | None, params: int, visibility: str, entry: bool = False) -> dict:
        full = f"{parent['full_name']}::{name}" if parent else f"{self.path}::{name}"
        return self.put("symbol", id=short_hash(f"{full}@{start}"), name=name, full_name=full, kind=kind, visibility=visibility, line_start=start, line_end=start, parent_id=parent and parent["id"], param_count=params, is_entry_point=entry)

    def finish(self, row: dict, lines: list[str]) -> None:
        body = "\n".join(lines[row["line_start"] - 1 : row["line_end"]])
        row["hash"], row["normalized_hash"] = short_hash(body), short_hash(erased(body))

    def call(self, caller: dict | None, name: str, line: int, first: str | None = None, dynamic: bool = False) -> None:
        last, receiver = re.split(r"->|::|\.", name)[-1], re.split(r"->|::|\.", name)[0]
        verb = last.lower()
        if first is not None and "." in name + "." and verb in VERBS | {"any", "all"} and (receiver in ROUTERS or receiver in CLIENTS) and first.startswith(("/", "http")):
            rel = "http_call" if receiver in CLIENTS and receiver not in ROUTERS or first.startswith("http") else "route"
            self.put(rel, verb={"all": "any"}.get(verb, verb), route=re.sub(r"^https?://[^/]*", "", first) or "/", line_start=line, caller_id=caller and caller["id"])
        elif first is not None and last == "fetch" and first.startswith(("/", "http")):
            self.put("http_call", verb="get", route=re.sub(r"^https?://[^/]*", "", first) or "/", line_start=line, caller_id=caller and caller["id"])
        self.put("call", caller_id=caller and caller["id"], callee_name=name, target_kind="Dynamic" if dynamic else "Unresolved", line_start=line)


def python_facts(path: str, text: str) -> list[dict]:
    f, lines = Facts(path, "Python"), text.splitlines()

    def walk(node: ast.AST, scope: dict | None, owner: dict | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                inside_class = isinstance(node, ast.ClassDef)
                kind = "Class" if is_class else "Method" if inside_class else "Function"
                n = 0
                if not is_class:
                    args = [a.arg for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]]
                    n = len([a for a in args if a not in ("self", "cls")])
                decorated = bool(child.decorator_list)
                row = f.symbol(child.name, kind, child.lineno, owner, n, "Private" if child.name.startswith("_") else "Public", decorated or child.name.startswith("test_"))
                row["line_end"] = child.end_lineno
                f.finish(row, lines)
                for d in child.decorator_list:
                    walk(ast.Expression(d), scope, owner)
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        verbs = [d.func.attr] if d.func.attr in VERBS else []
                        if d.func.attr == "route":
                            listed = [k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))]
                            verbs = [e.value.lower() for e in listed[0].elts if isinstance(e, ast.Constant)] if listed else ["get"]
                        for v in verbs:
                            f.put("route", verb=v, route=d.args[0].value, line_start=child.lineno, caller_id=row["id"])
                walk(child, row if not is_class else scope, row)
            else:
                if isinstance(child, ast.Call):
                    name = ast.unparse(child.func)
                    first = child.args[0].value if child.args and isinstance(child.args[0], ast.Constant) and isinstance(child.args[0].value, str) else None
                    f.call(scope, name, child.lineno, first if scope or "." in name else None, "getattr" in name or "eval" in name)
                walk(child, scope, owner)

    walk(ast.parse(text), None, None)
    return f.rows


def signature(lines: list[str], at: int, most: int = 30) -> str:
    """A line and those after it until its parentheses are closed."""
    out, depth = [], 0
    for line in lines[at : at + most]:
        out.append(line.strip() if out else line.rstrip())
        depth += line.count("(") - line.count(")")
        if depth <= 0:
            break
    return " ".join(out)


# Annotations and macros that register routes, with their verbs.
_SPRING = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b(?:\s*\(([^)]*)\))?")
_JAX = re.compile(r"@(GET|POST|PUT|DELETE|PATCH)\b")
_JAX_PATH = re.compile(r"@Path\s*\(\s*\"([^\"]*)\"")
_MACRO = re.compile(r"#\[\s*(?:\w+::)?(get|post|put|patch|delete)\s*\(\s*\"([^\"]*)\"")
_AXUM = re.compile(r"\.route\s*\(\s*\"([^\"]*)\"\s*,\s*(.*)")
_GO_VERB = re.compile(r"\b\w+\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\s*\(\s*\"(/[^\"]*)\"")
_GO_HANDLE = re.compile(r"\b\w+\.(?:HandleFunc|Handle)\s*\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE)\s+)?(/[^\"]*)\"")


def joined(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


def web_routes(lang: str, text: str) -> list[tuple[str, str, int]]:
    """(verb, path, line) of the routes that annotations, attributes or calls of web
    libraries register in Java, Rust and Go sources.  In Java the path of a class, on
    the annotations above it, goes before those of its methods."""
    out: list[tuple[str, str, int]] = []
    lines = text.splitlines()
    base, waiting = "", []
    for ln, raw in enumerate(lines, 1):
        line = signature(lines, ln - 1) if raw.count("(") > raw.count(")") else raw
        if line.lstrip().startswith(("//", "*", "/*")):
            continue
        if lang == "Rust":
            out += [(m[1], m[2], ln) for m in _MACRO.finditer(line)]
            if m := _AXUM.search(line):
                out += [(v, m[1], ln) for v in re.findall(r"\b(get|post|put|patch|delete|any)\s*\(", m[2])]
        elif lang == "Go":
            out += [(m[1].lower(), m[2], ln) for m in _GO_VERB.finditer(line)]
            out += [((m[1] or "any").lower(), m[2], ln) for m in _GO_HANDLE.finditer(line)]
        elif lang == "Java":
            if m := _SPRING.search(line):
                args = m[2] or ""
                paths = re.findall(r"\"([^\"]*)\"", re.sub(r"(produces|consumes|params|headers|name)\s*=\s*(\{[^}]*\}|\"[^\"]*\")", "", args)) or [""]
                verbs = [m[1].lower()] if m[1] != "Request" else [v.lower() for v in re.findall(r"RequestMethod\.(\w+)|\b(?:method\s*=\s*)(GET|POST|PUT|PATCH|DELETE)", args) for v in v if v] or ["any"]
                waiting += [("spring", v, p, ln) for v in verbs for p in paths]
            if m := _JAX.search(line):
                waiting.append(("verb", m[1].lower(), "", ln))
            if m := _JAX_PATH.search(line):
                waiting.append(("path", "", m[1], ln))
            if re.search(r"\b(class|interface|record)\s+\w+", line):
                base = next((p for k, _, p, _ in waiting if k in ("spring", "path")), "")
                waiting = []
            elif waiting and not line.lstrip().startswith("@") and "(" in line:
                path = next((p for k, _, p, _ in waiting if k == "path"), "")
                out += [(v, joined(base, p if k == "spring" else path), at) for k, v, p, at in waiting if k != "path"]
                waiting = []
    return out


def pattern_facts(path: str, lang: str, text: str, offset: int = 0) -> list[dict]:
    f, lines = Facts(path, lang), text.splitlines()
    stack: list[tuple[dict, int]] = []
    depth, quoted = 0, re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`")
    for ln, raw in enumerate(lines, 1):
        if raw.lstrip().startswith(("//", "*", "#!", "/*")) or len(raw) > 10_000:
            continue
        declared = None
        whole = signature(lines, ln - 1) if raw.count("(") > raw.count(")") else raw
        for kind, p in _PATTERNS[lang]:
            m = p.search(whole)
            if not m:
                continue
            owner = next((s for s, _ in reversed(stack) if s["kind"] == "Class"), None)
            if kind == "Class":
                declared = f.symbol(m[1], "Class", ln, None, 0, "Public", False)
            else:
                params = [x for x in m[3].split(",") if x.strip() and x.strip() not in ("self", "&self", "&mut self", "mut self")]
                visibility = "Private" if m[1] and "private" in m[1] else "Public"
                entry = m[2] == "main" or (lang == "Go" and m[2] == "init") or (ln > 1 and re.search(r"#\[(\w+::)?test|@Test", lines[ln - 2]) is not None)
                declared = f.symbol(m[2], "Method" if owner else "Function", ln, owner, len(params), visibility, entry)
            break
        bare = quoted.sub('""', raw)
        caller = declared if declared and declared["kind"] != "Class" else next((s for s, _ in reversed(stack) if s["kind"] != "Class"), None)
        for m in _CALL.finditer(raw):
            name = m[1].lstrip("$")
            if re.split(r"->|::|\.|\\", name)[-1] in _NOT_CALLS or (declared and re.split(r"->|::|\.", name)[-1] == declared["name"]) or not re.match(r"[A-Za-z_$]", name):
                continue
            first = _QUOTED.match(raw[m.end() :])
            f.call(caller, m[1] if lang == "Php" else name, ln, first[1] if first else None, "$$" in m[1] or name in ("call_user_func", "call_user_func_array"))
        opened, closed = bare.count("{"), bare.count("}")
        if declared and (opened or not bare.rstrip().endswith(";")):
            stack.append((declared, depth))
        depth += opened - closed
        while stack and depth <= stack[-1][1] and (closed or opened):
            stack[-1][0]["line_end"] = ln
            stack.pop()
    if lang in ("Java", "Rust", "Go"):
        own = [r for r in f.rows if r["rel"] == "symbol" and r["kind"] != "Class"]
        f.rows[:] = [r for r in f.rows if r["rel"] != "route"]
        for verb, route, ln in web_routes(lang, text):
            # the function whose declaration follows the annotation, or around the call
            after = next((r for r in own if r["line_start"] >= ln and r["line_start"] - ln <= 5), None) if lang != "Go" else None
            around = next((r for r in reversed(own) if r["line_start"] <= ln <= r["line_end"]), None)
            handler = after or around
            if after:
                after["is_entry_point"] = True
            f.put("route", verb=verb, route=route, line_start=ln, caller_id=handler and handler["id"])
    for row in f.rows:
        if row["rel"] == "symbol":
            f.finish(row, lines)
        for k in ("line_start", "line_end"):
            if row[k]:
                row[k] += offset
    return f.rows


def html_facts(path: str, text: str) -> list[dict]:
    """Facts of the inline scripts, on the page's own line numbers."""
    rows = []
    for i, m in enumerate(re.finditer(r"(?is)<script([^>]*)>(.*?)</script>", text)):
        if "src=" in m[1].lower() or re.search(r"(?i)type\s*=\s*[\"'](?!text/javascript|module|application/javascript)", m[1]):
            continue
        for r in pattern_facts(f"{path}::script[{i}]", "JavaScript", m[2], text.count("\n", 0, m.start(2))):
            r["path"] = path
            rows.append(r)
    used = set(re.findall(r"(?i)\son\w+\s*=\s*[\"']\s*(\w+)\s*\(", text)) | set(re.findall(r"window\.(\w+)\s*=", text))
    for r in rows:
        if r["rel"] == "symbol" and r["name"] in used:
            r["is_entry_point"] = True
    return rows


_GROUP = re.compile(r"->group\s*\(\s*(?:function|fn|static function)|Route::group\s*\(")
_VERB_ROUTE = re.compile(r"(?:Route::|->)(get|post|put|patch|delete|any)\s*\(\s*['\"]([^'\"]*)['\"]")
_RESOURCE = re.compile(r"(?:Route::|->)(apiResource|resource)\s*\(\s*['\"]([^'\"]*)['\"]")
_MATCH = re.compile(r"Route::match\s*\(\s*\[([^\]]*)\]\s*,\s*['\"]([^'\"]*)['\"]")
# The routes of a resource, and which of them an interface keeps.
RESOURCE = (("get", ""), ("get", "/create"), ("post", ""), ("get", "/{id}"), ("get", "/{id}/edit"), ("put", "/{id}"), ("delete", "/{id}"))


def _words(text: str, name: str) -> list[str]:
    found = re.search(rf"{name}\s*\(\s*(\[[^\]]*\]|'[^']*'|\"[^\"]*\")|['\"]{name}['\"]\s*=>\s*(\[[^\]]*\]|'[^']*'|\"[^\"]*\")", text)
    return re.findall(r"['\"]([^'\"]+)['\"]", found[1] or found[2]) if found else []


def framework_routes(text: str, prefix: str = "") -> list[tuple[str, str, list[str], int]]:
    """(verb, path, middleware, line) of a route file, with the prefixes and the
    middleware of the groups around; `prefix` is that of the whole file."""
    out, frames, depth, statement, first = [], [], 0, "", 1
    for ln, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith(("//", "*", "#", "<?")):
            continue
        first = ln if not statement else first
        statement += line + "\n"
        opened, closed = line.count("{"), line.count("}")
        if _GROUP.search(statement) and opened:
            frames.append((depth, "/".join(_words(statement, "prefix")), _words(statement, "middleware")))
            statement = ""
        elif ";" in line:
            join = lambda p: "/" + "/".join(x.strip("/") for x in (prefix, *(f[1] for f in frames), p) if x.strip("/"))  # noqa: E731, B023
            guards = [m for f in frames for m in f[2]] + _words(statement, "middleware")
            if m := _RESOURCE.search(statement):
                parts = m[2].strip("/").split(".")
                base = "/".join(f"{x}/{{{x.rstrip('s')}}}" for x in parts[:-1]) + ("/" if parts[:-1] else "") + parts[-1]
                kept = [r for r in RESOURCE if m[1] == "resource" or r[1] not in ("/create", "/{id}/edit")]
                out += [(v, join(base) + p.replace("id", parts[-1].rstrip("s")), guards, first) for v, p in kept]
            elif m := _MATCH.search(statement):
                out += [(v.lower(), join(m[2]), guards, first) for v in re.findall(r"['\"](\w+)['\"]", m[1])]
            elif m := _VERB_ROUTE.search(statement):
                out.append((m[1], join(m[2]), guards, first))
            statement = ""
        depth += opened - closed
        while frames and depth <= frames[-1][0]:
            frames.pop()
            statement = ""
    return out


def safe_routes(path: str, text: str) -> list[tuple[str, str, list[str], int]]:
    """framework_routes() of a file under its own prefix, none if it cannot be read."""
    try:
        return framework_routes(text, "api" if path.endswith("api.php") else "")
    except Exception:  # noqa: BLE001
        return []


def facts(path: str, lang: str, text: str) -> list[dict]:
    try:
        if lang == "Python":
            return python_facts(path, text)
        if path.lower().endswith((".html", ".htm")):
            return html_facts(path, text)
        return pattern_facts(path, lang, text) if lang in _PATTERNS else []
    except Exception:  # noqa: BLE001  one file stops no other
        return [dict.fromkeys(FIELDS) | {"rel": "failure", "path": path, "lang": lang, "name": "ParseFailure", "seq": 0}]


def extract(files: DataFrame) -> DataFrame:
    """All facts of files (path, lang, text)."""
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = [r for path, lang, text in zip(p["path"], p["lang"], p["text"]) for r in facts(path, lang, text or "")]
            out = pd.DataFrame(rows, columns=FIELDS)
            for c in ("line_start", "line_end", "param_count"):
                out[c] = out[c].astype("Int32")
            out["seq"], out["is_entry_point"] = out["seq"].astype("Int64"), out["is_entry_point"].astype("boolean")
            yield out

    return files.filter(F.col("lang").isNotNull()).select("path", "lang", "text").mapInPandas(run, SCHEMA)


def relation(all_facts: DataFrame, rel: str) -> DataFrame:
    return all_facts.filter(F.col("rel") == rel).drop("rel")
