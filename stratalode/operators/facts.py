"""Code facts: definitions, scopes, bindings, imports and call sites, and their resolution.

One pass over the bodies emits all facts of a file; the tables are filters of
it.  Python files are read through the interpreter's syntax tree; Go, JavaScript
and TypeScript through patterns over text whose comments and strings are
blanked, which sees top-level and member definitions and plain calls.

Every call and every other use of a name is a site that ends with a certainty:
resolved (one definition), candidate (one definition behind an import or in another
file of a Go package, which other files might replace), or unresolved with the first
reason that applies: partial_parse, computed, member_of_unknown, unbound, ambiguous,
use_before_declaration, alias_cycle, not_callable (calls only), import_missing,
import_ambiguous, member_missing.  Names that were given another name are followed
to what they were first.
"""

from __future__ import annotations

import ast
import re
import warnings

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, extension
from ..sources.shared import cut
from .golang import packages, resolve_in_package
from .resolution import follow_aliases, nearest_binding, unique_match
from .rowmap import map_rows

SCHEMA = "fact string, path string, ordinal int, scope int, parent int, name string, kind string, value string, callable boolean, exported boolean, start_byte bigint, end_byte bigint, start_line int, end_line int"
#: Changes whenever these rules collect something else: facts collected by other rules are not kept.
RULES = "2"
LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.rows, self.scopes, self.sites, self.symbols, self.imports = path, [], 0, 0, 0, 0
        self.starts, n = [0], 0
        for line in text.split("\n"):
            n += len(line.encode()) + 1
            self.starts.append(n)
        self.stack: list[tuple[int, str, str]] = []
        self.references, self.conditions = 0, 0

    def at(self, node):
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def add(self, fact, node, ordinal, scope, parent, name, kind, value, callable_=None, exported=None):
        a, b = self.at(node) if node is not None and hasattr(node, "lineno") else (0, self.starts[-1] - 1)
        la, lb = (node.lineno, node.end_lineno) if node is not None and hasattr(node, "lineno") else (1, len(self.starts) - 1)
        self.rows.append((fact, self.path, ordinal, scope, parent, name, kind, value, callable_, exported, a, b, la, lb))

    def open(self, node, kind, name):
        k, parent = self.scopes, self.stack[-1][0] if self.stack else -1
        self.scopes += 1
        self.add("scope", node, k, k, parent, name, kind, None)
        self.stack.append((k, kind, name))
        return k

    def bind(self, node, name, kind, value):
        if self.conditions and kind in ("import", "alias", "definition"):
            kind, value = "unknown", f"conditional_{kind}"  # which branch ran is not known
        self.add("binding", node, None, self.stack[-1][0], None, name, kind, value)

    def qualified(self, name):
        return ".".join([n for _, k, n in self.stack if k != "module"] + [name])

    def run(self, tree):
        self.open(None, "module", "")
        for n in tree.body:
            self.visit(n)
        return self.rows

    def _define(self, node, kind):
        q = self.qualified(node.name)
        ident = f"{self.path}#{q}@{self.at(node)[0]}"
        self.add("symbol", node, self.symbols, self.stack[-1][0], None, q, kind, ident, True, len(self.stack) == 1 and not node.name.startswith("_"))
        for what, nodes in (("decorator", node.decorator_list), ("base", getattr(node, "bases", []))):
            for d in nodes:
                self.add("syntax", d, None, self.stack[-1][0], None, q, what, self.dotted(d.func if isinstance(d, ast.Call) else d))
        self.symbols += 1
        if self.stack[-1][1] != "class":
            self.bind(node, node.name, "definition", ident)
        for d in node.decorator_list:
            self.visit(d)
        self.open(node, "class" if kind == "class" else "function", node.name)
        outside, self.conditions = self.conditions, 0
        if kind != "class":
            args = node.args
            for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *([args.vararg] if args.vararg else []), *([args.kwarg] if args.kwarg else [])]:
                self.bind(a, a.arg, "unknown", "parameter")
        for n in node.body:
            self.visit(n)
        self.stack.pop()
        self.conditions = outside

    def visit_FunctionDef(self, node):
        self._define(node, "method" if self.stack[-1][1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        for b in node.bases:
            self.visit(b)
        self._define(node, "class")

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node, self.imports, self.stack[-1][0], None, a.asname or a.name.split(".")[0], "module", a.name)
            self.imports += 1
            self.bind(node, a.asname or a.name.split(".")[0], "import", a.name + "|")

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", node, self.imports, self.stack[-1][0], None, a.asname or a.name, "member", f"{module}|{a.name}")
            self.imports += 1
            self.bind(node, a.asname or a.name, "import", f"{module}|{a.name}")

    @staticmethod
    def dotted(node) -> str | None:
        """``a.b.c`` as written; None for anything computed."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    def _targets(self, target):
        if isinstance(target, ast.Name):
            yield target
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                yield from self._targets(t)
        elif isinstance(target, ast.Starred):
            yield from self._targets(target.value)

    def visit_Assign(self, node):
        self.visit(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name):
                alias = isinstance(node.value, ast.Name)
                self.bind(t, t.id, "alias" if alias else "unknown", node.value.id if alias else "assignment")
            else:
                for n in self._targets(t):
                    self.bind(n, n.id, "unknown", "assignment")
                if isinstance(t, (ast.Attribute, ast.Subscript)):
                    self.visit(t.value)

    def visit_AnnAssign(self, node):
        self.visit(node.annotation)
        if node.value is not None:
            self.visit(node.value)
        for n in self._targets(node.target):
            self.bind(n, n.id, "unknown", "assignment")

    def visit_NamedExpr(self, node):
        self.visit(node.value)
        self.bind(node.target, node.target.id, "unknown", "assignment")

    def _conditional(self, node):
        for t in (getattr(node, "target", None), *[i.optional_vars for i in getattr(node, "items", [])]):
            for n in self._targets(t):
                self.bind(n, n.id, "unknown", "assignment")
        self.conditions += not isinstance(node, (ast.With, ast.AsyncWith))
        self.generic_visit(node)
        self.conditions -= not isinstance(node, (ast.With, ast.AsyncWith))

    visit_If = visit_Try = visit_TryStar = visit_For = visit_AsyncFor = visit_While = visit_With = visit_AsyncWith = visit_Match = _conditional

    def owner(self):
        return next((n for _, k, n in reversed(self.stack) if k == "function"), None)

    def visit_Call(self, node):
        f = node.func
        if isinstance(f, ast.Name):
            name, kind = f.id, "name"
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            name, kind = f"{f.value.id}.{f.attr}", "member"
        else:
            name, kind = None, "computed"
            self.visit(f)
        self.add("site", node, self.sites, self.stack[-1][0], None, name, kind, self.owner())
        self.sites += 1
        for n in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(n)

    def _refer(self, node, name, kind):
        self.add("reference", node, self.references, self.stack[-1][0], None, name, kind, self.owner())
        self.references += 1

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self._refer(node, node.id, "name")

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name) and isinstance(node.ctx, ast.Load):
            self._refer(node, f"{node.value.id}.{node.attr}", "member")
        else:
            self.visit(node.value)


_BLANK = {
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "js": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
}
_GO_DEF = re.compile(r"(?m)^func (?:\((?:\w+ )?\*?(?P<recv>\w+)[^)]*\) )?(?P<f>\w+)|^type (?P<t>\w+)(?:\[[^\]]*\])? (?P<k>struct|interface)?")
_JS_DEF = re.compile(r"(?m)^(?:export )?(?:default )?(?:async )?function\s*\*?\s*(?P<f>[\w$]+)|^(?:export )?(?:default )?(?:abstract )?class (?P<c>[\w$]+)|^(?:export )?(?:const|let|var) (?P<v>[\w$]+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)|^(?:export )?(?P<ik>interface|type) (?P<i>[\w$]+)|^[ \t]+(?:static |async |public |private |protected |\*|get |set )*(?P<m>[\w$]+)\s*\([^()\n]*\)\s*(?::[^{\n]+)?\{")
_JS_IMPORT = re.compile(r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:(?P<d>[\w$]+)\s*,?\s*)?(?:\*\s*as\s+(?P<ns>[\w$]+)\s*|\{(?P<m>[^}]*)\}\s*)?from\s*['"](?P<s>[^'"\n]+)['"]|^[ \t]*(?:const|let|var)\s+(?:(?P<rd>[\w$]+)|\{(?P<rm>[^}]*)\})\s*=\s*require\(\s*['"](?P<rs>[^'"\n]+)['"]\s*\)""")
_GO_IMPORT = re.compile(r'(?m)^import\s*(?:\((?P<block>[^)]*)\)|(?P<one>[^\n(]*"[^"\n]+"))')
_GO_SPEC = re.compile(r'(?:^|[\n;])[ \t]*(?:(?P<a>[\w.]+)[ \t]+)?"(?P<s>[^"\n]+)"')
_GO_PACKAGE = re.compile(r"(?m)^package\s+(\w+)")
_ALIAS = re.compile(r"(?m)^(?:export )?(?:const|let|var) (?P<n>[\w$]+)(?:\s*:[^=\n]+)?\s*=\s*(?P<v>[A-Za-z_$][\w$]*)\s*;?[ \t]*$")
_DEFAULT = re.compile(r"(?m)^export default (?:async )?(?:function\s*\*?\s*|class )?(?P<n>[\w$]+)")
_CALL = re.compile(r"(?<![\w.$])(?P<a>[A-Za-z_$][\w$]*)(?:\.(?P<b>[A-Za-z_$][\w$]*))?\s*\(")
_NOT_CALL = {
    True: frozenset("if for switch return func import select case range defer go var const type map chan interface struct".split()),
    False: frozenset("if for while switch catch function return import require super typeof await new case async constructor".split()),
}


def _plain(path: str, text: str, go: bool) -> list[tuple]:
    blanked = _BLANK["go" if go else "js"].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ascii_only = text.isascii()
    place = (lambda i: i) if ascii_only else (lambda i: len(text[:i].encode()))
    size = place(len(text))
    rows = [("scope", path, 0, 0, -1, "", "module", None, None, None, 0, size, 1, text.count("\n") + 1)]
    rows += _plain_imports(path, text, blanked, go, place)
    n, klass, ends, heads = 0, "", [], []
    for m in (_GO_DEF if go else _JS_DEF).finditer(blanked):
        g = m.groupdict()
        if go:
            name = f"{g['recv']}.{g['f']}" if g["recv"] else g["f"] or g["t"]
            kind = "method" if g["recv"] else "function" if g["f"] else "interface" if g["k"] == "interface" else "type"
        else:
            if g["m"] and (g["m"] in _NOT_CALL[False] or not klass):
                continue
            name = f"{klass}.{g['m']}" if g["m"] else g["f"] or g["c"] or g["v"] or g["i"]
            kind = "method" if g["m"] else "class" if g["c"] else "function_value" if g["v"] else "function" if g["f"] else g["ik"]
            if not g["m"]:
                klass = g["c"] or ""
        a = place(m.start())
        ident = f"{path}#{name}@{a}"
        ok = kind in ("function", "method", "function_value", "class")
        line = blanked.count("\n", 0, m.start()) + 1
        ends.append((m.start(), name.rsplit(".", 1)[-1]))
        heads.append((m.start(), m.start() + len(re.match(r"[^(\n]*", m.group())[0])))
        out = name.rsplit(".", 1)[-1][:1].isupper() if go else text.startswith("export", m.start())
        rows.append(("symbol", path, n, 0, None, name, kind, ident, ok, out, a, place(m.end()), line, line))
        n += 1
        if kind != "method":
            rows.append(("binding", path, None, 0, None, name, "definition", ident if ok else None, None, None, a, a, line, line))
    k, h = 0, 0
    for m in _CALL.finditer(blanked):
        while h < len(heads) and heads[h][1] < m.start():
            h += 1
        if m["a"] in _NOT_CALL[go] or h < len(heads) and heads[h][0] <= m.start() <= heads[h][1]:
            continue
        name = f"{m['a']}.{m['b']}" if m["b"] else m["a"]
        owner = next((x for s, x in reversed(ends) if s <= m.start()), None)
        a = place(m.start())
        line = blanked.count("\n", 0, m.start()) + 1
        rows.append(("site", path, k, 0, None, name, "member" if m["b"] else "name", owner, None, None, a, place(m.end()), line, line))
        k += 1
    return rows


def _plain_imports(path: str, text: str, blanked: str, go: bool, place: Callable) -> list[tuple]:
    """Package clause, imports with the names they bind, plain aliases and the default export."""
    rows, k = [], 0

    def add(fact, m, name, kind, value):
        a, line = place(m.start()), text.count("\n", 0, m.start()) + 1
        rows.append((fact, path, k if fact == "import" else None, 0, None, name, kind, value, None, None, a, place(m.end()), line, line))

    def bound(m, local, spec, what):
        nonlocal k
        add("import", m, local, "member" if what else "module", f"{spec}|{what}")
        add("binding", m, local, "import", f"{spec}|{what}")
        k += 1

    if go:
        p = _GO_PACKAGE.search(blanked)
        if p:
            add("package", p, p[1], "package", None)
        for m in _GO_IMPORT.finditer(text):
            if blanked[m.start()] == "i":
                for x in _GO_SPEC.finditer(m["block"] or m["one"]):
                    if x["a"] not in ("_", "."):
                        bound(m, x["a"] or x["s"].rsplit("/", 1)[-1], x["s"], "")
        return rows
    for m in _JS_IMPORT.finditer(text):
        if not blanked[m.start() : m.end()].strip().startswith(("import", "const", "let", "var")):
            continue
        spec = m["s"] or m["rs"]
        if m["d"]:
            bound(m, m["d"], spec, "default")
        if m["ns"] or m["rd"]:
            bound(m, m["ns"] or m["rd"], spec, "")
        for part in (m["m"] or m["rm"] or "").split(","):
            names = re.findall(r"[\w$]+", re.sub(r"\btype\s+", "", part))
            if names:
                bound(m, names[-1], spec, names[0])
    for m in _ALIAS.finditer(blanked):
        if m["v"] not in ("true", "false", "null", "undefined", "this", "new", "async", "function"):
            add("binding", m, m["n"], "alias", m["v"])
    for m in _DEFAULT.finditer(blanked):
        if m["n"] not in ("function", "class", "async"):
            add("default", m, m["n"], "default", None)
    return rows


def facts_of(path: str, text: str) -> list[tuple]:
    """All facts of one file; a file that does not parse has one ``error`` row and no sites."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            return _Python(path, text).run(tree)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            line = getattr(e, "lineno", None) or 1
            return [("error", path, 0, None, None, None, type(e).__name__, None, None, None, 0, len(text.encode()), line, line)]
    return _plain(path, text, ext == "go")


def collect(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Facts of all files in the four languages, written once to the shared folder; null bodies give none."""
    src = files.where(F.col(body).isNotNull() & extension(path).isin(*LANGUAGES)).select(F.col(path).alias("p"), F.col(body).alias("b"))
    return cut(map_rows(src, lambda: lambda p, b: facts_of(p, b), SCHEMA))


def symbols(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'symbol'").select(F.col("value").alias("id"), "path", "ordinal", "name", "kind", "callable", "exported", "start_byte", "end_byte", "start_line", "end_line")


def sites(facts: DataFrame) -> DataFrame:
    """Calls and other uses of names, with their ``role``."""
    role = F.when(F.col("fact") == "site", "call").otherwise("reference")
    ident = F.concat_ws(":", "path", F.concat(F.when(role == "call", "").otherwise("r"), F.col("ordinal").cast("string")))
    return facts.where("fact in ('site', 'reference')").select(ident.alias("site_id"), "path", "ordinal", "scope", "name", "kind", role.alias("role"), F.col("value").alias("caller"), "start_byte", "end_byte")


def exports(facts: DataFrame) -> DataFrame:
    """``path, exports, digest``: how many definitions a file offers to others, and a digest of them that is the same as long as they are."""
    e = facts.where("fact = 'symbol' and exported").select("path", F.concat_ws(":", "kind", "name").alias("item"))
    per = e.groupBy("path").agg(F.array_sort(F.collect_list("item")).alias("items"))  # the definitions of one file
    return per.select("path", F.size("items").alias("exports"), F.sha2(F.array_join("items", "\n"), 256).alias("digest"))


def module_path(path, module):
    """Candidate file of a module name as a column: relative dots climb from the importing file, other names start at the root."""
    from .imports import target_path

    return target_path(path, module, F.lit(""))


def submodule(module, what, inner):
    """``from module import what`` followed by ``what.x`` names the module below, not a member."""
    return F.when(inner, F.concat(module, F.when(module.endswith("."), F.lit("")).otherwise(F.lit(".")), what)).otherwise(module)


_PART = "\x1f"


def _bindings(facts: DataFrame) -> DataFrame:
    """``path, scope, name, value``: kind, value, scope and place of every binding as one text, for the nearest-scope lookup."""
    text = F.concat_ws(_PART, "kind", F.coalesce("value", F.lit("")), F.col("scope").cast("string"), F.col("start_byte").cast("string"))
    return facts.where("fact = 'binding'").select("path", "scope", "name", text.alias("value"))


def _parts(value: str, *names: str) -> list:
    split = F.split(value, _PART)
    return [F.get(split, i).alias(n) for i, n in enumerate(names)]


def _first_names(facts: DataFrame, scopes: DataFrame, bound: DataFrame) -> DataFrame:
    """``key, fk, fv, fr``: for every binding that is another name, kind and value of what it names in the end, or why that isn't known."""
    key = lambda p, s, n: F.concat_ws(_PART, p, s.cast("string"), n)
    al = facts.where("fact = 'binding' and kind = 'alias'").select(key(F.col("path"), F.col("scope"), F.col("name")).alias("site_id"), "path", "scope", F.col("value").alias("name")).dropDuplicates(["site_id"])
    got = cut(nearest_binding(al, scopes, bound).select("site_id", "path", "name", "reason", *_parts("value", "k", "v", "s", "at")))
    chain = got.where("k is not null").select(F.col("site_id").alias("name"), key(F.col("path"), F.col("s"), F.col("name")).alias("target"))
    ends = follow_aliases(chain).select(F.col("name").alias("key"), F.col("final"), F.col("reason").alias("_loop"))
    # the end of a chain is the binding that its last name found
    last = got.where("k is not null and k <> 'alias'").select(key(F.col("path"), F.col("s"), F.col("name")).alias("final"), "k", "v").groupBy("final").agg(F.min("k").alias("fk"), F.min("v").alias("fv"))
    out = got.select(F.col("site_id").alias("key"), F.col("reason").alias("_own")).join(ends, "key", "left").join(last, "final", "left")
    return out.select("key", "fk", "fv", F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_loop").isNotNull(), "alias_cycle").when(F.col("fk").isNull(), "unbound").alias("fr"))


def resolve(facts: DataFrame) -> DataFrame:
    """``site_id, path, role, caller, name, kind, target_id, certainty, reason`` of every call and reference."""
    s = sites(facts)
    errors = facts.where("fact = 'error'").select("path").distinct().withColumn("_partial", F.lit(True))
    scopes = facts.where("fact = 'scope'").select("path", "ordinal", "parent")
    bound = _bindings(facts)
    first = F.substring_index("name", ".", 1)
    asked = s.where("name is not null").select("site_id", "path", "scope", "start_byte", F.col("name").alias("_full"), first.alias("name"))
    near = nearest_binding(asked, scopes, bound).select("site_id", "path", "name", "scope", "start_byte", F.col("reason").alias("br"), *_parts("value", "bk", "bv", "bs", "bat"))
    early = (F.col("bs") != "0") & (F.col("bs") == F.col("scope").cast("string")) & (F.col("bat").cast("bigint") > F.col("start_byte"))
    near = near.withColumn("br", F.when(early, "use_before_declaration").otherwise(F.col("br"))).withColumn("key", F.concat_ws(_PART, "path", "bs", "name"))
    near = near.join(_first_names(facts, scopes, bound), "key", "left")
    alias = F.col("bk") == "alias"
    got = near.select("site_id", F.when(alias, F.col("fk")).otherwise(F.col("bk")).alias("bk"), F.when(alias, F.col("fv")).otherwise(F.col("bv")).alias("bv"), F.coalesce("br", F.when(alias, F.col("fr"))).alias("br"))
    got = cut(got)
    # imported members: the one definition of that name in the one file that the module names
    defs = symbols(facts).where("callable").select("path", F.col("name").alias("member"), "id")
    named_default = facts.where("fact = 'default'").select("path", F.col("name").alias("member")).join(defs, ["path", "member"]).select("path", F.lit("default").alias("member"), "id")
    defs = defs.unionByName(named_default)
    stem = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/(?:__init__|index)$", "")
    stems = defs.select("path").distinct().where(extension("path") != "go").select(F.col("path"), stem.alias("stem"))
    want = s.join(got, "site_id").where("bk = 'import'").select("site_id", "path", "name", F.substring_index("bv", "|", 1).alias("module"), F.substring_index("bv", "|", -1).alias("what"))
    dotted, go = F.col("name").contains("."), extension("path") == "go"
    member = F.when(dotted, F.substring_index("name", ".", -1)).when(F.col("what") != "", F.col("what"))
    named = submodule(F.col("module"), F.col("what"), dotted & (F.col("what") != "") & (extension("path") == "py"))
    want = want.select("site_id", go.alias("go"), F.when(go, F.col("module")).otherwise(module_path(F.col("path"), named)).alias("stem"), member.alias("member"))
    hit = unique_match(want.where("not go"), stems.select("stem", F.col("path").alias("target_path")), ["stem"], "target_path").withColumnRenamed("reason", "_file")
    hit = unique_match(hit, defs.withColumnRenamed("path", "target_path"), ["target_path", "member"], "id")
    hit = hit.select("site_id", F.col("id").alias("_imported"), F.when(F.col("_file").isNotNull(), F.concat(F.lit("import_"), F.when(F.col("_file") == "missing", "missing").otherwise("ambiguous"))).when(F.col("id").isNull(), "member_missing").alias("_why"))
    # a Go import names a directory: the one definition of that name in its files
    godefs = defs.where(extension("path") == "go").select(dirname("path").alias("stem"), "member", "id")
    package = unique_match(want.where("go"), godefs, ["stem", "member"], "id").join(godefs.select("stem").distinct().withColumn("_there", F.lit(True)), "stem", "left")
    hit = hit.unionByName(package.select("site_id", F.col("id").alias("_imported"), F.when(F.col("id").isNull(), F.when(F.col("_there"), "member_missing").otherwise("import_missing")).alias("_why")))
    # names that a Go file doesn't bind may be bound by another file of its package
    open_ = s.join(got.where("br = 'unbound'").select("site_id"), "site_id", "left_semi").where(go & (F.col("kind") == "name")).select("site_id", "path", "name")
    whole = packages(facts.where("fact = 'scope' and parent = -1").where(go).select("path").join(facts.where("fact = 'package'").select("path", F.col("name").alias("package")), "path", "left").withColumn("reason", F.lit(None).cast("string")))
    shared = resolve_in_package(open_, facts.where("fact = 'binding' and kind = 'definition'").where(go).select("path", "name", "kind", "value"), whole).select("site_id", F.col("value").alias("_shared"))
    j = s.join(errors, "path", "left").join(got, "site_id", "left").join(hit, "site_id", "left").join(shared, "site_id", "left")
    own, called = (F.col("bk") == "definition") & (F.col("kind") == "name"), F.col("role") == "call"
    reason = (
        F.when(F.col("_partial"), "partial_parse").when(F.col("kind") == "computed", "computed").when(F.nullif("_shared", F.lit("")).isNotNull(), F.lit(None).cast("string"))
        .when((F.col("br") == "unbound") & (F.col("kind") == "member"), "member_of_unknown").when(F.col("br").isNotNull(), F.col("br")).when(F.col("bk") == "import", F.col("_why")).when(F.col("kind") == "member", "member_of_unknown")
        .when(~own | (F.col("bv") == ""), F.when(called, "not_callable").otherwise("no_definition"))
    )
    target = F.when(reason.isNull(), F.when(F.col("bk") == "import", F.col("_imported")).otherwise(F.coalesce(F.nullif("_shared", F.lit("")), F.col("bv"))))
    certainty = F.when(target.isNull(), "unresolved").when((F.col("bk") == "import") | F.col("_shared").isNotNull(), "candidate").otherwise("resolved")
    return j.select("site_id", "path", "role", "caller", "name", "kind", target.alias("target_id"), certainty.alias("certainty"), F.when(target.isNull(), reason).alias("reason"))


def faults(facts: DataFrame) -> DataFrame:
    """``path, fault, rows`` of facts that don't hang together: a scope, parent or range that isn't there.  Empty for what ``collect`` made; for facts that were stored or sent."""
    scopes = facts.where("fact = 'scope'").select("path", F.col("ordinal").alias("scope"), F.lit(True).alias("_there")).distinct()
    size = facts.where("fact = 'scope' and parent = -1").groupBy("path").agg(F.max("end_byte").alias("_n"))
    inside = facts.where("fact not in ('scope', 'error')").join(scopes, ["path", "scope"], "left").join(size, "path", "left")
    fault = F.when(F.col("_there").isNull(), "unknown_scope").when((F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte")) | (F.col("end_byte") > F.col("_n")), "range_outside_source")
    a = inside.select("path", fault.alias("fault"))
    parents = facts.where("fact = 'scope' and parent >= 0").select("path", F.col("parent").alias("scope")).join(scopes, ["path", "scope"], "left_anti").select("path", F.lit("unknown_parent").alias("fault"))
    twice = facts.where("fact = 'scope'").groupBy("path", "ordinal").count().where("count > 1").select("path", F.lit("repeated_scope").alias("fault"))
    return a.where("fault is not null").unionByName(parents).unionByName(twice).groupBy("path", "fault").agg(F.count("*").alias("rows"))
