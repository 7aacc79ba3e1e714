"""Framework registrations: routes, commands and jobs that call code by configuration.

Python files are read through the syntax tree.  A registration becomes a
``framework`` row if everything it names is literal and what registers is the
framework's by the file's own imports (a look-alike is not), else a ``framework_boundary``
row with the reason, so that what is not known stays visible.  Callbacks are
resolved to definitions by the module-level bindings of their file and the files
these import from.
"""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from .facts import module_path, submodule, symbols
from .resolution import unique_match
from .rowmap import map_rows

SCHEMA = "path string, family string, kind string, pattern string, callback string, reason string, start_line int, end_line int"
ROUTE_CALLS = ("path", "re_path", "url")
# Where the frameworks define what registers, as full names.
DJANGO_ROUTES = frozenset(f"{m}.{f}" for m, fs in (("django.urls", ("path", "re_path", "include")), ("django.urls.conf", ("path", "re_path", "include")), ("django.conf.urls", ("url", "include"))) for f in fs)
DJANGO_COMMANDS = frozenset(f"{m}.{c}" for m in ("django.core.management", "django.core.management.base") for c in ("BaseCommand", "AppCommand", "LabelCommand"))
ODOO_ROUTES = frozenset(("odoo.http.route", "openerp.http.route"))


def _name(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _name(node.value)):
        return f"{base}.{node.attr}"
    return None


def bound_names(tree: ast.Module) -> dict[str, str | None]:
    """Full names of what a module's own names are imported as; None for a name that is bound otherwise, twice or under a condition."""
    out: dict[str, str | None] = {}

    def bind(name, full):
        out[name] = None if name in out else full

    for n in tree.body:
        if isinstance(n, ast.Import):
            for a in n.names:
                if a.asname or a.name.split(".")[0] not in out or out[a.name.split(".")[0]] != a.name.split(".")[0]:
                    bind(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
        elif isinstance(n, ast.ImportFrom) and not n.level:
            for a in n.names:
                bind(a.asname or a.name, f"{n.module}.{a.name}")
        else:
            for x in ast.walk(n):
                if isinstance(x, (ast.Import, ast.ImportFrom)) and not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    for a in x.names:
                        out[a.asname or a.name.split(".")[0]] = None
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AnnAssign, ast.AugAssign)) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    out[t.id] = None
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out[n.name] = None
    return out


def full_name(node, names: dict[str, str | None]) -> str | None:
    """What an expression names, whatever it is called here; None if the file's imports don't say."""
    first, _, rest = (_name(node) or "").partition(".")
    full = names.get(first)
    return full and (f"{full}.{rest}" if rest else full)


def proven(node, names: dict[str, str | None], wanted: frozenset[str]) -> bool:
    return full_name(node, names) in wanted


def _text(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _django(path: str, tree: ast.Module) -> list[tuple]:
    out, names = [], bound_names(tree)
    targets = [n for n in tree.body if isinstance(n, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in (n.targets if isinstance(n, ast.Assign) else [n.target]))]
    mutated = len(targets) > 1 or any(isinstance(n, ast.Call) and (_name(n.func) or "").startswith("urlpatterns.") for n in ast.walk(tree))
    for t in targets:
        if not isinstance(t.value, (ast.List, ast.Tuple)):
            out.append((path, "django", "route", None, None, "computed_list", t.lineno, t.end_lineno))
            continue
        for e in t.value.elts:
            known = isinstance(e, ast.Call) and proven(e.func, names, DJANGO_ROUTES)
            call = ((full_name(e.func, names) if known else _name(e.func)) or "").rsplit(".", 1)[-1] if isinstance(e, ast.Call) else ""
            if call not in ROUTE_CALLS:
                out.append((path, "django", "route", None, None, "computed_entry", e.lineno, e.end_lineno))
                continue
            args = dict(enumerate(e.args)) | {k.arg: k.value for k in e.keywords}
            pattern, view = args.get(0, args.get("route", args.get("regex"))), args.get(1, args.get("view"))
            literal, callback, reason = _text(pattern) if pattern is not None else None, None, None
            kind = "route"
            if isinstance(view, ast.Call) and (_name(view.func) or "").rsplit(".", 1)[-1] == "include":
                kind = "include"
                callback = _text(view.args[0]) if view.args else None
                reason = None if callback else "computed_include"
            elif isinstance(view, ast.Call) and (_name(view.func) or "").endswith(".as_view"):
                callback = _name(view.func).rsplit(".", 1)[0]
            elif isinstance(view, ast.Lambda):
                reason = "lambda"
            else:
                callback = _name(view) if view is not None else None
                reason = None if callback else "missing_view" if view is None else "computed_view"
            out.append((path, "django", kind, literal, callback, "mutated" if mutated else "api_identity_unproven" if not known else reason or (None if literal is not None else "computed_pattern"), e.lineno, e.end_lineno))
    if "/management/commands/" in f"/{path}" and not path.rsplit("/", 1)[-1].startswith("_"):
        for n in tree.body:
            if isinstance(n, ast.ClassDef) and n.name == "Command":
                handles = any(isinstance(m, ast.FunctionDef) and m.name == "handle" for m in n.body)
                out.append((path, "django", "command", path.rsplit("/", 1)[-1][:-3], "Command.handle" if handles else None, "api_identity_unproven" if not any(proven(b, names, DJANGO_COMMANDS) for b in n.bases) else None if handles else "no_handle", n.lineno, n.end_lineno))
    return out


def _odoo(path: str, tree: ast.Module) -> list[tuple]:
    out, names = [], bound_names(tree)
    for c in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        model = next((_text(s.value) for s in c.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id in ("_name", "_inherit") for t in s.targets)), None)
        for m in (n for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))):
            if model:
                out.append((path, "odoo", "model_method", f"{model}.{m.name}", f"{c.name}.{m.name}", None, m.lineno, m.end_lineno))
            for d in m.decorator_list:
                if isinstance(d, ast.Call) and (_name(d.func) or "") in ("http.route", "route"):
                    first = d.args[0] if d.args else next((k.value for k in d.keywords if k.arg == "route"), None)
                    parts = first.elts if isinstance(first, (ast.List, ast.Tuple)) else [first]
                    for x in parts:
                        p = _text(x) if x is not None else None
                        out.append((path, "odoo", "route", p, f"{c.name}.{m.name}", "api_identity_unproven" if not proven(d.func, names, ODOO_ROUTES) else None if p is not None else "inherited_pattern" if x is None else "computed_pattern", m.lineno, m.end_lineno))
    return out


def registrations_of(path: str, text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return _django(path, tree) + _odoo(path, tree)


def registrations(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Registrations of all Python files; only bodies that mention a registration's words are parsed."""
    hint = F.col(body).rlike(r"\burlpatterns\b|\bclass Command\b|\broute\(|\b_name\s*=|\b_inherit\s*=")
    src = files.where((extension(path) == "py") & hint).select(F.col(path).alias("path"), F.col(body).alias("b"))
    rows = map_rows(src, lambda: lambda p, b: registrations_of(p, b), SCHEMA)
    return rows.withColumn("role", F.when(F.col("reason").isNull(), "framework").otherwise("framework_boundary"))


def cron_jobs(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """``record_id, target, certainty, reason`` of scheduled jobs in XML configuration: the model method they call.

    ``fields``: rows of ``sources.xmlconfig.configuration``; ``methods``: registrations of
    kind model_method.  An identity that several records claim is unresolved.
    """
    jobs = fields.where("model = 'ir.cron'")
    per = jobs.groupBy("path", "ordinal", "record_id").agg(F.max(F.when(F.col("field") == "model_id", F.col("attributes")["ref"])).alias("ref"), F.max(F.when(F.col("field") == "code", F.col("content"))).alias("code"))
    dup = per.groupBy("record_id").agg(F.count("*").alias("n"))
    model = F.translate(F.regexp_replace(F.regexp_replace("ref", r"^.*\.", ""), "^model_", ""), "_", ".")
    call = F.regexp_extract("code", r"^\s*model\.(\w+)\(\s*\)\s*$", 1)
    j = per.join(dup, "record_id").select("record_id", "n", F.when(F.col("ref").isNotNull() & (call != ""), F.concat(model, F.lit("."), call)).alias("pattern"))
    out = unique_match(j, methods.where("kind = 'model_method'").select("pattern", F.concat_ws("#", "path", "callback").alias("target")), ["pattern"], "target")
    reason = F.when(F.col("n") > 1, "duplicate_identity").when(F.col("pattern").isNull(), "computed_call").otherwise(F.col("reason"))
    return out.select("record_id", F.when(reason.isNull(), F.col("target")).alias("target"), F.when(reason.isNull(), "resolved").otherwise("unresolved").alias("certainty"), reason.alias("reason"))


def callbacks(regs: DataFrame, facts: DataFrame) -> DataFrame:
    """``target_id`` of each registration's callback, or why it has none."""
    r = regs.where("callback is not null and kind in ('route', 'command')")
    first = F.substring_index("callback", ".", 1)
    bound = facts.where("fact = 'binding' and scope = 0").select("path", "name", F.concat_ws("\x1f", "kind", F.coalesce("value", F.lit(""))).alias("v"))
    j = unique_match(r.withColumn("name", first), bound, ["path", "name"], "v")
    defs = symbols(facts).where("callable").select(F.col("path").alias("target_path"), F.col("name").alias("member"), "id")
    stems = defs.select("target_path").distinct().withColumn("stem", F.regexp_replace(F.regexp_replace("target_path", r"\.\w+$", ""), "/__init__$", ""))
    kind, value = F.substring_index("v", "\x1f", 1), F.substring_index("v", "\x1f", -1)
    module, what = F.substring_index(value, "|", 1), F.substring_index(value, "|", -1)
    inner = (what != "") & F.col("callback").contains(".")
    member = F.when(kind == "definition", F.col("callback")).when((what != "") & ~inner, what).otherwise(F.expr("substring(callback, length(name) + 2)"))
    j = j.withColumn("member", member).withColumn("stem", F.when(kind == "import", module_path(F.col("path"), submodule(module, what, inner))))
    imported = unique_match(j.where("stem is not null").drop("reason"), stems, ["stem"], "target_path").drop("reason")
    local = j.where("stem is null").withColumn("target_path", F.when(F.col("v").isNotNull(), F.col("path"))).drop("reason")
    both = unique_match(local.unionByName(imported), defs, ["target_path", "member"], "id")
    return both.select("path", "family", "kind", "pattern", "callback", F.col("id").alias("target_id"), F.when(F.col("id").isNull(), F.coalesce("reason", F.lit("missing"))).alias("why"))
