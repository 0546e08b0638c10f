"""Code index: symbols, imports and calls of source files, and what imports and calls resolve to.

Parsing is sequential and goes through Python table functions over one file's text; everything after is joins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import small_batches

PARSED = "path string, parse_status string, kind string, name string, qualified_name string, parent string, start_line int, end_line int, module string, alias string, level int, caller string, start_col int, end_col int"


def longest_prefix(rows: DataFrame, key: str, parts: str, joiner: str, known: DataFrame) -> DataFrame:
    """key, target: the longest beginning of ``parts`` that is one of ``known`` (target)."""
    each = rows.select(key, parts, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    each = each.select(key, "n", F.array_join(F.slice(parts, 1, F.col("n")), joiner).alias("target"))
    return each.join(known, "target").groupBy(key).agg(F.max_by("target", "n").alias("target"))


def unique_candidate(rows: DataFrame, key: str, endings: list[str], known: DataFrame) -> DataFrame:
    """key, target: the one of ``base`` + ending that is known (path); none where several are."""
    each = rows.select(key, F.explode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(F.col("base"), e))).alias("path"))
    found = each.join(known, "path").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target"))
    return found.filter("n = 1").drop("n")


def _bound(function: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[str]:
    """Names of a function's parameters and of what it assigns, at any depth."""
    own = function.args
    yield from (a.arg for a in (*own.posonlyargs, *own.args, *own.kwonlyargs, own.vararg, own.kwarg) if a is not None)
    yield from (x.id for x in ast.walk(function) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store))


def _parse(path: str, text: str) -> Iterator[tuple]:
    """Rows of one Python file: symbols, imports, calls (alias "bound" where the outermost function binds the name itself), module-level aliases of names."""
    row = lambda **x: tuple(x.get(c.split()[0]) for c in PARSED.split(", "))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield row(path=path, parse_status="error", kind="file")
        return
    yield row(path=path, parse_status="ok", kind="file")
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Name):
            yield row(path=path, parse_status="ok", kind="alias", name=node.value.id, alias=node.targets[0].id, start_line=node.lineno)
    # direct: nothing but the module, or a class of the module's own body, lies around; only such functions are callers
    waiting: list[tuple[ast.AST, tuple[str, ...], str | None, str | None, frozenset[str], bool]] = [(tree, (), None, None, frozenset(), True)]
    while waiting:
        node, scope, inside, caller, bound, direct = waiting.pop()
        for child in ast.iter_child_nodes(node):
            below, holder, who, held, plain = scope, inside, caller, bound, False
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join((*scope, child.name))
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                yield row(path=path, parse_status="ok", kind=kind, name=child.name, qualified_name=name, parent=".".join(scope), start_line=child.lineno, end_line=child.end_lineno, start_col=child.col_offset, end_col=child.end_col_offset)
                below, holder = (*scope, child.name), "class" if kind == "class" else "function"
                plain = kind == "class" and node is tree
                if kind != "class" and direct:
                    who, held = name, frozenset(_bound(child))
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield row(path=path, parse_status="ok", kind="import", module=a.name, name=None, alias=a.asname or a.name.split(".")[0], level=0, parent="" if node is tree else "*", start_line=child.lineno)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield row(path=path, parse_status="ok", kind="import", module=child.module or "", name=a.name, alias=a.asname or a.name, level=child.level, parent="" if node is tree else "*", start_line=child.lineno)
            elif isinstance(child, ast.Call):
                f = child.func
                own = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self"
                name = f.id if isinstance(f, ast.Name) else f.attr if own else None
                if name:
                    owner = caller.rpartition(".")[0] if caller else None
                    yield row(path=path, parse_status="ok", kind="self_call" if own else "call", name=name, caller=caller, parent=owner, alias="bound" if name in bound else None, start_line=child.lineno)
                if dotted := _dotted(f):
                    yield row(path=path, parse_status="ok", kind="called", name=dotted, start_line=child.lineno)
            waiting.append((child, below, holder, who, held, plain))


def _dotted(node: ast.AST) -> str:
    """What a call names, with what it is an attribute of as far as that has names."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


#: Rows of a task's result that are made at once, and characters of text that are taken for them.
ROWS, CHARS = 5_000, 4_000_000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the files in ``batches`` (path, text), in blocks of bounded size; one file's text at a time is a Python string."""
    rows, chars = [], 0
    for batch in batches:
        paths, texts = batch.column("path"), batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            rows.extend(_parse(paths[i].as_py(), text))
            chars += len(text)
            if len(rows) >= ROWS or chars >= CHARS:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def parsed_python(files: DataFrame) -> DataFrame:
    """All rows of _parse() for ``files`` (path, text); each file is parsed once, in the task that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int32() if kind == "int" else pa.string()) for n, kind in (c.split() for c in PARSED.split(", "))])
        for rows in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    small_batches(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, PARSED)


#: Fixed value: how a script names what it imports.
SCRIPT_IMPORT = r"""(?:import\s+(?:[^'"]+\s+from\s+)?|require\()\s*['"]([^'"]+)['"]"""


def script_imports(files: DataFrame) -> DataFrame:
    """path, raw: what JavaScript and TypeScript files import or require."""
    found = F.regexp_extract_all("text", F.lit(SCRIPT_IMPORT), 1)
    return files.select("path", F.explode(F.array_distinct(found)).alias("raw"))


def module_candidates(module: Column) -> Column:
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


IMPORT = ["path", "module", "name", "alias", "level"]


def python_targets(imports: DataFrame) -> DataFrame:
    """Each import with each file it may mean: n, how many of its parts name it, and target."""
    folder = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - F.col("level"), F.lit(0)))
    head = F.when(F.col("level") > 0, folder).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.split("module", r"\."), lambda x: x != "")
    full = F.concat(head, own, F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    each = imports.withColumn("parts", full).withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts")))))
    return each.withColumn("target", F.explode(module_candidates(F.array_join(F.slice("parts", 1, F.col("n")), ".")))).select(*IMPORT, "n", "target")


def resolved_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, module, name, alias, target: the longest beginning of an absolute or relative import that is exactly one file.

    An import that two files fit at its longest fitting length resolves to none.
    """
    each = python_targets(imports)
    met = each.join(files.select(F.col("path").alias("target")), "target").groupBy(*IMPORT, "n").agg(F.count(F.lit(1)).alias("fits"), F.min("target").alias("target"))
    best = met.groupBy(*IMPORT).agg(F.max_by(F.struct("fits", "target"), "n").alias("b"))
    return best.filter("b.fits = 1").select(*IMPORT, F.col("b.target").alias("target"))


#: Endings by which a script import may name a file.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]


def script_bases(imports: DataFrame) -> DataFrame:
    """path, raw, base: what relative imports (path, raw) name, without its ending; none that leave the root."""
    folder = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    walk = F.aggregate(
        F.split("raw", "/"), F.struct(folder.alias("at"), F.lit(False).alias("out")),
        lambda s, x: F.when(x.isin("", "."), s)
        .when(x == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out")))
        .otherwise(F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["out"].alias("out"))),
    )
    rows = imports.filter(F.col("raw").startswith(".")).withColumn("w", walk).filter("not w.out")
    return rows.select("path", "raw", F.array_join("w.at", "/").alias("base"))


def script_targets(imports: DataFrame) -> DataFrame:
    """path, target: every file that a relative import may mean."""
    return script_bases(imports).select("path", F.explode(F.transform(F.array(*map(F.lit, SCRIPT_ENDINGS)), lambda x: F.concat("base", x))).alias("target"))


def resolved_scripts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, raw, target of relative imports (path, raw) that fit exactly one file; none that leave the root."""
    rows = script_bases(imports).select(F.struct("path", "raw").alias("key"), "base")
    return unique_candidate(rows, "key", SCRIPT_ENDINGS, files.select("path")).select("key.path", "key.raw", "target")


def calls(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, caller, target_path, target: calls of functions of the same file, of methods through self, of imported functions.

    Callers are the functions of a module's own body and the methods of its classes, for all calls anywhere inside. A name may
    be a function of the file (also by an alias of the module) and an imported one as well: both are called. Names that the
    caller binds itself aren't the imported ones. Of imports of one name in the module's body the last that is a single
    function counts. Calls of itself are left out.
    """
    functions = parsed.filter("kind = 'function' and parent = ''").groupBy("path", "name").agg(F.count(F.lit(1)).alias("times"))
    here = functions.select("path", "name")
    methods = parsed.filter("kind = 'method' and parent <> '' and not contains(parent, '.')").select("path", "name", "parent", "qualified_name").distinct()
    plain = parsed.filter("kind = 'call' and caller is not null and not contains(caller, '.')").select("path", "caller", "name", "alias")
    aliases = parsed.filter("kind = 'alias'").join(here, ["path", "name"]).groupBy("path", F.col("alias").alias("name")).agg(F.max_by("name", "start_line").alias("meant"))
    meant = plain.join(aliases, ["path", "name"], "left").select("path", "caller", F.coalesce("meant", "name").alias("name"))
    same = meant.join(here, ["path", "name"]).filter("caller <> name").select("path", "caller", F.col("path").alias("target_path"), F.col("name").alias("target"))
    through = parsed.filter("kind = 'self_call' and parent <> ''").select("path", "caller", "name", "parent")
    own = through.join(methods, ["path", "name", "parent"]).filter("caller <> qualified_name").select("path", "caller", F.col("path").alias("target_path"), F.col("qualified_name").alias("target"))
    told = parsed.filter("kind = 'import' and parent = '' and name is not null").select("path", "module", "name", "alias", "level", "start_line")
    there = functions.filter("times = 1").select(F.col("path").alias("target"), "name")
    imported = told.join(resolved, ["path", "module", "name", "alias", "level"]).join(there, ["target", "name"])
    imported = imported.groupBy("path", "alias").agg(F.max_by(F.struct("target", "name"), "start_line").alias("meant"))
    far = plain.filter("alias is null").select("path", "caller", F.col("name").alias("alias")).join(imported, ["path", "alias"])
    far = far.select("path", "caller", F.col("meant.target").alias("target_path"), F.col("meant.name").alias("target")).filter("path <> target_path or caller <> target")
    return same.unionByName(own).unionByName(far).distinct()


#: A file's language by its ending, or by its whole name.
LANGUAGES = {
    "python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "shell": ["sh", "bash", "zsh"],
    "markdown": ["md", "markdown"], "json": ["json"], "toml": ["toml"], "yaml": ["yaml", "yml"],
}
NAMED_LANGUAGES = {"Dockerfile": "dockerfile"}
SCRIPTS = ["javascript", "typescript"]
#: How scripts name functions, classes and variables, and what they call; words that aren't calls.
SCRIPT_SYMBOL = r"(?=[aceflv])\b(?:export\s+)?(?:(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=)"
SCRIPT_CALLED = r"\b([A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)?+)\s*+\z"  # before a parenthesis
NO_CALLS = ["if", "for", "while", "switch", "catch", "function"]
#: Effects by the packages a file imports, and by what it calls.
EFFECT_PACKAGES = {
    "crypto": ["hashlib", "crypto", "bcrypt", "jwt"], "db": ["sqlite", "sqlite3", "psycopg", "mysql", "sqlalchemy", "prisma"],
    "fs": ["os", "pathlib", "shutil", "fs"], "net": ["requests", "urllib", "http", "axios"], "time": ["time", "datetime"],
}
EFFECT_CALLS = {
    "crypto": ["hashlib.sha256", "hashlib.md5", "crypto.createHash"], "db": ["execute", "executemany", "query", "transaction"], "fs": ["open", "read_text", "write_text", "readFile", "writeFile"],
    "net": ["fetch", "axios", "requests.get", "requests.post", "urllib.request.urlopen"], "time": ["sleep", "datetime.now", "Date.now", "setTimeout", "setInterval"],
}


def language(path: Column) -> Column:
    """The language of a file by its name; ``unknown`` for others."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    known = [F.when(name == k, v) for k, v in NAMED_LANGUAGES.items()] + [F.when(ending.isin(endings), k) for k, endings in LANGUAGES.items()]
    return F.coalesce(*known, F.lit("unknown"))


def _effects(imports: Column, called: Column) -> Column:
    """Sorted effects: a package is meant by its name and by everything under it."""
    under = lambda names: F.exists(imports, lambda x: F.concat(x, F.lit(".")).rlike(f"^({'|'.join(names)})\\."))
    among = lambda names: F.exists(called, lambda x: x.isin(names))
    by_import = [F.when(under(names), F.lit(effect)) for effect, names in EFFECT_PACKAGES.items()]
    by_call = [F.when(among(names), F.lit(effect)) for effect, names in EFFECT_CALLS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*by_import, *by_call))))


def file_index(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """path, language, status, symbols, imports, calls, packages, effects of ``files`` (path, text): sorted names, each once.

    ``parsed`` holds what ``parsed_python`` gave for its Python files, where that is at hand; else they are parsed here.
    A Python file that can't be parsed has the status parse_error, one of another language skipped; both without names.
    """
    sorted_set = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda y: y != "")))
    kinds = F.col("kind")
    if parsed is None:
        parsed = parsed_python(files.filter(language(F.col("path")) == "python"))
    base = F.concat(F.repeat(F.lit("."), F.coalesce("level", F.lit(0))), "module")
    raw = F.when(F.col("name").isNull(), F.col("module")).when(F.col("module") == "", F.concat(base, "name")).otherwise(F.concat_ws(".", base, "name"))
    what = F.when(kinds.isin("class", "function", "method"), "symbol").when(kinds == "import", "import").when(kinds == "called", "call")
    value = F.when(kinds == "import", raw).otherwise(F.col("name"))
    named = parsed.groupBy("path", "parse_status").agg(*[F.collect_set(F.when(what == k, value)).alias(f"{k}s") for k in ("symbol", "import", "call")])
    named = named.select("path", F.when(F.col("parse_status") == "ok", "ok").otherwise("parse_error").alias("status"), "symbols", "imports", "calls")
    text, all_of = F.coalesce("text", F.lit("")), lambda pattern, i: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){pattern}"), i)
    defined = F.transform(all_of(SCRIPT_SYMBOL, 0), lambda x: F.concat(*[F.regexp_extract(x, f"(?U){SCRIPT_SYMBOL}", i) for i in (1, 2)]))  # one of the two is empty
    before = F.split(text, r"\(")  # and what is after the last one
    called = F.transform(F.slice(before, 1, F.size(before) - 1), lambda x: F.regexp_extract(x, f"(?U){SCRIPT_CALLED}", 1))  # empty where nothing is called
    scripts = files.filter(language(F.col("path")).isin(SCRIPTS)).select(
        "path", F.lit("ok").alias("status"), defined.alias("symbols"), F.regexp_extract_all(text, F.lit(SCRIPT_IMPORT), 1).alias("imports"),
        F.filter(called, lambda x: ~x.isin(NO_CALLS)).alias("calls"),
    )
    none = F.array().cast("array<string>")
    others = files.filter(~language(F.col("path")).isin("python", *SCRIPTS)).select("path", F.lit("skipped").alias("status"), none.alias("symbols"), none.alias("imports"), none.alias("calls"))
    rows = named.unionByName(scripts).unionByName(others)
    rows = rows.select("path", language(F.col("path")).alias("language"), "status", *[sorted_set(F.col(c)).alias(c) for c in ("symbols", "imports", "calls")])
    packages = F.array_sort(F.array_distinct(F.filter(F.transform("imports", lambda x: F.substring_index(x, ".", 1)), lambda x: x != "")))
    return rows.withColumn("packages", packages).withColumn("effects", _effects(F.col("imports"), F.col("calls")))


def observed_effects(imports: DataFrame, calls: DataFrame, hints: DataFrame) -> DataFrame:
    """path, effects: hints (effect, module, call) that a file's imports begin with or its calls equal."""
    by_import = imports.join(F.broadcast(hints.filter("module is not null")), F.expr("imports_module = module or startswith(imports_module, concat(module, '.'))")).select("path", "effect")
    by_call = calls.join(F.broadcast(hints.filter("call is not null")), "call").select("path", "effect")
    return by_import.union(by_call).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("effects"))
