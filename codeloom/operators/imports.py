"""Import resolution by language: rewrite rules, candidate paths in order, and joins with three indexes of the files.

Every import is turned into the candidates that its language tries, each with its place in the order; rules (path
aliases, module roots, namespace folders) are found by joining an import's own prefixes, the longest rule first. The
candidates then meet the files by equality only: by whole path, by path suffix (one file for each suffix, the shortest),
or by folder. The first candidate that meets a file wins; a package import brings all files of the folder.

imports (file, language, spec), files (path), rules (language, prefix, target). A null spec resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings that are tried, in order.
SCRIPT = ["", ".tsx", ".ts", ".mts", ".cts", ".jsx", ".js", ".mjs", ".cjs", ".vue", "/index.tsx", "/index.ts", "/index.jsx", "/index.js"]
ENDINGS = {
    "typescript": SCRIPT, "javascript": SCRIPT, "python": [".py", "/__init__.py"], "java": [".java", ".kt", ".kts"], "kotlin": [".kt", ".kts", ".java"],
    "c": ["", ".h", ".c"], "cpp": ["", ".h", ".hpp", ".hh", ".hxx", ".cpp", ".cc", ".cxx"], "rust": [".rs", "/mod.rs"], "php": [".php"], "ruby": [".rb"], "go": [".go"], "csharp": [".cs"],
}
#: Languages whose imports are names: their parts are cut at a dot or a backslash.
SEPARATORS = ["php", "csharp", "java", "kotlin", "python"]

_CANDIDATE = "array<struct<how:string,target:string>>"


def _tried(how: str, stem: Column, endings: list[str]) -> Column:
    """The stem with each ending; none for a null stem."""
    each = F.array(*[F.struct(F.lit(how).alias("how"), F.concat(stem, F.lit(e)).alias("target")) for e in endings])
    return F.when(stem.isNull(), F.array().cast(_CANDIDATE)).otherwise(each.cast(_CANDIDATE))


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _joined(*parts: Column) -> Column:
    """Parts put together by "/", without empty ones, with . and .. carried out; above the root stays the root."""
    steps = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))), "/")


def _unscripted(path: Column) -> Column:
    """A path without its script ending (imports name .js where .ts is meant); null if it has none."""
    return F.when(F.rlike(path, F.lit(r"\.(js|jsx|mjs|cjs)$")), F.regexp_replace(path, r"\.(js|jsx|mjs|cjs)$", ""))


def _script(folder: Column, spec: Column) -> Column:
    base = _joined(folder, spec)
    relative = F.concat(_tried("path", base, SCRIPT), _tried("path", _unscripted(base), SCRIPT))
    bare = F.when(F.contains(spec, F.lit("/")), _joined(spec)).otherwise(F.replace(spec, F.lit("."), F.lit("/")))
    return F.when(spec.startswith("."), relative).otherwise(_tried("suffix", bare, SCRIPT))


def _python(folder: Column, spec: Column) -> Column:
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    relative = F.when(dots - 1 <= F.size(parts), _joined(up, module))
    # a bare name: the importer's folder and those around it, the nearest first, a package before a module
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    near = F.flatten(F.transform(above, lambda a: _tried("path", _joined(a, spec), ["/__init__.py", ".py"])))
    return F.when(dots > 0, _tried("path", relative, ENDINGS["python"])).when(F.contains(spec, F.lit(".")), _tried("suffix", module, ENDINGS["python"])).otherwise(near)


def _rust(folder: Column, spec: Column) -> Column:
    """crate:: from src or the root, super:: and self:: from the file; the last part may be a symbol of the module."""
    path = F.replace(F.regexp_replace(F.regexp_replace(spec, r"::\{.*$", ""), r"^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    whole, outer = [".rs", "/mod.rs", "/lib.rs"], [".rs", "/mod.rs"]

    def module(stem: Column) -> Column:
        parent = F.when(F.contains(stem, F.lit("/")), F.regexp_replace(stem, "/[^/]*$", ""))
        return F.concat(_tried("path", stem, whole), _tried("path", parent, outer))

    plain = F.when(F.contains(spec, F.lit("::")), path)
    return (
        F.when(spec.startswith("crate::"), F.concat(module(_joined(F.lit("src"), path)), module(_joined(path))))
        .when(spec.startswith("super::"), module(_joined(folder, F.lit(".."), path)))
        .when(spec.startswith("self::"), module(_joined(folder, path)))
        .otherwise(F.concat(module(plain), _tried("suffix", plain, outer)))
    )


def _jvm(language: str, spec: Column) -> Column:
    """A package with all its classes, a class, or the class of an imported member."""
    path, endings = F.replace(spec, F.lit("."), F.lit("/")), ENDINGS[language]
    package = F.when(spec.endswith(".*"), F.regexp_replace(path, r"/\*$", ""))
    last = F.element_at(F.split(spec, r"\."), -1)
    member = F.when((F.size(F.split(spec, r"\.")) >= 3) & F.rlike(last, F.lit(r"^([a-z*].*|[A-Z_]+)$")), F.regexp_replace(path, "/[^/]*$", ""))
    folders = F.flatten(F.array(*[_tried(f"folder{e}", package, [""]) for e in endings]))
    return F.when(spec.endswith(".*"), F.concat(folders, _tried("suffix", member, endings))).otherwise(F.concat(_tried("suffix", path, endings), _tried("suffix", member, endings)))


def _plain(language: Column, folder: Column, spec: Column) -> Column:
    """What an import tries besides rules."""
    slashed = F.replace(spec, F.lit("\\"), F.lit("/"))
    php = F.when(~F.contains(slashed, F.lit("..")), _joined(slashed))
    ruby = F.when(spec.startswith("."), _joined(folder, spec))
    cases = {
        "python": _python(folder, spec),
        "rust": _rust(folder, spec),
        "java": _jvm("java", spec),
        "kotlin": _jvm("kotlin", spec),
        "php": _tried("suffix", php, ENDINGS["php"]),
        "c": F.concat(_tried("path", _joined(folder, spec), [""]), _tried("suffix", _joined(spec), ENDINGS["c"])),
        "cpp": F.concat(_tried("path", _joined(folder, spec), [""]), _tried("suffix", _joined(spec), ENDINGS["cpp"])),
        "ruby": F.concat(_tried("path", ruby, ["", ".rb"]), _tried("suffix", F.when(ruby.isNull(), _joined(spec)), ["", ".rb"])),
        "csharp": F.concat(_tried("suffix", F.replace(spec, F.lit("."), F.lit("/")), [".cs"]), _tried("folder.cs", F.replace(spec, F.lit("."), F.lit("/")), [""])),
    }
    out = F.when(language.isin("typescript", "javascript"), _script(folder, spec))
    for name, candidates in cases.items():
        out = out.when(language == name, candidates)
    return F.coalesce(out, F.array().cast(_CANDIDATE))


def _ruled(language: Column, target: Column, rest: Column) -> Column:
    """What an import tries where a rule gives its path."""
    path = F.when(language.isin("typescript", "javascript"), _joined(F.concat(target, rest))).otherwise(_joined(target, rest))
    script = F.concat(_tried("path", path, SCRIPT), _tried("path", _unscripted(path), SCRIPT), _tried("suffix", path, SCRIPT))
    package = F.when(rest != "", path)  # the module itself is no package of its own
    named = F.concat(_tried("path", path, [".php"]), _tried("lower", F.lower(path), [".php"]), _tried("first.php", _folder(path), [""]))
    out = F.when(language.isin("typescript", "javascript"), script).when(language == "go", _tried("folder.go", package, [""])).when(language == "php", named)
    for name in ("csharp", "java", "kotlin", "python"):
        out = out.when(language == name, F.concat(_tried("path", path, ENDINGS[name]), _tried(f"folder{ENDINGS[name][0]}", package, [""])))
    return F.coalesce(out, F.array().cast(_CANDIDATE))


def _candidates(imports: DataFrame, rules: DataFrame | None) -> DataFrame:
    """(file, language, spec, stage, place, how, target): all candidates in order; rules are stage 0, the longest first."""
    language, spec = F.col("language"), F.col("spec")
    known = imports.where("spec IS NOT NULL AND spec <> ''").select("file", "language", "spec").distinct()
    key = ["file", "language", "spec"]
    plain = known.select(*key, F.lit(1).alias("stage"), F.lit(0).alias("before"), F.posexplode(_plain(language, _folder(F.col("file")), spec)).alias("place", "c"))
    if rules is None:
        return plain.select(*key, "stage", "before", "place", "c.*")
    slashed = F.when(language.isin(*SEPARATORS), F.translate(spec, "\\.", "//")).otherwise(spec)
    r = rules.select(F.col("language").alias("l"), F.when(F.col("language").isin(*SEPARATORS), F.translate("prefix", "\\.", "//")).otherwise(F.col("prefix")).alias("prefix"), F.col("target").alias("base"))
    # only prefixes as long as some rule's, which are as few as the longest rule has characters; the prefixes themselves are many
    lengths = F.broadcast(r.select("l", F.length("prefix").alias("n")).where("n > 0").distinct())
    opened = known.withColumn("whole", slashed).where(~F.col("spec").startswith(".")).join(lengths, (F.col("language") == F.col("l")) & (F.col("n") <= F.length("whole"))).drop("l")
    opened = opened.withColumn("p", F.substr(F.col("whole"), F.lit(1), F.col("n"))).drop("n")
    met = opened.join(r.hint("merge"), (F.col("language") == F.col("l")) & (F.col("p") == F.col("prefix")))
    rest = F.substr(F.col("whole"), F.length("p") + 1)
    # in languages of names a rule ends where a part ends; aliases of scripts are plain prefixes
    met = met.where(F.col("language").isin("typescript", "javascript") | (rest == "") | rest.startswith("/") | F.col("p").endswith("/"))
    ruled = met.select(*key, F.lit(0).alias("stage"), (-F.length("p")).alias("before"), F.posexplode(_ruled(language, F.col("base"), rest)).alias("place", "c"))
    return ruled.unionByName(plain).select(*key, "stage", "before", "place", "c.*")


def resolve_imports(imports: DataFrame, files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(file, language, spec, target, how): the file, or all files of the package, that each import stands for."""
    f = files.select("path").distinct()
    parts = F.split("path", "/")
    best = F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("path")))["path"]
    suffixes = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("target"))
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    listed = f.where(~F.col("path").endswith("_test.go")).select("path", _folder(F.col("path")).alias("folder"), ending.alias("ending"))
    above = F.split("folder", "/")
    folders = listed.select("path", F.concat(F.lit("folder"), "ending").alias("how"), F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda n: F.array_join(F.slice(above, n, F.size(above)), "/"))).alias("target"))
    index = [
        f.select(F.lit("path").alias("how"), F.col("path").alias("target"), "path"),
        suffixes.groupBy("target").agg(best.alias("path")).select(F.lit("suffix").alias("how"), "target", "path"),
        f.groupBy(F.lower("path").alias("target")).agg(best.alias("path")).select(F.lit("lower").alias("how"), "target", "path"),
        listed.groupBy("ending", "folder").agg(F.min("path").alias("path")).select(F.concat(F.lit("first"), "ending").alias("how"), F.col("folder").alias("target"), "path"),
        folders.select("how", "target", "path"),
    ]
    whole = index[0]
    for part in index[1:]:
        whole = whole.unionByName(part)
    # both sides are much larger than the files they are estimated from: neither may be sent to all tasks
    hit = _candidates(imports, rules).join(whole.hint("merge"), ["how", "target"])
    order = F.struct("stage", "before", "place")
    first = Window.partitionBy("file", "language", "spec")
    best_of = hit.withColumn("order", order).withColumn("least", F.min("order").over(first)).where("order = least")
    return best_of.select("file", "language", "spec", F.col("path").alias("target"), F.regexp_extract("how", "^[a-z]+", 0).alias("how")).distinct()
