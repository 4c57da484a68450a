"""Import resolution of each language over file trees made of whole tables, with SQL; every tree has ties and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _resolve(spark: SparkSession, sf_dir: str, language: str, files: list, specs: list, file, rules: list | None = None) -> DataFrame:
    """Files and imports are texts put together from the columns of part; each row of ``file`` imports all of ``specs``."""
    p = table(spark, sf_dir, "part")
    paths = p.select(F.explode(F.array(*files)).alias("path")).where("path IS NOT NULL").distinct()
    wanted = p.select(file.alias("file"), F.lit(language).alias("language"), F.explode(F.array(*specs)).alias("spec")).distinct()
    ruled = spark.createDataFrame([(language, *r) for r in rules], "language string, prefix string, target string") if rules else None
    return imports.resolve_imports(wanted, paths, ruled).select("file", "spec", "target")


def _size():
    return F.col("p_size")


def _key():
    return F.col("p_partkey")


_ALIAS_SQL = """
WITH f AS (SELECT DISTINCT 'src/m' || p_size || '/f' || (p_partkey % 20) || '.ts' AS path FROM part UNION SELECT DISTINCT 'src/m' || p_size || '/f' || (p_partkey % 20) || '/index.tsx' FROM part WHERE p_partkey % 20 < 3),
i AS (SELECT DISTINCT 'src/m' || p_size || '/f' || (p_partkey % 20) || '.ts' AS file, unnest(['@m' || p_size || '/f' || (p_partkey % 20), '@m2' || (p_size % 10) || '/f' || (p_partkey % 20) || '.js', './f' || (p_partkey % 20), '../m' || (p_size + 1) || '/f1', 'm' || p_size || '/f' || (p_partkey % 20)]) AS spec FROM part),
r AS (SELECT * FROM (VALUES ('@m', 'src/m'), ('@m2', 'src/m3'), ('@m1', 'lib/m1')) t(prefix, target)),
s AS (SELECT i.*, 1000 - length(prefix) AS stage, target || substr(spec, length(prefix) + 1) AS stem FROM i JOIN r ON starts_with(spec, prefix)
  UNION ALL SELECT *, 2000, regexp_extract(file, '^(.*)/', 1) || substr(spec, 2) FROM i WHERE starts_with(spec, './')
  UNION ALL SELECT *, 2000, 'src/' || substr(spec, 4) FROM i WHERE starts_with(spec, '../')
  UNION ALL SELECT *, 2000, 'src/' || spec FROM i WHERE starts_with(spec, 'm')),
x AS (SELECT file, spec, stage, k, path FROM s JOIN (SELECT unnest(['.ts', '/index.tsx']) AS e, unnest([1, 2]) AS k) ON true JOIN f ON path = stem || e
  UNION ALL SELECT file, spec, stage, k + 5, path FROM s JOIN (SELECT unnest(['.ts', '/index.tsx']) AS e, unnest([1, 2]) AS k) ON true JOIN f ON ends_with(stem, '.js') AND path = left(stem, length(stem) - 3) || e)
SELECT file, spec, path AS target FROM x QUALIFY row_number() OVER (PARTITION BY file, spec ORDER BY stage, k) = 1
"""


@query("import_aliases", _ALIAS_SQL)
def import_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path aliases that are prefixes of each other, script endings, folders with an index, relative and bare imports."""
    k = _key() % 20
    own = _text("src/m", _size(), "/f", k, ".ts")
    files = [own, F.when(k < 3, _text("src/m", _size(), "/f", k, "/index.tsx"))]
    specs = [_text("@m", _size(), "/f", k), _text("@m2", _size() % 10, "/f", k, ".js"), _text("./f", k), _text("../m", _size() + 1, "/f1"), _text("m", _size(), "/f", k)]
    return _resolve(spark, sf_dir, "typescript", files, specs, own, [("@m", "src/m"), ("@m2", "src/m3"), ("@m1", "lib/m1")])


@query(
    "import_go_modules",
    """WITH f AS (SELECT 'internal/m' || p_size || '/p' || p_partkey || '.go' AS path, p_size AS s FROM part WHERE p_partkey % 3 <> 0),
i AS (SELECT DISTINCT 'cmd/c' || p_size || '.go' AS file, unnest([p_size, p_size + 1]) AS s FROM part)
SELECT file, 'example.com/app/internal/m' || i.s AS spec, path AS target FROM i JOIN f ON f.s = i.s""",
)
def import_go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module's packages: all files of the folder but tests, and nothing of deeper folders or other modules."""
    files = [_text("internal/m", _size(), "/p", _key(), F.when(_key() % 3 == 0, "_test.go").otherwise(".go")), _text("internal/m", _size(), "/deep/p", _key(), ".go")]
    specs = [_text("example.com/app/internal/m", _size()), _text("example.com/app/internal/m", _size() + 1), F.lit("example.com/apple/internal/m1"), F.lit("fmt")]
    return _resolve(spark, sf_dir, "go", files, specs, _text("cmd/c", _size(), ".go"), [("example.com/app", "")])


@query(
    "import_python_packages",
    """WITH f AS (SELECT DISTINCT 'pkg/m' || p_size || '/p' || p_partkey || '.py' AS path FROM part UNION SELECT DISTINCT 'pkg/m' || p_size || '/__init__.py' FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT 'pkg/m' || p_size || '.py' FROM part WHERE p_size % 3 = 0),
i AS (SELECT 'pkg/m' || p_size || '/p' || p_partkey || '.py' AS file, p_size AS s, p_partkey AS k FROM part),
c AS (SELECT file, '.p' || (k // 2) AS spec, 1 AS n, 'pkg/m' || s || '/p' || (k // 2) || '.py' AS path FROM i
  UNION ALL SELECT file, '..m' || (s + 1), 1, 'pkg/m' || (s + 1) || '.py' FROM i UNION ALL SELECT file, '..m' || (s + 1), 2, 'pkg/m' || (s + 1) || '/__init__.py' FROM i
  UNION ALL SELECT file, 'm' || (s + 2), 1, 'pkg/m' || (s + 2) || '/__init__.py' FROM i UNION ALL SELECT file, 'm' || (s + 2), 2, 'pkg/m' || (s + 2) || '.py' FROM i
  UNION ALL SELECT file, 'pkg.m' || s, 1, 'pkg/m' || s || '.py' FROM i UNION ALL SELECT file, 'pkg.m' || s, 2, 'pkg/m' || s || '/__init__.py' FROM i)
SELECT DISTINCT file, spec, path AS target FROM c JOIN f USING (path) QUALIFY rank() OVER (PARTITION BY file, spec ORDER BY n) = 1""",
)
def import_python_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative dots, bare names found in the folders around, dotted names; a module and a package of one name."""
    own = _text("pkg/m", _size(), "/p", _key(), ".py")
    files = [own, F.when(_size() % 2 == 0, _text("pkg/m", _size(), "/__init__.py")), F.when(_size() % 3 == 0, _text("pkg/m", _size(), ".py"))]
    specs = [_text(".p", F.floor(_key() / 2)), _text("..m", _size() + 1), _text("m", _size() + 2), _text("pkg.m", _size()), F.lit("numpy")]
    return _resolve(spark, sf_dir, "python", files, specs, own)


@query(
    "import_rust_crates",
    """WITH f AS (SELECT 'src/m' || p_size || '/p' || p_partkey || '.rs' AS path FROM part UNION SELECT 'src/m' || p_size || '/mod.rs' FROM part WHERE p_size % 2 = 0),
i AS (SELECT 'src/m' || p_size || '/p' || p_partkey || '.rs' AS file, p_size AS s, p_partkey AS k FROM part),
c AS (SELECT file, 'crate::m' || s || '::p' || k || '::Thing' AS spec, 'src/m' || s || '/p' || k || '.rs' AS path FROM i
  UNION ALL SELECT file, 'super::m' || (s + 1), 'src/m' || (s + 1) || '/mod.rs' FROM i
  UNION ALL SELECT file, 'self::p' || (k // 2) || '::run', 'src/m' || s || '/p' || (k // 2) || '.rs' FROM i
  UNION ALL SELECT file, 'crate::m' || (s + 2) || '::{a, b}', 'src/m' || (s + 2) || '/mod.rs' FROM i)
SELECT DISTINCT file, spec, path AS target FROM c JOIN f USING (path)""",
)
def import_rust_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate, super and self paths; the last part is a module or a symbol of one."""
    own = _text("src/m", _size(), "/p", _key(), ".rs")
    files = [own, F.when(_size() % 2 == 0, _text("src/m", _size(), "/mod.rs"))]
    specs = [_text("crate::m", _size(), "::p", _key(), "::Thing"), _text("super::m", _size() + 1), _text("self::p", F.floor(_key() / 2), "::run"), _text("crate::m", _size() + 2, "::{a, b}"), F.lit("std::fmt")]
    return _resolve(spark, sf_dir, "rust", files, specs, own)


@query(
    "import_php_namespaces",
    """WITH f AS (SELECT 'app/m' || p_size || '/P' || p_partkey || '.php' AS path FROM part UNION SELECT 'lib/m' || p_size || '/P' || p_partkey || '.php' FROM part WHERE p_size < 10),
i AS (SELECT 'web/w' || p_partkey || '.php' AS file, p_size AS s, p_partkey AS k FROM part),
d AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir, min(path) AS path FROM f GROUP BY dir),
c AS (SELECT file, 'App\\m' || s || '\\P' || k AS spec, 2 AS n, 'app/m' || s || '/P' || k || '.php' AS path FROM i UNION ALL SELECT file, 'App\\m' || s || '\\P' || k, 1, 'lib/m1/P' || k || '.php' FROM i WHERE s = 1)
SELECT file, spec, path AS target FROM c JOIN f USING (path) QUALIFY row_number() OVER (PARTITION BY file, spec ORDER BY n) = 1
UNION ALL SELECT file, 'App\\m' || s || '\\doIt', path FROM i JOIN d ON dir = CASE WHEN s = 1 THEN 'lib/m1' ELSE 'app/m' || s END
UNION ALL SELECT file, 'App\\M' || s || '\\p' || k, 'app/m' || s || '/P' || k || '.php' FROM i""".replace("\\\\", "\\"),
)
def import_php_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace folders, the longer prefix first; names of another case; a function of a namespace."""
    files = [_text("app/m", _size(), "/P", _key(), ".php"), F.when(_size() < 10, _text("lib/m", _size(), "/P", _key(), ".php"))]
    specs = [_text("App\\m", _size(), "\\P", _key()), _text("App\\m", _size(), "\\doIt"), _text("App\\M", _size(), "\\p", _key()), F.lit("Apple\\m1\\P1x")]
    return _resolve(spark, sf_dir, "php", files, specs, _text("web/w", _key(), ".php"), [("App\\", "app"), ("App\\m1", "lib/m1")])


@query(
    "import_jvm_packages",
    """WITH f AS (SELECT p_size AS s, p_partkey AS k, 'src/com/x/m' || p_size || '/P' || p_partkey || '.java' AS path FROM part UNION ALL SELECT p_size, p_partkey, 'src/main/com/x/m' || p_size || '/P' || p_partkey || '.kt' FROM part WHERE p_partkey % 5 = 0),
b AS (SELECT k, s, path FROM f WHERE ends_with(path, '.java')),
i AS (SELECT 'src/com/x/Main' || (p_partkey % 7) || '.java' AS file, p_size AS s, p_partkey AS k FROM part)
SELECT file, 'com.x.m' || i.s || '.P' || i.k AS spec, path AS target FROM i JOIN b USING (k)
UNION ALL SELECT file, 'com.x.m' || i.s || '.P' || i.k || '.VALUE', path FROM i JOIN b USING (k)
UNION ALL SELECT DISTINCT file, 'com.x.m' || i.s || '.*', path FROM i JOIN b ON b.s = i.s""",
)
def import_jvm_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in two source roots, members of classes, and packages; Java files come before Kotlin's."""
    files = [_text("src/com/x/m", _size(), "/P", _key(), ".java"), F.when(_key() % 5 == 0, _text("src/main/com/x/m", _size(), "/P", _key(), ".kt"))]
    specs = [_text("com.x.m", _size(), ".P", _key()), _text("com.x.m", _size(), ".P", _key(), ".VALUE"), _text("com.x.m", _size(), ".*"), F.lit("java.util.List")]
    return _resolve(spark, sf_dir, "java", files, specs, _text("src/com/x/Main", _key() % 7, ".java"))
