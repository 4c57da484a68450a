"""Filters of the graph queries as column expressions: all stay inside the JVM and can be pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence by relation type where none is stored.
CONFIDENCE_FLOOR = {
    "CALLS": 0.9,
    "IMPORTS": 0.9,
    "EXTENDS": 0.85,
    "IMPLEMENTS": 0.85,
    "METHOD_OVERRIDES": 0.85,
    "METHOD_IMPLEMENTS": 0.85,
    "HAS_METHOD": 0.95,
    "HAS_PROPERTY": 0.95,
    "ACCESSES": 0.8,
    "CONTAINS": 0.95,
}
DEFAULT_CONFIDENCE = 0.5

# Path patterns of test files, for queries and for indexing, and of utility files.
TEST_CONTAINS = [".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", "/spec/", "/test_", "/conftest."]
TEST_ENDS = ["_test.go", "_test.py", "_spec.rb", "_test.rb"]
INDEX_TEST_CONTAINS = [
    ".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/test_", "/src/test/", "uitests/", ".tests/", ".test/",
    ".integrationtests/", ".unittests/", "/testproject/", "/tests/feature/", "/tests/unit/", "/spec/", "/test/fixtures/",
]
INDEX_TEST_ENDS = ["_test.py", "_test.go", "tests.swift", "test.swift", "tests.cs", "test.cs", "test.php", "spec.php", "_spec.rb", "_test.rb"]
UTILITY_CONTAINS = ["/utils/", "/util/", "/helpers/", "/helper/", "/common/", "/shared/", "/lib/"]
UTILITY_ENDS = ["/utils.ts", "/utils.js", "/helpers.ts", "/helpers.js", "_utils.py", "_helpers.py"]


def _path(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def _any(path: Column | str, inside: list[str], ends: list[str]) -> Column:
    p, found = _path(path), F.lit(False)
    for part in inside:
        found = found | p.contains(part)
    for part in ends:
        found = found | p.endswith(part)
    return found


def is_test_path(path: Column | str) -> Column:
    """Test file, as queries see it."""
    return _any(path, TEST_CONTAINS, TEST_ENDS)


def is_test_file(path: Column | str) -> Column:
    """Test file, as the indexer sees it (more languages)."""
    return _any(path, INDEX_TEST_CONTAINS, INDEX_TEST_ENDS)


def is_utility_file(path: Column | str) -> Column:
    return _any(path, UTILITY_CONTAINS, UTILITY_ENDS)


def relation_filter(edges: DataFrame, wanted: list[str] | None, allowed: list[str], default: list[str]) -> DataFrame:
    """Edges of the wanted types that are allowed; of the default types if nothing is left."""
    kept = [t for t in wanted or [] if t in allowed]
    return edges.where(F.col("type").isin(*(kept or default)))


def min_confidence(edges: DataFrame, floor: float) -> DataFrame:
    """Applied only for a positive floor, so that null confidences survive otherwise."""
    return edges.where(F.col("confidence") >= floor) if floor > 0 else edges


def effective_confidence(kind: Column | str = "type", stored: Column | str = "confidence") -> Column:
    """The stored confidence if positive, else the type's floor."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    stored = F.col(stored) if isinstance(stored, str) else stored
    floors = F.create_map(*[F.lit(x) for pair in CONFIDENCE_FLOOR.items() for x in pair])
    return F.when(stored > 0, stored).otherwise(F.coalesce(floors[kind], F.lit(DEFAULT_CONFIDENCE)))


def tolerant_confidence(floor: float, stored: Column | str = "confidence") -> Column:
    stored = F.col(stored) if isinstance(stored, str) else stored
    return stored.isNull() | (stored >= floor)


def under_prefix(path: Column | str, prefix: Column | str) -> Column:
    """The path is the prefix or lies below it. Also used for subgroups of member paths."""
    path = F.col(path) if isinstance(path, str) else path
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def in_subgroup(path: Column | str, subgroup: str | None, exact: bool = False) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    if not subgroup:
        return F.lit(True)
    return path == subgroup if exact else under_prefix(path, subgroup)


def is_service_wildcard(contract: Column | str) -> Column:
    contract = F.col(contract) if isinstance(contract, str) else contract
    return contract.rlike(r"^(grpc|thrift)::.*/\*$")


def is_noisy_contract(contract: Column | str, exclude_paths: list[str] = (), exclude_param_only: bool = False) -> Column:
    """HTTP contracts of configured paths, or all of whose segments are parameters."""
    contract = F.col(contract) if isinstance(contract, str) else contract
    path = F.regexp_replace(F.regexp_replace(contract, r"^http::[^:]*::", ""), r"/+$", "")
    noisy = path.isin(*[p.rstrip("/") for p in exclude_paths]) if exclude_paths else F.lit(False)
    if exclude_param_only:
        parts = F.filter(F.split(path, "/"), lambda s: s != "")
        noisy = noisy | ((F.size(parts) > 0) & F.forall(parts, lambda s: s == "{param}"))
    return contract.rlike(r"^http::[^:]*::") & noisy


def overlay_matches(content: Column | str, query: str) -> Column:
    """The whole phrase, or every term, occurs in the content (case-insensitive)."""
    content = F.lower(F.col(content) if isinstance(content, str) else content)
    terms = [t for t in query.lower().split() if t]
    every = F.lit(bool(terms))
    for term in terms:
        every = every & content.contains(term)
    return content.contains(query.lower().strip()) | every


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (end >= other_start)


def in_package_dir(path: Column | str, suffix: Column | str) -> Column:
    """The file stands directly in a directory that ends with the suffix."""
    path = F.col(path) if isinstance(path, str) else path
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return (folder == suffix) | folder.endswith(F.concat(F.lit("/"), suffix))


def callable_candidate(kind: Column, kinds: list[str], required: Column, total: Column, given: Column) -> Column:
    """Right kind and an arity that fits; unknown arities fit."""
    return kind.isin(*kinds) & (given.isNull() | total.isNull() | given.between(F.coalesce(required, total), total))


# Words of Cypher that write.
WRITING_WORDS = "CREATE DELETE SET MERGE REMOVE DROP ALTER COPY DETACH FOREACH INSTALL LOAD".split()


def writes(statement: Column) -> Column:
    """Whether a statement has a writing word outside of strings that is no :Label."""
    bare = F.regexp_replace(statement, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''")
    return F.rlike(bare, F.lit(rf"(?i)(?<!:)\b(?:{'|'.join(WRITING_WORDS)})\b"))
