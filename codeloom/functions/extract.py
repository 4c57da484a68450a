"""Regex extraction of facts from source text: links, routes, fetches, ORM calls, contracts. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods and names that the extractors know.
PRISMA_METHODS = "findMany findFirst findUnique findUniqueOrThrow findFirstOrThrow create createMany update updateMany delete deleteMany upsert count aggregate groupBy".split()
SUPABASE_METHODS = "select insert update delete upsert".split()
RESPONSE_BLOCKLIST = "then catch finally json text blob status ok headers body length map filter forEach reduce find some every includes push pop slice splice join keys values entries toString".split()
SERVICE_MARKERS = "package.json go.mod Dockerfile pom.xml build.gradle build.gradle.kts Cargo.toml pyproject.toml requirements.txt mix.exs".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_links(html: Column | str) -> Column:
    """Targets of action="..", href="..", src=".." and url: ".."."""
    return F.regexp_extract_all(_c(html), F.lit(r"""(?:action|href|src)\s*=\s*"([^"]*)\""""), 1)


def reason_keys(reason: Column | str) -> Column:
    """Accessed keys out of ``keys:a,b``."""
    keys = F.regexp_extract(_c(reason), r"keys:([^|;\s]*)", 1)
    return F.filter(F.transform(F.split(keys, ","), lambda k: F.trim(k)), lambda k: k != "")


def reason_fetches(reason: Column | str) -> Column:
    """Number of routes that the consumer fetches, 1 if not stated."""
    n = F.regexp_extract(_c(reason), r"fetches:(\d+)", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.lit(1))


def consumer_keys(source: Column | str) -> Column:
    """Keys that a consumer reads off a response: destructured names and data.key, without well-known methods."""
    s = _c(source)
    groups = F.regexp_extract_all(s, F.lit(r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:await\s+)?[\w.]*(?:data|res|response|json|result)\b"), 1)
    names = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(F.regexp_replace(x, r"[:=].*$", "")))))
    dotted = F.regexp_extract_all(s, F.lit(r"\b(?:data|response|result|json)\??\.([A-Za-z_$][\w$]*)"), 1)
    every = F.filter(F.array_distinct(F.concat(names, dotted)), lambda x: x.rlike(r"^[A-Za-z_$][\w$]*$"))
    return F.array_except(every, F.array(*[F.lit(x) for x in RESPONSE_BLOCKLIST]))


def json_keys(source: Column | str) -> Column:
    """Top-level keys of flat .json({..}) and json_encode([..]) literals."""
    s = _c(source)
    bodies = F.concat(F.regexp_extract_all(s, F.lit(r"\.json\(\s*\{([^{}]*)\}"), 1), F.regexp_extract_all(s, F.lit(r"json_encode\(\s*\[([^\[\]]*)\]"), 1))
    keys = F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ","), lambda x: F.regexp_extract(F.trim(x), r"""^['"]?([A-Za-z_$][\w$]*)['"]?\s*(?:=>|:|$)""", 1))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def orm_queries(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, orm, model, method) of Prisma and Supabase calls."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("n", "text"))
    prisma = rf"\bprisma\.(\w+)\.({'|'.join(PRISMA_METHODS)})\("
    supabase = rf"""\bfrom\(\s*['"](\w+)['"]\s*\)\s*\.({'|'.join(SUPABASE_METHODS)})\("""
    out = None
    for orm, pattern in (("prisma", prisma), ("supabase", supabase)):
        hit = lines.where(F.col("text").rlike(pattern)).select("path", (F.col("n") + 1).alias("line"), F.lit(orm).alias("orm"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("model"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("method"))).alias("x"))
        part = hit.select("path", "line", "orm", "x.model", "x.method")
        out = part if out is None else out.unionByName(part)
    return out


def code_routes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, method, route) of Express, Laravel, decorator and annotation routes."""
    patterns = [
        r"""\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*['"`]([^'"`]+)""",
        r"""\bRoute::(get|post|put|delete|patch|any)\(\s*['"]([^'"]+)""",
        r"""@\w+\.(get|post|put|delete|patch|route)\(\s*['"]([^'"]+)""",
        r"""@(Get|Post|Put|Delete|Patch)(?:Mapping)?\(\s*(?:value\s*=\s*)?['"]([^'"]+)""",
    ]
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("n", "text"))
    out = None
    for pattern in patterns:
        part = lines.where(F.col("text").rlike(pattern)).select("path", (F.col("n") + 1).alias("line"), F.upper(F.regexp_extract("text", pattern, 1)).alias("method"), F.regexp_extract("text", pattern, 2).alias("route"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["path", "line", "method", "route"])


def tool_definitions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, description) of tool literals that carry an inputSchema; description cut at 200."""
    pattern = r"""(?s)name:\s*['"](\w+)['"]\s*,\s*description:\s*[`'"](.*?)[`'"]\s*,\s*inputSchema"""
    zipped = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(content, F.lit(pattern), 2).alias("description"))
    return files.select(F.col(path).alias("path"), F.explode(zipped).alias("x")).select("path", "x.name", F.substring("x.description", 1, 200).alias("description"))


def middleware_chain(source: Column | str) -> Column:
    """Names of nested wrappers: export const GET = withA(withB(handler)) -> [withA, withB]."""
    expression = F.regexp_extract(_c(source), r"export\s+(?:const\s+(?:GET|POST|PUT|DELETE|PATCH)|default)\s*=?\s*((?:\w+\()+)", 1)
    return F.filter(F.split(expression, r"\("), lambda x: x != "")


def matcher_regex(pattern: Column | str) -> Column:
    """A middleware matcher (/a/:path*, /b/:id, regex groups) as an anchored regular expression."""
    p = F.regexp_replace(F.regexp_replace(_c(pattern), r"/:\w+\*", "(?:/.*)?"), r":\w+\+?", "[^/]+")
    return F.concat(F.lit("^"), p, F.lit("$"))


def grpc_contracts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, contract_id) of the methods of .proto files: grpc::package.service/Method."""
    package = F.regexp_extract(content, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    services = F.regexp_extract_all(content, F.lit(r"(?s)\bservice\s+(\w+\s*\{.*?)(?=\bservice\s+\w+\s*\{|$)"), 1)
    each = files.where(F.col(path).endswith(".proto")).select(F.col(path).alias("path"), package.alias("pkg"), F.explode(services).alias("body"))
    methods = each.select("path", "pkg", F.regexp_extract("body", r"^(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("body", F.lit(r"\brpc\s+(\w+)"), 1)).alias("method"))
    full = F.when(F.col("pkg") == "", F.col("service")).otherwise(F.concat_ws(".", "pkg", "service"))
    return methods.select("path", F.concat(F.lit("grpc::"), F.lower(full), F.lit("/"), "method").alias("contract_id"))


def thrift_contracts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, contract_id) of the methods of .thrift files."""
    package = F.regexp_extract(content, r"(?m)^\s*namespace\s+\S+\s+([\w.]+)", 1)
    each = files.where(F.col(path).endswith(".thrift")).select(F.col(path).alias("path"), package.alias("pkg"), F.explode(F.regexp_extract_all(content, F.lit(r"(?s)\bservice\s+(\w+[^{]*\{.*?\})"), 1)).alias("body"))
    methods = each.select("path", "pkg", F.regexp_extract("body", r"^(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(?:oneway\s+)?[\w.<>, ]+?\s+(\w+)\s*\("), 1)).alias("method"))
    full = F.when(F.col("pkg") == "", F.col("service")).otherwise(F.concat_ws(".", "pkg", "service"))
    return methods.select("path", F.concat(F.lit("thrift::"), F.lower(full), F.lit("/"), "method").alias("contract_id"))


def topic_contracts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, role, contract_id) of publish and subscribe calls with a literal topic."""
    publish = r"""\b(?:publish|emit|send|produce|sendToQueue)\(\s*(?:\{\s*topic:\s*)?['"]([\w./-]+)['"]"""
    consume = r"""\b(?:subscribe|consume|KafkaListener|RabbitListener)\(\s*(?:\{\s*topics?:\s*\[?\s*|topics\s*=\s*|queues\s*=\s*)?['"]([\w./-]+)['"]"""
    out = None
    for role, pattern in (("provider", publish), ("consumer", consume)):
        part = files.select(F.col(path).alias("path"), F.lit(role).alias("role"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), 1))).alias("t"))
        out = part if out is None else out.unionByName(part)
    return out.select("path", "role", F.concat(F.lit("topic::"), F.lower("t")).alias("contract_id"))


def include_contracts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, contract_id) of quoted C and C++ includes that no file of the repository provides."""
    used = files.where(F.col(path).rlike(r"\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$")).select(F.col(path).alias("path"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r'(?m)^\s*#\s*include\s+"([^"]+)"'), 1))).alias("header"))
    parts = F.split(path, "/")
    suffixes = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("header")).distinct()
    return used.join(suffixes, "header", "left_anti").select("path", F.concat(F.lit("include::"), F.lower("header")).alias("contract_id"))


def service_boundaries(files: DataFrame, path: str = "path") -> DataFrame:
    """(service, markers, confidence): directories with a manifest and sources below; .75, .9, 1.0 by number of markers."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    marked = files.where(name.isin(SERVICE_MARKERS)).groupBy(folder.alias("service")).agg(F.countDistinct(name).alias("markers")).where("service <> ''")
    parts = F.split(F.col("p"), "/")
    sources = files.where(~name.isin(SERVICE_MARKERS) & F.col(path).rlike(r"\.(js|ts|tsx|jsx|py|go|java|kt|rs|rb|php|cs|ex|exs)$")).select(F.col(path).alias("p"))
    above = sources.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("service")).distinct()
    # Confidence by number of markers.
    return marked.join(above, "service", "left_semi").select("service", "markers", F.when(F.col("markers") >= 3, 1.0).when(F.col("markers") == 2, 0.9).otherwise(0.75).alias("confidence"))


def workspace_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, kind, name, dependency): package names and dependencies of package.json, go.mod, Cargo.toml, pyproject and requirements files."""
    base = F.element_at(F.split(path, "/"), -1)
    rules = [
        ("node", base == "package.json", r'"name"\s*:\s*"([^"]+)"', r'(?s)"(?:dev|peer)?[dD]ependencies"\s*:\s*\{([^}]*)\}', r'"([^"]+)"\s*:'),
        ("go", base == "go.mod", r"(?m)^module\s+(\S+)", r"(?s)(.*)", r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v"),
        ("rust", base == "Cargo.toml", r'(?m)^name\s*=\s*"([^"]+)"', r"(?s)\[dependencies\]([^\[]*)", r"(?m)^([\w-]+)\s*="),
        ("python", base == "pyproject.toml", r'(?m)^name\s*=\s*"([^"]+)"', r"(?s)dependencies\s*=\s*\[([^\]]*)\]", r'"([\w.-]+)'),
        ("python", base == "requirements.txt", r"()", r"(?s)(.*)", r"(?m)^([\w.-]+)"),
    ]
    out = None
    for kind, which, name, block, entry in rules:
        picked = files.where(which).select(F.col(path).alias("path"), F.lit(kind).alias("kind"), F.regexp_extract(content, name, 1).alias("name"), F.array_join(F.regexp_extract_all(content, F.lit(block), 1), "\n").alias("b"))
        part = picked.select("path", "kind", "name", F.explode(F.array_distinct(F.regexp_extract_all("b", F.lit(entry), 1))).alias("dependency"))
        out = part if out is None else out.unionByName(part)
    return out


def vue_script(source: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(_c(source), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1), "\n")


def vue_components(source: Column | str) -> Column:
    """PascalCase and kebab-case component names of the template."""
    template = F.regexp_extract(_c(source), r"(?s)<template[^>]*>(.*)</template>", 1)
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"<([A-Z][\w]*|[a-z]+-[\w-]+)"), 1))
