"""URLs, routes and contract ids in canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_fetch_url(url: Column | str) -> Column:
    """Path of a fetch call; null if it can't be told statically."""
    u = F.split(_c(url), r"\?", 2)[0]
    u = F.regexp_replace(u, r"\$\{[^}]+\}", "[param]")
    u = F.regexp_replace(u, "^`|`$", "")
    u = F.regexp_replace(u, r"\.(php|asp|aspx|jsp|cgi)$", "")
    return F.when(u.startswith("/") & ~u.contains("+") & ~u.contains("("), u)


def normalize_http_path(path: Column | str) -> Column:
    """Provider side: no query, lower case, no trailing slash, parameters as {param}."""
    p = F.regexp_replace(F.lower(F.split(F.trim(_c(path)), r"\?", 2)[0]), r"/+$", "")
    for pattern in (r":\w+", r"\{[^}]+\}", r"\[[^\]]+\]"):
        p = F.regexp_replace(p, pattern, "{param}")
    return F.when(p == "", "/").otherwise(p)


def normalize_consumer_path(url: Column | str) -> Column:
    """Consumer side: host dropped, template and numeric segments as {param}."""
    u = F.trim(F.regexp_replace(_c(url), r"\$\{[^}]+\}", "{param}"))
    absolute = u.rlike(r"(?i)^https?://")
    path = F.when(absolute, F.regexp_replace(F.regexp_replace(u, r"(?i)^https?://[^/?#]*", ""), r"#.*$", "")).otherwise(u)
    parts = F.filter(F.split(normalize_http_path(F.when(path == "", "/").otherwise(path)), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$"), F.lit("{param}")).otherwise(s)), "/"))


def normalize_contract_id(contract: Column | str) -> Column:
    """Canonical contract id by kind: http, grpc, thrift, topic, lib, include; others unchanged."""
    c = _c(contract)
    kind = F.regexp_extract(c, r"^([^:]*)::", 1)
    rest = F.regexp_replace(c, r"^[^:]*::", "")
    method, path = F.regexp_extract(rest, r"^([^:]*)::", 1), F.regexp_replace(F.regexp_replace(rest, r"^[^:]*::", ""), r"/+$", "")
    slash = F.instr(rest, "/")
    rpc = F.when(slash > 1, F.concat(F.lower(F.substring_index(rest, "/", 1)), F.regexp_replace(rest, r"^[^/]*", ""))).when(slash == 1, rest).otherwise(F.lower(rest))
    header = F.lower(F.regexp_replace(F.regexp_replace(F.replace(rest, F.lit("\\"), F.lit("/")), r"^\./", ""), r"/+", "/"))
    return (
        F.when((kind == "http") & rest.contains("::"), F.concat(F.lit("http::"), F.upper(method), F.lit("::"), path))
        .when(kind.isin("grpc", "thrift"), F.concat(kind, F.lit("::"), rpc))
        .when(kind == "topic", F.concat(F.lit("topic::"), F.lower(F.trim(rest))))
        .when(kind == "lib", F.concat(F.lit("lib::"), F.lower(rest)))
        .when(kind == "include", F.concat(F.lit("include::"), header))
        .otherwise(c)
    )


def _slashes(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def _present(x: Column) -> Column:
    return F.when(x != "", x)


def nextjs_route(path: Column | str) -> Column:
    """Route of a file below app/ (route files with an api segment) or pages/api; else null."""
    p = _slashes(path)
    app = F.regexp_replace(F.regexp_extract(p, r"app/(.+?)/route\.(ts|js|tsx|jsx)$", 1), r"\([^)]+\)/?", "")
    in_app = p.rlike(r"app/(.+?)/route\.(ts|js|tsx|jsx)$")
    page = _present(F.regexp_extract(p, r"pages/(api/.+?)\.(ts|js|tsx|jsx)$", 1))
    return F.when(in_app, F.when(app.startswith("api/") | (app == "api"), F.concat(F.lit("/"), app))).otherwise(F.regexp_replace(F.concat(F.lit("/"), page), "/index$", ""))


def expo_route(path: Column | str) -> Column:
    """Screen or +api route of a file below app/; layouts, declarations and special files have none."""
    p = _slashes(path)
    inner = _present(F.regexp_extract(p, r"app/(.+)\.(tsx?|jsx?)$", 1))
    name = F.element_at(F.split(inner, "/"), -1)
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(inner, r"\+api$", ""), r"\([^)]+\)/?", ""))
    plain = F.regexp_replace(route, "/index$", "")
    skipped = p.rlike(r"\.d\.tsx?$") | name.startswith("_") | (name.startswith("+") & ~name.startswith("+api"))
    return F.when(~skipped, F.when(plain == "", "/").otherwise(plain))


def php_route(path: Column | str) -> Column:
    """Route of a handler file below api/."""
    p = _slashes(path)
    inner = _present(F.regexp_extract(p, r"^(api/.+?)\.php$", 1))
    name = F.element_at(F.split(inner, "/"), -1)
    helper = name.startswith("_") | name.rlike(r"(?:^|_)(helper|config|test|fixture|mock|setup|bootstrap)(?:_|$)")
    return F.when(~helper, F.concat(F.lit("/"), inner))


def route_matches(fetch: Column, route: Column) -> Column:
    """Segment-wise match; [x] on either side matches one segment, a last [...x] the rest."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    f, r = parts(fetch), parts(route)
    last = F.try_element_at(r, F.lit(-1))
    catch_all = F.coalesce(last.startswith("[...") | last.startswith("[[..."), F.lit(False))
    same = lambda a, b: F.coalesce((a == b) | a.startswith("[") | b.startswith("["), F.lit(False))
    head = F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))
    heads = F.forall(F.zip_with(head, F.slice(f, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), same), lambda x: x)
    whole = (F.size(f) == F.size(r)) & F.forall(F.zip_with(f, r, same), lambda x: x)
    return F.when(catch_all, (F.size(f) >= F.size(r) - 1) & heads).otherwise(whole)
