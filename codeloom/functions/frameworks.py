"""Framework hints: path rules and decorator text that raise a function's entry-point score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern over the lower-cased path with a leading slash, multiplier, reason), first match wins.
PATH_RULES = [
    (r"^(?!.*/_)(?!.*/api/).*/pages/.*\.[jt]sx?$", 3.0, "nextjs-page"),
    (r"/app/.*page\.[jt]sx?$", 3.0, "nextjs-app-page"),
    (r"/pages/api/|/app/(.*/)?api/.*route\.ts$", 3.0, "nextjs-api-route"),
    (r"^(?!.*_layout).*/app/.*layout\.tsx?$", 2.0, "nextjs-layout"),
    (r"/app/(.*/)?_layout[^/]*\.[jt]sx?$", 2.0, "expo-layout"),
    (r"/app/(.*/)?\+(?!api)[^/]*\.[jt]sx?$", 1.5, "expo-special-route"),
    (r"/app/.*\+api\.tsx?$", 3.0, "expo-api-route"),
    (r"/app/.*\.[jt]sx?$", 2.5, "expo-screen"),
    (r"/prisma/.*schema\.prisma$", 1.5, "prisma-schema"),
    (r"(/lib/supabase|/utils/supabase|/supabase/).*\.[jt]s$", 1.5, "supabase-client"),
    (r"/routes/.*\.[jt]s$", 2.5, "routes-folder"),
    (r"/controllers/.*\.[jt]s$", 2.5, "controllers-folder"),
    (r"/handlers/.*\.[jt]s$", 2.5, "handlers-folder"),
    (r"/(components|views)/.*\.[jt]sx$", 1.5, "react-component"),
    (r"views\.py$", 3.0, "django-views"),
    (r"urls\.py$", 2.0, "django-urls"),
    (r"/(routers|endpoints|routes)/.*\.py$", 2.5, "api-routers"),
    (r"/api/(?!.*__init__\.py$).*\.py$", 2.0, "api-folder"),
    (r"/controllers?/.*\.java$", 3.0, "spring-controller"),
    (r"controller\.java$", 3.0, "spring-controller-file"),
    (r"/services?/.*\.java$", 1.8, "java-service"),
    (r"/controllers?/.*\.kt$|controller\.kt$", 3.0, "spring-kotlin-controller"),
    (r"/routes/.*\.kt$", 2.5, "ktor-routes"),
    (r"/plugins/.*\.kt$", 2.0, "ktor-plugin"),
    (r"(routing|routes)\.kt$", 2.5, "ktor-routing-file"),
    (r"/(activity|ui)/.*\.kt$", 2.5, "android-ui"),
    (r"(activity|fragment)\.kt$", 2.5, "android-component"),
    (r"/main\.kt$", 3.0, "kotlin-main"),
    (r"/application\.kt$", 2.5, "kotlin-application"),
    (r"/controllers/.*\.cs$|controller\.cs$", 3.0, "aspnet-controller"),
    (r"/services?/.*\.cs$", 1.8, "aspnet-service"),
    (r"/middleware/.*\.cs$", 2.5, "aspnet-middleware"),
    (r"/hubs/.*\.cs$|hub\.cs$", 2.5, "signalr-hub"),
    (r"/(program|startup)\.cs$", 3.0, "aspnet-entry"),
    (r"/(backgroundservices|hostedservices)/.*\.cs$", 2.0, "aspnet-background-service"),
    (r"/pages/.*\.razor$", 2.5, "blazor-page"),
    (r"/handlers?/.*\.go$", 2.5, "go-handlers"),
    (r"/routes/.*\.go$", 2.5, "go-routes"),
    (r"/controllers/.*\.go$", 2.5, "go-controller"),
    (r"/main\.go$", 3.0, "go-main"),
    (r"/(handlers|routes)/.*\.rs$", 2.5, "rust-handlers"),
    (r"/main\.rs$", 3.0, "rust-main"),
    (r"/bin/.*\.rs$", 2.5, "rust-bin"),
    (r"/main\.(c|cpp|cc)$", 3.0, "c-main"),
    (r"/src/(.*/)?app\.(c|cpp)$", 2.5, "c-app"),
    (r"/routes/.*\.php$", 3.0, "laravel-routes"),
    (r"/controllers/.*\.php$", 3.0, "laravel-controller"),
    (r"controller\.php$", 3.0, "laravel-controller-file"),
    (r"/commands/.*\.php$", 2.5, "laravel-command"),
    (r"/jobs/.*\.php$", 2.5, "laravel-job"),
    (r"/listeners/.*\.php$", 2.5, "laravel-listener"),
    (r"/http/middleware/.*\.php$", 2.5, "laravel-middleware"),
    (r"/providers/.*\.php$", 1.8, "laravel-provider"),
    (r"/policies/.*\.php$", 2.0, "laravel-policy"),
    (r"/models/.*\.php$", 1.5, "laravel-model"),
    (r"/services/.*\.php$", 1.8, "laravel-service"),
    (r"/repositories/.*\.php$", 1.5, "laravel-repository"),
    (r"/(bin|exe)/.*\.rb$", 2.5, "ruby-executable"),
    (r"/rakefile$|\.rake$", 1.5, "ruby-rake"),
    (r"/(appdelegate|scenedelegate|app)\.swift$", 3.0, "ios-app-entry"),
    (r"/sources/.*app\.swift$", 3.0, "swiftui-app"),
    (r"/(viewcontrollers|controllers|screens)/.*\.swift$", 2.5, "uikit-viewcontroller"),
    (r"(viewcontroller|vc)\.swift$", 2.5, "uikit-viewcontroller-file"),
    (r"/coordinators/.*\.swift$|coordinator\.swift$", 2.5, "ios-coordinator"),
    (r"/(views|scenes)/.*\.swift$", 1.8, "swiftui-view"),
    (r"/services/.*\.swift$", 1.8, "ios-service"),
    (r"/router/.*\.swift$", 2.0, "ios-router"),
    (r"/(main|app)\.dart$", 3.0, "flutter-main"),
    (r"/(screens|pages|views)/.*\.dart$", 2.5, "flutter-screen"),
    (r"/routes/.*\.dart$", 2.5, "flutter-routes"),
    (r"/(bloc|controllers|cubit|presentation)/.*\.dart$", 2.0, "flutter-state-management"),
    (r"/(services|domain)/.*\.dart$", 1.8, "flutter-service"),
]
# Decorator and annotation texts by language with their multiplier.
AST_RULES = [
    ("java", r"@(RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\b", 3.2, "spring-annotation"),
    ("kotlin", r"@(RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\b", 3.2, "spring-annotation"),
    ("python", r"@\w+\.(get|post|put|delete|patch|route|websocket)\(", 3.0, "python-route-decorator"),
    ("typescript", r"@(Controller|Get|Post|Put|Delete|Patch|Query|Mutation|Resolver)\(", 3.0, "nestjs-decorator"),
    ("csharp", r"\[(ApiController|HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\b", 3.2, "aspnet-attribute"),
    ("php", r"#\[Route\(", 3.0, "php-route-attribute"),
]


def _first(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def _norm(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def path_multiplier(path: Column | str) -> Column:
    p = _norm(path)
    return _first([(p.rlike(pattern), F.lit(weight)) for pattern, weight, _ in PATH_RULES], F.lit(1.0))


def path_reason(path: Column | str) -> Column:
    p = _norm(path)
    return _first([(p.rlike(pattern), F.lit(reason)) for pattern, _, reason in PATH_RULES], F.lit(None).cast("string"))


def ast_multiplier(language: Column | str, text: Column | str) -> Column:
    language = F.col(language) if isinstance(language, str) else language
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return _first([((language == lang) & text.rlike(pattern), F.lit(weight)) for lang, pattern, weight, _ in AST_RULES], F.lit(1.0))
