"""Scanning a repository: paths, ignore rules, languages, contents, text sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories, extensions and file names that are never scanned.
IGNORED_DIRS = """.git .svn .hg .bzr .idea .vscode .vs .eclipse .settings .DS_Store Thumbs.db node_modules bower_components jspm_packages vendor
third_party 3rdparty venv .venv env .env __pycache__ .pytest_cache .mypy_cache site-packages .tox eggs .eggs lib64 parts sdist wheels dist build out
output bin obj target .next .nuxt .output .vercel .netlify .serverless _build public/build .parcel-cache .turbo .svelte-kit coverage .nyc_output
htmlcov .coverage __tests__ __mocks__ .jest logs log tmp temp cache .cache .tmp .temp .generated generated auto-generated .terraform .husky .github
.circleci .gitlab fixtures snapshots __snapshots__""".split()
IGNORED_EXTENSIONS = """png jpg jpeg gif svg ico webp bmp tiff tif psd ai sketch fig xd zip tar gz rar 7z bz2 xz tgz exe dll so dylib a lib o obj class
jar war ear pyc pyo pyd beam wasm node pdf doc docx xls xlsx ppt pptx odt ods odp mp4 mp3 wav mov avi mkv flv wmv ogg webm flac aac m4a woff woff2
ttf eot otf db sqlite sqlite3 mdb accdb min.js min.css bundle.js chunk.js map lock pem key crt cer p12 pfx csv tsv parquet avro feather npy npz pkl
pickle h5 hdf5 bin dat data raw iso img dmg""".split()
IGNORED_FILES = """package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Cargo.lock go.sum .gitignore .gitattributes .npmrc
.yarnrc .editorconfig .prettierrc .prettierignore .eslintignore .dockerignore Thumbs.db .DS_Store LICENSE LICENSE.md LICENSE.txt CHANGELOG.md CHANGELOG
CONTRIBUTING.md CODE_OF_CONDUCT.md SECURITY.md .env .env.local .env.development .env.production .env.test .env.example""".split()
# Extensions by language, and file names of Ruby without one.
LANGUAGES = {
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx mts cts",
    "python": "py",
    "java": "java",
    "c": "c",
    "cpp": "cpp cc cxx h hpp hxx hh",
    "csharp": "cs",
    "go": "go",
    "ruby": "rb rake gemspec",
    "rust": "rs",
    "php": "php phtml php3 php4 php5 php8",
    "kotlin": "kt kts",
    "swift": "swift",
    "dart": "dart",
    "vue": "vue",
    "cobol": "cbl cob cpy cobol",
}
RUBY_FILES = "Rakefile Gemfile Guardfile Vagrantfile Brewfile".split()
MAX_FILE_BYTES, FILE_BYTES_CEILING = 512 * 1024, 32 * 1024 * 1024


def max_file_bytes(setting_kb: str | int | None = None) -> int:
    """Size limit from a setting in KB; the default for no or an invalid one, clamped to the ceiling."""
    try:
        kb = float(setting_kb) if setting_kb not in (None, "") else None
    except (TypeError, ValueError):
        kb = None
    if kb is None or kb <= 0 or kb != int(kb):
        return MAX_FILE_BYTES
    return min(int(kb) * 1024, FILE_BYTES_CEILING)


def language_of(path: Column | str) -> Column:
    """Language by extension (or name); null if unknown."""
    path = F.col(path) if isinstance(path, str) else path
    pairs = [F.lit(x) for language, names in LANGUAGES.items() for name in names.split() for x in (name, language)]
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.when(path.contains("."), F.element_at(F.split(path, r"\."), -1)))
    return F.coalesce(F.create_map(*pairs)[extension], F.when(name.isin(RUBY_FILES), "ruby"))


def _glob(rule: str) -> str:
    """A gitignore pattern as a regular expression over a relative path."""
    anchored = rule.startswith("/") or "/" in rule.rstrip("/")
    body = rule.strip("/")
    out = ""
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if rule.endswith("/") else "(?:/|$)")


def ignored(path: Column | str, rules: list[str] = ()) -> Column:
    """Built-in deny lists, then gitignore-style rules; the last matching rule wins and ! takes back."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.element_at(parts, -1)
    extensions = "|".join(re.escape(e) for e in IGNORED_EXTENSIONS)
    built_in = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS])) | name.isin(IGNORED_FILES) | F.lower(name).rlike(rf"\.({extensions})$") | path.contains("public/build/")
    verdict = built_in
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        verdict = F.when(path.rlike(_glob(rule[1:] if keep else rule)), F.lit(not keep)).otherwise(verdict)
    return verdict


def scan(spark: SparkSession, root: str, rules: list[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size) of the files below root that are small enough and not ignored; contents are not read."""
    base = re.sub(r"/+$", "", root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    relative = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    return raw.select(relative.alias("path"), "size").where((F.col("size") <= max_bytes) & ~ignored("path", rules))


def contents(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, rules: list[str] = ()) -> DataFrame:
    """(path, size, content, language, hash): decoded text of the scanned files."""
    base = re.sub(r"/+$", "", root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    picked = raw.select(relative.alias("path"), F.col("length").alias("size"), "content").where((F.col("size") <= max_bytes) & ~ignored("path", rules))
    return picked.select("path", "size", F.try_validate_utf8(F.col("content").cast("string")).alias("content"), language_of("path").alias("language"), F.sha2("content", 256).alias("hash")).where("content IS NOT NULL")


def diff_hunks(lines: DataFrame, diff: str = "diff_id", number: str = "n", text: str = "line") -> DataFrame:
    """(diff_id, filePath, startLine, endLine) of unified diffs given line by line: new side, empty hunks left out."""
    from ..operators.relational import carry_forward

    header = F.when(F.col(text).startswith("+++ b/"), F.substr(F.col(text), F.lit(7)))
    marked = carry_forward(lines, diff, [number], header, "filePath")
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hunk = marked.where(F.col(text).rlike(pattern) & F.col("filePath").isNotNull())
    size = F.regexp_extract(text, pattern, 2)
    start = F.regexp_extract(text, pattern, 1).cast("long")
    count = F.when(size == "", F.lit(1).cast("long")).otherwise(F.try_to_number(size, F.lit("9999999999")).cast("long"))
    return hunk.select(diff, "filePath", start.alias("startLine"), (start + count - 1).alias("endLine")).where("endLine >= startLine")


def diff_lines(diffs: DataFrame, diff: str = "diff_id", text: str = "text") -> DataFrame:
    return diffs.select(diff, F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))


def markdown_sections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n, level, title, startLine, endLine, parent): ATX headings outside code fences; lines from 1.

    A section ends before the next heading of its own or a higher level; its parent is the nearest earlier heading
    of a lower level number. Both are folds over the headings of one file.
    """
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    step = lambda a, x: F.struct(
        F.when(x["t"].rlike(r"^\s*(```|~~~)"), ~a["fence"]).otherwise(a["fence"]).alias("fence"),
        F.when(~a["fence"] & x["t"].rlike(r"^#{1,6}\s+\S"), F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"),
    )
    empty = F.struct(F.lit(False).alias("fence"), F.array().cast("array<struct<t:string,n:int>>").alias("out"))
    numbered = F.transform(lines, lambda t, i: F.struct(t.alias("t"), (i + 1).cast("int").alias("n")))
    heads = files.select(F.col(path).alias("path"), F.size(lines).alias("total"), F.aggregate(numbered, empty, step)["out"].alias("h"))
    heads = heads.withColumn("h", F.transform("h", lambda x: F.struct(x["n"].alias("line"), F.length(F.regexp_extract(x["t"], r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x["t"], r"^#+\s+", ""), r"\s+#+\s*$", "")).alias("title"))))
    each = heads.select("path", "total", "h", F.posexplode("h").alias("i", "x"))
    later = F.array_min(F.transform(F.filter("h", lambda y: (y["line"] > F.col("x.line")) & (y["level"] <= F.col("x.level"))), lambda y: y["line"]))
    above = F.array_max(F.transform(F.filter("h", lambda y: (y["line"] < F.col("x.line")) & (y["level"] < F.col("x.level"))), lambda y: y["line"]))
    return each.select("path", F.col("i").alias("n"), "x.level", "x.title", F.col("x.line").alias("startLine"), F.coalesce(later - 1, F.col("total")).alias("endLine"), above.alias("parentLine"))


def markdown_links(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(src, dst): relative links from a Markdown file to other files of the table, confidence 0.8 by convention."""
    link = F.explode(F.regexp_extract_all(content, F.lit(r"\]\(([^)#?\s]+)[^)]*\)"), 1))
    raw = files.where(F.col(path).rlike(r"(?i)\.mdx?$")).select(F.col(path).alias("src"), link.alias("target")).where(~F.col("target").rlike(r"^[a-z]+:|^//|^/"))
    folder = F.when(F.col("src").contains("/"), F.regexp_extract("src", r"^(.*)/[^/]*$", 1)).otherwise("")
    parts = F.filter(F.split(F.concat_ws("/", folder, "target"), "/"), lambda s: (s != "") & (s != "."))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(s))))
    resolved = raw.select("src", F.array_join(walk, "/").alias("dst"))
    return resolved.join(files.select(F.col(path).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()
