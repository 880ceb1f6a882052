"""Column functions that classify paths and file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that decide a file's class.
IGNORED = [".git", ".next", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv"]
BINARY = [
    "7z", "a", "avi", "bin", "bmp", "class", "dll", "dmg", "doc", "docx", "eot", "exe", "gif", "gz", "ico", "jar", "jpeg", "jpg", "mov", "mp3", "mp4", "o", "otf", "pdf",
    "png", "pyc", "so", "tar", "tiff", "ttf", "wasm", "webm", "webp", "woff", "woff2", "xls", "xlsx", "xz", "zip",
]
SENSITIVE = r"^\.env(\..*)?$|^id_rsa$|^credentials|^secrets|\.(pem|key)$"
LANGUAGES = {
    "c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "go": "Go", "h": "C", "hpp": "C++", "html": "HTML", "java": "Java",
    "js": "JavaScript", "jsx": "JavaScript", "json": "JSON", "kt": "Kotlin", "md": "Markdown", "mdx": "Markdown", "mjs": "JavaScript",
    "mts": "TypeScript", "php": "PHP", "ps1": "PowerShell", "py": "Python", "rb": "Ruby", "rs": "Rust", "scss": "SCSS", "sh": "Shell",
    "sql": "SQL", "swift": "Swift", "toml": "TOML", "ts": "TypeScript", "tsx": "TypeScript", "txt": "Text", "xml": "XML", "yaml": "YAML", "yml": "YAML",
}
CONFIGURATION = [
    ".editorconfig", ".gitattributes", ".gitignore", ".npmrc", "biome.json", "cargo.toml", "composer.json", "deno.json", "eslint.config.js", "eslint.config.mjs",
    "go.mod", "package-lock.json", "package.json", "pnpm-lock.yaml", "pyproject.toml", "requirements.txt", "tsconfig.json", "vite.config.js", "vite.config.ts", "yarn.lock",
]
ANALYSED = {"js": "javascript", "cjs": "javascript", "mjs": "javascript", "jsx": "jsx", "ts": "typescript", "cts": "typescript", "mts": "typescript", "tsx": "tsx", "py": "python"}


def segments(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def name_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; a name that only begins with a dot has none."""
    return F.regexp_extract(name_of(path), r"^.+\.([^.]*)$", 1)


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(x) for x in IGNORED]))


def is_sensitive(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.rlike(SENSITIVE))


def is_binary_path(path: Column) -> Column:
    return extension(path).isin(BINARY)


def looks_binary(content: Column) -> Column:
    """A NUL byte, or over a tenth of control bytes other than \\b \\t \\n \\f \\r."""
    text = F.decode(content, "ISO-8859-1")
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0B\x0E-\x1F]", ""))
    return F.contains(text, F.lit("\x00")) | (F.coalesce(odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)) > 0.1)


def language_of(path: Column) -> Column:
    by_extension = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    name = name_of(path)
    return F.when(name == "dockerfile", "Dockerfile").when(name == "makefile", "Makefile").otherwise(F.try_element_at(by_extension, extension(path)))


def parser_language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in ANALYSED.items() for v in kv]), extension(path))


def category_of(path: Column) -> Column:
    """The first class that fits: binary asset, generated, dependency, test, documentation, configuration, source, unknown."""
    s, name, ext = segments(path), name_of(path), extension(path)
    has = lambda *names: F.arrays_overlap(s, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(ext.isin(BINARY), "binary_asset")
        .when(has("generated", "gen") | name.contains(".generated.") | name.rlike(r"\.min\.(js|css)$"), "generated")
        .when(has("deps", "external", "third_party"), "dependency")
        .when(has("test", "tests", "__tests__") | name.rlike(r"\.(test|spec)\.[^.]+$|^test_.*\.py$|_test\.py$"), "test")
        .when(has("docs") | name.rlike(r"^(readme|agents|contributing|changelog|license)(\.|$)") | ext.isin("md", "mdx"), "documentation")
        .when(name.isin(CONFIGURATION) | name.rlike(r"^tsconfig\.|^eslint\.config\.") | F.lower(path).startswith(".github/") | ext.isin("json", "yaml", "yml", "toml"), "configuration")
        .when(language_of(path).isNull(), "unknown")
        .otherwise("source")
    )


def is_normalized(path: Column) -> Column:
    """A relative path with forward slashes and no empty, `.` or `..` part."""
    return (path != "") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.{0,2}(/|$)") & ~path.rlike("^[A-Za-z]:")


def content_status(path: Column, size: Column, content: Column, most: int = 1 << 20) -> Column:
    return F.when(size > most, "oversized").when(is_binary_path(path) | looks_binary(content), "binary").when(~F.is_valid_utf8(content), "malformed").otherwise("text")


def is_eligible(category: Column, status: Column) -> Column:
    return (status == "text") & ~category.isin("generated", "dependency", "binary_asset")


def category_priority(category: Column) -> Column:
    return F.when(category == "source", 0).when(category == "test", 1).when(category == "configuration", 2).when(category == "documentation", 3).otherwise(4)
