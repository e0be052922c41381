"""Languages by extension, and which paths are tracked, as column expressions.

The lists are behavioural data that must equal those of the index this engine replaces.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "java": "java", "c": "c", "h": "c", "go": "go"}
# Extensions that the full index scans, case-sensitive.
SCANNED = ("py", "js", "ts", "java", "c", "h", "go")
# Extensions of tracked code files, without case.
TRACKED_EXTENSIONS = (
    "java", "kt", "kts", "groovy", "scala", "c", "h", "cpp", "hpp", "cc", "hh", "cxx", "hxx", "tpp", "txx", "go", "ts", "tsx", "js", "jsx", "mjs",
    "cjs", "py", "pyi", "pyx", "pxd", "pxi", "rs", "rb", "php", "swift", "m", "mm", "cs", "fs", "fsx", "vb", "r", "dart", "lua", "pl", "pm", "t",
    "pod", "jl", "ex", "exs", "erl", "hrl", "elm", "clj", "cljc", "cljs", "edn",
)
# Tracked names without a tracked extension.
IMPORTANT_NAMES = (
    "Dockerfile", "Makefile", "CMakeLists.txt", ".gitignore", ".dockerignore", "BUILD", "WORKSPACE", "*.bzl", "pom.xml", "build.gradle",
    "settings.gradle", "Cargo.toml", "go.mod", "go.sum", "requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "tox.ini", ".flake8",
    ".eslintrc*", ".prettierrc*", ".babelrc*", "webpack.config.js", "rollup.config.js", "tsconfig.json", "jsconfig.json",
)
# Directories that are not entered.
IGNORED_DIRECTORIES = (
    ".git", ".github", "__pycache__", "node_modules", ".pytest_cache", "venv", "env", ".venv", "dist", "build", "target", "bin", "obj", "out",
    ".gradle", ".mvn", ".idea", ".vscode", ".vs", ".history", ".next", ".nuxt", ".output", ".cache", "vendor", "third_party", "third-party",
    ".bundle", "eggs", ".eggs", "lib", "lib64", "parts", "sdist", "var", "wheels", "*.egg-info", ".installed.cfg", "*.egg", ".mypy_cache", ".pyre",
    ".pytype", "bower_components", "jspm_packages", ".npm", ".yarn", ".settings", ".classpath", ".project", ".factorypath", ".recommenders",
    ".sts4-cache", "pkg", "pkg-mod", "mod", "CMakeFiles", "cmake-build-*", "Debug", "Release", "x64", "x86", "logs", "tmp", "temp", "coverage",
    ".nyc_output", "__snapshots__", ".serverless", ".terraform", ".env", ".env.*",
)
# Files that are ignored by name.
IGNORED_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "Pipfile.lock",
    "*.min.js", "*.bundle.js", "*.chunk.js", "*.map", "*.d.ts.map", "*.js.map", "*.min.css", "*.generated.*", "*.pb.go", "*.pb.cc", "*.pb.h",
    "*.grpc.pb.*", "*.thrift.*", "*.iml", "*.iws", "*.ipr", ".classpath", ".project", ".settings/*", "*.sublime-*", "*.sqlite", "*.db", "*.sql",
    "*.csv", "*.parquet", "*.avro", "*.orc", "*.feather", "*.pickle", "*.pkl", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.mp4",
    "*.mp3", "*.webm", "*.wav", "*.ogg", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.zip", "*.tar", "*.gz", "*.bz2", "*.7z", "*.rar", "*.jar", "*.war",
    "*.ear", "*.nar", "*.dmg", "*.pkg", "*.deb", "*.rpm", "*.nupkg", "*.whl", "*.egg", "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.obj", "*.class",
    "*.pyo", "*.pyd", "*.pyc", "*.wasm", "*.wasm-decompile", "*.wasm.map", "*.md", "*.txt", "*.rst", "LICENSE*", "COPYING*", "README*", "CHANGELOG*",
    "CONTRIBUTING*", "CODE_OF_CONDUCT*", "SECURITY*", "MAINTAINERS*", "AUTHORS*", ".DS_Store", "Thumbs.db", "desktop.ini",
)
# Directories that indexing skips.
SKIPPED_DIRECTORIES = ("__pycache__", "node_modules", ".git", "venv", "env")


def glob_regex(patterns, anywhere: bool = False) -> str:
    """One anchored expression for shell patterns; with ``anywhere``, each may start anywhere."""
    parts = []
    for p in patterns:
        body = "".join("[\\s\\S]*" if ch == "*" else "[\\s\\S]" if ch == "?" else "\\" + ch if ch in ".^$+{}()|[]\\" else ch for ch in p)
        parts.append(("[\\s\\S]*" if anywhere else "") + body)
    return "^(?:" + "|".join(parts) + ")$"


IGNORED_DIRECTORY_RE = glob_regex(IGNORED_DIRECTORIES)
IGNORED_NAME_RE = glob_regex(IGNORED_FILES)
IGNORED_PATH_RE = glob_regex(IGNORED_FILES, anywhere=True)
IMPORTANT_RE = glob_regex(IMPORTANT_NAMES)
EXTENSION_RE = r"^.+\.([^.]+)$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Without the dot, as written; '' for dotfiles and names without one."""
    return F.regexp_extract(file_name(path), EXTENSION_RE, 1)


def language(path: Column) -> Column:
    """Null where the extension has no language."""
    ext, out = F.lower(extension(path)), F.lit(None).cast("string")
    for lang in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin(sorted(e for e, x in LANGUAGES.items() if x == lang)), lang).otherwise(out)
    return out


def tracked(path: Column) -> Column:
    """Whether a file is tracked: no ignored directory on its relative path, not ignored by name or path,
    and of a code extension or an important name."""
    parts = F.split(path, "/")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ignored = F.exists(directories, lambda p: p.rlike(IGNORED_DIRECTORY_RE)) | file_name(path).rlike(IGNORED_NAME_RE) | path.rlike(IGNORED_PATH_RE)
    return ~ignored & (F.lower(extension(path)).isin(list(TRACKED_EXTENSIONS)) | file_name(path).rlike(IMPORTANT_RE))


def skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def is_tracked(path: str) -> bool:
    """The same for one relative path, for the walk on the driver."""
    *directories, name = path.split("/")
    if any(is_ignored_directory(d) for d in directories):
        return False
    if any(fnmatch.fnmatchcase(name, p) or fnmatch.fnmatchcase(path, "*" + p) for p in IGNORED_FILES):
        return False
    stem, dot, ext = name.rpartition(".")
    return bool(stem and dot and ext.lower() in TRACKED_EXTENSIONS) or any(fnmatch.fnmatchcase(name, p) for p in IMPORTANT_NAMES)


def is_ignored_directory(name: str) -> bool:
    return any(fnmatch.fnmatchcase(name, p) for p in IGNORED_DIRECTORIES)
