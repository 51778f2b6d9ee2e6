"""Path predicates, classes and scores as column expressions; they stay inside code generation and push down where Parquet can."""

from __future__ import annotations

import fnmatch
import posixpath
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, names and stems that class a path.
SOURCE_SUFFIXES = ["c", "cc", "cpp", "cs", "go", "h", "hpp", "java", "js", "jsx", "kt", "m", "php", "py", "rb", "rs", "swift", "ts", "tsx"]
DOC_MARKERS = ["readme", "changelog", "changes", "history", "news", "release-notes"]
DOCS_BUILD_ANYWHERE = ["mkdocs.yml", "mkdocs.yaml", ".readthedocs.yaml"]
DOCS_BUILD_BELOW_DOCS = ["conf.py", "make.bat", "makefile"]
WORKFLOW_NAMES = [".readthedocs.yaml", "mkdocs.yaml", "mkdocs.yml", "pytest.ini", "pyproject.toml", "setup.cfg", "setup.py", "tox.ini", "noxfile.py", "conftest.py"]
GENERIC_SEGMENTS = ["src", "tests", "test", "python", "lib"]
LOW_QUALITY_SEGMENTS = ["dist", "vendor", "node_modules"]
# Score by domain of the first class in order that fits, the last for none.
DOMAIN_SCORES = {
    "docs_policy": [("docs_authority", 1.0), ("workflow", 0.96), ("source", 0.30), ("test", 0.22), (None, 0.28)],
    "workflow_config": [("workflow", 1.0), ("docs_authority", 0.97), ("source", 0.26), ("test", 0.18), (None, 0.24)],
    "code": [("source", 1.0), ("test", 0.82), ("docs_authority", 0.28), ("workflow", 0.22), (None, 0.66)],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def normalized(c: Column | str) -> Column:
    """Slashes forward, none at the end."""
    return F.regexp_replace(F.translate(col(c), "\\", "/"), "/+$", "")


def lowered(c: Column | str) -> Column:
    return F.lower(normalized(c))


def segments(c: Column | str) -> Column:
    return F.filter(F.split(lowered(c), "/"), lambda x: x != "")


def basename(c: Column | str) -> Column:
    return F.substring_index(lowered(c), "/", -1)


def parent(c: Column | str) -> Column:
    """Directory of a path, '.' where it has none."""
    p = F.regexp_replace(normalized(c), "/?[^/]*$", "")
    return F.when(p != "", p).otherwise(F.when(normalized(c).startswith("/"), F.lit("/")).otherwise(F.lit(".")))


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension_label(c: Column | str) -> Column:
    """Lower-case suffix with its full stop, or '<none>'."""
    e = F.regexp_extract(basename(c), r"[^.](\.[^.]+)$", 1)
    return F.when(e == "", F.lit("<none>")).otherwise(e)


def is_source(c: Column | str) -> Column:
    return lowered(c).rlike(rf"\.({'|'.join(SOURCE_SUFFIXES)})$") | lowered(c).rlike("(^|/)src(/|$)")


def is_test(c: Column | str) -> Column:
    p = lowered(c)
    return p.rlike("(^|/)tests?(/|$)") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"_test\.(py|go)$") | basename(c).contains(".spec.")


def is_docs(c: Column | str) -> Column:
    p = lowered(c)
    return p.contains("/docs/") | p.contains("/doc/") | p.startswith("docs/") | stem(c).rlike("|".join(DOC_MARKERS))


def is_docs_build(c: Column | str) -> Column:
    return basename(c).isin(DOCS_BUILD_ANYWHERE) | (is_docs(c) & basename(c).isin(DOCS_BUILD_BELOW_DOCS))


def is_docs_authority(c: Column | str) -> Column:
    return lowered(c).rlike("(^|/)docs/internals/") | is_docs(c) | is_docs_build(c)


def is_workflow(c: Column | str) -> Column:
    return lowered(c).rlike(r"(^|/)\.github/workflows/") | is_docs_build(c) | basename(c).isin(WORKFLOW_NAMES)


_CLASSES = {"source": is_source, "test": is_test, "docs_authority": is_docs_authority, "workflow": is_workflow}


def is_authority(c: Column | str, domain: str) -> Column:
    """Paths that speak with authority in a domain of queries: tests and sources for code, else documentation and workflows."""
    return is_source(c) | is_test(c) if domain == "code" else is_docs_authority(c) | is_workflow(c)


def domain_score(c: Column | str, domain: str) -> Column:
    out = F.lit(DOMAIN_SCORES[domain][-1][1])
    for name, score in reversed(DOMAIN_SCORES[domain][:-1]):
        out = F.when(_CLASSES[name](c), F.lit(score)).otherwise(out)
    return out


def is_auxiliary(c: Column | str, domain: str) -> Column:
    if domain != "code":
        return F.lit(False)
    p = lowered(c)
    return is_docs(c) | is_workflow(c) | p.contains("/examples/") | p.contains("/example/")


def quality(c: Column | str, domain: str) -> Column:
    low = any_of([lowered(c).rlike(f"(^|/){s}(/|$)") for s in LOW_QUALITY_SEGMENTS])
    return F.when(low, 0.0).otherwise(domain_score(c, domain))


def path_class(c: Column | str) -> Column:
    """src, tests, scripts or other, by the first of these that is a segment."""
    s = segments(c)
    return F.when(F.array_contains(s, "src"), "src").when(F.array_contains(s, "tests"), "tests").when(F.array_contains(s, "scripts"), "scripts").otherwise("other")


def in_src(c: Column | str) -> Column:
    return F.array_contains(segments(c), "src")


def is_ranking_test(c: Column | str) -> Column:
    """Test path as the vector ranking sees it: .spec only for four suffixes."""
    p = lowered(c)
    return p.rlike("(^|/)tests?(/|$)") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"_test\.(py|go)$") | p.rlike(r"\.spec\.(ts|tsx|js|jsx)$")


def is_test_name(c: Column | str) -> Column:
    return F.lower(col(c)).rlike("^test(_|$)")


def under(c: Column | str, prefix: str) -> Column:
    """The path itself or anything below it; src doesn't match src2."""
    p = prefix.replace("\\", "/").rstrip("/")
    return (col(c) == p) | col(c).startswith(p + "/")


def under_any(c: Column | str, prefixes: list[str]) -> Column:
    return any_of([under(c, p) for p in prefixes])


def path_forms(path: str, root: str | None = None) -> list[str]:
    """The forms in which a path may be stored: as given, normalised, relative to the root, absolute."""
    p = path.replace("\\", "/").rstrip("/")
    forms = [path, p, posixpath.normpath(p), posixpath.normpath(p).removeprefix("./")]
    if root:
        r = root.replace("\\", "/").rstrip("/")
        forms += [p.removeprefix(r + "/"), posixpath.normpath(f"{r}/{p}") if not p.startswith("/") else p]
    return list(dict.fromkeys(x for x in forms if x))


def glob_to_regex(glob: str) -> str:
    """fnmatch semantics, in which * also crosses slashes."""
    return "(?s)^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"


def matches_any(c: Column | str, globs: list[str]) -> Column:
    return any_of([col(c).rlike(glob_to_regex(g)) for g in globs])


def allowed(c: Column | str, prefixes: list[str] = (), include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> Column:
    """Conjunction of the path filters of a search."""
    out = F.lit(True)
    if prefixes:
        out = out & under_any(c, list(prefixes))
    if include:
        out = out & matches_any(c, list(include))
    for g in (exclude, ignore):
        if g:
            out = out & ~matches_any(c, list(g))
    return out


def escape_like(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"([\\%_])", r"\\$1")


def subtree_segments(c: Column | str) -> Column:
    return F.filter(segments(c), lambda x: ~x.isin([*GENERIC_SEGMENTS, "."]))


def test_relevance(implementation: Column | str, candidate: Column | str) -> Column:
    """Shared path segments without generic ones, 3 more for an equal stem, 2 for a contained one."""
    shared = F.size(F.array_intersect(subtree_segments(implementation), subtree_segments(candidate)))
    a, b = stem(implementation), F.regexp_replace(F.regexp_replace(stem(candidate), "^test_", ""), "_test$", "")
    return shared + F.when(a == "", 0).when(a == b, 3).when(b.contains(a), 2).otherwise(0)


def module_distance(anchor: Column | str, other: Column | str) -> Column:
    """Steps in the directory tree between two files; 0 without an anchor."""
    dirs = lambda c: F.filter(F.split(F.regexp_replace(col(c), "/?[^/]*$", ""), "/"), lambda x: x != "")
    a, b = dirs(anchor), dirs(other)
    same = F.aggregate(F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y),
                       F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda s, eq: F.struct(F.when(s.on & eq, s.n + 1).otherwise(s.n).alias("n"), (s.on & eq).alias("on"))).n
    return F.when(col(anchor).isNull() | (col(anchor) == ""), 0).otherwise(F.size(a) + F.size(b) - 2 * same)
