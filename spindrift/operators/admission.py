"""Which files' texts are worth indexing: the first reason against one wins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lock files, extensions and names of generated text, folders of build output, dependencies and caches.
LOCKFILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock cargo.lock go.sum go.work.sum poetry.lock pdm.lock pipfile.lock composer.lock gemfile.lock cargo.lock.json mix.lock pubspec.lock packages.lock.json".split()
JSON = "json jsonc json5".split()
MINIFIED = [".min.", "-min.", ".bundle.", ".chunk.", ".minified."]
BUILD = "dist build out target bin obj _build .next .nuxt coverage deps incremental .fingerprint".split()
DEPENDENCIES = "site-packages node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache .ruff_cache".split()
CACHES = "gocache go-build .npm _cacache .pnpm-store pnpm-store .yarn yarn-cache .cargo .gradle .nuget .cache".split()
CACHE_PATHS = [
    "/cargo/registry/", "/cargo/git/", "/pip/cache/", "/pip-cache/", "/uv/cache/", "/.cache/uv/", "/cachestorage/", "/gpucache/", "/code cache/",
    "/dawncache/", "/mozilla/firefox/", "/google/chrome/", "/microsoft/edge/", "/chromium/user data/", "/node_modules/.cache/", "/go/pkg/mod/",
    "/.rustup/", "/.m2/repository/"
]
BINARY = "exe dll so dylib bin obj o a lib class jar war pyc png jpg jpeg gif bmp ico webp tif tiff mp3 mp4 avi mov mkv wav flac zip gz tar 7z rar xz bz2 zst iso img nrrd raw ttf otf woff woff2 db sqlite".split()
LARGE_JSON, MINIFIED_LINE, MINIFIED_SIZE, SAMPLE = 100 << 10, 2048, 32 << 10, 64 << 10
#: Bytes of text kept outside and inside of repositories; files of more than twice as much aren't read.
TEXT_OUTSIDE, TEXT_INSIDE = 1 << 20, 10 << 20


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def ignore_rules(lines: list[str]) -> list[tuple[str, bool, bool]]:
    """Patterns of one ignore file as regular expressions over ``/``-paths relative to it, whether they take back, and whether they hold for folders only."""
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line[back:].lstrip("\\") if line[back : back + 2] in ("\\#", "\\!") else line[back:]
        folder = body.endswith("/")
        body = body.rstrip("/")
        rooted = "/" in body
        body = body.lstrip("/")
        regex = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", body):
            regex += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(
                part, part.replace("[!", "[^") if part.startswith("[") else re.escape(part)
            )
        out.append(("^" + ("" if rooted else "(?:.*/)?") + regex + "$", back, folder))
    return out


def _verdict(path: Column, is_dir: Column, rules: dict[str, list[tuple[str, bool, bool]]]) -> Column:
    """What the deepest ignore file with a matching line says of one path (with ``/``), its last such line: true, false, or null."""
    out = F.lit(None).cast("boolean")
    for root in sorted(rules, key=lambda r: len(r.replace("\\", "/").rstrip("/"))):  # deeper files are asked last, and win
        base = root.replace("\\", "/").rstrip("/")
        relative = F.substring(path, len(base) + 2, 1 << 30)
        own = F.lit(None).cast("boolean")
        for regex, back, folder in rules[root]:
            own = F.when(relative.rlike(regex) & (is_dir if folder else F.lit(True)), F.lit(not back)).otherwise(own)
        out = F.when(F.lower(path).startswith(base.lower() + "/"), F.coalesce(own, out)).otherwise(out)
    return out


def ignored(path: Column, is_dir: Column, rules: dict[str, list[tuple[str, bool, bool]]]) -> Column:
    """Whether ignore files (by their folder) leave a path out; case counts. What lies in an ignored folder can't be taken back."""
    if not rules:
        return F.lit(False)
    slashed = F.translate(path, "\\", "/")
    parts = F.split(slashed, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return (
        F.coalesce(_verdict(slashed, is_dir, rules), F.lit(False))
        | F.exists(F.slice(above, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda a: F.coalesce(_verdict(a, F.lit(True), rules), F.lit(False)))
    )


def reason(
    roots: list[str] = (), excludes: list[str] = (), extensions: list[str] = (), user_skips: list[str] = (), repositories: list[str] = (),
    rules: dict[str, list[tuple[str, bool, bool]]] | None = None
) -> Column:
    """Why an entry isn't admitted, null if it is. In order: binary, ext, exclude, gitignore, user_skip, lockfile, large_json, minified, build_output, dependency, cache, root."""
    path = F.concat(F.lit("/"), F.translate("path_l", "\\", "/"))
    inside = lambda root: path.startswith("/" + root.lower().replace("\\", "/").rstrip("/") + "/")
    in_repo = _any([inside(r) for r in repositories])
    folders = F.slice(F.split("path_l", r"\\"), 1, F.greatest(F.lit(0), F.size(F.split("path_l", r"\\")) - 1))
    segment = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    by_rules = ignored(F.col("path"), F.col("is_dir"), rules or {})
    steps = [
        ("binary", F.col("ext_l").isin(BINARY)),
        ("ext", ~F.col("ext_l").isin(list(extensions)) if extensions else F.lit(False)),
        ("exclude", _any([inside(x) for x in excludes])),
        ("gitignore", by_rules),
        ("user_skip", _any([path.contains(s.lower()) for s in user_skips])),
        ("lockfile", F.col("name_l").isin(LOCKFILES)),
        ("large_json", F.col("ext_l").isin(JSON) & (F.col("size") >= LARGE_JSON)),
        ("minified", _any([F.col("name_l").contains(s) for s in MINIFIED])),
        ("build_output", ~in_repo & segment(BUILD)),
        ("dependency", ~in_repo & segment(DEPENDENCIES)),
        ("cache", segment(CACHES) | _any([F.concat(path, F.lit("/")).contains(s) for s in CACHE_PATHS])),
        ("root", ~_any([inside(r) for r in roots]) if roots else F.lit(False)),
    ]
    out = None
    for name, test in steps:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def minified_text(text: Column) -> Column:
    """Generated text by its lines: long texts whose first part has very long lines on average."""
    head = F.substring(text, 1, SAMPLE)
    return (F.octet_length(text) >= MINIFIED_SIZE) & (F.length(head) / F.size(F.split(head, "\n")) > MINIFIED_LINE)


def text_cap(repositories: list[str] = ()) -> Column:
    """Bytes of text that are kept of an entry, by whether it lies in a repository."""
    path = F.concat(F.lit("/"), F.translate("path_l", "\\", "/"))
    in_repo = _any([path.startswith("/" + r.lower().replace("\\", "/").rstrip("/") + "/") for r in repositories])
    return F.when(in_repo, TEXT_INSIDE).otherwise(TEXT_OUTSIDE)


def capped(entries: DataFrame, repositories: list[str] = ()) -> DataFrame:
    """Entries whose texts keep to the caps of an index: adds ``truncated`` and ``skipped``.

    A file of more than twice its cap isn't read (null text, ``skipped``); a longer text is cut behind its last whole
    character and marked. This is the limit of the index that it is modelled on; every other operator takes whole texts.
    """
    cap, raw = text_cap(repositories), F.encode("text", "UTF-8")
    skipped = F.coalesce(F.col("size") > 2 * cap, F.lit(False))
    longer = F.coalesce(F.octet_length("text") > cap, F.lit(False))
    follows = [F.hex(F.substring(raw, cap - k + 1, F.lit(1))).rlike("^[89AB]") for k in range(4)]  # a character has 4 bytes at most
    at = F.when(~follows[0], cap).when(~follows[1], cap - 1).when(~follows[2], cap - 2).otherwise(cap - 3)
    text = F.when(skipped, F.lit(None).cast("string")).when(longer, F.decode(F.substring(raw, F.lit(1), at), "UTF-8")).otherwise(F.col("text"))
    return entries.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in entries.columns], (longer & ~skipped).alias("truncated"), skipped.alias("skipped")
    )


def linked_worktrees(entries: DataFrame) -> DataFrame:
    """Folders that are linked worktrees: their ``.git`` is a file that points into the worktrees of another repository: volume, root."""
    pointer = entries.where("not is_dir and name_l = '.git' and text is not null")
    points = F.translate(F.lower("text"), "\\", "/").rlike(r"^\s*gitdir:.*/\.git/worktrees/")
    return pointer.where(points).select("volume", F.substring("path", F.lit(1), F.length("path") - 5).alias("root"))


def estimate(entries: DataFrame, why: Column, units: list[str], repositories: list[str] = ()) -> DataFrame:
    """What an index of some folders would hold, before any text is read: unit, ext, reason, files, bytes.

    Admitted files count under their unit (the longest of ``units`` above them) with at most their cap of bytes; files
    left out count under the reason, whole; what lies in no unit isn't counted.
    """
    path = F.concat(F.lit("/"), F.translate("path_l", "\\", "/"))
    unit = None
    for u in sorted(units, key=len, reverse=True):
        inside = path.startswith("/" + u.lower().replace("\\", "/").rstrip("/") + "/")
        unit = F.when(inside, u) if unit is None else unit.when(inside, u)
    shown = (
        entries.where("not is_dir")
            .select(
                unit.alias("unit"), F.col("ext_l").alias("ext"), F.coalesce(why, F.lit("admitted")).alias("reason"), "size",
                text_cap(repositories).alias("cap")
            )
            .where("unit is not null")
    )
    kept = F.when(F.col("reason") == "admitted", F.least("size", "cap")).otherwise(F.col("size"))
    return shown.groupBy("unit", "ext", "reason").agg(F.count("*").alias("files"), F.sum(kept).alias("bytes"))


def tally(entries: DataFrame, why: Column) -> DataFrame:
    """Files and bytes per reason; admitted files count under ``admitted``."""
    return (
        entries.where("not is_dir")
            .groupBy(F.coalesce(why, F.lit("admitted")).alias("reason"))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )
