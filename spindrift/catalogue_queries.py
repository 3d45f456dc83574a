"""Queries of the search language and of the operators around it, and their SQL over the same projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import admission, content, fuzzy, ranking, rollup, search
from spindrift.operators.changefeed import EqualityDeleteTable
from spindrift.plans.grammar import NANO, Settings, aliases, parse
from spindrift.session import fresh_path, table
from spindrift.sources.entries import ENTRIES_SQL, enriched
from spindrift.sources.entries import indexed as entries
from spindrift.sources.entries import indexed_words
from spindrift.api import Catalogue
from spindrift.sources import extract
from spindrift.sources.sinks import grep_lines, write_index, write_paths
from spindrift.streaming import feed



def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the texts, written once beside the listing."""
    return indexed_words(spark, sf_dir, content.vocabulary, "words")


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_words(spark, sf_dir, fuzzy.name_words, "name_words")


NOW = 1_782_800_000 * NANO
AT = Settings(now=NOW)
B = "chr(92)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _both(text: str) -> str:
    return f"(contains(name_l, '{text}') or contains(name_f, '{text}'))"


def _either(column: str, text: str) -> str:
    return f"(contains({column}_l, '{text}') or contains({column}_f, '{text}'))"


#: name: (query, condition in SQL, settings)
MATCHES: dict[str, tuple[str, str, Settings]] = {
    "q_term": ("quarry", _both("quarry"), AT),
    "q_terms": ("quarry amber", f"{_both('quarry')} and {_both('amber')}", AT),
    "q_phrase": ('"amber (1"', "contains(name_l, 'amber (1')", AT),
    "q_accents": ("resume", _both("resume"), AT),
    "q_accented_term": ("Résumé", "(contains(name_l, 'résumé') or contains(name_f, 'resume'))", AT),
    "q_equals": ("'doc_1002955.md", "(name_l = 'doc_1002955.md' or name_f = 'doc_1002955.md')", AT),
    "q_starts": ("^quarry", "(starts_with(name_l, 'quarry') or starts_with(name_f, 'quarry'))", AT),
    "q_ends": (".rtf$", "(suffix(name_l, '.rtf') or suffix(name_f, '.rtf'))", AT),
    "q_starts_and_ends": ("^quarry md$", "(starts_with(name_l, 'quarry') or starts_with(name_f, 'quarry')) and (suffix(name_l, 'md') "
        "or suffix(name_f, 'md'))", AT),
    "q_or": ("quarry|ember", f"({_both('quarry')} or {_both('ember')})", AT),
    "q_or_mixed": ("ext:md|quarry", f"(ext_l = 'md' or {_both('quarry')})", AT),
    "q_not": ("quarry !ext:md", f"{_both('quarry')} and not ext_l = 'md'", AT),
    "q_not_dash": ("quarry -amber", f"{_both('quarry')} and not {_both('amber')}", AT),
    "q_path": ("path:vendor quarry", f"{_either('path', 'vendor')} and {_either('path', 'quarry')}", AT),
    "q_path_implicit": ("vendor/quarry", f"{_either('path', 'vendor')} and {_either('path', 'quarry')}", AT),
    "q_ext": ("ext:md", "ext_l = 'md'", AT),
    "q_ext_twice": ("ext:md ext:csv", "false", AT),
    "q_ext_promoted": ("dir:wiki-amber md", f"{_either('path', 'wiki-amber')} and ext_l = 'md'", AT),
    "q_dotted_ext": ("path:corpus .md", f"{_either('path', 'corpus')} and ext_l = 'md'", AT),
    "q_dir": ("dir:vendor", _either("path", "vendor"), AT),
    "q_parent": ("parent:vendor", "parent_l = 'vendor'", AT),
    "q_in": (r"in:C:\corpus", f"(path_l = 'c:' || {B} || 'corpus' or starts_with(path_l, 'c:' || {B} || 'corpus' || {B}))", AT),
    "q_in_nested": (r"in:C:\corpus in:C:\corpus\wiki-amber", f"(path_l = 'c:' || {B} || 'corpus' || {B} || 'wiki-amber' "
        f"or starts_with(path_l, 'c:' || {B} || 'corpus' || {B} || 'wiki-amber' || {B}))", AT),
    "q_in_apart": (r"in:C:\corpus in:D:\corpus", "false", AT),
    "q_not_in": (r"!in:C:\corpus ext:md", f"not (path_l = 'c:' || {B} || 'corpus' or starts_with(path_l, 'c:' || {B} || 'corpus' || {B})) "
        f"and ext_l = 'md'", AT),
    "q_under": ("ext:md", f"(path_l = 'd:' || {B} || 'corpus' or starts_with(path_l, 'd:' || {B} || 'corpus' || {B})) "
        f"and ext_l = 'md'", Settings(now=NOW, under="D:\\corpus")),
    "q_glob": ("glob:q*_[0-9]*.??", "regexp_full_match(name_l, 'q[^/]*_[0-9][^/]*\\.[^/][^/]')", AT),
    "q_glob_bare": ("*amber*.md", "regexp_full_match(name_l, '.*amber.*\\.md')", AT),
    "q_braces": ("*.{md,csv}", "ext_l in ('md', 'csv')", AT),
    "q_path_glob": ("glob:vendor/**/*.md", f"regexp_full_match(replace(path_l, {B}, '/'), '(.*/)?vendor/([^/]+/)*[^/]*\\.md')", AT),
    "q_regex": (r"regex:quarry_\d+\.(rtf|md)$", "regexp_matches(path, '(?i)quarry_\\d+\\.(rtf|md)$')", AT),
    "q_regex_literal": (r"regex:corpus.*amber.*md$", "regexp_matches(path, '(?i)corpus.*amber.*md$')", AT),
    "q_size": ("size:>10k type:file", "size > 10240 and not is_dir", AT),
    "q_size_equal": ("size:1000", "size = 1000", AT),
    "q_size_span": ("size:>=1kb size:<2kb", "size >= 1024 and size < 2048", AT),
    "q_day": ("dm:2026-01-07", "mod_ns <> 0 and mod_ns >= 1767744000000000000 and mod_ns < 1767830400000000000", AT),
    "q_today": ("dm:today", "mod_ns <> 0 and mod_ns >= 1782777600000000000 and mod_ns < 1782864000000000000", AT),
    "q_this_week": ("dm:thisweek", "mod_ns <> 0 and mod_ns >= 1782604800000000000 and mod_ns < 1783209600000000000", AT),
    "q_days": ("dm:90d", f"mod_ns <> 0 and mod_ns >= {NOW - 90 * 86400 * NANO}", AT),
    "q_recent": ("type:file", f"not is_dir and mod_ns <> 0 and mod_ns > {NOW - 60 * 86400 * NANO}", Settings(now=NOW, recent="60d")),
    "q_modified_after": ("type:file", "not is_dir and mod_ns <> 0 and mod_ns > 1775001600000000000", Settings(now=NOW, modified_after="2026-04-01")),
    "q_attributes": ("attrib:RA", "(mode & 33) = 33", AT),
    "q_type_dir": ("type:dir vendor", f"is_dir and {_both('vendor')}", AT),
    "q_case": ("case: Quarry", "contains(name, 'Quarry')", AT),
    "q_case_late": ("Quarry case:", "contains(name, 'quarry')", AT),
    "q_volume": ("C: quarry", f"volume = 'C:' and {_both('quarry')}", AT),
    "q_aliases": (aliases("folder: pathpart:vendor"), f"is_dir and {_either('path', 'vendor')}", AT),
    "q_content": ("content:journal", "(contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal'))", AT),
    "q_content_phrase": ('content:"posting list"', "(contains(lower(text), 'posting list') "
        "or contains(strip_accents(lower(text)), 'posting list'))", AT),
    "q_content_plain_needle": ("content:ubersicht", "(contains(lower(text), 'ubersicht') or contains(strip_accents(lower(text)), 'ubersicht'))", AT),
    "q_content_accents": ("content:übersicht", "(contains(lower(text), 'übersicht') or contains(lower(text), 'u' || chr(776) || 'bersicht'))", AT),
    "q_content_smart_case": ("content:Journal", "contains(text, 'Journal')", AT),
    "q_content_regex": (r"content:/build \d+,/", "regexp_matches(text, '(?i)build \\d+,')", AT),
    "q_content_regex_lines": (r"content:/^limit = \d+$/", "regexp_matches(text, '(?im)^limit = \\d+$')", AT),
    "q_content_not": ("!content:journal ext:md", "not coalesce(contains(lower(text), 'journal') "
        "or contains(strip_accents(lower(text)), 'journal'), false) and ext_l = 'md'", AT),
    "q_content_joint": (
        "ext:md content:journal|quarry",
        f"ext_l = 'md' and (coalesce(contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal'), false) "
            f"or {_both('quarry')})",
        AT
    )
}


_WORDS_SQL = f"{ENTRIES_SQL}, w as (select path, unnest(regexp_extract_all(lower(text), '[a-z0-9_\u0080-\uffff]+')) as term from e where text is not null)"
#: Names within one edit of a word of some letters.
_CLOSE = ENTRIES_SQL.replace("{", "{{").replace("}", "}}") + """, n as (select distinct name_f from e),
 i as (select name_f, unnest(range(0, greatest(length(name_f) - {1} + 2, 0))) as i from n),
 l as (select name_f, i, unnest([{1} - 1, {1}, {1} + 1]) as l from i),
d as (select name_f, i, damerau_levenshtein(substring(name_f, i + 1, l), '{0}') as d from l where i + l <= length(name_f)),
 b as (select name_f, min(d) as dist from d where d <= 1 group by 1),
a as (select b.name_f, dist, min(i) as "at" from b join d on d.name_f = b.name_f and d.d = b.dist group by all)"""


def _match(text: str, settings: Settings) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search.matching(entries(spark, sf_dir), parse(text, settings)).select("path", "size", "is_dir")


for _name, (_text, _condition, _settings) in MATCHES.items():
    QUERIES[_name] = _match(_text, _settings)
    SQL[_name] = f"{ENTRIES_SQL} select path, size, is_dir from e where coalesce({_condition}, false)"

_NAME_ORDER = "name_l, path_l, path, frn nulls last"
#: name: (query, condition, order in SQL, keyword arguments of ``search``, offset)
PAGES: dict[str, tuple[str, str, str, dict]] = {
    "s_default": ("quarry", _both("quarry"), _NAME_ORDER, {}),
    "s_modified": ("quarry sort:modified", _both("quarry"), f"(mod_ns = 0), mod_ns desc, {_NAME_ORDER}", {}),
    "s_extension": ("quarry sort:extension", _both("quarry"), f"ext_l, {_NAME_ORDER}", {}),
    "s_type": ("vendor sort:type", _both("vendor"), f"is_dir desc, {_NAME_ORDER}", {}),
    "s_path": ("quarry sort:path", _both("quarry"), "path_l, path, frn nulls last", {}),
    "s_path_mode": ("path:vendor quarry", f"{_either('path', 'vendor')} and {_either('path', 'quarry')}", "path_l, path, frn nulls last", {}),
    "s_second_page": ("ext:md", "ext_l = 'md'", _NAME_ORDER, {"offset": 100}),
    "s_bias": ("ext:md", "ext_l = 'md'", f"(starts_with(path_l, 'd:' || {B} || 'corpus' || {B})) desc, {_NAME_ORDER}", {"bias": "D:\\corpus"}),
    "s_limit": ("ext:md", "ext_l = 'md'", _NAME_ORDER, {"limit": 20}),
}


def _page(text: str, more: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search.search(entries(spark, sf_dir), text, AT, **more).select("path", "size", "mod_ns")


for _name, (_text, _condition, _order, _more) in PAGES.items():
    QUERIES[_name] = _page(_text, _more)
    SQL[
        _name
    ] = f"{ENTRIES_SQL} select path, size, mod_ns from e where {_condition} order by {_order} limit {_more.get('limit', 100)} offset {_more.get('offset', 0)}"


_FOLDER_BYTES = f"""fs as (select volume, string_split(path, {B}) as p, size, name_l from e where not is_dir),
up as (select volume, array_to_string(p[1:i], {B}) as path, size, name_l from (select volume, p, size, name_l, unnest(range(1, len(p))) as i from fs)),
sized as (select e.* replace (cast(coalesce(case when is_dir then s.b else e.size end, 0) as bigint) as size) from e left join (select volume, path, sum(size) as b from up group by 1, 2) as s on s.volume is not distinct from e.volume and s.path = e.path)"""
QUERIES["s_size"] = _page("quarry sort:size", {})
SQL["s_size"] = f"{ENTRIES_SQL}, {_FOLDER_BYTES} select path, size, mod_ns from sized where {_both('quarry')} order by size, {_NAME_ORDER} limit 100"
QUERIES["s_size_folders"] = _page("type:dir vendor sort:size", {})
SQL[
    "s_size_folders"
] = f"{ENTRIES_SQL}, {_FOLDER_BYTES} select path, size, mod_ns from sized where is_dir and {_both('vendor')} order by size, {_NAME_ORDER} limit 100"


def _query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@_query(f"{ENTRIES_SQL} select count(*) as n from e where {_both('quarry')} and ext_l = 'md'")
def c_count(spark, sf_dir):
    return search.count(entries(spark, sf_dir), "quarry ext:md", AT)


@_query(f"{ENTRIES_SQL} select count(*) as n from e where contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal')")
def c_count_content(spark, sf_dir):
    return search.count(entries(spark, sf_dir), "content:journal", AT)


_MODIFIED = "case when mod_ns = 0 then null else strftime(make_timestamp(mod_ns // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || case when mod_ns % 1000000000 = 0 then '' else '.' || rtrim(lpad(cast(mod_ns % 1000000000 as varchar), 9, '0'), '0') end || 'Z' end"


@_query(f"{ENTRIES_SQL} select path, name, volume, is_dir, size, {_MODIFIED} as modified, source as index_source from e where ext_l = 'md'")
def o_results(spark, sf_dir):
    """Result rows as callers see them."""
    return search.results(search.matching(entries(spark, sf_dir), parse("ext:md", AT))).drop("snippet")


_JSON_FIELD = "'\"{0}\":' || to_json({0})"


@_query(f"""{ENTRIES_SQL}, r as (select path, name, volume, is_dir, size, {_MODIFIED} as modified, source as index_source from e where ext_l = 'md')
select '{{' || concat_ws(',', {', '.join(_JSON_FIELD.format(c) for c in ('path', 'name', 'volume', 'is_dir', 'size', 'modified', 'index_source'))}) || '}}' as json from r""")
def o_json(spark, sf_dir):
    """Result rows as JSON lines; unknown fields are left out."""
    return search.as_json(o_results(spark, sf_dir))


@_query(f"""{ENTRIES_SQL}, m as (select path, text, strpos(lower(text), 'journal') as p from e where contains(lower(text), 'journal')),
 s as (select path, text, greatest(1, p - 60) as b from m)
select path, case when b > 1 then '...' else '' end || translate(substring(text, b, 200), chr(13) || chr(10) || chr(9), '   ') || case when b + 199 < length(text) then '...' else '' end as snippet from s""")
def o_snippets(spark, sf_dir):
    q = parse("content:journal", AT)
    return search.results(search.matching(entries(spark, sf_dir), q), q).select("path", "snippet")


@_query(f"""{ENTRIES_SQL}, l as (select path, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as text from e where contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal')),
m as (select *, contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal') as match from l),
 n as (select *, max(match::int) over (partition by path order by line rows between 1 preceding and 1 following) as near from m)
select path, cast(line as int) as line, match from n where near = 1""")
def o_lines(spark, sf_dir):
    """Matching lines with one line before and after."""
    q = parse("content:journal", AT)
    return content.lines(search.matching(entries(spark, sf_dir), q), q, before=1, after=1).select("path", "line", "match")


@_query(f"""{ENTRIES_SQL}, m as (select *, strpos(lower(text), 'journal') as a, strpos(lower(text), 'index') as b from e
 where (contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal')) and (contains(lower(text), 'index')
 or contains(strip_accents(lower(text)), 'index')))
select path, 2 as relevance, 2 as tier, cast(coalesce(least(nullif(a, 0), nullif(b, 0)), 1073741824) as int) as first_at from m order by first_at, {_NAME_ORDER} limit 100""")
def o_relevance(spark, sf_dir):
    return search.search(entries(spark, sf_dir), "content:journal content:index sort:relevance", AT).select("path", "relevance", "tier", "first_at")


#: A definition of a name, and a line that only uses it, per language.
_CODE = {
    "go": ("func (s *T) {0}(x int) {{", "\t{0}()"), "h": ("class {0} : public Base {{", "class {0};"), "py": ("    async def {0}(self):", "# def "
        "{0}()"),
    "ts": ("  {0}(a: number): void {{", "const x = new {0}();"), "rs": ("pub fn {0}() {{}}", "let y = {0}();"),
    "java": ("  public static int {0}(int x) {{ return x; }}", "  int {0}(int x);")
}
_NAMED = r"\b([a-z]+)[A-Z][A-Za-z]+\b"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files, one a document: files of an even number define the first name in it that is spelt like a function, the others use it."""
    name, shape = F.regexp_extract("text", _NAMED, 1), F.lit("")
    for i, (yes, no) in enumerate(_CODE.values()):
        line = [
            F.concat(
                F.lit(x.split("{0}")[0].replace("{{", "{").replace("}}", "}")), name, F.lit(x.split("{0}")[1].replace("{{", "{").replace("}}", "}"))
            )
            for x in (yes, no)
        ]
        shape = F.when(F.col("doc_id") % 6 == i, F.when(F.floor(F.col("doc_id") / 6) % 2 == 0, line[0]).otherwise(line[1])).otherwise(shape)
    ext = F.get(F.array(*map(F.lit, _CODE)), (F.col("doc_id") % 6).cast("int"))
    docs = table(spark, sf_dir, "documents").where(name != "")
    return enriched(
        docs.select(
            "volume", F.col("doc_id").alias("frn"),
            F.concat("volume", F.lit("\\code\\f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
            F.lit(32).cast("long").alias("mode"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mod_ns"),
            F.lit("code").alias("source"), F.concat(F.lit("// \n"), shape, F.lit("\nend")).alias("text")
        )
    )


_CODE_SQL = f"with c as (select volume || {B} || 'code' || {B} || 'f' || doc_id || '.' || (['go', 'h', 'py', 'ts', 'rs', 'java'])[doc_id % 6 + 1] as path, doc_id, regexp_extract(text, '{_NAMED}', 1) as name from documents)"


@_query(f"{_CODE_SQL} select path from c where name = 'flush' and doc_id // 6 % 2 = 0")
def o_symbols(spark, sf_dir):
    return search.matching(_code(spark, sf_dir), parse("sym:flush", AT)).select("path")


@_query(_WORDS_SQL + " select distinct path from w where damerau_levenshtein(term, 'jurnal') <= 1")
def f_near_content(spark, sf_dir):
    return search.matching(entries(spark, sf_dir), parse("content~1:jurnal", AT), words=words(spark, sf_dir)).select("path")


@_query(
    _CLOSE.format("quarri", 6)
    + """ select e.path, cast(dist as int) as dist, cast(levenshtein(a.name_f, 'quarri') as int) as whole, cast("at" as int) as "at" from e
 join a on a.name_f = e.name_f"""
)
def f_close_names(spark, sf_dir):
    """Names within the edits that the term may need."""
    return fuzzy.close_names(entries(spark, sf_dir), parse("quarri", AT)).select("path", "dist", "whole", "at")


@_query(
    _CLOSE.format("qaurry", 6)
    + " select path, cast(dist as int) as dist from (select e.*, dist from e join a on a.name_f = e.name_f) order by dist, name_l, path limit 100"
)
def f_topped_up(spark, sf_dir):
    files, q = entries(spark, sf_dir), parse("qaurry", AT)
    return fuzzy.topped_up(files, search.matching(files, q), q, 100).select("path", "dist")


@_query(f"{ENTRIES_SQL} select path from e where {_both('quarry')} and {_both('amber')} order by {_NAME_ORDER} limit 100")
def f_rewritten(spark, sf_dir):
    """What a search without a match gives: the same with one term respelt."""
    shop = Catalogue(entries(spark, sf_dir), words=words(spark, sf_dir), name_words=name_words(spark, sf_dir))
    return shop.search("qaurry amber", AT).select("path")


@_query(f"{ENTRIES_SQL} select count(*) as n from e where contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal')")
def f_count_respelt(spark, sf_dir):
    """The count of a query on texts follows the search: a word that no text holds is respelt."""
    return Catalogue(entries(spark, sf_dir), words=words(spark, sf_dir), name_words=name_words(spark, sf_dir)).count("content:joyrnal", AT)


@_query(
    _WORDS_SQL
    + " select term, cast(damerau_levenshtein(term, 'jurnal') as int) as distance, count(distinct path) as df from w "
        "where damerau_levenshtein(term, 'jurnal') = 1 group by all"
)
def f_corrected_words(spark, sf_dir):
    return content.corrected(entries(spark, sf_dir), "jurnal", words(spark, sf_dir)).select("term", "distance", "df")


@_query(
    f"{ENTRIES_SQL}, {_FOLDER_BYTES} select volume, path, cast(sum(size) as bigint) as bytes, count(*) as files, min(name_l) as first_name from up "
        f"group by 1, 2"
)
def r_folder_bytes(spark, sf_dir):
    return rollup.folder_bytes(entries(spark, sf_dir))


@_query(f"{ENTRIES_SQL}, {_FOLDER_BYTES} select path, size from sized")
def r_effective_sizes(spark, sf_dir):
    return rollup.with_sizes(entries(spark, sf_dir)).select("path", "size")


@_query(f"""{ENTRIES_SQL}, w as (select path, unnest(regexp_extract_all(lower(text), '[a-z0-9_\u0080-\uffff]+')) as term from e
 where text is not null), n as (select term, path, count(*) as n from w group by 1, 2)
select term, cast(sum(n) as bigint) as tf, count(*) as df from n group by term""")
def r_vocabulary(spark, sf_dir):
    return content.vocabulary(entries(spark, sf_dir))


@_query(
    f"""{ENTRIES_SQL}, g as (select distinct path, substring(name_l, i, 3) as gram
 from (select path, name_l, unnest(range(1, length(name_l) - 1)) as i from e where length(name_l) >= 3)) select gram, count(*) as n_rows
 from g group by gram"""
)
def r_gram_counts(spark, sf_dir):
    return rollup.gram_counts(entries(spark, sf_dir).select("path", "name").distinct(), "path", "name")


@_query(
    f"{ENTRIES_SQL}, d as (select sha256(text) as digest, octet_length(encode(text)) as b, count(*) as files from e where text is not null "
        f"group by 1, 2) select digest, files, cast(b * (files - 1) as bigint) as bytes from d where files > 1"
)
def r_duplicates(spark, sf_dir):
    return rollup.duplicates(entries(spark, sf_dir))


@_query(
    f"{ENTRIES_SQL}, k as (select path, sha256(text) as digest from e where text is not null), f as (select digest, min(path) as first_path from k "
        f"group by 1) select path, first_path from k join f using (digest) where path <> first_path"
)
def r_copies(spark, sf_dir):
    return rollup.aliases(entries(spark, sf_dir))


@_query(
    f"{ENTRIES_SQL} select volume, count(*) as n_entries, count(distinct name) as n_names, cast(sum(length(name)) as bigint) as name_chars, "
        f"cast(sum(is_dir::int) as bigint) as n_folders from e group by volume"
)
def r_statistics(spark, sf_dir):
    return rollup.statistics(entries(spark, sf_dir))


@_query()
def r_latencies(spark, sf_dir):
    return rollup.latencies(table(spark, sf_dir, "events"), "value")


_TALLY = f"when ext_l in ({', '.join(map(repr, admission.BINARY))}) then 'binary'"


@_query(f"""{ENTRIES_SQL}, r as (select size, case {_TALLY} when name_l in ({', '.join(map(repr, admission.LOCKFILES))}) then 'lockfile' when ext_l in ('json', 'jsonc', 'json5') and size >= {admission.LARGE_JSON} then 'large_json'
 when contains(name_l, '.min.') or contains(name_l, '-min.') or contains(name_l, '.bundle.') or contains(name_l, '.chunk.')
 or contains(name_l, '.minified.') then 'minified'
 when list_has_any(string_split(path_l, {B})[:-2], [{', '.join(map(repr, admission.BUILD))}]) then 'build_output' when list_has_any(string_split(path_l, {B})[:-2], [{', '.join(map(repr, admission.DEPENDENCIES))}]) then 'dependency'
 when list_has_any(string_split(path_l, {B})[:-2], [{', '.join(map(repr, admission.CACHES))}]) then 'cache' else 'admitted' end as reason from e where not is_dir) select reason, count(*) as files, cast(sum(size) as bigint) as bytes from r group by reason""")
def a_admission(spark, sf_dir):
    """Files and bytes per reason for which a text isn't indexed."""
    return admission.tally(entries(spark, sf_dir), admission.reason())


@_query("select user_id, query_norm, path, max(pick_count) as pick_count from query_picks group by all having max(pick_count) >= 3")
def u_habits(spark, sf_dir):
    return ranking.habits(table(spark, sf_dir, "query_picks"))


@_query(
    "select user_id, path, max(last_open_unix) as last_open_unix from file_signals where last_open_unix is not null group by all "
        "order by 3 desc, path, user_id limit 50"
)
def u_recent(spark, sf_dir):
    return ranking.recent(table(spark, sf_dir, "file_signals"), 50)


@_query("""with o as (select user_id, path, max(opens) as opens, max(score) as score, max(last_open_unix) as last_open_unix from file_signals group by all)
select * from (select *, cast(row_number() over (partition by user_id order by score desc nulls last, last_open_unix desc nulls last, path) as int) as place from o) where place <= 5000""")
def u_compacted(spark, sf_dir):
    return ranking.compact(table(spark, sf_dir, "file_signals"))


@_query(
    "select user_id, path, count(*) as opens, round(sum(pow(0.5, greatest(0, (1782800000 - coalesce(last_open_unix, 1782800000)) / 86400.0) / "
        "30.0)), 9) as score, max(last_open_unix) as last_open from file_signals where path is not null group by all"
)
def u_frecency(spark, sf_dir):
    opens = table(spark, sf_dir, "file_signals").withColumn("opened", F.col("last_open_unix"))
    return ranking.frecency(opens, F.lit(1_782_800_000)).withColumn("score", F.round("score", 9)).withColumn("last_open", F.col("last_open"))


@_query("""with r as (select distinct path from file_signals where user_id = 'user-000' and path <> ''),
 n as (select path, lower(string_split(path, chr(92))[-1]) as name_l from r),
p as (select path, name_l, row_number() over (order by name_l, lower(path), path) as position from n where contains(name_l, 'raven')
 or contains(strip_accents(name_l), 'raven') qualify position <= 100),
f as (select path, max(score) as frecency from file_signals where user_id = 'user-000' group by 1),
h as (select path from query_picks where user_id = 'user-000' and query_norm = 'raven' group by 1 having max(pick_count) >= 3),
j as (select p.*, h.path is not null as habit, frecency, case when name_l = 'raven' then '0' when starts_with(name_l, 'raven') then '1' when contains(name_l, 'raven') then '2' else '3' end as band from p left join f using (path) left join h on h.path = p.path)
select path, cast(position as int) as position, cast(case when bool_or(habit or frecency is not null) over () then row_number() over (order by band, habit desc, coalesce(frecency, 0) desc, path) else position end as int) as place from j""")
def u_blended(spark, sf_dir):
    """A page of one person's query in the order of their signals."""
    from pyspark.sql import Window

    signals, picks = table(spark, sf_dir, "file_signals"), table(spark, sf_dir, "query_picks")
    rows = enriched(
        signals.where("user_id = 'user-000'")
            .select(
                F.substring("path", 1, 2).alias("volume"), F.lit(None).cast("long").alias("frn"), "path", F.lit(32).cast("long").alias("mode"),
                F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mod_ns"), F.lit("signals").alias("source"),
                F.lit(None).cast("string").alias("text")
            )
            .distinct()
    )
    page = search.search(rows, "raven", AT)
    q = parse("raven", AT)
    ordered = page.withColumn("position", F.row_number().over(Window.orderBy(*search.order(q))))
    return ranking.blend(ordered, q, "raven", "user-000", signals, picks).select("path", "position", "place")


def _with_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of search results with every state that any result reports of them."""
    states = ("modified", "staged", "untracked", "ignored", "conflict", "clean", "tracked")
    rows = table(spark, sf_dir, "search_results").where("path is not null").withColumn("path", F.translate("path", "/", "\\"))
    once = (
        rows.groupBy("path")
            .agg(
                F.min("volume").alias("volume"), F.max("size").alias("size"), F.max("is_dir").alias("is_dir"),
                *[F.max(F.col("git_status") == c).alias(c) for c in states]
            )
    )
    shaped = enriched(
        once.select(
            "volume", F.lit(None).cast("long").alias("frn"), "path", F.when(F.col("is_dir"), 16).otherwise(32).cast("long").alias("mode"), "size",
            F.lit(0).cast("long").alias("mod_ns"), F.lit("results").alias("source"), F.lit(None).cast("string").alias("text")
        )
    )
    return shaped.join(once.select("path", F.struct(*states).alias("git")), "path")


@_query(
    """select replace(path, '/', chr(92)) as path from search_results where path is not null and path <> ''
 group by 1 having bool_or(git_status in ('modified', 'untracked'))"""
)
def q_git(spark, sf_dir):
    """Files in one of several states of version control; a path that is reported in several states has all of them."""
    return search.matching(_with_git(spark, sf_dir), parse("git:modified git:untracked", AT)).select("path")


@_query("""with p as (select replace(path, '/', chr(92)) as path, list(git_status) filter (git_status is not null) as s from search_results
 where path is not null and path <> '' group by 1)
select path, list_filter(['conflict', 'modified', 'staged', 'ignored', 'untracked', 'clean', 'tracked'], lambda x: list_contains(s, x))[1] as git_status from p""")
def o_git_status(spark, sf_dir):
    """The most telling state of every path."""
    return search.results(_with_git(spark, sf_dir)).select("path", "git_status")


_APRIL = "received_at < timestamp '2026-04-01 00:00:00Z'"
_ORDER = ["checkpoint_usn", "feed_cursor"]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature_feed").withColumnRenamed("mod_unix", "mod_ns")


def _state_sql(name: str, condition: str) -> str:
    return f"{name} as (select volume, frn, path, size, mod_unix as mod_ns from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn from feature_feed where frn <> 0 and volume is not null and {condition}) where rn = 1 and not coalesce(deleted, false) and path is not null)"


@_query(f"""with {_state_sql('a', "received_at < timestamptz '2026-04-01 00:00:00+00'")}, {_state_sql('b', 'true')},
f as (select a.path as ap, a.size as asize, a.mod_ns as am, b.path as bp, b.size as bsize, b.mod_ns as bm, a.frn is null as come, b.frn is null as gone from a full join b on a.volume = b.volume and a.frn = b.frn)
select 'created' as event, bp as path, bsize as size, bm as mod_ns from f where come or (not gone and ap <> bp) union all
 select 'deleted', ap, asize, am from f where gone or (not come and ap <> bp)
union all select 'modified', bp, bsize, bm from f where not come and not gone and ap = bp and (asize is distinct from bsize or am is distinct from bm)""")
def w_watch(spark, sf_dir):
    """Events between the state at the beginning of April and the last."""
    return feed.watch_feed(_changes(spark, sf_dir), _ORDER, _APRIL)


@_query("""with l as (select * from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn
 from feature_feed where frn is not null and frn <> 0 and volume is not null) where rn = 1 and not coalesce(deleted, false))
select volume, frn, checkpoint_usn, feed_cursor from l""")
def w_stream(spark, sf_dir):
    """The feed applied as a stream of files; the state after the last batch."""
    source = f"{sf_dir}/feature_feed.parquet"
    changes = feed.file_stream(spark, f"{source}*", spark.read.parquet(source).schema)
    at = EqualityDeleteTable.fresh(spark, ("volume", "frn"), ("checkpoint_usn", "feed_cursor"))
    feed.apply_stream(changes, at, "deleted", fresh_path(spark, "stream"), floor="frn <> 0").awaitTermination()
    return at.read()


@_query(f"{ENTRIES_SQL} select path from e where not (path_l = 'c:' || {B} || 'corpus' or starts_with(path_l, 'c:' || {B} || 'corpus' || {B}))")
def w_cascade(spark, sf_dir):
    """What is left when a folder goes with everything below it."""
    gone = spark.createDataFrame([("C:", "c:\\corpus")], "volume string, path_l string")
    return feed.cascade(entries(spark, sf_dir), gone).select("path")


@_query(f"""with {_state_sql('a', "received_at < timestamptz '2026-04-01 00:00:00+00'")}, c as (select *
 from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn from feature_feed
 where frn <> 0 and volume is not null and received_at >= timestamptz '2026-04-01 00:00:00+00') where rn = 1)
select volume, frn, path from a where not exists (select 1 from c where c.volume = a.volume and c.frn = a.frn) union all select volume, frn, path from c where not coalesce(deleted, false)""")
def w_overlay(spark, sf_dir):
    """The April state under the changes that came after."""
    base = feed.transitions(_changes(spark, sf_dir).where(_APRIL), _ORDER, "true").where("b is not null").select("volume", "frn", "b.*")
    later = table(spark, sf_dir, "feature_feed").where("received_at >= timestamp '2026-04-01 00:00:00Z'")
    return (
        feed.overlay(
            base,
            later.select(
                "volume", "frn", F.col("checkpoint_usn").alias("usn"), F.col("feed_cursor").alias("seq"), "deleted", "path", "size",
                F.col("mod_unix").alias("mod_ns")
            )
        )
            .select("volume", "frn", "path")
    )


@_query(
    "select volume, frn, scan_month, seq from records r where seq = (select max(seq) "
        "from (select seq, rank() over (order by scan_month desc, seq desc) as k from records x where x.volume = r.volume and x.frn = r.frn) "
        "where k = 1)"
)
def w_occupants(spark, sf_dir):
    """Rows of the file that holds a record number last."""
    rows = table(spark, sf_dir, "records").select("volume", "frn", "scan_month", "seq", F.col("scan_month").alias("usn"))
    return feed.current_occupant(rows).select("volume", "frn", "scan_month", "seq")


@_query(
    f"{ENTRIES_SQL}, k as (select volume, path, mod_ns, size, coalesce('f' || frn, 'p' || path_l) as k from e) select volume, path "
        f"from (select *, row_number() over (partition by volume, k order by mod_ns desc, path desc, size desc) as rn from k) where rn = 1"
)
def d_dedupe(spark, sf_dir):
    """One row a file of a listing that holds everything twice."""
    files = entries(spark, sf_dir)
    return search.dedupe(files.unionByName(files)).select("volume", "path")


@_query(
    f"{ENTRIES_SQL}, p as (select path, row_number() over (order by {_NAME_ORDER}) as rn from e where ext_l = 'md') "
        f"select sha256(string_agg(path, chr(0) order by rn) || chr(0)) as hash from p where rn <= 100"
)
def d_page_hash(spark, sf_dir):
    return search.page_hash(search.search(entries(spark, sf_dir), "ext:md", AT))


@_query(
    f"{ENTRIES_SQL} select sha256(string_agg(path, chr(0) order by name_l, path_l, path, frn nulls last) || chr(0)) as hash from e where ext_l = 'md'"
)
def d_whole_hash(spark, sf_dir):
    """The hash of a page that holds every match."""
    return search.page_hash(search.search(entries(spark, sf_dir), "ext:md", AT, limit=1 << 30))


@_query(f"{ENTRIES_SQL} select path from e where ext_l = 'md' order by (mod_ns = 0), mod_ns desc, {_NAME_ORDER} limit 100 offset 100")
def s_keyset(spark, sf_dir):
    """The second page by time, newest first, behind the keys of the last row of the first."""
    shop = Catalogue(entries(spark, sf_dir))
    text = "ext:md sort:modified"
    return shop.search(text, AT, cursor=shop.cursor_behind(shop.search(text, AT), text, AT)).select("path")


@_query(
    "select user_id, query_norm, path, pick_count, last_unix, place from (select *, cast(row_number() over (partition by user_id, query_norm "
        "order by pick_count desc nulls last, last_unix desc nulls last, path) as int) as place "
        "from (select user_id, query_norm, path, max(pick_count) as pick_count, max(last_unix) as last_unix from query_picks group by all)) "
        "where place <= 8"
)
def u_compacted_picks(spark, sf_dir):
    return ranking.compact_picks(table(spark, sf_dir, "query_picks"))


SQL["r_latencies"] = (
    "select "
    + ", ".join(f"quantile_disc(value, {p}) as "
        f"{n}" for n, p in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("max", 1.0)))
    + " from events"
)


@_query(f"""with {_state_sql('a', "received_at < timestamptz '2026-04-01 00:00:00+00'")}, {_state_sql('b', 'true')},
 c as (select coalesce(b.path, a.path) as path, a.size as old_size, b.size as new_size from a full join b on a.volume = b.volume
 and a.frn = b.frn where a.path is null or b.path is null or a.path = b.path),
u as (select unnest(list_transform(range(1, len(string_split(replace(path, '/', chr(92)), chr(92)))), lambda i: array_to_string(string_split(replace(path, '/', chr(92)), chr(92))[1:i], chr(92)))) as path, coalesce(new_size, 0) - coalesce(old_size, 0) as d from c)
select path, cast(sum(d) as bigint) as delta from u group by path""")
def r_folder_deltas(spark, sf_dir):
    """How folders grew since the beginning of April, by files that stayed where they were, came or went."""
    both = feed.transitions(_changes(spark, sf_dir), _ORDER, _APRIL).where("a.path is null or b.path is null or a.path = b.path")
    return rollup.folder_deltas(
        both.select(
            F.translate(F.coalesce("b.path", "a.path"), "/", "\\").alias("path"), F.col("a.size").alias("old_size"), F.col("b.size").alias("new_size")
        )
    )


@_query("""with r as (select run_id, state from index_runs where source = 'walk' group by all),
 p as (select volume, frn, max((print_mod, print_size)) as v, state = 'replaying' as opened from file_prints join r using (run_id)
 where state in ('ready', 'replaying') and frn is not null group by all),
o as (select * from p where not opened), n as (select * from p where opened)
select coalesce(o.volume, n.volume) as volume, coalesce(o.frn, n.frn) as frn, case when o.frn is null then 'added' when n.frn is null then 'removed' when o.v is not distinct from n.v then 'same' else 'changed' end as state from o full join n on o.volume = n.volume and o.frn = n.frn""")
def w_reconcile(spark, sf_dir):
    """Walked volumes: what the open run found against what the successful runs hold."""
    from spindrift.operators.incremental import reconcile

    runs = table(spark, sf_dir, "index_runs").where("source = 'walk'").select("run_id", "state").distinct()
    prints = (
        table(spark, sf_dir, "file_prints")
            .join(runs, "run_id")
            .select("volume", "frn", F.col("print_size").alias("size"), F.col("print_mod").alias("mod"), "state")
    )
    return reconcile(prints.where("state = 'ready'"), prints.where("state = 'replaying'"))


@_query(f"""{ENTRIES_SQL}, l as (select path, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as text from e where contains(text, 'Journal')),
h as (select *, hex(encode(text)) as x from l where contains(text, 'Journal')),
 k as (select *, list_filter([500, 499, 498, 497], lambda n: not regexp_matches(substring(x, 2 * n + 1, 1), '[89AB]'))[1] as n from h)
select path, cast(line as int) as line, path || ':' || line || ':' || case when octet_length(encode(text)) <= 500 then text else decode(unhex(substring(x, 1, 2 * n))) || '…' end as shown from k""")
def o_grep(spark, sf_dir):
    """All matching lines as they are printed, those of more than 500 bytes cut behind a whole character."""
    q = parse("content:Journal", AT)
    return grep_lines(content.lines(search.matching(entries(spark, sf_dir), q), q))


def _companion(spark: SparkSession, sf_dir: str) -> dict:
    """A companion that answers with a set of files: those that the feed holds with at least so many bytes."""
    changes = table(spark, sf_dir, "feature_feed")
    return {"seen": lambda term: changes.where(F.col("size") >= int(term)).select("volume", "frn")}


@_query(
    f"{ENTRIES_SQL} select path from e where (volume, frn) in (select (volume, frn) from feature_feed where size >= 100000 and frn is not null) "
        f"and not ext_l = 'md'"
)
def q_feature(spark, sf_dir):
    """A companion's set of files, joined by key."""
    return search.matching(entries(spark, sf_dir), parse("feature:seen:100000 !ext:md", AT), _companion(spark, sf_dir)).select("path")


@_query(
    f"{ENTRIES_SQL} select path from e where contains(lower(text), 'journal') or contains(strip_accents(lower(text)), 'journal') "
        f"order by {_NAME_ORDER} limit 100"
)
def q_contents(spark, sf_dir):
    """Plain words searched in texts."""
    return Catalogue(entries(spark, sf_dir)).content("journal", AT).select("path")


@_query("""with l as (select * from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn
 from feature_feed where frn <> 0 and volume is not null) where rn = 1 and not coalesce(deleted, false) and path is not null),
m as (select volume, max(checkpoint_usn) as top from feature_feed where volume is not null group by 1),
 c as (select volume, top, case when volume = 'C:' then top + 1 when volume = 'D:' then null else top end as since from m)
select volume, top as seq, coalesce(since > top, false) as reset from c""")
def w_cursors(spark, sf_dir):
    """Cursors of a watcher whose cursor of one volume is too new, and that doesn't know another."""
    changes = _changes(spark, sf_dir).withColumn("seq", F.col("checkpoint_usn"))
    cursors = (
        changes.where("volume is not null and volume <> 'D:'")
            .groupBy("volume")
            .agg((F.max("seq") + F.when(F.col("volume") == "C:", 1).otherwise(0)).alias("seq"))
    )
    return feed.watch_from(changes, cursors)[0]


@_query(
    f"{ENTRIES_SQL} select volume, frn, case when starts_with(path_l, 'c:' || {B} || 'corpus' || {B}) or path_l = 'c:' || {B} || 'corpus' "
        f"then 'C:' || {B} || 'texts' || substring(path, 10) else path end as path from e"
)
def w_renamed(spark, sf_dir):
    """A folder renamed, with everything below it."""
    return feed.renamed(entries(spark, sf_dir), spark.createDataFrame([("C:", "C:\\corpus", "C:\\texts")], "volume string, old string, new string"))


@_query("""with l as (select * from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn
 from feature_feed where frn is not null and frn <> 0 and volume is not null) where rn = 1 and not coalesce(deleted, false))
select volume, frn, checkpoint_usn, feed_cursor from l""")
def w_folded(spark, sf_dir):
    """The table after two batches, folded between them."""
    changes = table(spark, sf_dir, "feature_feed").where("frn <> 0")
    at = EqualityDeleteTable.fresh(spark, ("volume", "frn"), ("checkpoint_usn", "feed_cursor"))
    at.append(changes.where(f"not coalesce({_APRIL}, false)"), "deleted")
    at = at.fold()
    at.append(changes.where(f"coalesce({_APRIL}, false)"), "deleted")
    return at.read()


@_query(
    f"{ENTRIES_SQL} select ext_l as ext, 'C:' || {B} || 'corpus' as unit, case when ext_l = 'json' and size >= {admission.LARGE_JSON} "
        f"then 'large_json' else 'admitted' end as reason, count(*) as files, cast(sum(case when ext_l = 'json' and size >= {admission.LARGE_JSON} "
        f"then size else least(size, {admission.TEXT_OUTSIDE}) end) as bigint) as bytes from e where not is_dir "
        f"and starts_with(path_l, 'c:' || {B} || 'corpus' || {B}) group by all"
)
def a_estimate(spark, sf_dir):
    """What an index of one folder would hold."""
    return admission.estimate(entries(spark, sf_dir), admission.reason(), ["C:\\corpus"])


@_query(
    f"{ENTRIES_SQL}, c as (select path, text, size from e where text is not null) "
        f"select path, size > {2 * admission.TEXT_OUTSIDE} as skipped, octet_length(encode(text)) > {admission.TEXT_OUTSIDE} "
        f"and size <= {2 * admission.TEXT_OUTSIDE} as truncated, case when size <= {2 * admission.TEXT_OUTSIDE} "
        f"then least(octet_length(encode(text)), {admission.TEXT_OUTSIDE}) end as bytes from c"
)
def a_capped(spark, sf_dir):
    """Texts under the caps of an index."""
    return (
        admission.capped(entries(spark, sf_dir).where("text is not null"))
            .select("path", "skipped", "truncated", F.octet_length("text").cast("long").alias("bytes"))
    )


def _extracted(spark: SparkSession, sf_dir: str, ext: str, to_bytes: Callable) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("." + ext)).alias("path"), to_bytes(F.col("text")).alias("content"))
    return (
        extract.texts(files).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "content_class", "skipped", "truncated", "text")
    )


@_query("select doc_id, 1 as content_class, false as skipped, false as truncated, text from documents where text is not null")
def x_plain(spark, sf_dir):
    """Texts that went through bytes and the text extractor."""
    return _extracted(spark, sf_dir, "txt", lambda text: F.encode(text, "UTF-8"))


@_query(
    "select doc_id, 4 as content_class, false as skipped, false as truncated, '<html><body><p>' || text || '</p></body></html>' as text "
        "from documents where text is not null"
)
def x_html(spark, sf_dir):
    """Texts in a page of HTML, with its markup."""
    return _extracted(spark, sf_dir, "html", lambda text: F.encode(F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>")), "UTF-8"))


@_query(
    "select doc_id, 5 as content_class, false as skipped, false as truncated, 'Subject: ' || doc_id || chr(10) || text as text from documents "
        "where text is not null"
)
def x_mail(spark, sf_dir):
    """Texts sent as mail: the subject, then the body."""
    mail = lambda text: F.encode(
        F.concat(
            F.lit("Subject: "), F.col("doc_id").cast("string"),
            F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
            F.base64(F.encode(text, "UTF-8")), F.lit("\r\n")
        ),
        "UTF-8"
    )
    return _extracted(spark, sf_dir, "eml", mail)


@_query(f"{ENTRIES_SQL} select path from e where ext_l = 'md'")
def k_paths(spark, sf_dir):
    """Paths written as plain lines and read again."""
    at = fresh_path(spark, "paths")
    write_paths(search.matching(entries(spark, sf_dir), parse("ext:md", AT)), at)
    return spark.read.text(at).withColumnRenamed("value", "path")


@_query(f"{ENTRIES_SQL} select volume, path, size from e where ext_l = 'md'")
def k_index(spark, sf_dir):
    """A listing written by volume and read again."""
    at = fresh_path(spark, "listing")
    write_index(search.matching(entries(spark, sf_dir), parse("ext:md", AT)), at)
    return spark.read.parquet(at).select("volume", "path", "size")


_DEPTH = f"len(string_split(path, {B})) - 1"


@_query(f"""{ENTRIES_SQL}, p as (select path, list_slice(string_split(lower(path), {B}), 1, {_DEPTH}) as t, ['c:', 'corpus', 'wiki-amber'] as h from e)
select path, cast(len(h) + len(t) - 2 * case when h[1:3] = t[1:3] then 3 when h[1:2] = t[1:2] then 2 when h[1] = t[1] then 1 else 0 end as int) as hops from p""")
def r_hops(spark, sf_dir):
    """Steps from a folder to every file."""
    return entries(spark, sf_dir).select("path", ranking.hops(F.col("path"), "C:\\corpus\\wiki-amber").alias("hops"))


@_query(
    f"{ENTRIES_SQL} select path, case when name_l = 'quarry' then '0' when starts_with(name_l, 'quarry') then '1' when contains(name_l, 'quarry') "
        f"then '2' else '3' end as band from e"
)
def r_bands(spark, sf_dir):
    """The stretches of a page inside which signals may reorder."""
    return entries(spark, sf_dir).select("path", ranking.band(parse("quarry", AT)).alias("band"))


@_query("""with p as (select replace(path, '/', chr(92)) as path, list(git_status) filter (git_status is not null) as s from search_results
 where path is not null and path <> '' group by 1)
select path, case when list_has_any(coalesce(s, []), ['conflict', 'modified', 'staged']) then 0 when list_contains(coalesce(s, []), 'untracked') then 2 else 3 end as class from p""")
def r_git_classes(spark, sf_dir):
    """How states of version control rank."""
    return _with_git(spark, sf_dir).select("path", ranking.git_class().alias("class"))


@_query(_CLOSE.format("quarri", 6) + " select e.path from e join a on a.name_f = e.name_f order by dist, name_l, path limit 100")
def f_tilde(spark, sf_dir):
    """A term that asks for slips itself."""
    return Catalogue(entries(spark, sf_dir)).search("quarri~", AT).select("path")


@_query(f"{ENTRIES_SQL} select path from e where ext_l = 'md' order by {_NAME_ORDER} limit 50 offset 150")
def s_cursor(spark, sf_dir):
    """A page by its offset, from a token."""
    shop = Catalogue(entries(spark, sf_dir))
    return shop.search("ext:md", AT, 50, cursor=shop.next_cursor("ext:md", AT, 150)).select("path")


@_query(f"""{ENTRIES_SQL}, t as (select path, repeat(text || ' ', 1 + 40000 // greatest(1, length(text))) as text from e where text is not null
 and length(text) > 0), j as (select path, case when size % 2 = 0 then replace(text, chr(10), ' ') else text end as text from t
 join (select path, size from e) using (path))
select path, octet_length(encode(text)) >= {admission.MINIFIED_SIZE} and length(substring(text, 1, {admission.SAMPLE})) / len(string_split(substring(text, 1, {admission.SAMPLE}), chr(10))) > {admission.MINIFIED_LINE} as minified from j""")
def a_minified(spark, sf_dir):
    """Texts repeated to some length, half of them on one line: the latter look generated."""
    rows = entries(spark, sf_dir).where("length(text) > 0")
    text = F.expr("repeat(concat(text, ' '), cast(1 + floor(40000 / greatest(1, length(text))) as int))")
    joined = rows.select("path", F.when(F.col("size") % 2 == 0, F.translate(text, "\n", " ")).otherwise(text).alias("text"))
    return joined.select("path", admission.minified_text(F.col("text")).alias("minified"))


@_query(f"""{ENTRIES_SQL}, s as (select path, is_dir, replace(path, {B}, '/') as p from e)
select path, case when starts_with(p, 'C:/corpus/') then case when regexp_matches(p, '^C:/corpus/wiki-amber(/|$)') then regexp_matches(p, '^C:/corpus/wiki-amber/(.*/)?[^/]*\\.html$') else (regexp_matches(p, '\\.(md|log)$') and not regexp_matches(p, '/doc_1000[^/]*$')) or regexp_matches(p, '^C:/corpus/(.*/)?ja(/|$)') end else false end as ignored from s""")
def a_ignored(spark, sf_dir):
    """What ignore files of a folder and of one inside it leave out."""
    rules = {
        "C:\\corpus": admission.ignore_rules(["# texts", "*.md", "*.log", "!doc_1000*", "ja/", "*.html", "!*.html"]),
        "C:\\corpus\\wiki-amber": admission.ignore_rules(["!*", "*.html"]),
    }
    return entries(spark, sf_dir).select("path", admission.ignored(F.col("path"), F.col("is_dir"), rules).alias("ignored"))
