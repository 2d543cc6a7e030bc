"""Queries of manuscripts checked against themselves: the texts of documents, with some of their words written as what manuscripts have.

Where a figure, citation, abbreviation or size stands is up to the text; the SQL makes the same texts and parses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.operators import compare, documents, manuscripts
from graywacke.plans.registry import register
from graywacke.plans.revision_queries import VERSIONS, _versions

#: Words, or beginnings of lines, and what they become, one after the other.
WRITTEN = (
    (" of ", " [1] "), (" in ", " [2] "), (" that ", " [3] "), (" with ", " [4] "), (" and ", " (Figure 1) "), (" the ", " Table 2 "), (" for ", " Fig. 3 "), (" is ", " big case (ABC) "), (" was ", " ABC "), (" it ", " EEG "),
    (" this ", " brain waves (EEG) "), (" by ", " (p = 0.000) "), (" from ", " p < .05 "), (" are ", " p = .012, 95% CI "), (" be ", " N = 12 "), (" as ", " n = 14 "), (" or ", " N = 15 "), (" on ", " n = 12 "),
    ("\nOn", "\nFigure 1. On"), ("\nTh", "\nTable 2: Th"), ("\nAn", "\nFigure 3. An"), ("\nEr", "\nTable 5. Er"), ("\nRe", "\n[1] Re"), ("\nIn", "\nMethods\nIn"),
)


def _written(text: str) -> str:
    """SQL of a text as a manuscript, for both engines: letters beyond ASCII as x, as \\b means other things beside them."""
    out = f"concat('Abstract', chr(10), regexp_replace({text}, '[^\\x00-\\x7F]', 'x'{{flags}}))"
    for word, other in WRITTEN:
        quoted = [" || ".join(f"'{part}'" if part else "''" for part in w.split("\n")).replace(" || ", " || chr(10) || ") for w in (word, other)]
        out = f"replace({out}, {quoted[0]}, {quoted[1]})"
    return out


def _lines(docs: DataFrame, text: str) -> DataFrame:
    # In Spark's SQL a backslash in quotes is doubled.
    return documents.lines(docs.select("doc_id", F.expr(_written(text).format(flags="").replace("\\", "\\\\")).alias("text")), "doc_id", "text")


def _manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null"), "text")


def _split(name: str, of: str, text: str) -> str:
    cells = f"string_split({_written(text).format(flags=chr(44) + chr(32) + chr(39) + 'g' + chr(39))}, chr(10))"
    return f"{name} as (select doc_id, unnest({cells}) as line, generate_subscripts({cells}, 1) as line_no from {of})"


LINES = _split("l", "documents where text is not null", "text")
CAPTION = r"'^\s*(Figure|Table)\s+(\d+)\s*[.:]'"


@register("tx20_exhibits", rf"""with {LINES}, c as (select distinct doc_id, regexp_extract(line, {CAPTION}, 1) as kind, regexp_extract(line, {CAPTION}, 2)::int as number from l where regexp_matches(line, {CAPTION})),
    raw as (select doc_id, unnest(regexp_extract_all(line, '\b(?:Figures?|Figs?\.|Tables?)\s*\d+')) as raw from l where not regexp_matches(line, {CAPTION})), m as (select distinct doc_id, case when raw[1] = 'F' then 'Figure' else 'Table' end as kind, regexp_extract(raw, '\d+')::int as number from raw),
    w as (select doc_id, kind, unnest(range(1, max(number) + 1))::int as number from c group by 1, 2)
    select *, 'not mentioned' as status from (select * from c except select * from m) union all select *, 'no caption' from (select * from m except select * from c) union all select *, 'skipped' from (select * from w except select * from c)""")
def tx20_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.exhibits(_manuscripts(spark, sf_dir))


@register("tx31_citation_order", rf"""with {LINES}, a as (select doc_id, line_no, regexp_extract_all(line, '\[(\d+)\]', 1) as found from l), c as (select doc_id, line_no, unnest(found)::int as number, generate_subscripts(found, 1) as nth from a),
    f as (select doc_id, number, min(line_no * 1000000 + nth) as place from c group by 1, 2), h as (select *, max(number) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding) as after from f) select doc_id, number, after from h where number < after""")
def tx31_citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.citation_order(_manuscripts(spark, sf_dir))


@register("tx23_abbreviations", rf"""with {LINES}, a as (select doc_id, line_no, regexp_extract_all(line, '\(?\b[A-Z]{{2,6}}\b\)?') as found from l), c as (select doc_id, unnest(found) as raw, line_no * 1000000 + generate_subscripts(found, 1) as place from a),
    e as (select doc_id, regexp_replace(raw, '[()]', '', 'g') as short, min(place) as used, min(place) filter (raw like '(%)') as defined, count(*) filter (raw like '(%)') as times from c group by 1, 2 having short not in ('USA', 'UK', 'DNA', 'CI', 'SD')),
    s as (select doc_id, short, case when times = 0 then 'undefined' when used < defined then 'used before' when times > 1 then 'defined twice' end as status from e) select * from s where status is not null""")
def tx23_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.abbreviations(_manuscripts(spark, sf_dir))


@register("tx22_reporting", rf"""with {LINES}, i as (select doc_id, line_no, unnest([case when regexp_matches(line, '\bp\s*=\s*0?\.0+([^0-9]|$)') then 'p of zero' end, case when regexp_matches(line, '\bp\s*[<>]\s*0?\.0?5\b') then 'threshold only' end,
    case when regexp_matches(line, '\bp\s*[=<>]') and not regexp_matches(line, '(?i)\bCI\b|cohen|hedges|\bd\s*=|\bg\s*=|\br\s*=|odds ratio|\bOR\b') then 'no effect size' end]) as issue from l) select doc_id, line_no::int as line_no, issue from i where issue is not null""")
def tx22_reporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.reporting(_manuscripts(spark, sf_dir))


SECTIONS = r"""h as (select *, regexp_extract(line, '(?i)^\s*#*\s*(Abstract|Introduction|Methods|Results|Discussion|References)\s*:?\s*$', 1) as head from l),
    s as (select *, last_value(nullif(upper(head[1]) || lower(head[2:]), '') ignore nulls) over (partition by doc_id order by line_no) as section from h)"""


@register("tx21_sample_sizes", rf"""with {LINES}, {SECTIONS}, n as (select distinct doc_id, section, unnest(regexp_extract_all(line, '\b[Nn]\s*=\s*(\d+)', 1))::int as n from s)
    select doc_id, n from n where section = 'Abstract' except select doc_id, n from n where section is distinct from 'Abstract'""")
def tx21_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.sample_sizes(_manuscripts(spark, sf_dir))


@register("tx24_lengths", rf"""with {LINES}, {SECTIONS}, w as (select doc_id, section, sum(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')))::bigint as words from s where head = '' and section in ('Abstract', 'Methods') group by 1, 2)
    select doc_id, section, words, case section when 'Abstract' then 250 else 100 end as most, words > case section when 'Abstract' then 250 else 100 end as over from w""")
def tx24_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts.lengths(_manuscripts(spark, sf_dir), {"Abstract": 250, "Methods": 100})


@register("tx19_counts", rf"""with {VERSIONS}, {_split("a", "both_versions", "old")}, {_split("b", "both_versions", "new")}, l as (select 'old' as v, * from a union all select 'new', * from b),
    k as (select *, case when regexp_matches(line, '^\s*Figure\s+\d+\s*[.:]') then 'figure' when regexp_matches(line, '^\s*Table\s+\d+\s*[.:]') then 'table' when regexp_matches(line, '^\s*\[?\d+[\].]\s+[A-Z]') then 'reference' end as kind from l)
    select doc_id, kind, count(*) filter (v = 'old') as n_before, count(*) filter (v = 'new') as n_after from k where kind is not null group by 1, 2 having n_before <> n_after""")
def tx19_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _versions(spark, sf_dir)
    return manuscripts.changes_in_counts(_lines(both, "old"), _lines(both, "new"))


CITED = r"""d as (select doc_id, source, string_split(text, chr(10))[1] as head, coalesce(string_split(text, chr(10))[2], '') as title from documents where text is not null and source is not null),
    cited as (select doc_id as key, case when head = '' then '' else case when doc_id % 2 = 0 then 'https://doi.org/10.1/' else '10.1/' end || upper(md5(head)) end as doi, title from d),
    toxic as (select distinct doc_id from labels where toxic = 1), registry as (select '10.1/' || md5(head) as doi, min(doc_id) as first_id, arg_min(title, doc_id) as title from d where head <> '' and source <> 'src1' group by 1)"""


@register("join17_metadata", rf"""with {CITED}, r as (select registry.*, toxic.doc_id is not null as retracted from registry left join toxic on toxic.doc_id = first_id), p as (select *, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as plain from cited)
    select key, p.doi, p.title, case when p.doi = '' then 'no doi' when r.doi is null then 'not found' when retracted then 'retracted' when plain <> trim(regexp_replace(lower(r.title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) then 'title differs' else 'ok' end as status
    from p left join r on lower(replace(p.doi, 'https://doi.org/', '')) = r.doi""")
def join17_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null and source is not null")
    d = docs.select("doc_id", "source", F.substring_index("text", "\n", 1).alias("head"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")).alias("title"))
    cited = d.selectExpr("doc_id as key", "case when head = '' then '' else concat(if(doc_id % 2 = 0, 'https://doi.org/10.1/', '10.1/'), upper(md5(head))) end as doi", "title")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select(F.col("doc_id").alias("first_id")).distinct().withColumn("retracted", F.lit(True))
    first = d.filter("head <> '' and source <> 'src1'").groupBy(F.expr("concat('10.1/', md5(head)) as doi")).agg(F.min("doc_id").alias("first_id"), F.min_by("title", "doc_id").alias("title"))
    return manuscripts.matched_metadata(cited, first.join(toxic, "first_id", "left").select("doi", "title", F.coalesce("retracted", F.lit(False)).alias("retracted")))


@register("snk05_sentences", """with m as (select c_mktsegment as g, count(*) as n, avg(c_acctbal) as m, stddev_samp(c_acctbal) as s from customer where c_mktsegment is not null and c_acctbal is not null group by 1)
    select g as "group", 'In ' || g || ' (n = ' || n || ') the mean was ' || printf('%.1f', m) || ' (SD ' || printf('%.1f', s) || ').' as sentence from m""")
def snk05_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.summary(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_mktsegment")
    return rows.select("group", F.format_string("In %s (n = %d) the mean was %.1f (SD %.1f).", "group", "n", "mean", "sd").alias("sentence"))
