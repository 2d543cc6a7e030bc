"""The registered queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.llm import chat, decontaminate, fill_in_middle, filter_audit, html_extract, language_id, line_dedup, minhash, packing, quality_classifier, quality_rules, url_filter, url_table, warc
from graywacke.llm.common import Scratch, remainder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_table.labelled_urls())
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "unwanted")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = quality_classifier.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    profiles = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.drop("lang"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forests = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rules = [F.col(f"rules.{k}").alias(k) for k in (*quality_rules.COUNTS, "base_failed", "kept", "anomaly")]
    return quality_rules.judge(docs, forests).select("doc_id", *rules)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = f"{scratch.root}/archives"
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), archives)
    found = scratch.save("records", warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    scratch.drop("archives")
    return found


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame([(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], said.schema)
    turns = said.unionByName(control)
    chats = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.coalesce("text", F.lit(""))).alias("parts")))
    sizes = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    back = chat.read_chats(chats.select("conv_id", "formatted", "spans")).withColumn("formatted_chars", F.lit(None).cast("long"))
    rows = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "masked"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda t: F.coalesce(t.masked, F.lit(""))), "")
    digests = rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))
    return digests.join(sizes.withColumnRenamed("conv_id", "its_id"), F.expr("conv_id <=> its_id")).drop("its_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.failures(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(flags)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    again = F.sha2(fill_in_middle.restored("output", "form"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_url_filter, op2_quality_classifier, op3_decontaminate, op4_language_id, op5_best_fit_packing, op6_quality_rules, op7_html_extraction, op8_minhash, op9_warc, op10_chat_format, op11_filter_audit, op12_line_dedup, op13_fill_in_middle,
    )}


WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

ORACLE = {
    "op3_decontaminate": rf"""
        with item as (select item_id, {WORDS} as w from benchmark),
        item_run as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as run
                     from item, unnest(range(1, len(w) - least(len(w), 10) + 2)) as r(i) where len(w) > 0),
        size as (select distinct n from item_run),
        doc as (select doc_id, {WORDS} as w from documents),
        doc_run as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as run from doc, size, unnest(range(1, len(w) - n + 2)) as r(i)),
        hit as (select doc_id, i, d.n, item_id from doc_run d join item_run b on d.n = b.n and d.run = b.run),
        place as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) as r(p) group by doc_id),
        named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id)
        select doc.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from doc left join place using (doc_id) left join named using (doc_id)""",
    "op8_minhash": r"""
        with recursive doc as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
        shingle as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from doc, unnest(range(1, greatest(len(w) - 3, 2))) as r(i) where len(w) > 0),
        size as (select doc_id, count(*) as n from shingle group by doc_id),
        met as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
        link as (select a, b from met join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
        way as (select a, b from link union select b, a from link),
        reach as (select doc_id, doc_id as r from documents union select reach.doc_id, way.b from reach join way on way.a = reach.r),
        least as (select doc_id, min(r) as component_id from reach group by doc_id)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents join least using (doc_id) left join size using (doc_id)""",
    "op9_warc": """
        with page as (select page_id, encode(coalesce(html, '')) as payload from pages),
        summed as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as sum, max(page_id) over (partition by sha1(payload)) as last from page)
        select page_id, payload_bytes::bigint as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sum, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
               case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id < last then last end as refers_to
        from summed""",
    "op10_chat_format": r"""
        with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                      union all select -7, t, case t when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from unnest(range(2)) as r(t)),
        sized as (select *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) + length(role) + length('<turn ></turn>') + 1 as chars from said)
        select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
        from sized group by conv_id""",
    "op11_filter_audit": r"""
        with doc as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        mark as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
        flag as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                   case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
                   || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 'C' else '' end
                   || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as failed
                 from doc left join mark using (doc_id)),
        alike as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from flag group by all),
        letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
        ordered as (select a.k || b.k || c.k || d.k || e.k as o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        step as (select o, s, o[s] as k, o[1:s - 1] as earlier from ordered, unnest(range(1, 6)) as r(s)),
        met as (select part, o, s, k, n, good, toxic, contains(failed, k) as fails, length(translate(failed, earlier, '')) < length(failed) as gone, failed = k as only_k from alike, step),
        told as (select part, o, s, k, coalesce(sum(n) filter (not fails and not gone), 0) as kept, coalesce(sum(n) filter (fails and not gone), 0) as removed, coalesce(sum(n) filter (fails and gone), 0) as redundant,
                   coalesce(sum(n) filter (only_k), 0) as unique_fails, coalesce(sum(good) filter (fails and not gone), 0) as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0) as toxic_lost from met group by part, o, s, k)
        select part, o as filter_order, s::int as step, k as filter, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
               good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, k)::bigint as shapley from told""",
    "op12_line_dedup": r"""
        with line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents),
        keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
        shared as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
        select doc_id, count(*)::bigint as n_lines, count(shared.key)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (shared.key is null), '')) as kept_sha256
        from keyed left join shared using (key) group by doc_id""",
    "op13_fill_in_middle": r"""
        with doc as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t, sha256('1:' || doc_id) as h from documents),
        rolled as (select *, len(t) as n, list_transform(range(4), lambda k: ('0x' || h[8 * k + 1:8 * k + 8])::bigint) as d from doc),
        cut as (select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
                  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 90 then 'plain' when d[4] % 100 < 20 then 'spm' else 'psm' end as form from rolled),
        part as (select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle, array_to_string(t[b + 1:], '') as suffix from cut)
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
        from part""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
