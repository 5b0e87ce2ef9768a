"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(plan):
    QUERIES[plan.__name__] = plan
    return plan


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies; TOKENIZER_DIR overrides the installed folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.records import records_digest, write_records

    written = write_records(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return records_digest(spark, written)


@query
def op7_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.unigram import encode, load_pieces

    return encode(table(spark, folder, "documents"), load_pieces(tokenizer_file("piece_bpe_32k.model")), keep_ids=False)


@query
def op8_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.tokencount import prefix_counts

    counts = prefix_counts(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), keep_steps=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.mixing import mix, mixed_documents

    return mixed_documents(mix(table(spark, folder, "documents")))


SQL["op1_source_mix"] = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents),
s as (
    select source, cast(sum(size) as bigint) as source_size, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
    from d group by source),
l as (
    select *, 2.0::double * source_size as cap, row_number() over o as nth,
        (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
    from s window o as (order by source_size / weight, case when source is null then 'n' else 's' || source end)),
f as (select arg_min(level, nth) filter (not cap <= level * weight) as level from l),
t as (
    select source, source_size, case when cap <= l.level * weight then cap else least(cap, f.level * weight) end as target
    from l cross join f),
p as (
    select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target) as bigint) as need,
        coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0) as start
    from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
    cast(case when source_size = 0 then 0
        else (need // source_size) * size + greatest(0, least(start + size, need % source_size) - start) end as bigint) as taken
from p
"""


@query
def op3_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.toxicity import chain_for, score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, chain_for(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


@query
def op5_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.repeats import without_repeats

    return without_repeats(table(spark, folder, "documents"))


@query
def op9_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.vectors import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))


@query
def op2_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.weighted import fingerprints

    return fingerprints(table(spark, folder, "documents"))


@query
def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.urls import judge_urls

    return judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.audit import filter_audit

    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op11_filter_audit"] = r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (coalesce(d.doc_id > min(d.doc_id) over (partition by t), false))::int as mask
    from d left join l using (doc_id)),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (
    select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from f a join f b on b.f <> a.f join f c on c.f not in (a.f, b.f) join f d on d.f not in (a.f, b.f, c.f)
    join f e on e.f not in (a.f, b.f, c.f, d.f)),
s as (
    select filter_order, step::int as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
    from o, unnest(range(1, 6)) as u(step)),
r as (
    select part, filter_order, step, bit,
        count(*) filter (mask & (earlier | bit) = 0) as kept,
        count(*) filter (mask & bit <> 0 and mask & earlier = 0) as removed,
        count(*) filter (mask & bit <> 0 and mask & earlier <> 0) as redundant,
        count(*) filter (mask = bit) as unique_fails,
        count(*) filter (mask & bit <> 0 and mask & earlier = 0 and good = 1) as good_lost,
        count(*) filter (mask & bit <> 0 and mask & earlier = 0 and toxic = 1) as toxic_lost
    from m cross join s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from r
"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


SQL["op12_prefix_trie"] = r"""
with own as (
    select conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}
        order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as ts
    from conversations where conv_id is not null group by conv_id),
b as (select *, conv_id - (conv_id % 5 + 5) % 5 as base, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint) as bytes from own),
h as (
    select conv_id, base, ts,
        (xor(list_reduce([4294967295::bigint] || bytes, lambda c, byte: list_reduce([xor(c, byte)] || range(8),
            lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 9)::int as h
    from b),
r as (
    select h.conv_id, list_transform(case when h.h = 0 then [] else coalesce(o.ts[1:h.h], []) end || h.ts[h.h + 1:],
        lambda t: {'role': t.role, 'text': t.text}) as path
    from h left join own o on o.conv_id = h.base),
m as (select conv_id, path, d, path[1:d] as node, len(path) = d as ends from r, unnest(range(0, len(path) + 1)) as u(d)),
n as (
    select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
        case when d = 0 then 0 else (count(*) - 1) * strlen(node[d].text) end as saved,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
    from m group by node, d),
k as (select n.*, p.conv_id as parent_conv_id, (select count(*) from n c where c.depth = n.depth + 1 and c.node[1:n.depth] = n.node) as n_children
    from n left join n p on p.depth = n.depth - 1 and p.node = n.node[1:p.depth]),
t as (
    select a.node, count(*) filter (k.n_children = 0) as n_leaves, sum(k.saved) as saved_tokens
    from (select node as below, node[1:d] as node from k, unnest(range(0, depth + 1)) as u(d)) a join k on k.node = a.below
    group by a.node)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from k join t using (node)
"""


@query
def op13_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatt.llm.langid import identify

    return identify(table(spark, folder, "documents"))
