"""The registered queries of this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import decontaminate
from .langid import identify_languages
from .lexical import ranked_search
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack
from .phrases import collocations
from .quality_qda import quality_scores
from .quality_rules import quality_rules
from .sharding import shuffle_into_shards
from .suffix_dedup import cut_repeats
from .toxicity import toxicity_scores
from .wordpiece import token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents"), 24)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), length=50)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end_id=0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_quality_classifier, op3_suffix_array_dedup, op4_minhash_near_dedup, op5_best_fit_packing, op6_language_id, op7_toxicity, op8_quality_rules, op9_benchmark_decontamination, op10_token_counts, op11_phrase_collocations, op12_lexical_search, op13_source_mixing)}

#: Each 50-byte string with the smallest document where it starts; starts at most 50 bytes apart are one removed run.
_OP3_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    w as (select doc_id, i, substr(h, cast(2 * i + 1 as bigint), 100) as s from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from d)),
    first as (select s, min(doc_id) as least from w group by 1),
    hit as (select w.doc_id, i from w join first using (s) where least < w.doc_id),
    new as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as opens from hit),
    run as (select doc_id, min(i) as a, max(i) + 50 as b from (select *, sum(opens) over (partition by doc_id order by i) as k from new) group by doc_id, k),
    rest as (select r.doc_id, a, b, substr(h, cast(2 * b + 1 as bigint), cast(2 * (coalesce(lead(a) over (partition by r.doc_id order by a), len(h) // 2) - b) as bigint)) as tail, h from run r join d using (doc_id)),
    cut as (select doc_id, sum(b - a) as n, count(*) as k, substr(any_value(h), 1, cast(2 * min(a) as bigint)) || string_agg(tail, '' order by a) as kept from rest group by 1)
    select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(k, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join cut using (doc_id)"""
#: Distinct 4-word shingles, all pairs of documents that share one, and what is reachable by links.
_OP4_SQL = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s from w),
    classes as (select min(doc_id) as c, len(k) as n, k from (select doc_id, list_sort(s) as k from sets) where len(k) > 0 group by k),
    items as (select c, n, unnest(k) as x from classes),
    links as (select a.c as a, b.c as b from items a join items b on a.x = b.x and a.c <> b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    top as (select a, min(b) as least from reach group by 1)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(least(t.least, c.c), s.doc_id) as component_id, s.doc_id = coalesce(least(t.least, c.c), s.doc_id) as kept
    from sets s left join classes c on list_sort(s.s) = c.k left join top t on t.a = c.c"""
#: All contiguous phrases of pieces by language, cuts joined with the counts of their parts, and what lies inside a longer phrase.
_OP11_SQL = """with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
    w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
    places as (select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
    all_grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select *, unnest(range(1, least(4, len(w) - i + 1) + 1)) as k from places)),
    f as (select lang, k, phrase, count(*) as f from all_grams group by 1, 2, 3),
    n as (select lang, sum(f) as n from f where k = 1 group by 1),
    c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
    cut as (select *, unnest(range(1, k)) as j from c),
    s as (select cut.*, l.f as l, r.f as r, (2000000 * a::hugeint) // (l.f + r.f) as score from cut
        join f l on l.lang = cut.lang and l.phrase = array_to_string(cut.w[1:j], ' ') join f r on r.lang = cut.lang and r.phrase = array_to_string(cut.w[j + 1:cut.k], ' ')),
    low as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    part as (select lang, a, k, w, unnest(range(2, k)) as m from c where k > 2),
    inner_ as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, a from (select *, unnest(range(1, k - m + 2)) as i from part)),
    gone as (select distinct low.lang, low.phrase from low join inner_ using (lang, phrase) where 100 * inner_.a >= 80 * low.a),
    kept as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from low anti join gone using (lang, phrase))
    select kept.lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from kept join n using (lang) where rank <= 2000"""
#: Every document that shares a term with an item, scored and ranked.
_OP12_SQL = """with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from documents),
    tf as (select doc_id, t, count(*) as tf from t group by 1, 2),
    d as (select doc_id, sum(tf)::bigint as n from tf group by 1),
    c as (select count(*) as nd, sum(n)::bigint as l from d),
    w as (select t, cast(floor(1000 * ln((2.0 * any_value(nd) + 2) / (2.0 * count(*) + 1))) as bigint) as w from tf, c group by 1),
    m as (select doc_id, 25 + (75 * n * nd) // l as m from d, c),
    q as (select item_id, t, count(*) as q from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark) group by 1, 2),
    s as (select item_id, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from q join w using (t) join tf using (t) join m using (doc_id) group by 1, 2)
    select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10"""
#: The same keys from the same digests; the level of the targets by running sums, what each source takes by one more.
_OP13_SQL = """with w as (select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
        md5('13:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as digest from documents),
    k as (select doc_id, source, size, digest, 0.25::double + 0.75::double * (len(list_distinct(lines))::double / greatest(len(lines), 1)) * (size::double / greatest(size + len(regexp_extract_all(text, '[#*$%&|<>]')), 1)) as q, (cast('0x' || substr(digest, 1, 13) as bigint) + 1) / 4503599627370496::double as u from w),
    s as (select source, sum(size)::bigint as total, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3) + 1]::bigint as weight from k group by 1),
    r as (select *, 2::double * total as cap, 2::double * total / weight as ratio from s),
    v as (select *, (1.5::double * sum(total) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from r),
    t as (select source, total, case when max(case when ratio > level then level end) over () is null then cap else least(cap, max(case when ratio > level then level end) over () * weight) end as target from v),
    e as (select *, case when total > 0 then cast(floor(target / total) as bigint) else 0 end as epochs from t),
    o as (select k.doc_id, size, total, target, epochs, target - epochs * total as rest, coalesce(sum(size) over (partition by k.source order by -ln(u) / q, k.doc_id, digest rows between unbounded preceding and 1 preceding), 0) as before
        from k join e on k.source is not distinct from e.source)
    select doc_id, size, total as source_size, target, cast(size * (epochs + case when before + size / 2::double <= rest then 1 else 0 end) as bigint) as taken from o"""
#: The other operators draw, learn, tokenize or pack: tests hold them against brute force.
ORACLE: dict[str, str] = {"op3_suffix_array_dedup": _OP3_SQL, "op4_minhash_near_dedup": _OP4_SQL, "op11_phrase_collocations": _OP11_SQL, "op12_lexical_search": _OP12_SQL, "op13_source_mixing": _OP13_SQL}
