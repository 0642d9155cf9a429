"""Thin queries over the operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, chosen_path, collocations, decontaminate, html_text, katz, nn_descent, pii, prefix_trie, quality, quality_rules, substring_dedup, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))[0]


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op6_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("redacted")


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.model_and_scores(table(spark, sf_dir, "documents"), held_out)[0]


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def quality_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, table(spark, sf_dir, "labels"), quality_held_out())
    return scored.select("doc_id", quality_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.REPORTED, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_spaced_seed_decontamination, op2_nn_descent, op3_warc_zip, op4_html_tree_model, op5_chosen_path_join, op6_pii_semi_crf, op7_katz_backoff, op8_substring_dedup, op9_quality_knn, op10_bpe, op11_quality_rules, op12_prefix_trie, op13_collocations)}
ORACLE: dict[str, str] = {
    "op3_warc_zip": """
        with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) d from pages),
        k as (select *, strlen(html) n, max(page_id) over (partition by d) m from p)
        select page_id, n::bigint payload_bytes, d payload_digest,
               case when n >= 1000 and page_id < m then 'revisit' else 'response' end record_type,
               case when n >= 1000 and page_id < m then m end refers_to
        from k""",
    "op8_substring_dedup": """
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
        win as (select doc_id, i, array_to_string(w[i : i + 19], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
        rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) r from win) where r > 1),
        gone as (select distinct doc_id, i + j p from rep, range(20) t(j)),
        kept as (select doc_id, string_agg(x, ' ' order by p) t from (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from d) anti join gone using (doc_id, p) group by doc_id),
        n as (select doc_id, count(*) n from gone group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n.n, 0)::bigint n_removed, sha256(coalesce(kept.t, '')) kept_sha256
        from d left join n using (doc_id) left join kept using (doc_id)""",
    "op5_chosen_path_join": """
        with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) s from w),
        k as (select doc_id, len(s) n, array_to_string(list_sort(s), '|') k, unnest(s) t from s),
        x as (select a.doc_id a, b.doc_id b from k a join k b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
        e as (select a, b from x union all select b, a from x),
        r as (with recursive r(i, c) as (select doc_id, doc_id from s union select r.i, e.b from r join e on e.a = r.c) select i, min(c) c from r group by i),
        n as (select a, count(*) n from e group by a),
        q as (select doc_id, array_to_string(list_sort(s), '|') k, len(s) n from s),
        c as (select *, case when n > 0 then min(doc_id) over (partition by k) else doc_id end copy_of from q)
        select c.doc_id, copy_of, coalesce(n.n, 0)::bigint n_links, r.c class_id, c.doc_id = r.c kept
        from c left join n on n.a = c.doc_id join r on r.i = c.doc_id""",
    "op11_quality_rules": """
        with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
        w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ln,
                     list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D,.;:!?]+'), lambda x: list_contains(string_split('STOP', ' '), x)) sw from d),
        win as (select r, i, array_to_string(w[i : i + 4], ' ') k from (select r, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)),
        rep as (select r, i from win qualify count(*) over (partition by r, k) > 1),
        cov as (select r, count(distinct i + j) n from rep, range(5) x(j) group by r),
        m as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
                     (len(ln) - len(list_distinct(ln)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, len(regexp_extract_all(t, '[!?]')) marks, len(regexp_extract_all(t, '\\.\\.|…')) dots,
                     len(sw) stops, len(ln) n_lines, len(list_filter(ln, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) bullets from w left join cov using (r)),
        f as (select *, list_filter([case when n_words < 10 then 'few_words' end, case when 100 * n_repeat_words > 20 * n_words then 'repeated_windows' end]::varchar[], lambda x: x is not null) b,
                     list_filter([case when 100 * word_chars < 200 * n_words or 100 * word_chars > 2000 * n_words then 'word_length' end, case when 100 * n_symbols > 10 * n_words then 'symbols' end,
                                  case when 100 * marks > 30 * n_words then 'marks' end, case when 100 * dots > 10 * n_words then 'dots' end, case when 100 * stops < 4 * (n_words - 20) then 'stop_words' end,
                                  case when 100 * n_dup_lines > 60 * n_lines then 'repeated_lines' end, case when 100 * bullets > 90 * n_lines then 'bullets' end]::varchar[], lambda x: x is not null) v from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, len(b) > 0 base_failed, len(b) + len(v) = 0 kept, array_to_string(b || v, ',') failed from f""".replace("STOP", " ".join(quality_rules.STOP_WORDS)),
    "op12_prefix_trie": """
        with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) p from conversations where conv_id is not null),
        h as (select distinct c, c - c % 20 b, (xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda y: ascii(y)::bigint)), lambda v, y: list_reduce(list_concat([xor(v, y)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda q, i: xor(q >> 1, (q & 1) * 3988292384))), 4294967295) % 4) h from t),
        k as (select h.*, (select least(h.h, count(*)) from t where t.c = h.b) k from h),
        z as (select k.c, t.p, r, x from k join t on t.c = k.b and t.p <= k.h union all select k.c, k.k + t.p - k.h, r, x from k join t on t.c = k.c and t.p > k.h),
        s as (select c, p, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ) over (partition by c order by p)) s, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) w, count(*) over (partition by c) n from z),
        m as (select c, 0 p, '' s, 0 w, coalesce((select any_value(n) from s where s.c = k.c), 0) n from k union all select c, p, s, w, n from s),
        g as (select s, p, any_value(w) w, min(c) c, count(*) n, coalesce(sha256(string_agg(c::varchar, ',' order by c) filter (where m.n = p)), sha256('')) e from m group by s, p),
        l as (select m.c, m.p, g.s, g.c node, lag(g.s) over (partition by m.c order by m.p) up, lag(g.c) over (partition by m.c order by m.p) up_c from m join g on g.s = m.s and g.p = m.p),
        u as (select distinct s, p, up, up_c from l),
        k2 as (select up s, count(*) n from u where up is not null group by up),
        a as (select distinct x.s top, y.s low from l x join l y on x.c = y.c and x.p <= y.p),
        v as (select top, sum((g.n - 1) * g.w) saved, count(*) filter (where k2.n is null) leaves from a join g on g.s = a.low left join k2 on k2.s = a.low group by top)
        select g.c conv_id, g.p::bigint depth, u.up_c parent_conv_id, g.n n_convs, coalesce(k2.n, 0) n_children, v.leaves n_leaves, v.saved::bigint saved_tokens, g.e ends_sha256
        from g join u on u.s = g.s and u.p = g.p join v on v.top = g.s left join k2 on k2.s = g.s""",
    "op13_collocations": """
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents where text is not null),
        w as (select lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') w from p),
        g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (values (1), (2), (3)) x(k) where len(w) >= k)),
        f as materialized (select lang, k, g, count(*) f from g group by all),
        n as (select lang, sum(f) n from f where k = 1 group by lang),
        c as (select *, string_split(g, ' ') w from f where k > 1 and f >= 10),
        h as materialized (select lang, k, g, f a, j, array_to_string(w[1 : j], ' ') lg, array_to_string(w[j + 1 :], ' ') rg from c, (values (1), (2)) x(j) where j < k),
        l as materialized (select h.*, f.f l from h join f on f.lang = h.lang and f.g = h.lg),
        s as materialized (select l.*, f.f r, 1000000::hugeint * a * a // (l::hugeint * f.f) s from l join f on f.lang = l.lang and f.g = l.rg),
        b as (select * from s qualify row_number() over (partition by lang, g order by s, j) = 1),
        sub as (select lang, array_to_string(w[1 : 2], ' ') g, f from c where k = 3 union all select lang, array_to_string(w[2 : 3], ' '), f from c where k = 3),
        m as (select lang, g, max(f) f from sub group by all),
        kept as (select b.* from b left join m using (lang, g) where m.f is null or 100 * m.f < 50 * b.a)
        select lang, row_number() over (partition by lang order by s desc, a desc, g) as rank, g phrase, a, l, r, n::bigint n, s::bigint score from kept join n using (lang) qualify rank <= 2000""",
    "op2_nn_descent": """
        with v as (select vec_id, label, embedding::double[] e from embeddings),
        x as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
        e as (select a, b from x union all select b, a from x),
        r as (with recursive r(i, c) as (select vec_id, vec_id from v union select r.i, e.b from r join e on e.a = r.c) select i, min(c) c from r group by i),
        n as (select a, count(*) n from e group by a)
        select vec_id, coalesce(n.n, 0)::bigint n_links, r.c component_id, vec_id = r.c kept from v left join n on n.a = vec_id join r on r.i = vec_id""",
}
