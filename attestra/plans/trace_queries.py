"""Registered queries of traces and reports, each beside its SQL (see ``queries``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import evaluation, scoring, traces
from attestra.plans.queries import D, L, S, col, query, rnd, t
from attestra.sources import dataset as source

# ---- shapes and padding: the lines of a text as crops, 10 high and as wide as they are long ----

_CROPS = "select doc_id, lang, greatest(1, length(x)) w, 8 + length(x) % 5 h from (select doc_id, lang, unnest(string_split(text, chr(10))) x from documents)"


@query(f"""with c as ({_CROPS}), g as (select doc_id, count(*) batch_size, max(h) max_height, max(w) max_width, sum(h * w)::bigint area, (max(h) * max(w) * count(*))::bigint padded, sum(w / h) / (max(w / h) * count(*)) ratio from c group by 1)
select doc_id, batch_size, max_height, max_width, area, case when doc_id % 2 = 0 then padded end padded_area, case when doc_id % 2 = 0 then round(area / padded::double, 6) end efficiency, case when doc_id % 2 = 1 then round(ratio, 6) end ratio_efficiency from g""")
def call_shapes(s, d):
    """Every text's lines as one call's crops; of every second the padded tensors are known."""
    lines = F.split("text", "\n")
    shapes = F.transform(lines, lambda x: F.struct((F.lit(8) + F.length(x) % 5).alias("h"), F.greatest(F.lit(1), F.length(x)).alias("w")))
    x = t(s, d, "documents").select("doc_id", shapes.alias("sources"), (col("doc_id") % 2 == 0).alias("transformed"))
    most = lambda k: F.array_max(F.transform("sources", lambda q: q[k]))
    x = x.withColumn("inputs", F.transform("sources", lambda q: F.struct(most("h").alias("h"), most("w").alias("w"))))
    r = traces.call_shapes(x)
    return r.select("doc_id", *(col(c).cast(L).alias(c) for c in ("batch_size", "max_height", "max_width", "area", "padded_area")), rnd(col("efficiency")).alias("efficiency"), rnd(col("ratio_efficiency")).alias("ratio_efficiency"))


@query(f"""with c as (select lang, doc_id // 3 batch, h * w useful, 16 * (w + 31 - (w + 31) % 32) padded, 16 th, w + 31 - (w + 31) % 32 tw from ({_CROPS})), b as (select lang, batch, count(*) n from c group by all), s as (select lang, string_agg(n || ':' || k, ' ' order by n) batch_sizes from (select lang, n, count(*) k from b group by all) group by 1), h as (select lang, string_agg(th || 'x' || tw || ':' || k, ' ' order by th, tw) shapes from (select lang, th, tw, count(*) k from c group by all) group by 1)
select lang, count(*) crops, sum(useful)::bigint useful, sum(padded)::bigint padded, count(distinct batch) batches, any_value(batch_sizes) batch_sizes, any_value(shapes) shapes, round(sum(useful) / sum(padded)::double, 6) efficiency from c join s using (lang) join h using (lang) group by lang""")
def padding_by_language(s, d):
    x = t(s, d, "documents").select("lang", F.floor(col("doc_id") / 3).alias("batch"), F.explode(F.split("text", "\n")).alias("x"))
    w, h = F.greatest(F.lit(1), F.length("x")), 8 + F.length("x") % 5
    tw = w + 31 - (w + 31) % 32
    c = x.select("lang", "batch", (h * w).alias("useful"), (16 * tw).alias("padded"), F.lit(16).alias("tensor_h"), tw.alias("tensor_w"))
    return traces.padding_report(c, "lang").withColumn("efficiency", rnd(col("efficiency")))


@query("""select c.conv_id, coalesce(string_agg(turn || '=' || role, ' ' order by turn), '') lines, count(turn) n from (select distinct conv_id from conversations) c left join conversations t on t.conv_id = c.conv_id and t.turn % 2 = 1 group by 1""")
def crops_with_lines(s, d):
    c = t(s, d, "conversations")
    lines = c.where("turn % 2 = 1").select("conv_id", col("turn").alias("line_index"), "role")
    r = traces.with_lines(c.select("conv_id").distinct(), lines, "conv_id")
    shown = F.array_join(F.transform("line_crops", lambda x: F.concat_ws("=", x["line_index"].cast(S), x["role"])), " ")
    return r.select("conv_id", F.coalesce(shown, F.lit("")).alias("lines"), col("line_crop_count").cast(L).alias("n"))


# ---- lists of lines ----

_LISTS = "select o_orderkey k, o_orderstatus g, [o_orderpriority, o_clerk_, 'x' || o_orderkey] e, case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then [o_orderpriority, 'y'] else [o_orderpriority, o_clerk_, 'x' || (o_orderkey // 2 * 2)] end a, case when o_orderkey % 4 = 0 then [o_orderpriority] else [o_orderpriority, o_clerk_, 'x' || o_orderkey, 'more'] end b from (select *, 'c' || o_custkey o_clerk_ from orders)"


def _lists(s, d):
    k, p, c = col("o_orderkey"), col("o_orderpriority"), F.concat(F.lit("c"), col("o_custkey").cast(S))
    x = lambda v: F.concat(F.lit("x"), v.cast(S))
    a = F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.array(p, F.lit("y"))).otherwise(F.array(p, c, x(F.floor(k / 2) * 2)))
    b = F.when(k % 4 == 0, F.array(p)).otherwise(F.array(p, c, x(k), F.lit("more")))
    return t(s, d, "orders").select(k.alias("k"), col("o_orderstatus").alias("g"), F.array(p, c, x(k)).alias("e"), a.alias("a"), b.alias("b"))


@query(f"""with x as ({_LISTS}), y as (select k, e, coalesce(a, []) a from x) select k, e = a as exact, list_sum(list_transform([1, 2, 3], lambda i: (len(a) >= i and a[i] = e[i])::int))::bigint exact_lines, 3::bigint line_total, round(list_sum(list_transform([1, 2, 3], lambda i: (len(a) >= i and a[i] = e[i])::int)) / 3.0, 6)::double line_rate, list_sum(list_transform([1, 2, 3], lambda i: levenshtein(e[i], coalesce(a[i], ''))))::bigint line_errors, levenshtein(array_to_string(e, chr(10)), array_to_string(a, chr(10)))::bigint distance, round(1 - levenshtein(array_to_string(e, chr(10)), array_to_string(a, chr(10))) / greatest(1, length(array_to_string(e, chr(10))), length(array_to_string(a, chr(10))))::double, 6) char_rate from y""")
def list_metrics(s, d):
    r = traces.line_metrics(_lists(s, d), "e", "a")
    return r.select("k", "exact", *(col(c).cast(L).alias(c) for c in ("exact_lines", "line_total", "line_errors", "distance")), rnd(col("line_rate")).alias("line_rate"), rnd(col("char_rate")).alias("char_rate"))


@query(f"""with x as ({_LISTS}), y as (select g, unnest([1, 2, 3]) i, e, coalesce(a, []) a, b from x), z as (select g, e[i] = coalesce(a[i], '') l, e[i] = coalesce(b[i], '') r from y) select g, count(*) filter (where l and r) both_correct, count(*) filter (where l and not r) regression, count(*) filter (where not l and r) improvement, count(*) filter (where not l and not r) both_wrong, count(*) evaluable, count(*) filter (where not l and r) - count(*) filter (where l and not r) net_change from z group by 1""")
def list_transitions(s, d):
    return traces.line_transitions(_lists(s, d), "e", "a", "b", "g")


# ---- reports ----


@query("""select l_returnflag, round(sum(case when l_linenumber % 2 = 1 then l_quantity else 0 end + l_discount)::double, 4) as seconds from lineitem where l_linenumber <> 7 group by 1""")
def parsing_seconds(s, d):
    n, q = col("l_linenumber"), col("l_quantity").cast(D)
    times = F.when(n == 7, F.lit(None)).when(n % 2 == 1, F.create_map(F.lit("parse"), q, F.lit("check"), col("l_discount").cast(D), F.lit("other"), F.lit(9.0))).otherwise(F.create_map(F.lit("check"), col("l_discount").cast(D)))
    r = traces.named_seconds(t(s, d, "lineitem").select("l_returnflag", times.alias("times")), "times", ("assign", "parse", "check"), "l_returnflag")
    return r.withColumn("seconds", F.round("seconds", 4))


@query("""with x as (select event_type kind, user_id % 30 doc, 'c' || event_id % 3 as configuration, avg(value % 1) accuracy from events group by all), b as (select kind, doc, case when accuracy >= 0.6 then 'easy' when accuracy < 0.4 then 'hard' else 'mixed' end bucket from x where configuration = 'c0') select kind, bucket, configuration, round(avg(accuracy), 6) mean, count(*) documents from x join b using (kind, doc) group by all""")
def difficulty_buckets(s, d):
    x = t(s, d, "events").groupBy(col("event_type").alias("kind"), (col("user_id") % 30).alias("doc"), F.concat(F.lit("c"), (col("event_id") % 3).cast(S)).alias("configuration")).agg(F.avg(col("value") % 1).alias("accuracy"))
    return traces.difficulty(x, "c0", ["kind", "doc"], 0.6, 0.4).withColumn("mean", rnd(col("mean")))


_FIELDS = "select l_orderkey doc, 'f' || l_linenumber as field, max(l_shipmode) expected, max(case when l_partkey % 3 = 0 then '' when l_partkey % 5 = 0 then null else l_shipmode end) as value, max(case when l_partkey % 2 = 0 then 'ocr' end) source from (select *, 'm' || l_suppkey % 4 l_shipmode from lineitem) group by 1, 2"


@query(f"""select doc, count(*) configured, count(*) filter (where expected = value) exact_matches, coalesce(string_agg(field, ',' order by field) filter (where expected = value), '') matched, coalesce(string_agg(field, ',' order by field) filter (where coalesce(value, '') = ''), '') missing, coalesce(string_agg(distinct source, ','), '') sources from ({_FIELDS}) group by 1""")
def field_reports(s, d):
    mode, p = F.concat(F.lit("m"), (col("l_suppkey") % 4).cast(S)), col("l_partkey")
    x = t(s, d, "lineitem").groupBy(col("l_orderkey").alias("doc"), F.concat(F.lit("f"), col("l_linenumber").cast(S)).alias("field")).agg(F.max(mode).alias("expected"), F.max(F.when(p % 3 == 0, "").when(p % 5 == 0, F.lit(None)).otherwise(mode)).alias("value"), F.max(F.when(p % 2 == 0, "ocr")).alias("source"))
    r = traces.field_report(x, "doc")
    return r.select("doc", "configured", "exact_matches", *(F.array_join(c, ",").alias(c) for c in ("matched", "missing", "sources")))


_REQUESTS = "select event_id k, event_type expected, case when user_id % 3 = 0 then event_type when user_id % 3 = 1 then 'other' end detected, case event_id % 5 when 0 then 'match' when 1 then 'likely_match' when 2 then 'mismatch' when 3 then 'not_found' end status, 1 + event_id % 2 as repeat from events"


def _requests(s, d):
    k, u = col("event_id"), col("user_id")
    status = F.when(k % 5 == 0, "match").when(k % 5 == 1, "likely_match").when(k % 5 == 2, "mismatch").when(k % 5 == 3, "not_found")
    return t(s, d, "events").select(k.alias("k"), col("event_type").alias("expected"), F.when(u % 3 == 0, col("event_type")).when(u % 3 == 1, "other").alias("detected"), status.alias("status"), (1 + k % 2).alias("repeat"))


@query(f"""select k, detected is not distinct from expected raw_exact, coalesce(status = 'match', false) normalized_exact, coalesce(status, 'request_failed') status from ({_REQUESTS})""")
def field_request_rows(s, d):
    return traces.field_rows(_requests(s, d)).select("k", "raw_exact", "normalized_exact", "status")


@query(f"""select expected, count(*) fields, count(*) filter (where status in ('match', 'likely_match')) accepted, count(*) filter (where status in ('mismatch', 'not_found')) hard_failures, round(count(*) filter (where status in ('match', 'likely_match')) / count(*)::double, 6) accuracy from ({_REQUESTS}) where repeat = 1 group by 1""")
def first_repeat_accuracy(s, d):
    return traces.first_repeat(_requests(s, d), "expected").withColumn("accuracy", rnd(col("accuracy")))


_OUT = "select 'v' || l_linenumber % 3 as variant, l_orderkey doc, 'f' || l_linenumber // 3 as field, max(l_suppkey % 3)::varchar as value from lineitem group by 1, 2, 3"


@query(f"""with o as ({_OUT}), b as (select doc, field, value from o where variant = 'v0'), e as (select x.variant, b.* from (select distinct variant from o) x, b) select coalesce(e.variant, o.variant) as variant, count(*) filter (where e.value is distinct from o.value) changed from e full join o on o.variant = e.variant and o.doc = e.doc and o.field = e.field group by 1""")
def changes_by_variant(s, d):
    n = col("l_linenumber")
    x = t(s, d, "lineitem").groupBy(F.concat(F.lit("v"), (n % 3).cast(S)).alias("variant"), col("l_orderkey").alias("doc"), F.concat(F.lit("f"), F.floor(n / 3).cast(S)).alias("field")).agg(F.max(col("l_suppkey") % 3).cast(S).alias("value"))
    return traces.variant_changes(x, "v0", ["doc", "field"])


@query("""select p_partkey, 0::bigint together, case p_partkey % 3 when 0 then 0::bigint when 1 then 1 end apart from part""")
def calls_by_role(s, d):
    x = t(s, d, "part").select("p_partkey", F.when(col("p_partkey") % 3 == 0, "visible").when(col("p_partkey") % 3 == 1, "mrz").otherwise("face").alias("role"))
    a, b = traces.role_batches(x, False).select("p_partkey", col("call").alias("together")), traces.role_batches(x, True).select("p_partkey", col("call").cast(L).alias("apart"))
    return a.join(b, "p_partkey")


@query("""with g as (select p_brand, p_type, avg(p_retailprice) cost, avg(p_size)::double gain from part group by 1, 2) select p_brand, p_type, round(cost, 6) cost, round(gain, 6) gain from g a where not exists (select 1 from g b where b.p_brand = a.p_brand and b.cost < a.cost and b.gain > a.gain)""")
def pareto_strict(s, d):
    g = t(s, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("cost"), F.avg("p_size").alias("gain"))
    return evaluation.pareto(g, "p_brand", "cost", "gain", strict=True).select("p_brand", "p_type", rnd(col("cost")).alias("cost"), rnd(col("gain")).alias("gain"))


@query("""select o_orderkey k, coalesce(sum(l_linenumber) filter (where l_returnflag = 'R'), 0)::bigint r, coalesce(sum(l_linenumber) filter (where l_returnflag = 'A'), 0)::bigint a from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def documents_with_deltas(s, d):
    deltas = t(s, d, "lineitem").select(col("l_orderkey").alias("k"), F.lower("l_returnflag").alias("name"), col("l_linenumber").cast(L).alias("delta"))
    return evaluation.with_deltas(t(s, d, "orders").select(col("o_orderkey").alias("k")), deltas, "k", "name", "delta", ["r", "a"]).select("k", "r", "a")


@query("""select c_mktsegment, count(*) documents, round(count(*) filter (where c_custkey % 5 <> 0 and c_custkey % 9 <> 0) / count(*)::double, 6) parser_success, round(count(*) filter (where c_custkey % 5 <> 0 and c_custkey % 9 <> 0 and c_custkey % 7 <> 0) / count(*)::double, 6) validation_success from customer group by 1""")
def zone_success(s, d):
    k = col("c_custkey")
    checks = F.when(k % 5 == 0, F.lit(None)).when(k % 9 == 0, F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True), k % 7 != 0))
    r = scoring.zone_success(t(s, d, "customer").select("c_mktsegment", checks.alias("checks")), "c_mktsegment")
    return r.select("c_mktsegment", "documents", rnd(col("parser_success")).alias("parser_success"), rnd(col("validation_success")).alias("validation_success"))


# ---- pictures to annotate ----

_AT = "case page_id % 6 when 0 then 'passports/P' || page_id || '.PNG' when 1 then 'cards/c' || page_id || '/front.jpg' when 2 then 'cards/c' || (page_id - 1) || '/back.tif' when 3 then 'cards/c' || page_id || '/front.jpg' when 4 then 'cards/c' || (page_id - 1) || '/Front.png' else 'cards/loose' || page_id || '.jpg' end"


def _inputs(s, d):
    layout = lambda *v: F.struct(*(x.alias(n) for n, x in zip(("place", "layout", "document_type", "input_directory", "pair_sides"), v, strict=True)))
    sides, none = F.array(F.lit("front"), F.lit("back")), F.lit(None).cast("array<string>")
    layouts = s.range(1).select(F.inline(F.array(layout(F.lit(0), F.lit("page"), F.lit("passport"), F.lit("passports"), none), layout(F.lit(1), F.lit("card"), F.lit("id_card"), F.lit("cards"), sides))))
    return source.inputs(t(s, d, "pages").select(F.expr(_AT).alias("file")), layouts)


@query(f"""with f as (select page_id, {_AT} file from pages) select 'page' layout, null::varchar side, 'passport:' || string_split(file, '/')[2] as key, file from f where page_id % 6 = 0
union all select 'card', case page_id % 6 when 1 then 'front' else 'back' end, 'id_card:' || string_split(file, '/')[2] || ':' || case page_id % 6 when 1 then 'front' else 'back' end, file from f where page_id % 6 in (1, 2)
union all select 'card', 'front', 'id_card:' || string_split(file, '/')[2] || ':front', file from f where page_id % 6 = 3 and page_id + 1 not in (select page_id from f)""")
def annotation_inputs(s, d):
    return _inputs(s, d)[0].select("layout", "side", "key", "file")


@query(f"""with f as (select page_id, {_AT} file from pages) select 'card' layout, 'not in a folder of its own: ' || string_split(file, '/')[2] detail from f where page_id % 6 = 5
union all select 'card', 'missing back in ' || string_split(file, '/')[2] from f where page_id % 6 = 3 union all select 'card', case when max(page_id) % 6 = 4 then 'duplicate front in ' else null end || string_split(file, '/')[2] from f where page_id % 6 in (3, 4) group by string_split(file, '/')[2] having count(*) > 1
union all select 'card', 'missing back in ' || string_split(file, '/')[2] from f where page_id % 6 = 1 and page_id + 1 not in (select page_id from f) union all select 'card', 'missing front in ' || string_split(file, '/')[2] from f where page_id % 6 = 2 and page_id - 1 not in (select page_id from f)""")
def annotation_input_problems(s, d):
    return _inputs(s, d)[1]
