"""Registered queries of snapshots and stage times, each beside its SQL (see ``queries``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import snapshots, stage_time
from attestra.plans.queries import L, S, col, query, rnd, t

# ---- JSON results: events in an envelope four levels deep; every 5th user's later run differs in a value, every 7th's in a time ----

_TEXT = "'{\"success\":' || case when event_id % 11 = 0 then 'false' else 'true' end || ',\"result\":{\"fields\":{\"kind\":{\"value\":\"' || event_type || '\",\"confidence\":{\"score\":' || (user_id % 90 + 10) || '}},\"k\":{\"value\":' || props || '}},\"mrz\":[\"' || user_id || '\",[1,null]],\"none\":{},\"timings\":{\"ms\":' || (event_id % 13) || '}}}'"
_LATER = "'{\"result\":{\"timings\":{\"ms\":' || (event_id % 13 + case when user_id % 7 = 0 then 1 else 0 end) || '},\"mrz\":[\"' || user_id || '\",[1,null]],\"fields\":{\"k\":{\"value\":' || props || '},\"kind\":{\"value\":\"' || case when user_id % 5 = 0 then 'other' else event_type end || '\",\"confidence\":{\"score\":' || (user_id % 90 + 10 + case when user_id % 3 = 0 then 1 else 0 end) || '}}},\"none\":{}},\"success\":' || case when event_id % 11 = 0 then 'false' else 'true' end || '}'"


def _results(s, d, text=_TEXT, where="true"):
    return t(s, d, "events").where(where).select("event_id", F.expr(text).alias("text"))


_TREE = "select event_id, regexp_replace(replace(replace(fullkey, '$.', ''), '\"', ''), '^\\$', '') path, case when type = 'NULL' then null else atom->>'$' end as value, type from (select event_id, {text} j from events) e, json_tree(e.j::json) x where type not in ('OBJECT', 'ARRAY')"


@query(f"select event_id, path, value from ({_TREE.format(text=_TEXT)})")
def json_scalars(s, d):
    return snapshots.scalars(_results(s, d), ["event_id"], "text", lists=True).select("event_id", "path", "value")


@query(f"select event_id, path, value from ({_TREE.format(text=_TEXT)}) where path not like '%[%'")
def json_scalars_of_objects(s, d):
    return snapshots.scalars(_results(s, d), ["event_id"], "text").select("event_id", "path", "value")


_A, _B = (f"select event_id, path, value, type from ({_TREE.format(text=x)})" for x in (_TEXT, _LATER))
_CUT = " where event_id % 17 <> 0"


@query(f"""with a as ({_A}), b as (select * from ({_B}) where event_id % 17 <> 0) select coalesce(a.event_id, b.event_id) event_id, coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end change, a.value as before, b.value as after from a full join b on a.event_id = b.event_id and a.path = b.path where a.path is null or b.path is null or a.value is distinct from b.value or a.type <> b.type""")
def snapshot_difference(s, d):
    before = snapshots.scalars(_results(s, d), ["event_id"], "text", lists=True)
    after = snapshots.scalars(_results(s, d, _LATER, "event_id % 17 <> 0"), ["event_id"], "text", lists=True)
    return snapshots.difference(before, after, ["event_id"])


@query("""select event_id, case when user_id % 5 = 0 and event_type <> 'other' or user_id % 3 = 0 then 'kind' else '' end changed_fields, false zone_changed, false success_changed from events where user_id % 5 = 0 and event_type <> 'other' or user_id % 3 = 0""")
def changed_documents(s, d):
    before = snapshots.scalars(_results(s, d), ["event_id"], "text", lists=True)
    after = snapshots.scalars(_results(s, d, _LATER), ["event_id"], "text", lists=True)
    c = snapshots.document_changes(before, after, "event_id", "result.fields.", "result.mrz")
    return c.withColumn("changed_fields", F.array_join("changed_fields", ","))


_SEMANTIC = (r"^result\.timings\.", r"(^|\.)confidence\.score$")


@query("""select count(*) compared, count(*) filter (where user_id % 5 = 0 and event_type <> 'other') semantic, count(*) filter (where not (user_id % 5 = 0 and event_type <> 'other') and user_id % 3 = 0) detail_only from events""")
def output_changes(s, d):
    """Results of two runs: changes of values against changes of confidence alone; times don't count."""

    side = lambda text: snapshots.graded_digests(_results(s, d, text), ["event_id"], "text", _SEMANTIC[:1], _SEMANTIC[1:])
    return snapshots.change_counts(side(_TEXT), side(_LATER), "event_id")


@query("""with r as (select 'r' || (event_id % 4) run, user_id doc, event_type || (event_id // 40 % 3) digest from events), n as (select run, doc, digest, count(*) n from r group by all), b as (select doc, digest, n m from n where run = 'r0'), o as (select * from n where run <> 'r0'), same as (select run, sum(least(n, m)) same from o join b using (doc, digest) group by run),
k as (select run, doc, sum(n) n from o group by all), bk as (select doc, sum(m) m from b group by doc), c as (select run, sum(least(n, coalesce(m, 0))) common, sum(n) n from k left join bk using (doc) group by run)
select run, coalesce(same, 0)::bigint identical, (common - coalesce(same, 0))::bigint different, ((select sum(m) from bk) - common)::bigint missing, (n - common)::bigint extra from c left join same using (run)""")
def run_equivalence(s, d):
    i = col("event_id")
    r = t(s, d, "events").select(F.concat(F.lit("r"), (i % 4).cast(S)).alias("run"), col("user_id").alias("doc_id"), F.concat("event_type", (F.floor(i / 40) % 3).cast(S)).alias("digest"))
    return snapshots.equivalence(r, "r0")


@query("""with r as (select event_type kind, event_id % 4 threads, case when event_id % 6 = 5 then 'failed' else 'ok' end status, value as seconds, user_id % 20 whole, user_id % 10 semantic from events where not (event_type = 'view' and event_id % 4 = 2)),
j as (select *, exists(select 1 from r b where b.threads = 2 and b.kind = r.kind) based, exists(select 1 from r b where b.threads = 2 and b.kind = r.kind and b.whole = r.whole) w, exists(select 1 from r b where b.threads = 2 and b.kind = r.kind and b.semantic = r.semantic) m from r)
select kind, threads, count(*) repeats, count(*) filter (where status = 'ok') ok, count(*) filter (where status <> 'ok') failed, round(median(seconds) filter (where status = 'ok'), 6) as seconds, case when bool_or(based) then count(*) filter (where not w) end differences, case when bool_or(based) then count(*) filter (where not m) end semantic_differences, case when bool_or(based) then count(*) filter (where not w) - count(*) filter (where not m) end detail_only from j group by kind, threads""")
def thread_comparison(s, d):
    i = col("event_id")
    r = t(s, d, "events").where(~((col("event_type") == "view") & (i % 4 == 2))).select(col("event_type").alias("kind"), (i % 4).alias("threads"), F.when(i % 6 == 5, "failed").otherwise("ok").alias("status"), col("value").alias("seconds"), (col("user_id") % 20).alias("whole"), (col("user_id") % 10).alias("semantic"))
    return snapshots.against_set(r, ["kind"], "threads", 2).withColumn("seconds", rnd(col("seconds")))


# ---- nested stages: the lines of an order as spans, every third one short, the others around all that follow ----

_SPANS = "select distinct l_orderkey, 's' || l_linenumber stage, l_linenumber * 10 as start, case when l_linenumber % 3 = 0 then l_linenumber * 10 + 5 else 100 - l_linenumber end as stop from lineitem"


def _spans(s, d):
    n = col("l_linenumber")
    return t(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), n.cast(S)).alias("stage"), (n * 10).cast(L).alias("start"), F.when(n % 3 == 0, n * 10 + 5).otherwise(100 - n).cast(L).alias("end")).distinct()


@query(f"""with s as ({_SPANS}), p as (select c.*, p.stage parent, p.stop - p.start len, row_number() over (partition by c.l_orderkey, c.stage order by p.stop - p.start) n, count(p.stage) over (partition by c.l_orderkey, c.stage) level from s c left join s p on p.l_orderkey = c.l_orderkey and p.stage <> c.stage and p.start <= c.start and p.stop >= c.stop),
o as (select * from p where n = 1), k as (select l_orderkey, parent, sum(stop - start) inside from o where parent is not null group by all)
select o.l_orderkey, o.stage, o.parent, o.level, (o.stop - o.start - coalesce(inside, 0))::double own from o left join k on k.l_orderkey = o.l_orderkey and k.parent = o.stage""")
def nested_stages(s, d):
    return stage_time.nested(_spans(s, d), "l_orderkey").select("l_orderkey", "stage", "parent", col("level").cast(L).alias("level"), "own")


@query(f"""with s as ({_SPANS}), t as (select l_orderkey, sum(c.stop - c.start) explained from s c where not exists (select 1 from s p where p.l_orderkey = c.l_orderkey and p.stage <> c.stage and p.start <= c.start and p.stop >= c.stop) group by 1) select o_orderkey l_orderkey, (o_orderkey % 120)::double total, coalesce(explained, 0)::double explained, greatest(0, (o_orderkey % 120) - coalesce(explained, 0))::double other from orders left join t on t.l_orderkey = o_orderkey""")
def unexplained_time(s, d):
    total = t(s, d, "orders").select(col("o_orderkey").alias("l_orderkey"), (col("o_orderkey") % 120).cast("double").alias("total"))
    return stage_time.residual(_spans(s, d), "l_orderkey", total)


@query("""with o as (select l_orderkey % 5 kind, l_orderkey, l_linenumber, sum(l_quantity)::double q from lineitem group by all), m as (select kind, l_orderkey, sum(q) total from o group by all), n as (select kind, median(total) total from m group by kind), k as (select distinct kind, l_linenumber from o),
e as (select k.kind, k.l_linenumber, m.l_orderkey, coalesce(o.q, 0) q from k join m on m.kind = k.kind left join o on o.kind = k.kind and o.l_orderkey = m.l_orderkey and o.l_linenumber = k.l_linenumber)
select kind, 'line' || l_linenumber metric, round(median(q), 6) median, round(100 * median(q) / any_value(n.total), 6) percent from e join n using (kind) group by kind, l_linenumber""")
def stage_profile(s, d):
    """Lines of an order as its measured stages: medians over orders, absent ones 0, and their share of the median total."""
    o = t(s, d, "lineitem").groupBy((col("l_orderkey") % 5).alias("kind"), "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("q"))
    m = o.groupBy("kind", "l_orderkey").agg(F.sum("q").alias("total"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("line"), col("l_linenumber").cast(S)), "q"))).alias("times"))
    return stage_time.profile(m, ["kind"]).select("kind", "metric", rnd(col("median")).alias("median"), rnd(col("percent")).alias("percent"))


@query("""select event_type stage, round(sum(value), 6) as seconds, count(*) calls, sum(user_id % 3)::bigint inputs, round(sum(value) / count(*), 6) seconds_per_call, round(sum(value) / nullif(sum(user_id % 3), 0), 6) seconds_per_input from events group by 1""")
def stage_unit_costs(s, d):
    g = t(s, d, "events").groupBy(col("event_type").alias("stage")).agg(F.sum("value").alias("seconds"), F.count("*").alias("calls"), F.sum(col("user_id") % 3).alias("inputs"))
    return stage_time.unit_costs(g).select("stage", rnd(col("seconds")).alias("seconds"), "calls", "inputs", rnd(col("seconds_per_call")).alias("seconds_per_call"), rnd(col("seconds_per_input")).alias("seconds_per_input"))
