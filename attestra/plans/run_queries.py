"""Registered queries of the scoring, identity and run operators, each beside its SQL (see ``queries``)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.operators import identity, layout, ranking, runs, scoring
from attestra.plans.queries import D, L, S, _verdicts, col, query, rnd, t

# ---- truth and scores ----

_TRUTH = "select p_partkey, p_brand, case when p_partkey % 11 = 0 then 'unreadable' when p_partkey % 5 = 0 then 'empty' else 'value' end state, case when p_partkey % 5 = 0 then null else p_name end as value, case when p_partkey % 3 = 0 then replace(p_name, 'a', 'e') when p_partkey % 7 = 0 then null else p_name end seen from part"
_SCORABLE = f"select p_partkey, p_brand, case when state = 'value' then value end as value, seen from ({_TRUTH}) where state in ('value', 'empty')"


def _truth(s, d):
    k = col("p_partkey")
    state = F.when(k % 11 == 0, "unreadable").when(k % 5 == 0, "empty").otherwise("value")
    return t(s, d, "part").select("p_partkey", "p_brand", state.alias("state"), F.when(k % 5 == 0, F.lit(None)).otherwise(col("p_name")).alias("value"), F.when(k % 3 == 0, F.regexp_replace("p_name", "a", "e")).when(k % 7 == 0, F.lit(None)).otherwise(col("p_name")).alias("seen"))


@query(f"""select state, count(*) n, count(*) filter (where state in ('value', 'empty')) scorable, count(*) filter (where state = 'value' and coalesce(value, '') <> '') with_value from ({_TRUTH}) group by state""")
def truth_states(s, d):
    x = _truth(s, d)
    n = x.groupBy("state").agg(F.count("*").alias("n"))
    a, b = scoring.scorable(x).groupBy("state").agg(F.count("*").alias("scorable")), scoring.with_value(x).groupBy("state").agg(F.count("*").alias("with_value"))
    return n.join(a, "state", "left").join(b, "state", "left").na.fill(0, ["scorable", "with_value"])


@query(f"""with v as (select p_brand, coalesce(value, '') e, coalesce(seen, '') a from ({_SCORABLE})) select p_brand, count(*) evaluated, count(*) filter (where e = a) exact, count(*) filter (where e <> a and a = '') missing, count(*) filter (where e <> a and a <> '') incorrect, sum(greatest(length(e), 1) - levenshtein(e, a))::bigint as characters, sum(greatest(length(e), 1))::bigint character_total from v group by 1""")
def field_outcomes(s, d):
    return scoring.outcomes(scoring.scorable(_truth(s, d)), "value", "seen", "p_brand")


@query(f"""with v as (select p_brand, p_partkey // 4 g, coalesce(value, '') = coalesce(seen, '') ok from ({_SCORABLE})) select p_brand, count(*) documents, count(*) filter (where ok) exact_documents from (select p_brand, g, bool_and(ok) ok from v group by 1, 2) group by 1""")
def exact_documents(s, d):
    x = scoring.scorable(_truth(s, d)).withColumn("g", F.floor(col("p_partkey") / 4))
    return scoring.exact_documents(x, "value", "seen", "g", "p_brand")


@query(f"""with v as (select p_brand, coalesce(value, '') e, coalesce(seen, '') a, replace(upper(coalesce(value, '')), ' ', '') be, replace(upper(coalesce(seen, '')), ' ', '') ba from ({_SCORABLE})) select p_brand, count(*) filter (where e <> '') fields, round(1 - sum(levenshtein(e, a)) filter (where e <> '') / (sum(greatest(length(e), length(a))) filter (where e <> ''))::double, 6) by_longest, round(sum(greatest(length(be) - levenshtein(be, ba), 0)) / sum(length(be))::double, 6) by_expected from v group by 1""")
def character_rates(s, d):
    r = scoring.character_rates(scoring.scorable(_truth(s, d)), "value", "seen", "p_brand")
    return r.select("p_brand", "fields", rnd(col("by_longest")).alias("by_longest"), rnd(col("by_expected")).alias("by_expected"))


@query(f"""with v as (select substr(p_brand, 1, 7) maker, coalesce(value, '') e, coalesce(seen, '') a from ({_SCORABLE})) select maker, count(*) evaluated, count(*) filter (where e = a) exact, sum(greatest(length(e), 1) - levenshtein(e, a))::bigint as characters, sum(greatest(length(e), 1))::bigint character_total, round(count(*) filter (where e = a) / count(*)::double, 6) exact_rate, round(sum(greatest(length(e), 1) - levenshtein(e, a)) / sum(greatest(length(e), 1))::double, 6) character_rate from v group by 1""")
def merged_scores(s, d):
    each = scoring.outcomes(scoring.scorable(_truth(s, d)), "value", "seen", "p_brand").withColumn("maker", F.substring("p_brand", 1, 7))
    m = scoring.merged(each, "maker")
    return m.select("maker", "evaluated", "exact", "characters", "character_total", rnd(col("exact_rate")).alias("exact_rate"), rnd(col("character_rate")).alias("character_rate"))


@query("""select o_orderkey, o_orderdate::date::varchar as day, o_orderdate::date::varchar iso, strftime(o_orderdate, '%m%Y') cut, upper(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) code, trim(regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) words from orders""")
def neutral_forms(s, d):
    """Dates, numbers and text in the evaluator's form; the day of a dotted date goes as a label."""
    x = lambda p: F.date_format("o_orderdate", p)
    n = lambda v, f: scoring.neutral(v, F.lit(f))
    return t(s, d, "orders").select("o_orderkey", n(x("dd/MM/yyyy"), "birth_date").alias("day"), n(x("yyyy-MM-dd"), "issue_date").alias("iso"), n(x("dd.MM.yyyy"), "expiry_date").alias("cut"), n(col("o_orderpriority"), "serial_number").alias("code"), n(col("o_orderpriority"), "remark").alias("words"))


_CHECKS = """select l_orderkey, l_linenumber, l_returnflag, list_extract(['passport_number', 'name', 'pinfl', 'address', 'birth_date', 'remark', 'serial_number'], ((l_partkey % 7) + 1)::int) field, case when l_quantity < 25 then 'correct' when l_quantity < 40 then 'incorrect' else 'not_found' end neutral_status, l_discount < 0.05 accepted from lineitem"""


@query(f"""select l_returnflag, count(*) fields, count(*) filter (where neutral_status = 'correct') correct_accepted, count(*) filter (where accepted and neutral_status <> 'correct') incorrect_accepted, count(*) filter (where neutral_status = 'incorrect') mismatch, count(*) filter (where neutral_status = 'not_found') not_found from ({_CHECKS}) where field in ('passport_number', 'pinfl', 'birth_date', 'serial_number') group by 1""")
def strict_audit(s, d):
    names = F.array(*map(F.lit, ("passport_number", "name", "pinfl", "address", "birth_date", "remark", "serial_number")))
    q = col("l_quantity")
    x = t(s, d, "lineitem").select("l_returnflag", names[(col("l_partkey") % 7).cast("int")].alias("field"), F.when(q < 25, "correct").when(q < 40, "incorrect").otherwise("not_found").alias("neutral_status"), (col("l_discount") < 0.05).alias("accepted"))
    return scoring.strict_audit(x, "l_returnflag")


_REQ = "select *, case when l_suppkey % 13 = 0 then 'error' else 'ok' end request_status, case when l_quantity < 25 then 'match' when l_quantity < 35 then 'likely_match' when l_quantity < 45 then 'mismatch' else 'not_found' end status, case when l_quantity < 45 then l_discount::double end score, l_quantity < 20 raw_exact from lineitem"


@query(f"""with r as (select *, request_status = 'ok' ok from ({_REQ})) select coalesce(l_returnflag, 'all') grp, count(*) total, count(*) filter (where ok) evaluated, count(*) filter (where not ok) failed, count(*) filter (where ok and raw_exact) raw_exact, count(*) filter (where ok and status = 'match') "match", count(*) filter (where ok and status = 'likely_match') likely_match, count(*) filter (where ok and status = 'mismatch') mismatch, count(*) filter (where ok and status = 'not_found') not_found,
round(count(*) filter (where ok and status in ('match', 'likely_match')) / (count(*) filter (where ok))::double, 6) accuracy, round(count(*) filter (where ok) / count(*)::double, 6) coverage, round(avg(score) filter (where ok), 6) mean_score, min(score) filter (where ok) low_score, max(score) filter (where ok) high_score from r group by grouping sets ((l_returnflag), ())""")
def request_accuracy(s, d):
    x = _verdicts(s, d).withColumns({"request_status": F.when(col("l_suppkey") % 13 == 0, "error").otherwise("ok"), "score": F.when(col("l_quantity") < 45, col("l_discount").cast(D)), "raw_exact": col("l_quantity") < 20})
    r = scoring.request_accuracy(x, "l_returnflag")
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("grp"), *r.columns[1:9], *(rnd(col(c)).alias(c) for c in ("accuracy", "coverage", "mean_score")), "low_score", "high_score")


@query("""with r as (select event_type, case when user_id % 2 = 0 then 'ocr' else 'check' end phase, event_id % 9 <> 0 ok, value from events) select coalesce(event_type, 'overall') grp, count(*) filter (where phase = 'ocr') ocr_requests, count(*) filter (where phase = 'ocr' and ok) ocr_succeeded, count(*) filter (where phase = 'ocr' and not ok) ocr_failed, round(median(value) filter (where phase = 'ocr' and ok), 6) median_ocr_value, count(*) filter (where phase = 'check') check_requests, count(*) filter (where phase = 'check' and ok) check_succeeded, count(*) filter (where phase = 'check' and not ok) check_failed, round(median(value) filter (where phase = 'check' and ok), 6) median_check_value from r group by grouping sets ((event_type), ())""")
def request_summary(s, d):
    x = t(s, d, "events").select("event_type", F.when(col("user_id") % 2 == 0, "ocr").otherwise("check").alias("phase"), F.when(col("event_id") % 9 != 0, "ok").otherwise("error").alias("status"), "value")
    r = scoring.request_summary(x, "event_type", ["ocr", "check"], "value")
    return r.select(F.coalesce("event_type", F.lit("overall")).alias("grp"), *(rnd(col(c)).alias(c) if c.startswith("median") else col(c) for c in r.columns[1:]))


_RUN = "select l_orderkey, l_linenumber, count(*) n, bool_and(l_quantity < 35) good, bool_and(l_discount < 0.06) other from lineitem group by 1, 2"


def _two_runs(s, d):
    """Two runs over the same documents and fields, as two tables; each lacks some."""
    g = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_and(col("l_quantity") < 35).alias("good"), F.bool_and(col("l_discount") < 0.06).alias("other"))
    a = g.where(col("l_orderkey") % 10 != 0).select("l_orderkey", "l_linenumber", col("good").alias("ok"))
    return a, g.where(col("l_linenumber") != 3).select("l_orderkey", "l_linenumber", col("other").alias("ok"))


@query(f"""with a as (select * from ({_RUN}) where l_orderkey % 10 <> 0), b as (select * from ({_RUN}) where l_linenumber <> 3) select case when a.good and b.other then 'both' when a.good then 'baseline only' when b.other then 'candidate only' else 'none' end winner, count(*) fields from a join b using (l_orderkey, l_linenumber) group by 1""")
def run_winner(s, d):
    return scoring.winner(scoring.paired(*_two_runs(s, d), ["l_orderkey", "l_linenumber"], "ok"))


@query(f"""with a as (select * from ({_RUN}) where l_orderkey % 10 <> 0), b as (select * from ({_RUN}) where l_linenumber <> 3) select coalesce(a.l_linenumber, b.l_linenumber) l_linenumber, count(*) filter (where b.l_orderkey is null) missing, count(*) filter (where a.l_orderkey is null) extra, count(*) filter (where a.l_orderkey is not null and b.l_orderkey is not null) as both from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber group by 1""")
def field_sets(s, d):
    a, b = _two_runs(s, d)
    return scoring.field_sets(a, b, ["l_orderkey", "l_linenumber"], "l_linenumber")


@query("""with z as (select c_custkey, 'P<UZB' || upper(c_mktsegment) one, lpad(c_custkey::varchar, 9, '0') two from customer), e as (select c_custkey, 0 pos, one x from z union all select c_custkey, 1, two from z), a as (select c_custkey, 0 pos, case when c_custkey % 3 = 0 then replace(one, 'B', '8') else one end x from z union all select c_custkey, 1, two from z where c_custkey % 5 <> 0)
select c_custkey, count(*) lines, count(*) filter (where e.x = coalesce(a.x, '')) line_exact, sum(length(e.x))::bigint character_total, sum(length(e.x) - levenshtein(e.x, coalesce(a.x, '')))::bigint as characters from e left join a using (c_custkey, pos) group by 1""")
def zone_line_pairs(s, d):
    z = t(s, d, "customer").select("c_custkey", F.concat(F.lit("P<UZB"), F.upper("c_mktsegment")).alias("one"), F.lpad(col("c_custkey").cast(S), 9, "0").alias("two"))
    lines = lambda *x: z.select("c_custkey", F.posexplode(F.array(*x)).alias("position", "text")).where("text is not null")
    return scoring.line_pairs(lines("one", "two"), lines(F.when(col("c_custkey") % 3 == 0, F.regexp_replace("one", "B", "8")).otherwise(col("one")), F.when(col("c_custkey") % 5 != 0, col("two"))), "c_custkey")


@query("""with v as (select l_returnflag, l_linenumber, case when l_quantity < 35 then 'match' else 'mismatch' end status from lineitem) select l_returnflag, l_linenumber, count(*) fields, count(*) filter (where status <> 'match') failures, round(count(*) filter (where status <> 'match') / count(*)::double, 6) failure_rate from v group by 1, 2 having count(*) filter (where status <> 'match') > 0""")
def failure_concentration(s, d):
    r = scoring.failure_concentration(_verdicts(s, d), "l_returnflag", "l_linenumber")
    return r.select("l_returnflag", "l_linenumber", "fields", "failures", rnd(col("failure_rate")).alias("failure_rate"))


# ---- identity documents ----


@query("""select o_orderkey, 'REGION ' || o_custkey place, strftime(o_orderdate, '%d.%m.%Y') date from orders where o_orderkey % 4 <> 0 union all select o_orderkey, 'REGION ' || o_custkey || ' 31', null from orders where o_orderkey % 4 = 0""")
def birth_lines(s, d):
    v = F.when(col("o_orderkey") % 4 == 0, F.concat(F.lit("REGION "), col("o_custkey").cast(S), F.lit(" 31"))).otherwise(F.concat(F.lit("REGION "), col("o_custkey").cast(S), F.lit("  "), F.date_format("o_orderdate", "dd.MM.yyyy")))
    place, date = identity.birth_line(v)
    return t(s, d, "orders").select("o_orderkey", place.alias("place"), date.alias("date"))


@query("""select c_custkey doc_id, upper(c_mktsegment) surname, 'ANNA ' || c_nationkey given_names, 'REGION ' || c_nationkey birth_place, case when c_custkey % 2 = 0 then '01.02.1990' else '03.04.1991' end birth_date, case when c_custkey % 3 <> 0 then 'AA' || c_custkey end license_number from customer""")
def licence_records(s, d):
    """Tokens of five boxes; the date stands in its own box or on the birth line, and one token is in two boxes."""
    k = col("c_custkey")
    n = col("c_nationkey").cast(S)
    token = lambda box, pos, num, text, x: F.struct(F.lit(box).alias("box"), F.lit(pos).alias("box_pos"), F.lit(num).alias("token"), text.alias("text"), F.lit(1.0).alias("center_y"), F.lit(x).alias("x1"))
    rows = F.array(
        token("surname", 0, 1, F.upper("c_mktsegment"), 1.0), token("name", 1, 3, n, 9.0), token("name", 1, 2, F.lit("ANNA"), 2.0), token("place_of_birth", 2, 4, F.lit("REGION"), 1.0), token("place_of_birth", 2, 5, n, 2.0),
        token("place_of_birth", 2, 6, F.when(k % 2 == 1, "03.04.1991"), 3.0), token("date_of_birth", 3, 7, F.when(k % 2 == 0, "01.02.1990"), 1.0), token("surname", 4, 2, F.lit("ANNA"), 0.0), token("id_number_2", 5, 8, F.when(k % 3 != 0, F.concat(F.lit("AA"), k.cast(S))), 1.0),
    )
    x = t(s, d, "customer").select(k.alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")
    return identity.licence_records(x).select("doc_id", "surname", "given_names", "birth_place", "birth_date", "license_number")


@query("""select o_orderkey doc_id, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'warning' else 'passed' end status, concat_ws(', ', case when o_orderkey % 5 = 0 then 'surname' end, case when o_orderkey % 7 = 0 then 'number' end) missing from orders""")
def required_fields(s, d):
    k = col("o_orderkey")
    f = F.array(F.struct(F.lit("surname").alias("field"), F.when(k % 5 != 0, "X").alias("value")), F.struct(F.lit("number").alias("field"), F.when(k % 7 != 0, "1").otherwise("").alias("value")), F.struct(F.lit("sex").alias("field"), F.lit(None).cast(S).alias("value")))
    x = t(s, d, "orders").select(k.alias("doc_id"), F.lit("passport").alias("document_type"), F.explode(f).alias("f")).select("doc_id", "document_type", "f.*")
    profile = s.createDataFrame([("passport", "surname", 0, True), ("passport", "number", 1, True), ("passport", "sex", 2, False)], "document_type string, field string, field_pos int, required boolean")
    return identity.required(x, profile)


@query("""select l_orderkey, case when count(*) filter (where l_linenumber = 4) = 0 then min(l_discount)::double end confidence from lineitem group by 1""")
def document_confidence(s, d):
    x = t(s, d, "lineitem").select("l_orderkey", F.when(col("l_linenumber") != 4, col("l_discount").cast(D)).alias("confidence"))
    return identity.document_confidence(x, "l_orderkey")


@query("""select page_id // 2 doc_id, case when count(*) filter (where seen is not null) = 2 and count(*) filter (where seen <> side) = 2 then 'swapped' when count(*) filter (where seen <> side) > 0 then 'one side differs' when count(*) filter (where seen is not null) < 2 then 'not seen' else 'passed' end status from (select page_id, case when page_id % 2 = 0 then 'front' else 'back' end side, case when length(url) % 3 = 0 then 'front' when length(url) % 3 = 1 then 'back' end seen from pages) group by 1""")
def swapped_sides(s, d):
    n = F.length("url") % 3
    x = t(s, d, "pages").select(F.floor(col("page_id") / 2).alias("doc_id"), F.when(col("page_id") % 2 == 0, "front").otherwise("back").alias("side"), F.when(n == 0, "front").when(n == 1, "back").alias("seen"))
    return identity.swapped_sides(x)


@query("""select distinct 'no region' issue, p_brand document_type, p_type field from part where p_size > 45 and (p_brand, p_type) not in (select (p_brand, p_type) from part where p_size <= 45) union all select distinct 'no field', p_brand, p_type from part where p_size <= 45 and (p_brand, p_type) not in (select (p_brand, p_type) from part where p_size > 45) union all select 'repeated field', p_brand, p_type from part where p_size > 45 group by 2, 3 having count(*) > 1""")
def profile_issues(s, d):
    p = t(s, d, "part").select(col("p_brand").alias("document_type"), col("p_type").alias("field"), "p_size")
    box = {"x1": F.lit(0.1), "y1": F.lit(0.1), "x2": F.lit(0.5), "y2": F.lit(0.4)}
    return identity.profile_issues(p.where("p_size > 45").drop("p_size"), p.where("p_size <= 45").select("document_type", "field").distinct().withColumns(box))


# ---- stages, sweeps, gates ----

_CALLS = "select event_type stage, case when user_id % 3 = 0 then 'mrz' else 'visible' end as role, (1 + event_id % 4)::int a, (1 + event_id % 7)::int b, (event_id % 11 = 0)::int failed, value from events"


@query(f"""select stage, role, count(*) calls, (2 * count(*))::bigint tensor_batches, sum(a + b)::bigint submitted, max(greatest(a, b))::bigint largest_batch, sum(failed)::bigint failures, round(sum(value), 4) model_seconds, round(sum(case when failed = 1 then value else value * 2 end), 4) wall_seconds from ({_CALLS}) group by 1, 2""")
def stage_totals(s, d):
    k, v = col("event_id"), col("value")
    a, b = (1 + k % 4).cast("int"), (1 + k % 7).cast("int")
    x = t(s, d, "events").select(col("event_type").alias("stage"), F.when(col("user_id") % 3 == 0, "mrz").otherwise("visible").alias("role"), F.array(a, b).alias("tensor_batch_sizes"), (a + b).alias("submitted_batch_size"), (k % 11 == 0).cast("int").alias("failure_count"), v.alias("model_seconds"), F.when(k % 11 != 0, v * 2).alias("wall_seconds"))
    r = runs.stage_totals(x, "stage", "role")
    return r.select(*r.columns[:-2], F.round("model_seconds", 4).alias("model_seconds"), F.round("wall_seconds", 4).alias("wall_seconds"))


@query("""select lang, count(*) n, round(min(n_chars / 48.0), 6)::double low, round(max(n_chars / 48.0), 6)::double high, round(avg(n_chars / 48.0), 6)::double mean, round(sum(n_chars / 48.0) / (max(n_chars / 48.0) * count(*)), 6)::double efficiency from documents group by lang""")
def shape_stats(s, d):
    r = runs.shape_stats(t(s, d, "documents"), col("n_chars") / 48.0, "lang")
    return r.select("lang", "n", *(rnd(col(c)).alias(c) for c in r.columns[2:]))


@query("""select 'user ' || (user_id % 5) grp, count(*) total, count(*) filter (where event_type <> 'error') succeeded, count(*) filter (where event_type = 'error') failed from events group by 1""")
def batch_counts(s, d):
    x = t(s, d, "events").select(F.concat(F.lit("user "), (col("user_id") % 5).cast(S)).alias("grp"), F.when(col("event_type") == "error", "failed").alias("error"))
    c = runs.batch_counts(x, "grp")
    return c.join(runs.broken_counts(c).select("grp"), "grp", "left_anti")


@query("""with l as (select * from (values ('en', 500::bigint), ('de', 2000), ('xx', 5)) v(lang, lim)) select l.lang, lim "limit", case when count(n_chars) > 0 then count(*) filter (where n_chars < lim) end below, case when count(n_chars) > 0 then count(*) filter (where n_chars = lim) end "at", case when count(n_chars) > 0 then count(*) filter (where n_chars > lim) end above, round(case when count(n_chars) > 0 then count(*) filter (where n_chars > lim) / count(n_chars)::double end, 6) binding_rate, count(n_chars) > 0 applicable from l left join documents d using (lang) group by 1, 2""")
def cap_rows(s, d):
    r = runs.cap_rows(t(s, d, "documents").select("lang", "n_chars"), "n_chars", s.createDataFrame([("en", 500), ("de", 2000), ("xx", 5)], "lang string, limit long"), "lang")
    return r.select("lang", "limit", "below", "at", "above", rnd(col("binding_rate")).alias("binding_rate"), "applicable")


@query("""select event_type, count(*) runs, round(median(value), 6) median_value, round(quantile_cont(value, 0.9), 6) p90_value, round(quantile_cont(value, 0.95), 6) p95_value, round(coalesce(stddev_samp(value), 0), 4) stdev_value, round(avg(value), 6) mean_value, sum(user_id)::bigint total_user_id, max(value) max_value, min(value) min_value, bool_and(value > 1) all_high, bool_or(value > 100) any_peak from (select *, value > 1 high, value > 100 peak from events) group by 1""")
def sweep_summary(s, d):
    x = t(s, d, "events").withColumns({"high": col("value") > 1, "peak": col("value") > 100})
    r = runs.sweep(x, ["event_type"], medians=("value",), p90=("value",), p95=("value",), stdev=("value",), means=("value",), totals=("user_id",), most=("value",), least=("value",), every=("high",), some=("peak",))
    return r.select("event_type", "runs", *(rnd(col(c)).alias(c) for c in ("median_value", "p90_value", "p95_value", "mean_value")), F.round("stdev_value", 4).alias("stdev_value"), "total_user_id", "max_value", "min_value", "all_high", "any_peak")


@query("""with m as (select event_type, user_id % 4 cfg, median(value) v from events group by 1, 2), b as (select event_type, v from m where cfg = 0 and event_type <> 'view'), f as (select v from b order by event_type limit 1) select m.event_type, m.cfg, round(coalesce(b.v, (select v from f)) / m.v, 6) ratio from m left join b using (event_type)""")
def ratio_with_fallback(s, d):
    m = ranking.quantiles(t(s, d, "events").withColumn("cfg", col("user_id") % 4), ["event_type", "cfg"], {"v": ("value", 0.5)})
    r = runs.against_baseline(m, m.where("cfg = 0 and event_type <> 'view'"), "event_type", "v")
    return r.select("event_type", "cfg", rnd(col("ratio")).alias("ratio"))


@query("""select o.o_orderkey, coalesce(x.checks, 0)::bigint checks, round(coalesce(x.quantity, 0), 4)::double quantity from orders o left join (select l_orderkey, count(*) checks, sum(l_quantity) quantity from lineitem where l_linenumber > 2 group by 1) x on x.l_orderkey = o.o_orderkey""")
def rows_with_totals(s, d):
    facts = t(s, d, "lineitem").where("l_linenumber > 2").select(col("l_orderkey").alias("o_orderkey"), "l_quantity")
    r = runs.with_totals(t(s, d, "orders").select("o_orderkey"), facts, ["o_orderkey"], F.count("*").alias("checks"), F.sum("l_quantity").alias("quantity"))
    return r.select("o_orderkey", "checks", F.round(col("quantity").cast(D), 4).alias("quantity"))


@query("""with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i from conversations where role = 'user'), q as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i from conversations where role <> 'user') select p.conv_id, p.turn asked, q.turn answered from p join q using (conv_id, i)""")
def paired_by_position(s, d):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("position")
    c = t(s, d, "conversations")
    return runs.by_position(c.where("role = 'user'").select("conv_id", col("turn").alias("asked"), n), c.where("role <> 'user'").select("conv_id", col("turn").alias("answered"), n), ["conv_id"]).drop("position")


_GATE = "select p_brand, p_size::double target, count(*) exact, count(*) filter (where p_retailprice < 950) missing, avg(p_retailprice) accuracy, 0 failures from part group by 1, 2"


def _gate(s, d):
    g = t(s, d, "part").groupBy("p_brand", col("p_size").cast(D).alias("target")).agg(F.count("*").alias("exact"), F.count_if(col("p_retailprice") < 950).alias("missing"), F.avg("p_retailprice").alias("accuracy"), F.lit(0).alias("failures"))
    top = g.groupBy("p_brand").agg(F.max_by(F.struct("exact", "missing", "accuracy"), "target").alias("x")).select("p_brand", "x.*")
    return runs.clean(g, top, "p_brand", no_more=("missing",), no_less=("exact", "accuracy"))


_CLEAN = f"with g as ({_GATE}), t as (select p_brand, arg_max(exact, target) e, arg_max(missing, target) m, arg_max(accuracy, target) a from g group by 1), c as (select g.*, missing <= m and exact >= e and accuracy >= a - 1e-12 and failures = 0 clean from g join t using (p_brand))"


@query(_CLEAN + " select p_brand, target, clean from c")
def clean_gate(s, d):
    return _gate(s, d).select("p_brand", "target", "clean")


@query(_CLEAN + ", b as (select p_brand, max(target) filter (where not clean) bad from c group by 1) select p_brand, min(target) filter (where bad is null or target > bad) good, any_value(bad) bad from c join b using (p_brand) group by 1")
def gate_boundary(s, d):
    return runs.boundary(_gate(s, d), "p_brand", "target").select("p_brand", "good", "bad")


@query("""select lang, count(*) n, round(avg((n_chars > 100)::int), 6) found_rate, round(avg((doc_id % 2 = 0)::int), 6) exact_rate, round(count(*) filter (where valid) / count(*)::double, 6) coverage, round(count(*) filter (where valid and doc_id % 2 = 0) / (count(*) filter (where valid))::double, 6) "precision", round(count(*) filter (where valid and doc_id % 2 = 1) / count(*)::double, 6) wrong_accept_rate, round(avg(n_chars), 6) mean_seconds, round(median(n_chars), 6) median_seconds, round(quantile_cont(n_chars, 0.95), 6) p95_seconds from (select *, case when doc_id % 5 <> 0 then doc_id % 3 <> 0 end valid from documents) group by lang""")
def check_gate(s, d):
    k = col("doc_id")
    x = t(s, d, "documents").select("lang", (col("n_chars") > 100).alias("found"), (k % 2 == 0).alias("exact"), F.when(k % 5 != 0, k % 3 != 0).alias("valid"), col("n_chars").cast(D).alias("seconds"))
    r = runs.gate_quality(x, "lang")
    return r.select("lang", "n", *(rnd(col(c)).alias(c) for c in r.columns[2:]))


@query("""select p_brand, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by p_partkey desc) n from part) where n = 1""")
def distinct_signatures(s, d):
    return runs.first_of_signature(t(s, d, "part"), ["p_brand"], "p_type", "p_partkey").select("p_brand", "p_partkey")


@query("""with a as (select p_partkey k, p_brand v from part where p_partkey % 9 <> 0), b as (select p_partkey k, case when p_partkey % 4 = 0 then p_type else p_brand end v from part where p_partkey % 8 <> 1) select coalesce(a.k, b.k)::varchar setting, a.v previous, b.v now, case when a.v is not distinct from b.v then 'same' when coalesce(a.k, b.k) % 20 = 0 then 'known' when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end classification from a full join b on a.k = b.k""")
def settings_difference(s, d):
    p, k = t(s, d, "part"), col("p_partkey")
    old = p.where(k % 9 != 0).select(k.cast(S).alias("setting"), col("p_brand").alias("value"))
    new = p.where(k % 8 != 1).select(k.cast(S).alias("setting"), F.when(k % 4 == 0, col("p_type")).otherwise(col("p_brand")).alias("value"))
    return runs.settings_difference(old, new, p.where(k % 20 == 0).select(k.cast(S).alias("setting")))


@query("""select o_custkey, count(*) steps, count(*) filter (where o_orderstatus = 'F') done, arg_min(o_orderkey, o_orderkey) filter (where o_orderstatus <> 'F')::varchar next_step from orders group by 1""")
def annotation_progress(s, d):
    x = t(s, d, "orders").select("o_custkey", col("o_orderkey").alias("position"), col("o_orderkey").cast(S).alias("step"), (col("o_orderstatus") == "F").alias("done"))
    return runs.progress(x, "o_custkey")


@query("""select p_partkey, issue from (select p_partkey, case when st not in ('value', 'empty', 'unreadable') then 'unknown state' when st = 'value' and v = '' then 'value without text' when st <> 'value' and v <> '' then 'text without value' end issue from (select p_partkey, list_extract(['value', 'empty', 'unreadable', 'odd'], (p_partkey % 4 + 1)::int) st, case when p_partkey % 3 = 0 then '' else p_name end v from part)) where issue is not null""")
def bad_states(s, d):
    k = col("p_partkey")
    x = t(s, d, "part").select("p_partkey", F.array(*map(F.lit, ("value", "empty", "unreadable", "odd")))[(k % 4).cast("int")].alias("state"), F.when(k % 3 != 0, col("p_name")).alias("value"))
    return runs.bad_states(x).select("p_partkey", "issue")


@query("""select l_orderkey, n::bigint n, pos::bigint pos, ((pos - l_orderkey) % n + n) % n as turn from (select l_orderkey, count(*) over (partition by l_orderkey) n, row_number() over (partition by l_orderkey order by l_linenumber) - 1 pos from (select distinct l_orderkey, l_linenumber from lineitem)) where n = 3""")
def rotated_order(s, d):
    w = W.partitionBy("l_orderkey")
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("l_linenumber")) - 1).cast(L).alias("pos")).where("n = 3")
    return runs.rotated(x, "pos", 3, col("l_orderkey"))


@query("""select user_id, event_type, (case when user_id % 2 = 1 then row_number() over (partition by user_id order by event_type desc) else row_number() over (partition by user_id order by event_type) end)::bigint turn from (select distinct user_id, event_type from events)""")
def alternating_order(s, d):
    x = t(s, d, "events").select("user_id", "event_type").distinct().withColumn("number", col("user_id"))
    return runs.alternating(x, "user_id", "number", "event_type").select("user_id", "event_type", col("turn").cast(L).alias("turn"))


@query("""select lang, case when doc_id % 6 = 0 then 'false accept' when doc_id % 3 = 0 then 'fallback' when doc_id % 2 = 0 then 'correct' else 'unclassified' end state, count(*) n from documents group by 1, 2""")
def fallback_states(s, d):
    k = col("doc_id")
    return t(s, d, "documents").groupBy("lang", runs.fallback_state(k % 6 == 0, k % 3 == 0, k % 2 == 0).alias("state")).agg(F.count("*").alias("n"))


@query("""select count(*) configurations, sum((2 + p_size) * (p_partkey % 5) * 3)::bigint requests from part""")
def workload_estimate(s, d):
    return runs.workload(t(s, d, "part").select(F.lit(2).alias("warmups"), col("p_size").alias("repeats"), (col("p_partkey") % 5).alias("documents"), F.lit(3).alias("concurrency")))


@query("""select p_partkey, greatest(floor(p_size * 20 / 32.0 + 0.5) * 32, 32)::bigint side, round(sqrt(p_size / 100.0), 6) scale from part""")
def aligned_sides(s, d):
    return t(s, d, "part").select("p_partkey", runs.aligned(col("p_size") * 20).alias("side"), rnd(runs.pixel_scale(col("p_size"))).alias("scale"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) n, round(least(greatest(least(x, y), 0), 1), 6)::double x1, round(least(greatest(greatest(x, y), 0), 1), 6)::double x2 from (select *, l_quantity / 40.0 x, l_discount * 10 y from lineitem) group by all""")
def unit_boxes(s, d):
    b = layout.unit_box(col("l_quantity"), F.lit(0), col("l_discount") * 400, F.lit(1), F.lit(40.0), F.lit(1.0))
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd(b["x1"]).alias("x1"), rnd(b["x2"]).alias("x2"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))
