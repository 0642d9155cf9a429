"""Registered queries of the verification and evaluation operators, each beside its SQL.

The tables are generic, so each query derives its operator's input (lines, tokens
with boxes, verdicts, measured runs) from whole tables, the same way on both sides.
Rounded to six places where sums of doubles meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import mrz, stats
from attestra.functions import text as tx
from attestra.functions.similarity import scored_pairs
from attestra.operators import evaluation as ev
from attestra.operators import layout, line_matcher, matcher, packing, ranking, runs, zones
from attestra.operators.tasks import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


L, D, S = "long", "double", "string"
col = F.col


def rnd(c):
    return F.round(c, 6).cast(D)


# ---- lines, tokens, normal forms ----


@query("""select doc_id, (i - 1)::bigint line_pos, x as text from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents) where trim(x) <> ''""")
def ocr_lines(s, d):
    return layout.text_lines(t(s, d, "documents")).select("doc_id", col("line_pos").cast(L).alias("line_pos"), "text")


@query("""with k as (select item_id, regexp_replace(trim(regexp_replace(text, '[^a-z ]+', ' ', 'g')), ' +', ' ', 'g') x from benchmark), w as (select item_id, x, string_split(x, ' ') w, unnest(range(1, len(string_split(x, ' ')) + 1)) i from k where x <> ''), s as (select item_id, x, w, i, unnest(range(i, least(i + 5, len(w)) + 1)) j from w),
r as (select item_id, array_to_string(w[i:j], ' ') span, case when i = 1 then 0 else length(array_to_string(w[1:i-1], ' ')) + 1 end a from s) select item_id::varchar doc_id, span as "text", a::bigint a, (a + length(span))::bigint b from r union all select item_id::varchar, x, 0::bigint, length(x)::bigint from k where x <> ''""")
def token_spans(s, d):
    """The matcher's candidates inside one line: the whole of it and every span of one to six words."""
    x = F.trim(F.regexp_replace(F.trim(F.regexp_replace("text", "[^a-z ]+", " ")), " +", " "))
    lines = t(s, d, "benchmark").select(col("item_id").alias("doc_id"), F.lit(0).alias("line_pos"), x.alias("text"), F.lit(1.0).alias("confidence"))
    r = col("resources")[0]
    return matcher.span_candidates(lines).select("doc_id", "text", r["a"].cast(L).alias("a"), r["b"].cast(L).alias("b"))


@query("""select o_orderkey, o_orderdate::date::varchar dotted, o_orderdate::date::varchar iso, strftime(o_orderdate, '20%y-%m-%d') short, '3102' || strftime(o_orderdate, '%Y') invalid from orders""")
def date_spans(s, d):
    x = col("o_orderdate")
    f = lambda p: F.date_format(x, p)
    return t(s, d, "orders").select("o_orderkey", tx.normal_date(F.concat(F.lit("4a. "), f("dd.MM.yyyy"))).alias("dotted"), tx.normal_date(f("yyyy-MM-dd")).alias("iso"), tx.normal_date(f("ddMMyy")).alias("short"), tx.normal_date(F.concat(F.lit("31.02."), f("yyyy"))).alias("invalid"))


@query("select c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) ident from customer")
def identifier_norm(s, d):
    return t(s, d, "customer").select("c_custkey", tx.normal_compact(col("c_name")).alias("ident"))


@query("select p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) norm from part")
def name_norm(s, d):
    return t(s, d, "part").select("p_partkey", tx.normal_compact(col("p_name")).alias("norm"))


@query("select o_orderkey, upper(trim(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))) norm from orders")
def text_norm(s, d):
    return t(s, d, "orders").select("o_orderkey", tx.normal_text(col("o_orderpriority")).alias("norm"))


_NAMES = ("Birth_Date", "residence", "authority", "remark", "family", "expires", "note", "sex", "holder", "pinfl")
_KIND_SQL = "select p_partkey, list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + "], (p_partkey % 10 + 1)::int) field, case when p_partkey % 3 = 0 then p_name when p_partkey % 7 = 0 then '19.10.' || (2000 + p_size) when p_partkey % 11 = 0 then (10000000 + p_partkey)::varchar when p_partkey % 5 = 0 then p_partkey || ' ' || p_size else p_brand end as value from part"


@query(f"""select p_partkey, case when lower(field) in ('birth_date','issue_date','expiry_date','date_of_birth','date_of_issue','date_of_expiry') then 'date' when lower(field) = 'pinfl' then 'identifier' when lower(field) in ('authority','address','sex') then 'text'
when regexp_matches(field, '(?i)date|birth|expiry|expire|issue') then 'date' when regexp_matches(field, '(?i)number|num|passport|document|card|license|licence|pin|personal|serial|id') then 'identifier' when regexp_matches(field, '(?i)name|surname|family|given|patronymic') then 'name'
when regexp_full_match(value, '\\d{{1,4}}[./, -]\\d{{1,2}}[./, -]\\d{{1,4}}|\\d{{6,8}}') then 'date' when length(regexp_replace(value, '[^0-9]', '', 'g')) >= 2 and regexp_matches(value, '[A-Za-z]') then 'identifier' else 'text' end kind
from ({_KIND_SQL})""")
def field_kind(s, d):
    k = col("p_partkey")
    value = F.when(k % 3 == 0, col("p_name")).when(k % 7 == 0, F.concat(F.lit("19.10."), (2000 + col("p_size")).cast(S))).when(k % 11 == 0, (10000000 + k).cast(S)).when(k % 5 == 0, F.concat_ws(" ", k.cast(S), col("p_size").cast(S))).otherwise(col("p_brand"))
    return t(s, d, "part").select("p_partkey", tx.field_kind(F.array(*map(F.lit, _NAMES))[(k % 10).cast("int")], value).alias("kind"))


@query("""select p_partkey, case when b = '' then v else b end bare from (select p_partkey, v, case when regexp_matches(v, '(?i)^\\s*(\\d+[A-Z]|[A-Z]\\d*)[.)](\\s|\\d|[A-Z])') then regexp_replace(v, '(?i)^\\s*(\\d+[A-Z]|[A-Z]\\d*)[.)]\\s*', '') when regexp_matches(v, '(?i)^\\s*\\d+[.)](\\s|[A-Z])') then regexp_replace(v, '^\\s*\\d+[.)]\\s*', '') else v end b
from (select p_partkey, case p_partkey % 6 when 0 then p_size || '. ' || p_name when 1 then '19.10.' || (2000 + p_size) when 2 then '4a. ' || p_size || '.12.2017' when 3 then '5.' || p_brand when 4 then '8. ' else p_name end v from part) t)""")
def label_strip(s, d):
    k, n = col("p_partkey") % 6, col("p_size").cast(S)
    v = F.when(k == 0, F.concat(n, F.lit(". "), "p_name")).when(k == 1, F.concat(F.lit("19.10."), (2000 + col("p_size")).cast(S))).when(k == 2, F.concat(F.lit("4a. "), n, F.lit(".12.2017"))).when(k == 3, F.concat(F.lit("5."), "p_brand")).when(k == 4, "8. ").otherwise(col("p_name"))
    return t(s, d, "part").select("p_partkey", tx.strip_label(v).alias("bare"))


# ---- machine-readable zones ----


@query("""with v as (select c_custkey, upper(substr(c_mktsegment, 1, 3)) || lpad(c_custkey::varchar, 6, '0') || '<' z from customer)
select c_custkey, z as zone, (list_sum(list_transform(range(1, 11), lambda i: (case when substr(z, i, 1) between '0' and '9' then ascii(substr(z, i, 1)) - 48 when substr(z, i, 1) between 'A' and 'Z' then ascii(substr(z, i, 1)) - 55 else 0 end) * [7, 3, 1][((i - 1) % 3 + 1)::int])) % 10)::bigint::varchar digit from v""")
def mrz_check_digit(s, d):
    z = F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lpad(col("c_custkey").cast(S), 6, "0"), F.lit("<"))
    return t(s, d, "customer").select("c_custkey", z.alias("zone"), mrz.check_digit(z).alias("digit"))


def _td3(s, d) -> DataFrame:
    """Passport zones made of customers; every seventh has a wrong birth date digit."""
    num, birth, expiry, opt = F.lpad(col("c_custkey").cast(S), 9, "0"), F.lpad((col("c_custkey") % 1000000).cast(S), 6, "0"), F.lit("301231"), F.rpad(F.lit("X1"), 14, "<")
    first = F.rpad(F.concat(F.lit("P<UZB"), F.upper(F.col("c_mktsegment")), F.lit("<<NAME<"), F.translate(col("c_nationkey").cast(S), "0123456789", "ABCDEFGHIJ")), 44, "<")
    cd = mrz.check_digit
    a, b, c, e = F.concat(num, cd(num)), F.concat(birth, cd(birth)), F.concat(expiry, cd(expiry)), F.concat(opt, cd(opt))
    second = F.concat(a, F.lit("UZB"), b, F.lit("M"), c, e, cd(F.concat(a, b, c, e)))
    wrong = F.concat(a, F.lit("UZB"), birth, ((cd(birth).cast("int") + 1) % 10).cast(S), F.lit("M"), c, e, cd(F.concat(a, b, c, e)))
    lines = F.when(col("c_custkey") % 7 == 0, F.array(first, wrong)).otherwise(F.array(first, second))
    return spread(t(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")).select("c_custkey", F.explode(F.array(lines)).alias("z")).select("c_custkey", col("z")[0].alias("l1"), col("z")[1].alias("l2"))


@query("""select c_custkey, upper(c_mktsegment) surname, 'NAME ' || translate(c_nationkey::varchar, '0123456789', 'ABCDEFGHIJ') given_names, lpad(c_custkey::varchar, 9, '0') document_number, lpad((c_custkey % 1000000)::varchar, 6, '0') date_of_birth, 'M' sex, 'X1' optional_data, c_custkey % 7 <> 0 valid from customer""")
def mrz_td3_parse(s, d):
    fields, checks = mrz.td3(col("l1"), col("l2"))
    return _td3(s, d).select("c_custkey", *(fields[k].alias(k) for k in ("surname", "given_names", "document_number", "date_of_birth", "sex", "optional_data")), mrz.all_passed(checks).alias("valid"))


@query("""select p_partkey, case when p_partkey % 4 <> 3 then p_partkey % 5 <> 0 end valid from part""")
def mrz_digits_valid(s, d):
    """Zones of the three shapes and of none; in every fifth the document number's last digit is another one."""
    k, fill, cd = col("p_partkey"), lambda n: F.lit("<" * n), mrz.check_digit
    df = t(s, d, "part").select("p_partkey", F.lpad(k.cast(S), 9, "0").alias("num"))
    num, wrong = F.concat("num", cd(col("num"))), F.concat(F.substring("num", 1, 8), ((F.substring("num", 9, 1).cast("int") + 1) % 10).cast(S), cd(col("num")))
    seen = F.when(k % 5 == 0, wrong).otherwise(num)
    b, x = (F.concat(F.lit(v), cd(F.lit(v))) for v in ("740301", "340327"))
    td3 = F.array(F.rpad(F.lit("P<UZBPART<<A"), 44, "<"), F.concat(seen, F.lit("UZB"), b, F.lit("F"), x, fill(15), cd(F.concat(num, b, x, fill(15)))))
    td2 = F.array(F.rpad(F.lit("I<UZBPART<<A"), 36, "<"), F.concat(seen, F.lit("UZB"), b, F.lit("F"), x, fill(7), cd(F.concat(num, b, x, fill(7)))))
    td1 = F.array(F.concat(F.lit("I<UZB"), seen, fill(15)), F.concat(b, F.lit("F"), x, F.lit("UZB"), fill(11), cd(F.concat(num, fill(15), b, x, fill(11)))), F.rpad(F.lit("PART<<A"), 30, "<"))
    df = df.select("p_partkey", F.when(k % 4 == 0, td3).when(k % 4 == 1, td2).when(k % 4 == 2, td1).otherwise(F.array(F.lit("UZB"))).alias("z"))
    return df.select("p_partkey", mrz.digits_valid(col("z")).alias("valid"))


@query("""select s_suppkey, lpad(s_suppkey::varchar, 9, '0') document_number, lpad((s_suppkey * 7)::varchar, 14, '0') pinfl, '7403' || lpad((1 + s_suppkey % 28)::varchar, 2, '0') date_of_birth, lpad((1 + s_suppkey % 28)::varchar, 2, '0') || '.03.1974' birth_full, 'SUPPLIER' surname, true valid from supplier""")
def mrz_td1_parse(s, d):
    num, opt, birth, expiry = F.lpad(col("s_suppkey").cast(S), 9, "0"), F.rpad(F.lpad((col("s_suppkey") * 7).cast(S), 14, "0"), 15, "<"), F.concat(F.lit("7403"), F.lpad((1 + col("s_suppkey") % 28).cast(S), 2, "0")), F.lit("340327")
    cd = mrz.check_digit
    first = F.concat(F.lit("I<UZB"), num, cd(num), opt)
    b, e, rest = F.concat(birth, cd(birth)), F.concat(expiry, cd(expiry)), F.lit("UZB" + "<" * 11)
    whole = F.concat(F.substring(first, 6, 25), b, e, F.lit("<" * 11))
    second = F.concat(b, F.lit("F"), e, rest, cd(whole))
    one = F.concat(first, second, F.rpad(F.lit("SUPPLIER<<A"), 30, "<"))  # a single line that is cut up again
    df = t(s, d, "supplier").select("s_suppkey", mrz.resplit(F.array(mrz.fragment(one)), 30, 3).alias("z"))
    fields, checks = mrz.td1(col("z")[0], col("z")[1], col("z")[2])
    return df.select("s_suppkey", fields["document_number"].alias("document_number"), fields["pinfl"].alias("pinfl"), fields["date_of_birth"].alias("date_of_birth"), mrz.full_date(fields["date_of_birth"]).alias("birth_full"), fields["surname"].alias("surname"), mrz.all_passed(checks).alias("valid"))


@query("""select p as position, count(*) zones, 0::bigint passed from customer, (values (9::bigint), (19), (27), (42), (43)) v(p) where c_custkey % 7 <> 0 group by p""")
def mrz_mutation_audit(s, d):
    z = _td3(s, d).where(col("c_custkey") % 7 != 0).select("l1", "l2", F.explode(F.array(*(F.lit(p) for p in (9, 19, 27, 42, 43)))).alias("p"))
    c = F.substr("l2", col("p") + 1, F.lit(1))
    z = z.withColumn("l2", F.concat(F.substr("l2", F.lit(1), col("p")), F.when(c == "9", "0").otherwise((F.ascii(c) - 48 + 1).cast(S)), F.substr("l2", col("p") + 2)))
    return z.groupBy(col("p").cast(L).alias("position")).agg(F.count("*").alias("zones"), F.count_if(mrz.all_passed(mrz.td3(col("l1"), col("l2"))[1])).alias("passed"))


@query("""with v as (select c_custkey, case when c_custkey % 10 = 0 then 'WRONG' else c_mktsegment end surname, case when c_custkey % 4 = 0 then null else 'Ayol' end sex, c_mktsegment, strftime(date '1974-03-11', '%d.%m.%Y') birth from customer)
select c_custkey, case when upper(surname) = upper(c_mktsegment) then 'passed' else 'failed' end surname_status, case when sex is null then 'not_run' else 'passed' end sex_status, 'passed' birth_status from v""")
def reconcile_visible_mrz(s, d):
    c = t(s, d, "customer").select("c_custkey", F.when(col("c_custkey") % 10 == 0, "WRONG").otherwise(col("c_mktsegment")).alias("surname"), F.when(col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.lit("Ayol")).alias("sex"), F.upper("c_mktsegment").alias("z_surname"))
    r = lambda v, z, f, g: mrz.reconciled(v, z, F.lit(f), F.lit(g))
    return c.select("c_custkey", r(col("surname"), col("z_surname"), "surname", "surname").alias("surname_status"), r(col("sex"), F.lit("F"), "sex", "sex").alias("sex_status"), r(F.lit("11.03.1974"), F.lit("740311"), "date_of_birth", "date_of_birth").alias("birth_status"))


# ---- layout ----

_ROIS = [("name", 0, 0.0, 0.0, 0.5, 0.5), ("date", 1, 0.25, 0.25, 0.75, 0.75), ("number", 2, 0.5, 0.0, 1.0, 1.0)]
_ROI_SQL = "(values ('name', 0, 0, 0, 50, 50), ('date', 1, 25, 25, 75, 75), ('number', 2, 50, 0, 100, 100)) r(field, pos, x1, y1, x2, y2)"
_TOKENS_SQL = "select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::double x1, (l_discount * 1000)::bigint::double y1, l_quantity + 10.0 x2, (l_discount * 1000)::bigint + 8.0 y2 from lineitem"


def _tokens(s, d) -> DataFrame:
    y = F.round(col("l_discount") * 1000).cast(L).cast(D)
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", col("l_quantity").cast(D).alias("x1"), y.alias("y1"), (col("l_quantity") + 10.0).alias("x2"), (y + 8.0).alias("y2")).distinct()


@query(f"""with k as ({_TOKENS_SQL}), a as (select k.*, r.field, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, k.x1, k.y1 order by r.pos) n from k left join {_ROI_SQL} on (k.x1 + k.x2) / 2 between r.x1 and r.x2 and (k.y1 + k.y2) / 2 between r.y1 and r.y2)
select coalesce(field, 'unassigned') field, count(*) tokens, round(sum(x1 + y1), 6) place from a where n = 1 group by 1""")
def roi_assign_first(s, d):
    got = layout.first_region(_tokens(s, d), _ROIS, 100, 100)
    return got.groupBy(F.coalesce("field", F.lit("unassigned")).alias("field")).agg(F.count("*").alias("tokens"), rnd(F.sum(col("x1") + col("y1"))).alias("place"))


@query(f"""with k as ({_TOKENS_SQL}), a as (select k.*, r.field, r.pos, greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1)) / ((k.x2 - k.x1) * (k.y2 - k.y1)) share from k, {_ROI_SQL}),
b as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, x1, y1 order by share desc, pos) n from a)
select field, count(*) tokens, round(sum(share), 6)::double share from b where n = 1 and share >= 0.4 group by field""")
def roi_assign_overlap(s, d):
    got = layout.best_overlap(_tokens(s, d), _ROIS, 100, 100, 0.4)
    return got.groupBy("field").agg(F.count("*").alias("tokens"), rnd(F.sum("share")).alias("share"))


@query(f"""with k as ({_TOKENS_SQL}) select l_orderkey, round(avg(case when l_linenumber % 5 = 0 then null else y1 / 100 end), 6)::double score, min(x1)::double x1, min(y1)::double y1, max(x2)::double x2, max(y2)::double y2 from k group by l_orderkey""")
def field_evidence(s, d):
    k = _tokens(s, d).withColumn("score", F.when(col("l_linenumber") % 5 == 0, F.lit(None)).otherwise(col("y1") / 100))
    e = layout.evidence(k, "l_orderkey")
    return e.select("l_orderkey", rnd(col("score")).alias("score"), "x1", "y1", "x2", "y2")


@query(f"""with k as ({_TOKENS_SQL}), o as (select *, lag(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) over (partition by l_orderkey order by y1, x1, l_linenumber, l_partkey, l_suppkey) p from k)
select count(*) pairs, count(*) filter (where y1 - p.y2 <= 3 * greatest(1, y2 - y1, p.y2 - p.y1) and (least(x2, p.x2) > greatest(x1, p.x1) or abs(x1 - p.x1) <= 0.35 * greatest(x2 - x1, p.x2 - p.x1, 1))) compatible from o where p is not null""")
def line_compatibility(s, d):
    w = W.partitionBy("l_orderkey").orderBy("y1", "x1", "l_linenumber", "l_partkey", "l_suppkey")
    k = _tokens(s, d).withColumn("b", F.struct("x1", "y1", "x2", "y2")).withColumn("p", F.lag("b").over(w)).where("p is not null")
    return k.agg(F.count("*").alias("pairs"), F.count_if(layout.compatible(col("p"), col("b"))).alias("compatible"))


# ---- verdicts, accuracy, differences ----

_VERDICT_SQL = "select *, case when l_quantity < 25 then 'match' when l_quantity < 35 then 'likely_match' when l_quantity < 45 then 'mismatch' else 'not_found' end status, case when l_discount < 0.05 then 'match' else 'mismatch' end other from lineitem"


def _verdicts(s, d) -> DataFrame:
    q = col("l_quantity")
    return t(s, d, "lineitem").withColumn("status", F.when(q < 25, "match").when(q < 35, "likely_match").when(q < 45, "mismatch").otherwise("not_found")).withColumn("other", F.when(col("l_discount") < 0.05, "match").otherwise("mismatch"))


@query(f"""select l_returnflag, count(*) filter (where status = 'match') "match", count(*) filter (where status = 'likely_match') likely_match, count(*) filter (where status = 'mismatch') mismatch, count(*) filter (where status = 'not_found') not_found from ({_VERDICT_SQL}) group by l_returnflag""")
def status_summary(s, d):
    return matcher.summary(_verdicts(s, d), "l_returnflag")


@query(f"""select coalesce(l_returnflag, 'all') grp, count(*) fields, count(*) filter (where status in ('match', 'likely_match')) accepted, count(*) filter (where status in ('mismatch', 'not_found')) hard_failures, round(count(*) filter (where status in ('match', 'likely_match')) / count(*)::double, 6) accuracy from ({_VERDICT_SQL}) group by grouping sets ((l_returnflag), ())""")
def accuracy_rollup(s, d):
    r = ev.accuracy(_verdicts(s, d), "l_returnflag")
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("grp"), "fields", "accepted", "hard_failures", rnd(col("accuracy")).alias("accuracy"))


@query(f"""with g as (select l_orderkey, any_value(l_returnflag) f, bool_and(status = 'match') perfect, bool_and(status in ('match', 'likely_match')) clean from ({_VERDICT_SQL}) group by l_orderkey) select count(*) documents, count(*) filter (where perfect) perfect, count(*) filter (where clean) zero_hard_failure from g""")
def doc_perfect(s, d):
    return ev.perfect_documents(_verdicts(s, d), "l_orderkey")


_MUTATED = "case when p_partkey % 3 = 0 then replace(p_name, 'a', 'e') when p_partkey % 7 = 0 then null else p_name end"


def _mutated(s, d) -> DataFrame:
    k = col("p_partkey")
    return t(s, d, "part").withColumn("seen", F.when(k % 3 == 0, F.regexp_replace("p_name", "a", "e")).when(k % 7 == 0, F.lit(None)).otherwise(col("p_name")))


@query(f"""with v as (select p_brand, p_name e, coalesce({_MUTATED}, '') a from part) select p_brand, count(*) fields, count(*) filter (where e = a) exact, sum(greatest(length(e), 1))::bigint expected_chars, sum(levenshtein(e, a))::bigint errors, round(1 - sum(levenshtein(e, a)) / sum(greatest(length(e), 1))::double, 6) char_accuracy from v group by p_brand""")
def field_cer(s, d):
    r = ev.character_scores(_mutated(s, d), "p_name", "seen", "p_brand")
    return r.select("p_brand", "fields", "exact", "expected_chars", "errors", rnd(col("char_accuracy")).alias("char_accuracy"))


@query(f"""with v as (select levenshtein(p_name, coalesce({_MUTATED}, '')) n from part) select case when n = 0 then '0' when n = 1 then '1' when n <= 3 then '2-3' when n <= 6 then '4-6' else '7+' end bucket, count(*) fields from v group by 1""")
def edit_buckets(s, d):
    return ev.edit_buckets(_mutated(s, d), "p_name", "seen")


@query(f"""with v as (select p_name e, {_MUTATED} a from part where {_MUTATED} is not null), c as (select e, a, unnest(range(1, greatest(length(e), length(a)) + 1)) i from v)
select x as expected, y as seen, count(*) n from (select substr(e, i, 1) x, substr(a, i, 1) y from c) where x <> y group by 1, 2 order by n desc, 1, 2 limit 15""")
def confusions_top15(s, d):
    return ev.confusions(_mutated(s, d).where("seen is not null"), "p_name", "seen", 15)


@query("""with x as (select conv_id, turn, regexp_replace(lower(text), '[^a-z ]', '', 'g') e, regexp_replace(lower(lag(text) over (partition by conv_id order by turn)), '[^a-z ]', '', 'g') a from conversations)
select conv_id, count(*) lines, count(*) filter (where e = a) exact, round(count(*) filter (where e = a) / count(*)::double, 6) line_exact from x where a is not null group by conv_id""")
def line_exact_rate(s, d):
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z ]", "")
    prev = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    x = t(s, d, "conversations").select("conv_id", fold(col("text")).alias("e"), fold(prev).alias("a")).where("a is not null")
    return x.groupBy("conv_id").agg(F.count("*").alias("lines"), F.count_if(col("e") == col("a")).alias("exact"), rnd(F.avg((col("e") == col("a")).cast(D))).alias("line_exact"))


_OK = "status in ('match', 'likely_match')"


@query(f"""select l_returnflag, case when {_OK} and other = 'match' then 'BOTH_CORRECT' when {_OK} then 'REGRESSION' when other = 'match' then 'IMPROVEMENT' else 'BOTH_WRONG' end transition, count(*) n from ({_VERDICT_SQL}) group by 1, 2""")
def transitions(s, d):
    v = _verdicts(s, d)
    return v.groupBy("l_returnflag", ev.transition(v["status"].isin(*ev.ACCEPTED), v["other"].isin(*ev.ACCEPTED)).alias("transition")).agg(F.count("*").alias("n"))


@query(f"""select status || '->' || other change, count(*) n from ({_VERDICT_SQL}) group by 1""")
def status_matrix(s, d):
    return ev.status_changes(_verdicts(s, d), "status", "other")


@query(f"""select l_shipmode_like grp, count(*) filter (where tr = 'BOTH_CORRECT') both_correct, count(*) filter (where tr = 'REGRESSION') regression, count(*) filter (where tr = 'IMPROVEMENT') improvement, count(*) filter (where tr = 'BOTH_WRONG') both_wrong from (select l_linestatus l_shipmode_like, case when {_OK} and other = 'match' then 'BOTH_CORRECT' when {_OK} then 'REGRESSION' when other = 'match' then 'IMPROVEMENT' else 'BOTH_WRONG' end tr from ({_VERDICT_SQL})) group by 1""")
def pivot_transitions(s, d):
    v = _verdicts(s, d).withColumnRenamed("l_linestatus", "grp")
    return ev.transition_table(v, col("status").isin(*ev.ACCEPTED), col("other").isin(*ev.ACCEPTED), "grp")


@query("""with l as (select doc_id, (i - 1)::bigint p, x from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents)),
r as (select doc_id - 1 doc_id, p, x from l) select coalesce(l.doc_id, r.doc_id) doc_id, count(*) filter (where l.x is distinct from r.x) changed, count(*) filter (where r.x is null) removed, count(*) filter (where l.x is null) added from l full join r on l.doc_id = r.doc_id and l.p = r.p group by 1""")
def diff_full_outer(s, d):
    left = layout.text_lines(t(s, d, "documents"), keep_blank=True)
    right = left.select((col("doc_id") - 1).alias("doc_id"), "line_pos", "text")
    return ev.keyed_difference(left, right, ["doc_id", "line_pos"], "text", "doc_id")


@query("""with c as (select conv_id, list(text order by turn) a from conversations group by conv_id), p as (select x.conv_id, x.a, coalesce(y.a, []) b from c x left join c y on y.conv_id = x.conv_id + 1)
select conv_id, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]))::bigint changed, greatest(len(a), len(b))::bigint positions from p""")
def diff_positional(s, d):
    c = t(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("a"))
    p = c.join(c.select((col("conv_id") - 1).alias("conv_id"), col("a").alias("b")), "conv_id", "left")
    return ev.positional_changes(p, "a", "b").select("conv_id", "changed", "positions")


@query("""select event_type, count(*) groups, count(*) filter (where n > 1) unstable from (select event_type, user_id, count(distinct coalesce(props, '')) n from events group by 1, 2) group by 1""")
def stability(s, d):
    return ev.stability(t(s, d, "events"), F.coalesce("props", F.lit("")), "user_id", "event_type")


# ---- measured runs ----


@query("""select event_type, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) iqr, round(mad(value), 6) mad, min(value) low, max(value) high from events group by event_type""")
def stats_iqr_mad(s, d):
    m = ranking.spread(t(s, d, "events"), ["event_type"], "value")
    return m.select("event_type", *(rnd(col(c)).alias(c) for c in ("median", "iqr", "mad")), "low", "high")


@query("""select event_type, count(*) n, round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.95), 6) p95, round(coalesce(stddev_samp(value), 0), 4) stdev, round(count(*) / sum(value), 6) per_second from events group by event_type""")
def perf_percentiles(s, d):
    e, v = t(s, d, "events"), col("value")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("stdev"), rnd(F.count("*") / F.sum(v)).alias("per_second"))
    q = ranking.quantiles(e, ["event_type"], {"p90": ("value", 0.9), "p95": ("value", 0.95)})
    return ranking.beside(n, q, ["event_type"]).select("event_type", "n", rnd(col("p90")).alias("p90"), rnd(col("p95")).alias("p95"), "stdev", "per_second")


@query("""select event_type, list_sort(list(value))[len(list(value)) // 2 + 1] upper_median from events group by event_type""")
def upper_median(s, d):
    return ranking.upper_median(t(s, d, "events"), ["event_type"], "value")


@query("""with g as (select user_id, event_type, sum(value) v from events group by 1, 2) select user_id, event_type, round(v / sum(v) over (partition by user_id), 6) share, round(1 / greatest(1 - v / sum(v) over (partition by user_id), 1e-9), 4) bound from g""")
def stage_shares(s, d):
    g = runs.stage_shares(t(s, d, "events"), "user_id", "event_type", "value")
    return g.select("user_id", "event_type", rnd(col("share")).alias("share"), F.round(stats.amdahl(col("share")), 4).alias("bound"))


@query("""select user_id, round(sum(value) filter (where event_type = 'view'), 6) view_s, round(greatest(0, sum(value) - coalesce(sum(value) filter (where event_type in ('view', 'click')), 0)), 6) other_s from events group by user_id""")
def residual_other(s, d):
    e = t(s, d, "events")
    view = e.groupBy("user_id").agg(rnd(F.sum(F.when(col("event_type") == "view", col("value")))).alias("view_s"))
    return view.join(runs.other_time(e, "user_id", "event_type", "value", ("view", "click")), "user_id").select("user_id", "view_s", rnd(col("other")).alias("other_s"))


@query("""with g as (select lang, count(*) n, sum(quality)::double h from documents join labels using (doc_id) group by lang), p as (select *, h / n p, 1.959963984540054 z from g)
select lang, n, h::bigint hits, round(greatest(0, ((p + z*z/(2*n)) / (1 + z*z/n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) low, round(least(1, ((p + z*z/(2*n)) / (1 + z*z/n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) high from p""")
def wilson_ci(s, d):
    g = t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast(L).alias("hits"))
    low, high = stats.wilson(col("hits"), col("n"))
    return g.select("lang", "n", "hits", rnd(low).alias("low"), rnd(high).alias("high"))


@query("""with m as (select event_type, median(value) m from events group by 1), b as (select m from m where event_type = 'view') select event_type, round(m.m, 6) median, round(b.m / m.m, 6) speedup from m, b""")
def speedup_vs_baseline(s, d):
    m = ranking.quantiles(t(s, d, "events"), ["event_type"], {"m": ("value", 0.5)})
    return runs.against_one(m, "event_type", "view", "m").select("event_type", rnd(col("m")).alias("median"), rnd(col("speedup")).alias("speedup"))


@query("""with g as (select p_brand, p_type, avg(p_retailprice) cost, avg(p_size)::double gain from part group by 1, 2) select p_brand, p_type, round(cost, 6) cost, round(gain, 6) gain from g a where not exists (select 1 from g b where b.p_brand = a.p_brand and b.cost <= a.cost and b.gain >= a.gain and (b.cost < a.cost or b.gain > a.gain))""")
def pareto_frontier(s, d):
    g = t(s, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("cost"), F.avg("p_size").alias("gain"))
    return ev.pareto(g, "p_brand", "cost", "gain").select("p_brand", "p_type", rnd(col("cost")).alias("cost"), rnd(col("gain")).alias("gain"))


@query("""select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_nationkey desc, s_name, s_suppkey limit 10""")
def rank_topk(s, d):
    return t(s, d, "supplier").orderBy(F.desc("s_acctbal"), F.desc("s_nationkey"), "s_name", "s_suppkey").limit(10).select("s_suppkey", "s_name", "s_acctbal")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) n from orders) where n = 1""")
def first_record(s, d):
    return runs.first_record(t(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("""select o_custkey, o_orderkey, n::bigint option_rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 12""")
def topk_per_field(s, d):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t(s, d, "orders").withColumn("n", n).where("n <= 12").select("o_custkey", "o_orderkey", col("n").cast(L).alias("option_rank"))


@query("""select o_custkey, o_orderkey, ((row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4)::bigint chunk from orders""")
def ordinal_chunks(s, d):
    return packing.chunks(t(s, d, "orders"), ["o_custkey"], [col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "chunk")


@query("""with k as (select s_suppkey item, row_number() over (order by s_suppkey) - 1 n, count(*) over () total from supplier), c as (select max(total) * 2 + 3 n from k) select i::bigint pos, item from c, range(c.n) r(i) join k on k.n = i % k.total""")
def cycle_documents(s, d):
    """Suppliers in turn, two rounds and three."""
    x = t(s, d, "supplier").select(col("s_suppkey").alias("item"))
    return packing.cycled(x, [col("item")], 2 * x.count() + 3).select("pos", "item")


@query("""select lang, source, doc_id, ((row_number() over (partition by lang, source order by n_chars / 48.0, doc_id) - 1) // 8)::bigint chunk from documents""")
def aspect_pack(s, d):
    return packing.chunks(t(s, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], [col("n_chars") / 48.0, col("doc_id")], 8).select("lang", "source", "doc_id", "chunk")


@query("""select lang, source, doc_id, ((row_number() over (partition by lang, source order by doc_id) - 1) // 8)::bigint chunk from documents""")
def sequential_pack(s, d):
    return packing.chunks(t(s, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], [col("doc_id")], 8).select("lang", "source", "doc_id", "chunk")


@query("""select w as width, lang, doc_id, ((row_number() over (partition by w, lang order by doc_id) - 1) // 8)::bigint chunk from (select *, least(3200, greatest(320, n_chars))::bigint w from documents)""")
def fixed_width_pack(s, d):
    w = packing.target_width(col("n_chars"), F.lit(48))
    return packing.chunks(t(s, d, "documents").select("lang", "doc_id", w.alias("width")), ["width", "lang"], [col("doc_id")], 8).select("width", "lang", "doc_id", "chunk")


@query("""select lang, source, doc_id, ((row_number() over (partition by lang, source order by n_chars, doc_id) - 1) // 2)::bigint chunk from documents""")
def best_fit_pack(s, d):
    return packing.chunks(t(s, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], [col("n_chars"), col("doc_id")], 2).select("lang", "source", "doc_id", "chunk")


@query("""select case when n_chars < 64 then '<64' when n_chars < 128 then '64-127' when n_chars < 256 then '128-255' when n_chars < 512 then '256-511' else '512+' end bucket, count(*) n from documents group by 1""")
def width_bucket_hist(s, d):
    return t(s, d, "documents").groupBy(packing.width_bucket(col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select lang, count(*) n, round(sum(n_chars / 48.0) / (max(n_chars / 48.0) * count(*)), 6)::double efficiency from documents group by lang""")
def padding_efficiency(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), rnd(packing.efficiency(col("n_chars") / 48.0)).alias("efficiency"))


@query("""with g as (select lang, source, count(*) n from documents group by 1, 2) select lang, lim::bigint cap, sum(ceil(n / lim::double))::bigint calls, count(*) filter (where n > lim) over_cap from g, (values (1), (2), (4), (8), (16)) v(lim) group by lang, lim""")
def hypothetical_calls(s, d):
    g = t(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return runs.hypothetical_calls(g, "n", [1, 2, 4, 8, 16], "lang")


# ---- datasets, sources, configuration ----


@query("""select lang, count(*) documents, count(quality) labelled, count(*) filter (where quality = 1) good, count(*) - count(quality) missing from documents left join labels using (doc_id) group by lang""")
def coverage(s, d):
    return ev.coverage(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels"), "doc_id", "quality", "lang")


@query("""select 'unlabelled' issue, doc_id from documents where doc_id not in (select doc_id from labels) union all select 'length', doc_id from documents where n_chars <> length(text) union all select 'orphan label', doc_id from labels where doc_id not in (select doc_id from documents) union all select 'empty', doc_id from documents where trim(text) = ''""")
def validation_issues(s, d):
    docs, labels = t(s, d, "documents"), t(s, d, "labels")
    rules = [("unlabelled", docs.join(labels, "doc_id", "left_anti")), ("length", docs.where(F.length("text") != col("n_chars"))), ("orphan label", labels.join(docs, "doc_id", "left_anti")), ("empty", docs.where(F.trim("text") == ""))]
    return ev.issues([(name, df.select("doc_id")) for name, df in rules])


@query("""select o_orderkey, sha256(concat_ws('|', o_orderkey::varchar, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'))) digest from orders""")
def semantic_digest(s, d):
    return t(s, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", col("o_orderkey").cast(S), "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd")), 256).alias("digest"))


@query("""select event_type, count(*) n, sum(coalesce((json_extract(props, '$.k'))::bigint, 0))::bigint total from events group by 1""")
def json_props(s, d):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast(L), F.get_json_object("props", "$.K").try_cast(L), F.lit(0))
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).cast(L).alias("total"))


@query("""with x as (select p_retailprice v, unnest(string_split(p_type || '|' || p_brand, '|')) tag from part) select tag, count(*) n, round(avg(v), 6) mean from x group by tag""")
def augmentation_breakdown(s, d):
    x = ev.breakdown(t(s, d, "part"), F.split(F.concat_ws("|", "p_type", "p_brand"), r"\|"), col("p_retailprice"))
    return x.select("tag", "n", rnd(col("mean")).alias("mean"))


@query("""with a as (select distinct o_orderkey k from orders), b as (select distinct l_orderkey k from lineitem) select 'union' op, (select count(*) from (select * from a union select * from b)) n union all select 'intersect', (select count(*) from (select * from a intersect select * from b)) union all select 'left only', (select count(*) from (select * from a except select * from b)) union all select 'right only', (select count(*) from (select * from b except select * from a))""")
def key_setops(s, d):
    return ev.key_sets(t(s, d, "orders").select(col("o_orderkey").alias("k")), t(s, d, "lineitem").select(col("l_orderkey").alias("k")))


_MAGIC = [("FFD8FFE0", "jpg"), ("89504E470D0A1A0A00", "png"), ("524946460000000057454250", "webp"), ("524946460000000057415645", None), ("424D00", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("474946383961", "gif"), ("255044462D", "pdf"), ("504B0304", "zip"), ("00", None), ("", None)]


@query("select page_id, list_extract([" + ", ".join(repr(k) if k else "null" for _, k in _MAGIC) + f"], (page_id % {len(_MAGIC)} + 1)::int) kind from pages")
def sniff_type(s, d):
    """Pages as uploads, each behind the first bytes of some file type."""
    head = F.array(*(F.lit(h) for h, _ in _MAGIC))[(col("page_id") % len(_MAGIC)).cast("int")]
    body = F.when(head == "", F.lit("").cast("binary")).otherwise(F.concat(F.unhex(head), F.encode("html", "utf-8")))
    return t(s, d, "pages").select("page_id", tx.file_type(body).alias("kind"))


@query("""select page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as safe from pages""")
def safe_name(s, d):
    return t(s, d, "pages").select("page_id", tx.safe_name(col("url")).alias("safe"))


@query("""select p as parent, count(*) entries, count(*) filter (where side = 'front') fronts, count(*) filter (where side = 'back') backs, count(*) filter (where side = 'front') = 1 and count(*) filter (where side = 'back') = 1 paired from (select 'dir' || (page_id // 2) p, case when page_id % 2 = 0 then 'front' else 'back' end side from pages) group by 1""")
def archive_pairs(s, d):
    e = t(s, d, "pages").select(F.concat(F.lit("dir"), F.floor(col("page_id") / 2).cast(S), F.lit("/"), F.when(col("page_id") % 2 == 0, "front").otherwise("back"), F.lit(".jpg")).alias("path"))
    return packing.side_pairs(e)


@query("""select a as threads, b as batch, c as side, case when a * b > 64 then 'too large' when c % 32 <> 0 then 'not aligned' end invalid_reason from (select distinct l_linenumber::bigint * 4 a from lineitem) x, (select distinct n_nationkey::bigint b from nation) y, (select distinct p_size::bigint * 16 c from part) z""")
def matrix_expand(s, d):
    """Settings that the tables hold: threads, batches, sides."""
    m = packing.matrix({"threads": t(s, d, "lineitem").select(col("l_linenumber").cast(L) * 4), "batch": t(s, d, "nation").select(col("n_nationkey").cast(L)), "side": t(s, d, "part").select(col("p_size").cast(L) * 16)})
    return m.withColumn("invalid_reason", F.when(col("threads") * col("batch") > 64, "too large").when(col("side") % 32 != 0, "not aligned"))


# ---- matching (not expressible in SQL: tested against a direct evaluation) ----


@query()
def match_fields(s, d):
    """Three words of each conversation turn as expected values against the turns as recognised lines."""
    lines, fields = _turns(s, d)
    return matcher.verify(lines, fields, evidence=False)


@query()
def matcher_work(s, d):
    """What matching every conversation's fields took: candidates, comparisons, ratios, options, states and transitions."""
    return matcher.work(*_turns(s, d))


@query()
def similarity_ratio(s, d):
    p = _mutated(s, d).select("p_partkey", col("p_name").alias("a"), F.coalesce("seen", F.lit("")).alias("b"))
    return scored_pairs(p, "a", "b").select("p_partkey", F.round("score", 4).alias("score"))


def _turns(s, d) -> tuple[DataFrame, DataFrame]:
    """Every line of conversation turns, numbered through each conversation, and three words of each turn's first line as an expected value."""
    turns = t(s, d, "conversations").select(col("conv_id").cast(S).alias("doc_id"), col("turn").cast("int").alias("turn"), "text")
    lines = turns.select("doc_id", "turn", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    lines = lines.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("turn", "part", "text")).alias("line_pos"), "text", F.lit(0.9).alias("confidence"))
    first = F.substring_index("text", "\n", 1)
    fields = turns.select("doc_id", col("turn").alias("field_pos"), F.concat(F.lit("name_"), col("turn").cast(S)).alias("field"), F.array_join(F.slice(F.split(first, " "), 2, 3), " ").alias("expected"))
    return lines, fields


@query()
def match_fields_older(s, d):
    return line_matcher.verify(*_turns(s, d))


@query()
def matcher_transitions(s, d):
    """Status changes from the older matcher to the present one, on the same fields."""
    lines, fields = _turns(s, d)
    now = matcher.verify(lines, fields, evidence=False).select("doc_id", "field_pos", col("status").alias("now"))
    old = line_matcher.verify(lines, fields).select("doc_id", "field_pos", col("status").alias("old"))
    return old.join(now, ["doc_id", "field_pos"]).groupBy(F.concat_ws("->", "old", "now").alias("change")).agg(F.count("*").alias("n"))


@query()
def zone_reconstruct(s, d):
    """Zone lines of customers, cut into three tokens each, joined again and read."""
    z = _td3(s, d).select(col("c_custkey").cast(S).alias("sample_id"), F.posexplode(F.array("l1", "l2")).alias("line", "z"))
    cut = F.array(*(F.struct(F.substring("z", a, 15).alias("text"), F.lit(a).alias("x1")) for a in (1, 16, 31)))
    k = z.select("sample_id", (col("line") * 40 + 100).alias("center_y"), F.explode(cut).alias("c")).select("sample_id", "c.text", F.lit(0.9).alias("score"), "c.x1", "center_y", F.lit(20).alias("height"))
    b = zones.zone_blocks(zones.zone_lines(k), (2,))
    fields, checks = mrz.td3(col("lines")[0], col("lines")[1])
    return b.select(col("sample_id").cast(L).alias("c_custkey"), fields["surname"].alias("surname"), fields["document_number"].alias("document_number"), mrz.all_passed(checks).alias("valid"))


ORACLE["zone_reconstruct"] = "select c_custkey, upper(c_mktsegment) surname, lpad(c_custkey::varchar, 9, '0') document_number, c_custkey % 7 <> 0 valid from customer"

from attestra.plans import archive_queries, dataset_queries, more_queries, run_queries, snapshot_queries, trace_queries  # noqa: E402, F401  register more queries
