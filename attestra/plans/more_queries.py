"""Registered queries of operators on regions, frames, zones, run reports and sides, each beside its SQL (see ``queries``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import geometry as g
from attestra.functions import text as tx
from attestra.operators import identity, layout, profiles, runs, scoring, timings, zone_search
from attestra.operators.tasks import spread
from attestra.plans.queries import D, L, S, _td3, col, query, rnd, t

# ---- regions and reading order ----


@query("""select p_partkey from part where (p_size * 2 + 5 between 10 and 40 and p_partkey % 50 + 5 between 0 and 30) or (p_size * 2 + 5 between 60 and 100 and p_partkey % 50 + 5 between 20 and 60)""")
def lines_in_regions(s, d):
    """Boxes of ten by ten whose centre lies in one of two regions of a page of a hundred by a hundred."""
    x, y = (col("p_size") * 2).cast(D), (col("p_partkey") % 50).cast(D)
    boxes = t(s, d, "part").select("p_partkey", x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 10).alias("y2"))
    return layout.in_any_region(boxes, [("a", 0, 0.1, 0.0, 0.4, 0.3), ("b", 1, 0.6, 0.2, 1.0, 0.6)], 100, 100).select("p_partkey")


@query("""with l as (select l_orderkey page, l_linenumber n, (l_partkey % 7) * 10 y, l_suppkey % 5 x, l_linenumber || '-' || l_partkey as text from lineitem) select page, text, (row_number() over (partition by page order by y + 2.5, x, y, text) - 1)::bigint place from (select distinct * from l)""")
def reading_places(s, d):
    x, y = (col("l_suppkey") % 5).cast(D), ((col("l_partkey") % 7) * 10).cast(D)
    polygon = F.array(*(g.point(x + a, y + b) for a, b in ((0, 0), (20, 0), (20, 5), (0, 5))))
    lines = t(s, d, "lineitem").select(col("l_orderkey").alias("page"), col("l_linenumber"), F.concat_ws("-", col("l_linenumber").cast(S), col("l_partkey").cast(S)).alias("text"), polygon.alias("polygon")).distinct()
    return layout.page_order(lines, "page").select("page", "text", col("place").cast(L).alias("place"))


@query("""select l_orderkey, string_agg(w, ' ' order by y, x, w) as text from (select distinct l_orderkey, l_partkey % 7 y, l_suppkey % 5 x, case when l_linenumber % 4 = 0 then '' else l_shipmode end w from (select *, case l_linenumber % 3 when 0 then 'RAIL' when 1 then 'SHIP' else 'AIR' end l_shipmode from lineitem)) where w <> '' group by 1""")
def field_texts(s, d):
    n = col("l_linenumber")
    w = F.when(n % 4 == 0, "").when(n % 3 == 0, "RAIL").when(n % 3 == 1, "SHIP").otherwise("AIR")
    tokens = t(s, d, "lineitem").select("l_orderkey", (col("l_partkey") % 7).alias("center_y"), (col("l_suppkey") % 5).alias("x1"), w.alias("text")).distinct()
    return layout.reading_text(tokens, "l_orderkey")


# ---- run reports ----


@query("""select event_type, sum(1 + event_id % 4) > 1 several, max(1 + event_id % 3) > 1 batched from events where event_id % 3 <> 2 or event_type <> 'view' group by 1""")
def batching_proof(s, d):
    i = col("event_id")
    x = t(s, d, "events").where("event_id % 3 <> 2 or event_type <> 'view'").select("event_type", (1 + i % 4).alias("submitted_batch_size"), F.array(F.lit(1).cast(L), 1 + i % 3).alias("tensor_batch_sizes"))
    return runs.proves_batching(x, "event_type")


@query("""select conv_id, count(*) detected, count(*) filter (where coalesce(x, '') <> '') recognized from (select conv_id, unnest(string_split(text, chr(10))) x from conversations) group by 1""")
def detected_lines(s, d):
    return runs.line_counts(t(s, d, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("text")), "conv_id")


_FAIL = "case event_id % 6 when 0 then 'CUDA out of memory: ' || event_type when 1 then 'Resource exhausted' when 2 then 'timeout' when 3 then 'std::bad alloc' when 4 then 'Cannot allocate 5' end"


@query(f"""select event_type, count(*) filter (where coalesce(regexp_matches(lower(e), 'out of memory|resource exhausted|cannot allocate|bad alloc'), false)) exhausted, count(*) n from (select event_type, {_FAIL} e from events) group by 1""")
def resource_failures(s, d):
    x = t(s, d, "events").select("event_type", F.expr(_FAIL).alias("e"))
    return x.groupBy("event_type").agg(F.count_if(runs.resource_error(col("e"))).alias("exhausted"), F.count("*").alias("n"))


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by md5('7:' || doc_id), doc_id) depth from documents) select lang, doc_id from r where depth <= 40 order by depth, lang limit 40""")
def diverse_sample(s, d):
    return runs.diverse(t(s, d, "documents"), "lang", "doc_id", 40, 7).select("lang", "doc_id")


@query("""select p_brand, p_name, p_partkey from part order by list_position(['Brand#3', 'Brand#1'], p_brand) nulls first, lower(p_name), p_name, p_partkey limit 50""")
def ranked_types(s, d):
    return runs.by_type_rank(t(s, d, "part").select("p_brand", F.concat_ws("~", "p_name", F.lpad(col("p_partkey").cast(S), 12, "0")).alias("k"), "p_name", "p_partkey"), "p_brand", "k", ["Brand#3", "Brand#1"]).limit(50).drop("k")


@query("""select event_type, count(*) n, round(sum(value), 6) as seconds from events where event_id % 3 = 1 and user_id % 4 <> 0 group by 1""")
def measured_runs(s, d):
    x = t(s, d, "events").withColumns({"phase": F.when(col("event_id") % 3 == 1, "measured").otherwise("warmup"), "status": F.when(col("user_id") % 4 == 0, "failed").otherwise("ok")})
    return scoring.measured(x).groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("seconds"))


_STATES = "case when p_partkey % 3 = 0 then 'correct' else 'incorrect' end as before, case when p_partkey % 2 = 0 then 'correct' else 'not_found' end as after"


@query(f"""select p_partkey, case when before = 'correct' and after <> 'correct' then 'association' when after = 'correct' and before <> 'correct' then 'localization' else 'recognition or image quality' end cause from (select p_partkey, p_brand, {_STATES} from part) where p_brand in (select p_brand from part where p_size = 7)""")
def failure_causes(s, d):
    p = t(s, d, "part")
    rows = p.select("p_partkey", "p_brand", F.when(col("p_partkey") % 3 == 0, "correct").otherwise("incorrect").alias("before"), F.when(col("p_partkey") % 2 == 0, "correct").otherwise("not_found").alias("after"))
    return scoring.known_failures(rows, p.where("p_size = 7").select("p_brand"), ["p_brand"]).select("p_partkey", "cause")


@query("""with f as (select unnest(['birth_date', 'serial_number', 'surname', 'pinfl', 'passport_number', 'address', 'card', 'license_number', 'update_note']) as field) select p_partkey, field, contains(field, 'date') or contains(field, 'number') or contains(field, 'personal_id') or contains(field, 'pinfl') or contains(field, 'serial') or contains(field, 'license') strict from part, f""")
def wide_strict_fields(s, d):
    names = F.array(*map(F.lit, ("birth_date", "serial_number", "surname", "pinfl", "passport_number", "address", "card", "license_number", "update_note")))
    return t(s, d, "part").select("p_partkey", F.explode(names).alias("field")).withColumn("strict", scoring.strict_by_name(col("field")))


# ---- sides, fields, shapes ----


@query("""select p_brand document_type, p_type field from part where p_size <= 20 intersect select p_brand, p_type from part where p_size > 30""")
def fields_on_both_sides(s, d):
    p = t(s, d, "part").select(col("p_brand").alias("document_type"), col("p_type").alias("field"), "p_size")
    return identity.double_ownership(p.where("p_size <= 20"), p.where("p_size > 30"))


@query("""with k as (select distinct l_orderkey doc_id from lineitem), p as (select * from (values ('line1', 1), ('line3', 3), ('line9', 9)) v(field, n)), f as (select l_orderkey doc_id, 'line' || l_linenumber as field, max(l_partkey)::varchar as value, max(l_discount)::double score from lineitem group by all)
select doc_id, field, 'r' || n % 2 region, value, case when value is not null then score end score from k cross join p left join f using (doc_id, field)""")
def profile_fields(s, d):
    x = t(s, d, "lineitem").groupBy(col("l_orderkey").alias("doc_id"), F.concat(F.lit("line"), col("l_linenumber").cast(S)).alias("field")).agg(F.max("l_partkey").cast(S).alias("value"), F.max("l_discount").cast(D).alias("score"))
    pairs = F.array(*(F.struct(F.lit("order").alias("document_type"), F.lit(f"line{n}").alias("field"), F.lit(f"r{n % 2}").alias("region"), F.lit(n).alias("field_pos")) for n in (1, 3, 9)))
    profile = s.range(1).select(F.inline(pairs))
    return identity.field_results(x.select("doc_id", F.lit("order").alias("document_type"), "field", "value"), x.select("doc_id", "field", "score"), profile).select("doc_id", "field", "region", "value", "score")


@query("""with v as (select p_partkey, unnest([p_partkey::varchar, p_name, 'AB' || p_partkey, '01.02.1990', '']) found, unnest(['identifier', 'name', 'identifier', 'date', 'text']) kind, unnest([(p_partkey + 1)::varchar, '123', 'CD9', '1990-02-01', 'x']) target from part)
select p_partkey, kind, target, found <> '' and case kind when 'identifier' then case when regexp_matches(target, '^[0-9]+$') then regexp_matches(found, '^[0-9]+$') else regexp_matches(found, '[A-Za-z]') and regexp_matches(found, '[0-9]') end when 'name' then not (regexp_matches(found, '^[0-9]+$') and not regexp_matches(target, '^[0-9]+$')) else true end fits from v""")
def fitting_shapes(s, d):
    """Values of the kinds that a target may have, and whether their shape allows a comparison."""
    k = col("p_partkey").cast(S)
    case = lambda found, kind, target: F.struct(found.alias("found"), F.lit(kind).alias("kind"), target.alias("target"))
    cases = F.array(case(k, "identifier", (col("p_partkey") + 1).cast(S)), case(col("p_name"), "name", F.lit("123")), case(F.concat(F.lit("AB"), k), "identifier", F.lit("CD9")), case(F.lit("01.02.1990"), "date", F.lit("1990-02-01")), case(F.lit(""), "text", F.lit("x")))
    v = t(s, d, "part").select("p_partkey", F.inline(cases))
    return v.select("p_partkey", "kind", "target", tx.shape_fits(col("target"), col("found"), col("found"), col("kind")).alias("fits"))


# ---- frames and profiles: a part's page is a slanted one in its picture ----


def _page(k):
    """Corners of a parallelogram: from (10, 20) along (w, 5) and (-8, h)."""
    w, h = (col("p_size") * 3 + 100).cast(D), (k % 90 + 80).cast(D)
    return F.array(g.point(10, 20), g.point(10 + w, F.lit(25.0)), g.point(2 + w, 25 + h), g.point(F.lit(2.0), 20 + h))


@query("""with c as (select p_partkey, (p_size * 3 + 100)::double w, (p_partkey % 90 + 80)::double h, (p_partkey % 100)::double x, (p_size * 2)::double y from part), d as (select *, w * h + 40 as det from c)
select p_partkey, round(((x - 10) * h + 8 * (y - 20)) / det, 6) u, round((w * (y - 20) - 5 * (x - 10)) / det, 6) v, x back_x, y back_y from d""")
def page_coordinates(s, d):
    """A point in the page's own square, and taken back to the picture."""
    k = col("p_partkey")
    square = F.array(g.point(0, 0), g.point(1, 0), g.point(1, 1), g.point(0, 1))
    x = spread(t(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", _page(k).alias("page"), F.array(g.point(k % 100, col("p_size") * 2)).alias("p")).withColumn("q", g.applied(g.between(col("page"), square), col("p")))
    back = g.applied(g.from_square(col("page")), col("q"))[0]
    return x.select("p_partkey", rnd(col("q")[0]["x"]).alias("u"), rnd(col("q")[0]["y"]).alias("v"), rnd(back["x"]).alias("back_x"), rnd(back["y"]).alias("back_y"))


@query("""with c as (select p_partkey, (p_size * 3 + 100)::double w, (p_partkey % 100)::double x, (p_size * 2)::double y from part), f as (select *, sqrt(w * w + 25) e from c) select p_partkey, round(((x - 10) * w + (y - 20) * 5) / e / e, 6) along, round(((y - 20) * w - (x - 10) * 5) / e / e, 6) across, x back_x, y back_y from f""")
def zone_coordinates(s, d):
    """A point in the frame of a zone, in lengths of its top edge, and taken back."""
    k = col("p_partkey")
    x = spread(t(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", _page(k).alias("zone"), F.array(g.point(k % 100, col("p_size") * 2)).alias("p")).withColumn("q", g.to_frame(col("zone"), col("p")))
    back = g.from_frame(col("zone"), col("q"))[0]
    return x.select("p_partkey", rnd(col("q")[0]["x"]).alias("along"), rnd(col("q")[0]["y"]).alias("across"), rnd(back["x"]).alias("back_x"), rnd(back["y"]).alias("back_y"))


def _samples(s, d):
    """Parts as annotated samples whose page is a rectangle of the picture (in every fourth the space is canonical)."""
    k = col("p_partkey")
    r = lambda *v: F.struct(*((x if not isinstance(x, (int, float)) else F.lit(float(x))).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)))
    left = ((k % 5) / 10.0).cast(D)
    corners = F.array(g.point(left, 0), g.point(1, 0), g.point(1, 0.8), g.point(left, 0.8))
    fields = F.create_map(F.lit("sec"), r(0, 0, 0.5, 1), F.concat(F.lit("f"), (k % 3).cast(S)), r(0.25, 0.25, 0.75, 0.5))
    return t(s, d, "part").select(
        F.lpad(k.cast(S), 9, "0").alias("key"), col("p_brand").alias("layout"), F.when(k % 2 == 0, "front").alias("side"), F.when(k % 7 == 0, "open").otherwise("complete").alias("status"), F.when(k % 4 == 0, "canonical").alias("coordinate_space"),
        corners.alias("corners"), r(0.5, 0.4, 0.9, 0.6).alias("data_crop"), fields.alias("fields"), F.lit(200).alias("original_width"), F.lit(100).alias("original_height"), F.lit(400).alias("canonical_width"), F.lit(300).alias("canonical_height"),
    )


_PROMOTED = """with s as (select p_brand layout, case when p_partkey % 2 = 0 then 'front' else 'data_page' end region, p_partkey k, (p_partkey % 5) / 10.0 l, p_partkey % 4 = 0 done from part where p_partkey % 7 <> 0), b as (select * from s qualify row_number() over (partition by layout, region order by lpad(k::varchar, 9, '0') desc) = 1),
e as (select *, unnest(['sex', 'f' || k % 3]) as field, unnest([0.0, 0.25]) a, unnest([0.5, 0.75]) z from b)
select layout, region, field, field = 'sex' and layout <> 'Brand#1' required, round(case when done then 0.5 else (0.5 - l) / (1 - l) end, 6) left_edge, round(case when done then 0.6 else 0.75 end::double, 6) bottom, a::double a, z::double z from e"""


def _promoted(s, d):
    p = t(s, d, "part").select(col("p_brand").alias("layout")).distinct().select("layout", F.lit("sex").alias("field"), (col("layout") != "Brand#1").alias("required"))
    return profiles.promoted(_samples(s, d), p)


@query(_PROMOTED)
def promoted_profiles(s, d):
    return _promoted(s, d).select("layout", "region", "field", "required", rnd(col("crop.x1")).alias("left_edge"), rnd(col("crop.y2")).alias("bottom"), rnd(col("roi.x1")).alias("a"), rnd(col("roi.x2")).alias("z"))


@query(f"""with p as ({_PROMOTED}), n as (select layout, region, field from p where field <> 'sex' union all select layout, region, field from p where field = 'sex' and required) select layout, count(*) boxes from n group by 1""")
def drifted_profiles(s, d):
    """Planned profiles against ones without some fields and with a flag turned."""
    planned = _promoted(s, d)
    return profiles.drifted_layouts(planned, planned.where("field = 'sex'").withColumn("required", F.lit(False)))


# ---- zones ----


@query("""select c_custkey, rpad('P<UZB' || upper(c_mktsegment) || '<<NAME<' || translate(c_nationkey::varchar, '0123456789', 'ABCDEFGHIJ'), 44, '<') first, true second_found, case when c_custkey % 3 = 0 then 0.8 else 0.85 end::double score from customer""")
def zone_search_best(s, d):
    """Zones of customers among other lines: in every third the first line comes in two pieces, and some text looks like a zone."""
    k = col("c_custkey")
    line = lambda text, score, x1, y1, x2, y2: F.struct(text.alias("text"), *(F.lit(float(v)).alias(n) for n, v in zip(("score", "x1", "y1", "x2", "y2"), (score, x1, y1, x2, y2), strict=True)))
    cut = F.array(line(F.substring("l1", 21, 24), 0.8, 205, 202, 440, 222), line(F.substring("l1", 1, 20), 0.7 + 0.1, 0, 200, 200, 220))
    noise = F.array(line(F.lit("REPUBLIC OF NOWHERE AND ELSEWHERE"), 0.99, 0, 10, 300, 30), line(F.concat(F.lit("ID"), k.cast(S)), 0.9, 0, 50, 60, 70), line(F.lit("AAAAAAAAAAAAAAA"), 0.5, 0, 90, 100, 110))
    lines = F.concat(noise, F.array(line(col("l2"), 0.8, 0, 230, 440, 250)), F.when(k % 3 == 0, cut).otherwise(F.array(line(col("l1"), 0.9, 0, 200, 440, 220))))
    z = _td3(s, d).select(k.alias("sample"), "l2", lines.alias("lines"), F.array(F.lit(44), F.lit(44)).alias("lengths"), F.lit(500).alias("width"), F.lit(300).alias("height"))
    found = zone_search.search(z)
    return found.join(z.select("sample", "l2"), "sample").select(col("sample").alias("c_custkey"), col("lines")[0].alias("first"), (col("lines")[1] == col("l2")).alias("second_found"), rnd(col("score")).alias("score"))


# ---- timing facts of three tables that have little in common ----

_SOURCES = [
    timings.Source("baseline", {"document_type": "event_type", "configuration": "user_id", "repeat": "event_id", "seconds": "value", "docs_per_second": "rate"}, where="event_id % 10 <> 3"),
    timings.Source("batch", {"document_type": "kind", "configuration": "clerk", "seconds": "millis", "lines_per_second": "lines"}, 0.001, stages="stages"),
    timings.Source("models", {"document_type": "o_type", "configuration": "p_brand", "seconds": "p_retailprice"}),
]
_TYPES = "case k % 4 when 0 then 'view' when 1 then 'click' when 2 then 'error' else 'none' end"
_FACTS = f"""select 'baseline' experiment, event_type document_type, user_id::varchar as configuration, event_id as repeat, value as seconds, null::double lines, null::double detect from events where event_id % 10 <> 3
union all select 'batch', {_TYPES.replace("k", "o_orderkey")}, (o_custkey % 3)::varchar, null, o_totalprice::double * 0.001, o_custkey::double, o_totalprice::double / 4 from orders
union all select 'models', null, p_brand, null, p_retailprice::double, null, null from part"""


def _timings(s, d):
    k = col("o_orderkey")
    kind = F.expr(_TYPES.replace("k", "o_orderkey"))
    batch = t(s, d, "orders").select(kind.alias("kind"), (col("o_custkey") % 3).alias("clerk"), col("o_totalprice").alias("millis"), col("o_custkey").alias("lines"), F.create_map(F.lit("detect"), col("o_totalprice").cast(D) / 4, F.lit("read"), (k % 5).cast(D)).alias("stages"))
    documents = t(s, d, "events").groupBy(col("event_type").alias("document_type")).agg(F.count("*").alias("documents"))
    return timings.facts({"baseline": t(s, d, "events"), "batch": batch, "models": t(s, d, "part")}, _SOURCES, documents)


@query(f"""with f as ({_FACTS}), n as (select event_type document_type, count(*) n from events group by 1) select experiment, document_type, configuration, count(*) n, count(repeat) repeats, round(sum(seconds), 4) as seconds, round(sum(n / seconds), 4) rate, sum(lines)::bigint as lines, round(sum(detect), 4) detect from f left join n using (document_type) group by all""")
def timing_facts(s, d):
    f, _ = _timings(s, d)
    return f.groupBy("experiment", "document_type", "configuration").agg(F.count("*").alias("n"), F.count("repeat").alias("repeats"), F.round(F.sum("seconds"), 4).alias("seconds"), F.round(F.sum("docs_per_second"), 4).alias("rate"), F.sum("lines_per_second").cast(L).alias("lines"), F.round(F.sum(col("stages")["detect"]), 4).alias("detect"))


@query("""with r as (select 'baseline' experiment, (select count(*) from events where event_id % 10 <> 3) n union all select 'batch', (select count(*) from orders) union all select 'models', (select count(*) from part)), c as (select * from (values ('baseline', 'document_type', 'event_type', true), ('baseline', 'configuration', 'user_id', true), ('baseline', 'repeat', 'event_id', true), ('baseline', 'seconds', 'value', true), ('baseline', 'docs_per_second', 'rate', false), ('batch', 'document_type', 'kind', true), ('batch', 'configuration', 'clerk', true), ('batch', 'seconds', 'millis', true), ('batch', 'lines_per_second', 'lines', true), ('models', 'document_type', 'o_type', false), ('models', 'configuration', 'p_brand', true), ('models', 'seconds', 'p_retailprice', true)) v(experiment, field, "column", present)) select experiment, field, "column", present, case when present then n else 0 end filled, n as rows from c join r using (experiment)""")
def observed_fields(s, d):
    return _timings(s, d)[1]


@query(f"""with f as ({_FACTS}), m as (select experiment, document_type, configuration, median(seconds) m from f group by all), p as (select * from (values ('slow', 'batch', '0', 'batch', '1', true), ('other', 'batch', '2', 'batch', '0', false)) v(family, be, b, e, c, counts))
select family, x.document_type, round(x.m / y.m, 6) speedup, case when counts then case when x.document_type = 'view' then 7 else 0 end end regressions from p join m x on x.experiment = be and x.configuration = b join m y on y.experiment = e and y.configuration = c and y.document_type = x.document_type""")
def measured_opportunities(s, d):
    pair = lambda *v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("family", "base_experiment", "base", "experiment", "candidate", "counts"), v, strict=True)))
    pairs = s.range(1).select(F.inline(F.array(pair("slow", "batch", "0", "batch", "1", True), pair("other", "batch", "2", "batch", "0", False))))
    regressions = t(s, d, "events").where("event_type = 'view'").groupBy(col("event_type").alias("document_type")).agg(F.lit(7).alias("regressions"))
    return timings.opportunities(_timings(s, d)[0], pairs, regressions).withColumn("speedup", rnd(col("speedup")))


@query(f"""select document_type, configuration, count(*) n, round(avg(detect / seconds), 6) detect_share from ({_FACTS}) where experiment = 'batch' group by all""")
def stage_facts(s, d):
    f = timings.stage_facts(_timings(s, d)[0]).where("stage = 'detect'")
    return f.groupBy("document_type", "configuration").agg(F.count("*").alias("n"), rnd(F.avg("share")).alias("detect_share"))
