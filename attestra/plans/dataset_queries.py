"""Registered queries of dataset validation, each beside its SQL (see ``queries``): the datasets are derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import dataset
from attestra.plans.queries import L, S, col, query, t
from attestra.sources import dataset as source

# ---- discovery ----

_NAMES = "case page_id % 9 when 0 then 'passport/p' || page_id || '.JPG' when 1 then 'passport/p' || (page_id - 1) || '.png' when 2 then 'driving_license/p' || (page_id - 2) || '.webp' when 3 then 'passport/p' || page_id || '.txt' when 4 then 'id_card/c' || page_id || '/front.png' when 5 then 'id_card/c' || (page_id - 1) || '/Back.jpg' when 6 then 'id_card/c' || page_id || '/front.png' when 7 then 'id_card/c' || (page_id - 1) || '/front.jpeg' else 'other/x.jpg' end"


def _named_files(s, d):
    return t(s, d, "pages").select(F.expr(_NAMES).alias("file"))


@query(f"""with f as (select {_NAMES} file from pages), p as (select file, string_split(file, '/') p, regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') stem from f), i as (select *, p[1] kind from p where p[1] in ('passport', 'id_card', 'driving_license') and regexp_matches(lower(file), '\\.(jpg|jpeg|png|webp)$')),
one as (select kind, stem id, file, row_number() over (partition by kind, stem order by lower(file), file) n from i where kind <> 'id_card' and len(p) = 2),
two as (select p.p[2] id, count(*) filter (where i.file is not null and lower(i.stem) = 'front') fronts, count(*) filter (where i.file is not null and lower(i.stem) = 'back') backs, string_agg(lower(i.stem) || '=' || i.file, ' ' order by lower(i.stem)) found from p left join i on i.file = p.file and i.kind = 'id_card' where p.p[1] = 'id_card' and len(p.p) >= 3 group by 1)
select kind as document_type, id, 'image=' || file pictures from one where n = 1 union all select 'id_card', id, found from two where fronts = 1 and backs = 1""")
def discovered_documents(s, d):
    docs, _ = source.discovered(_named_files(s, d))
    return docs.select("document_type", "id", F.array_join(F.transform(F.array_sort(F.map_entries("images")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("pictures"))


@query(f"""with f as (select {_NAMES} file from pages), p as (select file, string_split(file, '/') p, regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') stem from f), i as (select *, p[1] kind from p where p[1] in ('passport', 'id_card', 'driving_license') and regexp_matches(lower(file), '\\.(jpg|jpeg|png|webp)$')),
one as (select kind, stem id, file, row_number() over (partition by kind, stem order by lower(file), file) n from i where kind <> 'id_card' and len(p) = 2),
two as (select p.p[2] id, count(*) filter (where i.file is not null and lower(i.stem) = 'front') front, count(*) filter (where i.file is not null and lower(i.stem) = 'back') back from p left join i on i.file = p.file and i.kind = 'id_card' where p.p[1] = 'id_card' and len(p.p) >= 3 group by 1),
docs as (select kind, id from one where n = 1 union all select 'id_card', id from two where front = 1 and back = 1)
select 'duplicate id' issue, kind as document_type, id, null as detail from one where n > 1
union all select 'missing or duplicate side', 'id_card', id, case when front = 0 then 'missing front' else 'duplicate front' end from two where front <> 1
union all select 'missing or duplicate side', 'id_card', id, case when back = 0 then 'missing back' else 'duplicate back' end from two where back <> 1
union all select 'duplicate logical id', null, id, string_agg(kind, ', ' order by kind) from docs group by id having count(*) > 1""")
def discovery_problems(s, d):
    return source.discovered(_named_files(s, d))[1]


# ---- annotations: a licence for each document, one in twelve of them whole ----

_FIELD = '"{}":{{"state":"value","value":"A"}}'
_ALL = ",".join(_FIELD.format(f) for f in dataset.FIELDS["driving_license"])
_LESS = ",".join(_FIELD.format(f) for f in dataset.FIELDS["driving_license"] if f not in ("address", "surname"))


def _annotation_text(sha: str) -> str:
    """SQL of both engines for a document's annotation, from k = doc_id % 12."""
    k = "doc_id % 12"
    pick = lambda usual, **other: "case " + " ".join(f"when {k} = {n[1:]} then {v}" for n, v in other.items()) + f" else {usual} end"
    parts = [
        "'{'",
        pick("'\"id\":\"d' || doc_id || '\",'", k8="'\"id\":7,'"),
        pick("'\"document_type\":\"driving_license\",'", k9="'\"document_type\":\"visa\",'"),
        pick("'\"images\":{\"image\":\"driving_license/d' || doc_id || '.jpg\"},'", k6="'\"images\":{\"image\":\"driving_license/gone' || doc_id || '.jpg\"},'"),
        pick(f"'\"image_sha256\":{{\"image\":\"' || {sha} || '\"}},'", k5="'\"image_sha256\":{\"image\":\"00\"},'"),
        "'\"fields\":{'",
        pick(f"'{_ALL}'", k0=f"'{_LESS}'", k3=f"'{_ALL},\"x' || doc_id || '\":{{\"state\":\"empty\"}}'", k7=f"'{_ALL}'"),
        pick("'},'", k7="'},\"extra\":1,'"),
        pick("'\"status\":\"complete\"'", k1="'\"status\":\"in_progress\"'", k7="'\"status\":\"done\"'"),
        pick("',\"notes\":\"\"'", k4="''", k10="',\"notes\":\"\",\"mrz\":{}'"),
        pick("'}'", k2="''"),
    ]
    return " || ".join(parts)


@query(f"""with a as (select doc_id, 'annotations/driving_license/d' || doc_id || '.json' file, {_annotation_text("sha256(text)")} j, 'driving_license/d' || doc_id || '.jpg' pic, sha256(text) sha from documents),
v as (select *, json_valid(j) ok, try_cast(j as json) v from a),
w as (select *, v->>'$.id' id, v->>'$.document_type' kind, v->>'$.status' status, json_keys(v, '$.fields') names, v->>'$.images.image' image, v->>'$.image_sha256.image' declared from v where ok and json_type(v, '$.id') = 'VARCHAR' and v->>'$.document_type' = 'driving_license'),
need as (select unnest({dataset.FIELDS["driving_license"]!r}) n),
d as (select distinct doc_id, pic, sha, 'd' || doc_id id from a)
select 'malformed' issue, file, '' detail from v where not ok
union all select 'missing id', file, '' from v where ok and json_type(v, '$.id') <> 'VARCHAR'
union all select 'invalid type', file, v->>'$.document_type' from v where ok and json_type(v, '$.id') = 'VARCHAR' and v->>'$.document_type' <> 'driving_license'
union all select 'unknown fields', file, string_agg(n, ', ' order by n) from (select file, unnest(names) n from w) where n not in (select n from need) group by file
union all select 'missing fields', file, string_agg(n, ', ' order by n) from (select file, n from w, need where not list_contains(names, n)) group by file
union all select 'invalid status', file, status from w where status not in ('complete', 'in_progress', 'skipped')
union all select 'incomplete', file, status from w where status <> 'complete'
union all select 'missing notes', file, '' from w where status = 'complete' and json_type(v, '$.notes') is distinct from 'VARCHAR'
union all select 'zone not allowed', file, '' from w where json_type(v, '$.mrz') is not null
union all select 'pictures differ from those found', file, '' from w where image <> pic
union all select 'missing picture', file, image from w where image not in (select pic from d)
union all select 'changed digest', file, image from w join d on d.pic = image where declared <> d.sha
union all select 'not annotated', null, 'driving_license/' || id from d where id not in (select id from w)""")
def annotation_issues(s, d):
    docs = t(s, d, "documents").select("doc_id", "text")
    pic = F.concat(F.lit("driving_license/d"), col("doc_id").cast(S), F.lit(".jpg"))
    digests = docs.select(pic.alias("file"), F.sha2("text", 256).alias("sha256"))
    notes = docs.select(F.expr("'annotations/driving_license/d' || doc_id || '.json'").alias("file"), F.expr(_annotation_text("sha2(text, 256)")).alias("text"))
    return dataset.annotation_issues(notes, source.discovered(digests)[0], digests)


@query("""with l as (select doc_id::varchar label_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') lines from documents where doc_id % 3 <> 0),
m as (select e.event_id line, 'p' || (event_id % 50) || '.jpg' image, case when event_id % 4 = 0 then '' else (user_id % 200)::varchar end label_id, case when event_id % 4 = 0 then (user_id % 100)::varchar end source_image, nullif(event_type, 'view') as variant from events e),
f as (select distinct 'p' || page_id || '.jpg' image from pages where page_id % 2 = 0),
j as (select m.*, coalesce(nullif(m.label_id, ''), nullif(source_image, '')) own, l.lines, f.image as there from m left join l on l.label_id = coalesce(nullif(m.label_id, ''), nullif(source_image, '')) left join f on f.image = m.image)
select coalesce(issue, 'sample') outcome, coalesce(variant, 'unknown') as variant, count(*) n, sum(coalesce(len(lines), 0))::bigint lines from (select *, case when lines is null then 'label not found' when there is null then 'missing picture' end issue from j) group by all""")
def manifest_samples(s, d):
    """Events as a manifest's lines over documents as labels and pages as pictures: samples and problems, counted."""
    labels = t(s, d, "documents").where("doc_id % 3 <> 0").select(col("doc_id").cast(S).alias("label_id"), F.array_remove(F.split("text", "\n"), "").alias("lines"))
    i = col("event_id")
    m = t(s, d, "events").select(i.alias("line"), F.concat(F.lit("p"), (i % 50).cast(S), F.lit(".jpg")).alias("image"), F.when(i % 4 == 0, "").otherwise((col("user_id") % 200).cast(S)).alias("label_id"), F.when(i % 4 == 0, (col("user_id") % 100).cast(S)).alias("source_image"), F.nullif("event_type", F.lit("view")).alias("variant"), F.array().cast("array<string>").alias("augmentation"))
    files = t(s, d, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("p"), col("page_id").cast(S), F.lit(".jpg")).alias("file"))
    samples, problems = source.labelled_samples(m, labels, files)
    known = problems.where("line is not null").join(m.select("line", F.coalesce("variant", F.lit("unknown")).alias("variant"), F.coalesce(F.nullif("label_id", F.lit("")), F.nullif("source_image", F.lit(""))).alias("label_id")), "line").join(labels, "label_id", "left")
    both = samples.select(F.lit("sample").alias("outcome"), "variant", F.size("lines").alias("k")).unionByName(known.select(col("issue").alias("outcome"), "variant", F.coalesce(F.size("lines"), F.lit(0)).alias("k")))
    return both.groupBy("outcome", "variant").agg(F.count("*").alias("n"), F.sum("k").cast(L).alias("lines"))


# ---- layout profiles ----

_BOX = '{"x1":0.1,"y1":0.1,"x2":0.9,"y2":0.9}'
_PROFILE = (
    "'{\"version\":' || case when p_partkey % 8 = 0 then '2' else '1' end || ',\"layout\":\"' || p_brand || '\",\"sample_metadata\":{},\"canonical_size\":{\"width\":' || (p_size - case when p_partkey % 8 = 1 then p_size else 0 end) || ',\"height\":5},"
    f"\"regions\":{{\"front\":{{\"data_crop\":' || case when p_partkey % 8 = 2 then '{{\"x1\":0.5,\"y1\":0,\"x2\":0.5,\"y2\":1}}' else '{_BOX}' end || ',\"field_rois\":{{\"name\":{_BOX}' || case when p_partkey % 8 = 3 then ',\"p' || p_partkey || '\":{_BOX}' else '' end || '}}}}}},"
    "\"fields\":[{\"name\":\"name\",\"region\":\"' || case when p_partkey % 8 = 4 then 'back' else 'front' end || '\",\"required\":' || case when p_partkey % 8 = 5 then '1' else 'true' end || '}' || case when p_partkey % 8 = 6 then ',{\"name\":\"name\",\"region\":\"front\",\"required\":true}' else '' end || ']}'"
)


@query(f"""with p as (select p_partkey, {_PROFILE} j from part), v as (select p_partkey::varchar file, j::json v from p),
r as (select file, e.key region, e.value v from v, json_each(v.v, '$.regions') e), b as (select file, region, e.key as name, e.value box from r, json_each(r.v, '$.field_rois') e), f as (select file, e.value->>'$.name' as name, e.value->>'$.region' region, json_type(e.value, '$.required') flag from v, json_each(v.v, '$.fields') e)
select 'version or layout' issue, file, '' detail from v where (v->>'$.version') <> '1'
union all select 'canonical size', file, '' from v where (v->>'$.canonical_size.width')::int <= 0
union all select 'region rectangle', file, region from r where not ((v->>'$.data_crop.x1')::double < (v->>'$.data_crop.x2')::double)
union all select 'box without a field', file, region || '/' || name from b where not exists (select 1 from f where f.file = b.file and f.name = b.name and f.region = b.region)
union all select 'field outside its region', file, name from f where not exists (select 1 from b where f.file = b.file and f.name = b.name and f.region = b.region)
union all select 'required is no flag', file, name from f where flag <> 'BOOLEAN'
union all select 'field owned twice', file, name from f group by file, name having count(*) > 1""")
def layout_profile_issues(s, d):
    return dataset.layout_issues(t(s, d, "part").select(col("p_partkey").cast(S).alias("file"), F.expr(_PROFILE).alias("text")))
