"""Queries of the older cleaners: numbered fields and raw zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import numbered
from attestra.plans.queries import query, t

col, L, S = F.col, "long", "string"

# Customers and parts as boxes of licences, each with its number before it, in one of several ways of writing it.
_WIDE = """select p_partkey, case p_partkey % 8 when 0 then 'surname' when 1 then 'birth_place_and_date' when 2 then 'issue_date' when 3 then 'personal_id' when 4 then 'license_number' when 5 then 'serial_number' when 6 then 'categories' else 'comment' end field,
case p_partkey % 8 when 0 then ' 1. :' || p_name || '  ' when 1 then '3. ' || p_name || case when p_size > 25 then ' ' || (p_size % 28 + 1) || '/' || (p_size % 12 + 1) || '/' || (1950 + p_size) else '' end when 2 then '4 A, ' || (p_size % 28 + 1) || '-' || (p_size % 12 + 1) || '-' || case when p_size > 40 then '19' else '2001' end
when 3 then '4d. ' || p_size || ' ' || p_partkey when 4 then '5.' || p_brand when 5 then '5.' || p_brand when 6 then '9. b,  c ' || p_brand else '  7. ' || p_name end v from part"""


@query(rf"""with v as ({_WIDE}), n as (select *, regexp_replace(trim(v), case field when 'surname' then '^1' when 'birth_place_and_date' then '^3' when 'issue_date' then '(?i)^4\s*a' when 'personal_id' then '(?i)^4\s*d' when 'license_number' then '^5' when 'categories' then '^9' else '^$' end || case when field in ('serial_number', 'comment') then '' else '[.\s:,-]*' end, '') b from v),
m as (select *, regexp_extract(b, '\b(\d{{1,2}})[.\-/](\d{{1,2}})[.\-/](\d{{4}})\b', ['d', 'm', 'y']) p, regexp_matches(b, '\b\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{4}}\b') has from n), k as (select *, case when has then lpad(p.d, 2, '0') || '.' || lpad(p.m, 2, '0') || '.' || p.y end dated from m)
select p_partkey, field, nullif(case when field = 'issue_date' then dated when field = 'personal_id' then regexp_replace(b, '\D', '', 'g') when field in ('license_number', 'serial_number') then regexp_replace(upper(b), '[^A-Z0-9]', '', 'g') when field = 'categories' then trim(regexp_replace(upper(b), '\s+', ' ', 'g'))
when field = 'birth_place_and_date' and has then trim(regexp_replace(regexp_replace(b, '\b\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{4}}\b.*$', ''), '\s+', ' ', 'g')) else trim(regexp_replace(b, '\s+', ' ', 'g')) end, '') as value, case when field = 'birth_place_and_date' then dated end date from k""")
def numbered_fields(s, d):
    """Parts as numbered boxes of a licence, cleaned."""
    got = _boxes(s, d).withColumn("got", numbered.wide_value(col("field"), col("v")))
    return got.select("p_partkey", "field", "got.value", "got.date")


def _boxes(s, d):
    n, size = col("p_partkey") % 8, col("p_size")
    names = F.array(*map(F.lit, "surname birth_place_and_date issue_date personal_id license_number serial_number categories comment".split()))
    day = lambda sep, year: F.concat((size % 28 + 1).cast(S), F.lit(sep), (size % 12 + 1).cast(S), F.lit(sep), year)
    values = F.array(
        F.concat(F.lit(" 1. :"), "p_name", F.lit("  ")), F.concat(F.lit("3. "), "p_name", F.when(size > 25, F.concat(F.lit(" "), day("/", (1950 + size).cast(S)))).otherwise("")), F.concat(F.lit("4 A, "), day("-", F.when(size > 40, "19").otherwise("2001"))),
        F.concat(F.lit("4d. "), size.cast(S), F.lit(" "), col("p_partkey").cast(S)), F.concat(F.lit("5."), "p_brand"), F.concat(F.lit("5."), "p_brand"), F.concat(F.lit("9. b,  c "), "p_brand"), F.concat(F.lit("  7. "), "p_name"),
    )
    return t(s, d, "part").select("p_partkey", F.get(names, n.cast("int")).alias("field"), F.get(values, n.cast("int")).alias("v"))


@query(rf"""with v as ({_WIDE}), n as (select *, case when field in ('surname', 'issue_date', 'personal_id', 'license_number', 'categories') then regexp_replace(v, case field when 'surname' then '^1' when 'issue_date' then '(?i)^4a' when 'personal_id' then '(?i)^4d' when 'license_number' then '^5' else '^9' end || '[.\s]*', '') else v end b from v)
select p_partkey, field, case when trim(b) = '' then null when field = 'issue_date' then replace(trim(b), ' ', '') when field in ('personal_id', 'license_number') then regexp_replace(upper(b), '[^A-Z0-9]', '', 'g') else trim(regexp_replace(b, '\s+', ' ', 'g')) end as value from n""")
def numbered_fields_narrow(s, d):
    """The same boxes, cleaned the narrow way."""
    return _boxes(s, d).select("p_partkey", "field", numbered.narrow_value(col("field"), col("v")).alias("value"))


@query("""with l as (select doc_id, trim(x) x from documents, unnest(string_split(text, chr(10))) u(x)) select d.doc_id, count(x) filter (where x <> '') line_count, coalesce(sum(length(x)), 0)::bigint characters, count(x) filter (where x <> '') = 2 and count(x) filter (where x <> '' and length(x) <> 44) = 0 looks_like_td3 from documents d left join l using (doc_id) group by 1""")
def zone_shapes(s, d):
    """Documents as zones as read: lines, characters, whether they have a passport zone's shape."""
    got = t(s, d, "documents").select("doc_id", numbered.zone_shape(col("text")).alias("z"))
    total = F.aggregate("z.lines", F.lit(0).cast(L), lambda a, x: a + x["length"])
    return got.select("doc_id", col("z.line_count").cast(L).alias("line_count"), total.alias("characters"), "z.looks_like_td3")
