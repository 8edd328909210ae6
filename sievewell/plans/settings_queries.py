"""Settings of many companies, checked and chosen as tables."""

from __future__ import annotations

from ..functions import web
from ..sources.settings_files import ID, NO_PROFILE, PROFILE_TAGS, RISK_TAGS
from .registry import sql_query


def _companies(d) -> str:
    """A company per customer, some with faults."""
    case = lambda key, n, cases, other: f"case {key} % {n} {' '.join(f'when {i} then {v}' for i, v in cases.items())} else {other} end"
    site = "'https://c' || cast(c_custkey as varchar(12)) || '.example'"
    tags = case("c_custkey", 7, {0: "'expat_friendly,Expat_Friendly'", 1: "'strong_wlb, rich'", 2: "''"}, "'stable_public,product_leader'")
    return f"""(select c_custkey as pos, {case("c_custkey", 11, {0: "c_name", 1: "''", 2: "'company_2'"}, "'company_' || cast(c_custkey as varchar(12))")} as id, {case("c_custkey", 13, {3: "' KITA Retail '", 5: "'kita retail'", 7: "''"}, "c_name")} as name,
        {case("c_custkey", 9, {0: "'ftp://x.example'", 1: "'http://192.168.0.4/'", 2: "'https://user:pw@x.example/'", 4: "''"}, site)} as career_url, {case("c_custkey", 5, {0: "'https://x.internal/'"}, site + " || '/en/'")} as corporate_url,
        {tags} as profile_tags, {case("c_custkey", 8, {0: "'layoff_risk,late,layoff_risk'"}, "'overtime_risk'")} as risk_tags from @customer)"""


@sql_query
def company_settings_checked(d):
    """What is wrong with the settings of every company: ids, names, addresses, tags."""
    at = lambda field: f"'companies[' || cast(pos as varchar(12)) || '].{field}"
    allowed = {"profile_tags": PROFILE_TAGS, "risk_tags": RISK_TAGS}
    items = lambda column: f"(select pos, trim(item) as item from (select pos, {d.unnest(d.split_on(column, ','))} as item from companies where {column} <> ''))"
    first = lambda column: f"(select lower(trim({column})) as k, min(pos) as first_pos from companies where trim({column}) <> '' group by 1)"
    parts = [
        f"select pos, {at('id')} cannot be blank' as error from companies where trim(id) = ''",
        f"select pos, {at('id')} must match pattern ^{ID}$' from companies where trim(id) <> '' and not {d.matches('id', f'^{ID}$')}",
        # The first of equal ids or names is right; one row a key is joined, not a window over its rows.
        f"select pos, 'Duplicate company id: ' || id from companies c join {first('id')} f on lower(trim(c.id)) = f.k where pos > first_pos",
        f"select pos, 'Duplicate company name: ' || name from companies c join {first('name')} f on lower(trim(c.name)) = f.k where pos > first_pos",
    ]
    for column in ("career_url", "corporate_url"):
        parts.append(f"select pos, {at(column)} must be a valid public http/https URL' from companies where {web.unsafe_reason(d, column)} is not null")
    for column, known in allowed.items():
        parts.append(f"select pos, {at(column)} contains unknown tag ' || item from {items(column)} where lower(item) not in ({', '.join(map(d.text, known))})")
        parts.append(f"select pos, {at(column)} contains duplicate value ' || max(item) from {items(column)} group by pos, lower(item) having count(*) > 1")
    return f"with companies as (select * from {_companies(d)}) " + " union all ".join(parts)


@sql_query
def profile_selection(d):
    """Which profile each customer's request means: by name whatever its case, none, or an error."""
    asked = f"case c_custkey % 5 when 0 then '  SUPPLIER#' || lpad(cast(c_nationkey + 1 as varchar(9)), 9, '0') || ' ' when 1 then '' when 2 then ' None ' when 3 then 'Supplier#' || lpad(cast(c_custkey as varchar(9)), 9, '0') else c_name end"
    return f"""with asked as (select c_custkey, {asked} as asked from @customer), known as (select lower(trim(s_name)) as k, min(s_name) as s_name, count(*) as n from @supplier group by 1),
    only_one as (select case when count(*) = 1 then max(s_name) end as s_name from known)
    select a.c_custkey, case when trim(asked) = '' then o.s_name when lower(trim(asked)) <> '{NO_PROFILE}' then k.s_name end as profile,
        case when trim(asked) <> '' and lower(trim(asked)) <> '{NO_PROFILE}' and k.s_name is null then 'Unknown candidate profile id: ' || trim(asked) end as error
    from asked a cross join only_one o left join known k on k.k = lower(trim(a.asked))"""
