"""Queries over what is known of companies, and numbers of keys however frequent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB as D, SPARK, Spark
from ..operators.company_context import with_context
from ..operators.numbering import numbered
from ..sources.context_files import contexts
from ..sources.postings import postings, postings_sql
from .registry import query


def _companies(d: Spark) -> str:
    """Every fifth customer: some named as in postings, some by a part of that, some by more than that."""
    name = "case c_custkey % 3 when 0 then upper(substr(c_name, 1, length(c_name) - 1)) when 1 then 'The ' || c_name || ' Group' else '  ' || c_name end"
    return f"select c_custkey as ordinal, 'ID ' || c_name as company_id, {name} as company_name from @customer where c_custkey % 5 = 0"


def _files() -> str:
    """Up to three files of a company; JSON is YAML. The first extension tells more than the others."""
    said = "to_json(named_struct('company_name', c_name, 'summaries', array('Serves ' || c_mktsegment, 'SERVES ' || c_mktsegment, ' '), 'sources', array(named_struct('page_title', 'Careers')), 'links', array(named_struct('title', 'careers'), named_struct('title', 'Blog ' || c_custkey))))"
    file = lambda extension, text, some: f"select 'contexts/id-customer-' || substr(c_name, 10) || '.{extension}' as source_file, {text} as raw_text from @customer where {some}"
    return " union all ".join([file("yaml", said, "c_custkey % 4 = 0"), file("yml", "'- a list of ' || c_custkey", "c_custkey % 8 in (0, 1)"), file("txt", "'Known as ' || c_name", "c_custkey % 4 <> 3")])


def _with_context_sql() -> str:
    name = D.norm("company_name")
    context = "case when c_custkey % 4 = 0 then c_name || ' Serves ' || c_mktsegment || ' Careers Blog ' || c_custkey when c_custkey % 8 = 1 then '- a list of ' || c_custkey when c_custkey % 4 <> 3 then 'Known as ' || c_name else '' end"
    return f"""with known as (select ordinal, {name} as known from ({_companies(D).replace('@', '')})),
    told as (select distinct {name} as name from {postings_sql(D)}),
    first as (select t.name, min(k.ordinal) as ordinal from told t join known k on t.name <> '' and (contains(t.name, k.known) or contains(k.known, t.name)) group by 1)
    select p.ordinal, p.company_name, coalesce({context}, '') as company_context from {postings_sql(D)} p left join first f on f.name = {D.norm('p.company_name')} left join customer on c_custkey = f.ordinal"""


@query(_with_context_sql())
def company_context(spark, sf_dir):
    """What files tell of each posting's company, by the first tracked company whose name fits."""
    over = lambda sql: spark.sql(sql.replace("@customer", f"parquet.`{sf_dir}/customer.parquet`"))
    return with_context(postings(spark, sf_dir), over(_companies(SPARK)), contexts(over(_files()))).select("ordinal", "company_name", "company_context")


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_orderkey * 8 + l_linenumber) as turn from lineitem")
def numbered_hot_keys(spark, sf_dir):
    """The place of each line among those of its flag: a few keys, the most frequent of which holds half of the rows."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    return numbered(lines, ("l_returnflag",), "place", range_rows=1_000).select("l_orderkey", "l_linenumber", "turn")
