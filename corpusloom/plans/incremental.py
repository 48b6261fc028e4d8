"""Queries over the crawler's tables that find what is due."""

from __future__ import annotations

from corpusloom.operators import incremental
from corpusloom.session import table

#: char(9) to char(13), the space and its Unicode kin, as trailing white space in DuckDB.
_BLANK = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$"


def p1_found(spark, folder):
    return incremental.stages_due(table(spark, folder, "resource"), table(spark, folder, "resource_text"), table(spark, folder, "chunk"))


def queries():
    return {"p1_found": p1_found}


def oracle_sql():
    return {
        "p1_found": rf"""
with r as (select distinct id, lower(sha256) sha from resource where sha256 is not null),
t as (select distinct resource_id, lower(sha256) sha, status, length(text) full_end,
             length(regexp_replace(text, '{_BLANK}', '')) least_end from resource_text),
k as (select distinct resource_id, chunk_index, lower(source_sha) sha, char_end from chunk),
c as (select resource_id, count(distinct chunk_index) n, min(chunk_index) lo, max(chunk_index) hi,
             min(sha) sha_lo, max(sha) sha_hi, count(*) - count(sha) lost, max_by(char_end, chunk_index) last_end
      from k group by 1),
s as (select r.id, t.status, t.sha, c.n,
             c.n is not null and c.sha_lo = t.sha and c.sha_hi = t.sha and c.lost = 0 and c.lo = 0 and c.hi = c.n - 1
             and c.last_end between t.least_end and t.full_end as complete
      from r left join t on t.resource_id = r.id and t.sha = r.sha left join c on c.resource_id = r.id)
select id as resource_id,
       case when sha is null then 'extract' when status = 'ok' then 'embed' else 'clear' end as stage
from s where sha is null or (status <> 'ok' and n is not null) or (status = 'ok' and not coalesce(complete, false))
"""
    }
