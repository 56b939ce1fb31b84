"""SQL of the queries that SQL can express. Windows of the entropy method are recounted from scratch here."""

from __future__ import annotations

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOW = (
    r"^[^0-9]*$|^[0-9_+/=-]*$|^[a-z]+([_/-][a-z0-9]{1,12})+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|placeholder|xxxx|0123456789abcdef)"
)


def _found(kind: str, no: int, pattern: str) -> str:
    return f"select doc_id, {no} as kn, '{kind}' as kind, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits from docs"


SECRETS = rf"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as ({_found("assign", 0, _ASSIGN)} union all {_found("access", 1, "AKIA[A-Z0-9]{12,}")} union all {_found("hex", 2, "[0-9a-f]{32,}")}
          union all {_found("entropy", 3, "[A-Za-z0-9+/_=-]{20,}")}),
placed as (select doc_id, kn, kind, hits[i] as hit, cast(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint) as s
           from (select *, unnest(range(1, len(hits) + 1)) as i from found) x),
base as (select doc_id, kn, kind, s, s + length(hit) as e from placed where kn in (1, 2) or (kn = 0 and length(regexp_extract(hit, '{_ASSIGN}', 1)) >= 8)),
candidates as (select doc_id, hit, s, case when regexp_matches(hit, '^[0-9a-fA-F]+$') then 3.0 else 3.75 end as bits from placed where kn = 3 and not regexp_matches(hit, '{_ALLOW}')),
windows as (select doc_id, s, a, bits, substr(hit, a + 1, 20) as w from (select *, unnest(range(0, length(hit) - 19)) as a from candidates) x),
high as (select doc_id, s, a from windows
         where list_sum(list_transform(list_distinct(string_split(w, '')), lambda ch: round(1000000 * (20 - length(replace(w, ch, ''))) * log2(20 - length(replace(w, ch, ''))))))
               <= round(1000000 * 20 * (log2(20) - bits))),
islands as (select *, sum(fresh) over (partition by doc_id, s order by a) as island from (select *, case when a <= lag(a) over (partition by doc_id, s order by a) + 20 then 0 else 1 end as fresh from high) x),
stretches as (select doc_id, s + min(a) as s, s + max(a) + 20 as e from islands group by doc_id, s, island),
cut as (select x.doc_id, greatest(x.s, coalesce(max(b.e) filter (where b.s <= x.s), x.s)) as s, least(x.e, coalesce(min(b.s) filter (where b.s > x.s), x.e)) as e
        from stretches x left join base b on b.doc_id = x.doc_id and b.s < x.e and b.e > x.s group by x.doc_id, x.s, x.e),
spans as (select * from base union all select doc_id, 3, 'entropy', s, e from cut where e - s >= 20)
select d.doc_id, cast(count(*) filter (where kn = 0) as bigint) as n_assign, cast(count(*) filter (where kn = 1) as bigint) as n_access, cast(count(*) filter (where kn = 2) as bigint) as n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, kn, e) filter (where kn < 3), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, kn, e) filter (where kn is not null), '') as spans
from docs d left join spans p on p.doc_id = d.doc_id group by d.doc_id"""

ORACLES = {"op1_secret_scans": SECRETS}
