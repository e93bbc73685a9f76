"""Shared fragments of the DuckDB oracles."""

from __future__ import annotations

STEM = """case when right(t,3)='ing' and length(t)>6 then left(t,length(t)-3) when right(t,3)='ers' and length(t)>6 then left(t,length(t)-3)
 when right(t,3)='ies' and length(t)>6 then left(t,length(t)-3)||'y' when right(t,3)='ied' and length(t)>6 then left(t,length(t)-3)||'y'
 when right(t,2)='ed' and length(t)>5 then left(t,length(t)-2) when right(t,2)='es' and length(t)>5 then left(t,length(t)-2) when right(t,1)='s' and length(t)>4 then left(t,length(t)-1) else t end"""


def tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower(regexp_replace(strip_accents(coalesce({text},'')), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+'), lambda t: {STEM})"


def bm25(source: str, fields: dict[str, str], terms: list[str], boosts: dict[str, float]) -> str:
    """CTEs ending in bm(id, bm25_score); source must give id and the fields' columns."""
    counts = {t: terms.count(t) for t in terms}
    values = ", ".join(f"('{t}', {n})" for t, n in counts.items())
    boost = ", ".join(f"('{f}', {b})" for f, b in boosts.items())
    union = " union all ".join(f"select id, '{f}' as field, {tokens(c)} as toks from {source}" for f, c in fields.items())
    return f"""bt as ({union}), bl as (select id, field, len(toks) as dl, toks from bt),
bp as (select id, field, dl, term, count(*) as tf from (select id, field, dl, unnest(toks) as term from bl) group by all),
bs as (select field, count(*) as n, avg(dl) as avgdl from bl group by field),
br as (select field, term, ln(n - nd + 0.5) - ln(nd + 0.5) as raw from (select field, term, count(*) as nd from bp group by all) join bs using (field)),
bf as (select field, 0.25 * avg(raw) as floor from br group by field),
bi as (select field, term, case when raw < 0 then floor else raw end as idf from br join bf using (field)),
bq(term, qtf) as (values {values}), bb(field, boost) as (values {boost}),
bm as (select id, sum(boost * qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as bm25_score from bp join bq using (term) join bi using (field, term) join bs using (field) join bb using (field) group by id having sum(boost * qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) > 0)"""


def ranked(source: str, score: str, k: int, rank: str, name: str) -> str:
    """CTE `name`: the k best of source by score at 12 digits and id, ranks from 0."""
    return f"{name} as (select id, round({score}, 12) as {score}, row_number() over (order by round({score}, 12) desc, id) - 1 as {rank} from {source} qualify row_number() over (order by round({score}, 12) desc, id) <= {k})"
