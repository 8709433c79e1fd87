"""DuckDB text for the input views; a query's SQL names the views it needs and gets them prepended."""

from __future__ import annotations

import re

from sitelake.functions import dims
from sitelake.plans import inputs as I


def values(rows, columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) t({columns})"


def r(expr: str, digits: int = 6) -> str:
    """The same double arithmetic as ``exprs.rounded``."""
    scale = f"1e{digits}"
    return f"(floor(({expr})::double * {scale} + 0.5e0) / {scale})"


_motifs = " union all ".join(
    f"select *, '{s}' as source, {c} as copy from o_hash where {m}" for s, c, m in I.SOURCE_MOTIFS)

VIEWS: dict[str, str] = {
    "o_types": values(dims.type_rows(), "type, stratum"),
    "o_strata": values(dims.stratum_rows(), "stratum, residue, stratum_order"),
    "o_spell": values(dims.spelling_rows(), "spelling_key, spelled_type"),
    "o_byres": values(dims.by_residue_rows(), "resolved_key, resolved_residue, resolved_type"),
    "o_seq": """select doc_id as pid, 'P' || doc_id as accession, sequence, length(sequence) as length, source, lang from
        (select *, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as sequence from documents) where length(sequence) > 0""",
    "o_prot": """select *, min(pid) over (partition by sequence) as cluster_id, case when pid % 10 < 7 then 'discovery_train'
        when pid % 10 = 7 then 'discovery_val' else 'held_out' end as partition from o_seq""",
    "o_letters": """select pid, accession, length, lang, cluster_id, partition, unnest(string_split(sequence, '')) as residue,
        generate_subscripts(string_split(sequence, ''), 1) as position from o_prot""",
    "o_ctx": """select *, coalesce(lag(residue) over (partition by pid order by position), '') as prev,
        coalesce(lead(residue) over (partition by pid order by position), '') as next from o_letters""",
    "o_hash": f"select *, {I.ROW_HASH} as h from o_ctx",
    "o_hits": _motifs,
    "o_raw": f"""select source, {I.RAW_ACCESSION} as accession, {I.RAW_POSITION} as position, {I.RAW_TYPE} as type,
        {I.RAW_EVIDENCE} as evidence, ({I.RAW_RELIABILITY})::bigint as reliability, {I.RAW_SPECIES} as species,
        substr(source, 2)::bigint as source_rank, position * 10 + copy as row_no, pid, lang from o_hits""",
    "o_gold": f"""select accession, position, case when h < 60 then 'Non-glycosylated' else 'Glycosylated' end as label
        from o_hash where residue = 'N' and next in ('E', 'A')""",
    "o_vec": """select vec_id // 20 as pid, vec_id % 20 + 1 as position, embedding as vec, label::bigint as label, vec_id from embeddings""",
    "o_dictlong": """select label * 4 + vec_id % 4 as latent, d, avg(x::double) as w from (select vec_id, label,
        generate_subscripts(embedding, 1) as d, unnest(embedding) as x from embeddings) group by all""",
    "o_dict": "select latent::bigint as latent, list(w order by d) as w from o_dictlong group by latent",
    "o_fire": "select event_id // 100 as batch, user_id as latent, value, value > 60 as fired, event_id from events",
    "o_log": "select user_id % 8 as run, event_type as metric, event_id as step, value from events",
    "o_sprot": """select o_orderkey as uniprot_id, o_custkey as cluster_id, floor(o_totalprice / 1000)::bigint + 1 as length,
        o_orderpriority as sequence from orders""",
    "o_ssite": "select l_orderkey as uniprot_id, l_returnflag as type_pooled, l_linenumber > 3 as crosstalk from lineitem",
}


def define(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(body: str) -> str:
    """Prepend, in definition order, every view the body names directly or through another view."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bo_\w+\b", text)) & VIEWS.keys():
            if name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    # A view that is read more than once is computed once.
    texts = [VIEWS[name] for name in needed] + [body]
    often = {name for name in needed if sum(len(re.findall(rf"\b{name}\b", text)) for text in texts) > 1}
    ctes = ",\n".join(f"{name} as {'materialized ' if name in often else ''}({VIEWS[name]})" for name in VIEWS if name in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
