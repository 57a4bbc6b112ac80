"""Logical views over the test tables: the same SQL text on both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # A spectrum per order; the customer stands for the compound, one in seven has no key.
    "v_spectra": """select cast(o_orderkey as string) as spec_id, o_orderkey as pos,
        case when o_custkey % 7 = 0 then null else concat(upper(substr(md5(cast(o_custkey as string)), 1, 14)), '-UHFFFAOYSA-N') end as inchikey,
        case when o_orderstatus = 'P' then null else concat('Mode', o_orderstatus) end as ionmode,
        case when o_orderkey % 11 = 0 then null else o_orderpriority end as charge, o_totalprice as precursor_mz,
        concat('S', cast(o_custkey as string)) as smiles, concat(' I', cast(o_orderkey % 5 as string), ' ') as instrument_type,
        case when o_orderkey % 3 = 0 then '' else concat('A', cast(o_orderkey % 2 as string)) end as adduct,
        case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 9 as string) end as collision_energy from {orders}""",
    "v_spec_to_comp": """select cast(o_orderkey as string) as spec_id, upper(substr(md5(cast(o_custkey as string)), 1, 14)) as comp_id
        from {orders} where o_custkey % 7 <> 0""",
    "v_peaks": """select cast(l_orderkey as string) as spec_id, l_orderkey as pos, l_linenumber as n,
        cast(floor(l_extendedprice) as double) / 100 as mz, l_quantity as intensity from {lineitem}""",
    "v_embeddings": "select cast(vec_id as string) as spec_id, vec_id as pos, embedding as vec from {embeddings}",
    "v_labels": "select vec_id as pos, label from {embeddings}",
    "v_emb_map": """select cast(vec_id as string) as spec_id, concat('C', cast(vec_id % 60 + 1 as string)) as comp_id from {embeddings}""",
    # A fingerprint per supplier: parts are bits, lines are counts.
    "v_fp": """select concat('C', cast(l_suppkey as string)) as comp_id, l_partkey as bit, cast(count(*) as double) as value
        from {lineitem} group by l_suppkey, l_partkey""",
    "v_groups": """select concat('C', cast(s_suppkey as string)) as comp_id, s_nationkey as grp, s_suppkey % 3 + 1 as weight from {supplier}""",
    # Requests over the whole range of keys: some repeated, some that nothing has.
    "v_request": """select c_custkey as pos, cast((c_custkey - c_custkey % 2) * 11 as string) as spec_id,
        upper(substr(md5(cast((c_custkey - c_custkey % 3) * 2 as string)), 1, 14)) as comp_id from {customer}""",
    "v_keys": """select c_custkey as pos, case c_custkey % 9 when 0 then null when 1 then '' when 2 then 'ab-cd'
        when 3 then concat(' ', substr(md5(cast(c_custkey as string)), 1, 14), '-UHFF-N ') when 4 then md5(cast(c_custkey as string))
        when 5 then 'short' when 6 then '-X' when 7 then concat(md5(cast(c_custkey as string)), '-A')
        else upper(substr(md5(cast(c_custkey % 50 as string)), 1, 14)) end as inchikey from {customer}""",
    "v_compounds": """select upper(substr(md5(cast(c_custkey as string)), 1, 14)) as comp_id, c_name as smiles,
        case when c_custkey % 3 = 0 then null else concat('InChI=', c_name) end as inchi, c_mktsegment as classyfire_class from {customer}""",
    "v_updates": """select c_custkey as pos, upper(substr(md5(cast(c_custkey * 2 as string)), 1, 14)) as comp_id,
        case when c_custkey % 4 = 0 then null else concat('new', c_name) end as smiles,
        case when c_custkey % 5 = 0 then 'InChI=new' end as inchi, cast(null as string) as classyfire_class from {customer}""",
    "v_wide": """select c_custkey as pos, case when c_custkey % 10 = 0 then 'SHORT' else
        concat(' ', upper(substr(md5(cast(c_custkey % 800 as string)), 1, 14))) end as nchikey, c_name as smiles, c_mktsegment as cf_class, c_acctbal as mass from {customer}""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """The views over the tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(_NAME.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """``sql`` for the other engine, with the views it names put in front."""
    need = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} as ({_NAME.sub(r'\1', VIEWS[v])})" for v in need)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[14:].strip()}" if ctes else body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:].strip()}" if ctes else body
    return f"with {ctes} {body}" if ctes else body
