"""Queries in the dialect over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.plans import dialect
from mapweave.session import table

# name: (query in the dialect, tables, SQL). Line items' quantities and prices are floats, keys integers.
CASES: dict[str, tuple[str, tuple[str, ...], str]] = {
    "sql_filter": (
        "select l_orderkey, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 30.0 and l_returnflag = 'R' order by l_orderkey",
        ("lineitem",),
        "select l_orderkey, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 30.0 and l_returnflag = 'R'",
    ),
    "sql_not_null_2valued": ("select l_orderkey from lineitem where not (nullif(l_returnflag, 'R') = 'A')", ("lineitem",), "select l_orderkey from lineitem where not coalesce(nullif(l_returnflag, 'R') = 'A', false)"),
    "sql_cmp_type_mismatch": ("select l_orderkey, l_quantity = 5 as eq, l_quantity <> 5 as ne from lineitem where not l_quantity < 5", ("lineitem",), "select l_orderkey, false as eq, false as ne from lineitem"),
    "sql_between": ("select l_orderkey, l_linenumber from lineitem where l_linenumber between 2 and 4 and l_quantity not between 10.0 and 20.0", ("lineitem",), "select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem where l_linenumber between 2 and 4 and not (l_quantity between 10.0 and 20.0)"),
    "sql_like_prefix": ("select p_partkey, p_type from part where p_type like 'S%' and p_name not like 'goldenrod'", ("part",), "select p_partkey, p_type from part where starts_with(p_type, 'S')"),
    "sql_in_string": ("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH', null) and o_orderstatus not in ('F')", ("orders",), "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F'"),
    "sql_in_int_quirk": ("select o_orderkey, o_custkey in (1, 2, 3) as found from orders where o_custkey not in (1, 2)", ("orders",), "select o_orderkey, false as found from orders"),
    "sql_case": ("select o_orderkey, case when o_totalprice > 200000.0 then 'high' when o_totalprice > 100000.0 then 'mid' end as band from orders", ("orders",), "select o_orderkey, case when o_totalprice > 200000.0 then 'high' when o_totalprice > 100000.0 then 'mid' end as band from orders"),
    "sql_bool_column": ("select o_orderkey, o_totalprice > 1000.0 and not o_orderstatus = 'F' as hit from orders", ("orders",), "select o_orderkey, o_totalprice > 1000.0 and o_orderstatus <> 'F' as hit from orders"),
    "sql_missing_column": ("select o_orderkey, coalesce(no_such, o_orderstatus) as x, o_custkey is not null as y from orders where nothing is null", ("orders",), "select o_orderkey, o_orderstatus as x, true as y from orders"),
    "sql_subquery": ("select k from (select o_orderkey as k, o_custkey from orders where o_orderstatus = 'O') t where k > 100", ("orders",), "select o_orderkey as k from orders where o_orderstatus = 'O' and o_orderkey > 100"),
    "sql_union_bag": ("select r_name as n from region union select r_name as n from region union all select n_name as n from nation", ("region", "nation"), "select r_name as n from region union all select r_name from region union all select n_name from nation"),
    "sql_union_by_name": ("select n_name as a, n_regionkey as b from nation union select r_regionkey as b, r_name as c from region", ("region", "nation"), "select n_name as a, n_regionkey as b from nation union all select null, r_regionkey from region"),
    "sql_values": ("select id, label from (values (1, 'a'), (2, 'it''s'), (-3, null)) as t (id, label) where id <> 2", ("region",), "select cast(id as bigint) as id, label from (values (1, 'a'), (-3, null)) as t(id, label)"),
    "sql_join_using_last_wins": (
        "select k, c_name, o_orderkey from (select c_custkey as k, c_name from customer) join latest using (k)",
        ("customer",),
        "select c_custkey as k, c_name, max(o_orderkey) as o_orderkey from customer join orders on o_custkey = c_custkey group by all",
    ),
    "sql_join_null_key": (
        "select l_orderkey, n_name from (select l_orderkey, nullif(l_linenumber, 3) as k from items) join named using (k)",
        (),
        "select l_orderkey, n_name from lineitem join (select nullif(n_nationkey, 7) as k, n_name from nation ) x on nullif(l_linenumber, 3) is not distinct from x.k",
    ),
    "sql_orderby_input": ("select 0 - l_orderkey as l_orderkey, l_linenumber as n from lineitem order by l_orderkey desc, l_linenumber", ("lineitem",), "select -l_orderkey as l_orderkey, l_linenumber::bigint as n from lineitem"),
    "fn_coalesce_nullif": ("select p_partkey, coalesce(nullif(p_brand, 'Brand#11'), p_type, 'x') as c, nullif(p_size, 7) as n from part", ("part",), "select p_partkey, coalesce(nullif(p_brand, 'Brand#11'), p_type) as c, nullif(p_size, 7)::bigint as n from part"),
    "fn_numchar": ("select p_partkey, numchar(p_name, 'e') as n, numchar(p_name, '') as m, numchar(p_size, 'e') as z from part", ("part",), "select p_partkey, (len(p_name) - len(replace(p_name, 'e', '')))::bigint as n, (len(p_name) + 1)::bigint as m, null as z from part"),
    "fn_maxwidth": ("select p_partkey, maxwidth(p_type, ' ') as w, maxwidth(p_type) as v from part", ("part",), "select p_partkey, list_max(list_transform(string_split(p_type, ' '), lambda x: strlen(x)))::bigint as w, strlen(p_type)::bigint as v from part"),
    "fn_makeinteger": ("select o_orderkey, makeinteger(substr(o_orderpriority, 1, 1)) as a, makeinteger(o_orderpriority) as b, makeinteger(o_orderkey) as c, makefloat('2.5e1') as d, makefloat('x') as e from orders", ("orders",), "select o_orderkey, substr(o_orderpriority, 1, 1)::bigint as a, 0::bigint as b, 0::bigint as c, 25.0::double as d, 0.0::double as e from orders"),
    "fn_length_bytes": ("select p_partkey, char_length(p_name || 'ü') as a, length(p_size) as b from part", ("part",), "select p_partkey, (strlen(p_name) + 2)::bigint as a, 0::bigint as b from part"),
    "fn_substr_bytes": ("select p_partkey, substr(p_type, 2, 4) as a, substr(p_type, 0, 4) as b, substr(p_type, 1, 500) as c, substr(p_type, 3, 0) as d from part", ("part",), "select p_partkey, case when strlen(p_type) >= 5 then substr(p_type, 2, 4) end as a, case when strlen(p_type) >= 3 then substr(p_type, 1, 3) end as b, null::varchar as c, null::varchar as d from part"),
    "fn_concat": ("select p_partkey, concat(p_brand, '-', p_type) as a, p_brand || p_size as b, p_brand || nullif(p_brand, 'Brand#11') as c from part", ("part",), "select p_partkey, p_brand || '-' || p_type as a, null as b, p_brand || nullif(p_brand, 'Brand#11') as c from part"),
    "fn_arith_int": ("select o_orderkey, (o_orderkey - 1000) / 7 as a, o_orderkey * 3 + o_custkey - 5 as b, 9223372036854775807 + o_orderkey as w from orders", ("orders",), "select o_orderkey, cast(trunc((o_orderkey - 1000) / 7.0) as bigint) as a, o_orderkey * 3 + o_custkey - 5 as b, case when o_orderkey = 0 then 9223372036854775807 else -9223372036854775808 + greatest(o_orderkey - 1, 0) end as w from orders"),
    "fn_arith_float": ("select l_orderkey, l_quantity + 1 as a, l_quantity * 'x' as b, 'x' + 1 as c, l_quantity / 4 as d from lineitem", ("lineitem",), "select l_orderkey, l_quantity + 1 as a, 0.0::double as b, null as c, l_quantity / 4 as d from lineitem"),
    "fn_strreplace_null": ("select p_partkey, strreplace(p_name, 'a', 'b') as r from part", ("part",), "select p_partkey, null as r from part"),
}


def _tables(spark: SparkSession, d: str, name: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    if name == "sql_join_using_last_wins":
        latest = table(spark, d, "orders", "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "k")
        return {"customer": table(spark, d, "customer"), "latest": latest}, {"latest": "o_orderkey"}
    if name == "sql_join_null_key":
        named = table(spark, d, "nation").select(F.expr("nullif(n_nationkey, 7)").alias("k"), "n_name")
        return {"items": table(spark, d, "lineitem"), "named": named}, {}
    return {t: table(spark, d, t) for t in CASES[name][1]}, {}


def _query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables, ordinals = _tables(spark, d, name)
        out = dialect.run(CASES[name][0], tables, ordinals)
        return out.select(*[F.col(c).cast("string") if t == "void" else F.col(c) for c, t in out.dtypes])

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in CASES}
SQL = {name: sql for name, (_, _, sql) in CASES.items()}
