"""The registered queries in plain SQL, for DuckDB over the same tables.

Written from the definitions (row_number, RANGE frames, quantile_cont), not from
the Spark plans, so that both sides can only agree by computing the same thing.
"""

from __future__ import annotations


def _u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 13))::bigint / 4503599627370496.0::double)"


def _dec(column: str) -> str:
    return f"cast({column} as decimal(18,2))"


_MONEDA = (
    f"case when {_u('o_orderkey', 'moneda')} < 0.75 then 'GTQ' "
    f"when {_u('o_orderkey', 'moneda')} < 0.95 then 'USD' else 'EUR' end"
)
_ESTADO = "case o_orderstatus when 'O' then 'ACTIVA' when 'F' then 'CERRADA' else 'CONGELADA' end"
_TX_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

_NULLED = (
    "select o_orderkey as transaccion_id, o_custkey as cliente_id, o_orderdate as timestamp_tx, "
    f"case when {_u('o_orderkey', 'nulos')} < 0.02 then null else {_dec('o_totalprice')} end as monto "
    "from orders"
)

_SCORE = f"""
tx as (
  select l_orderkey, o_custkey as c, cast(l_extendedprice as double) as m, l_suppkey
  from lineitem join orders on l_orderkey = o_orderkey),
z as (
  select c, m, avg(m) over (partition by c) as a, stddev_samp(m) over (partition by c) as s from tx),
amount as (
  select c, count(*) filter (where s > 0 and (m - a) / s > 2.0) / cast(count(*) as double) as r
  from z group by c),
geo as (
  select c, count(*) filter (where s_nationkey <> c_nationkey) / cast(count(*) as double) as r
  from tx join customer on c = c_custkey join supplier on l_suppkey = s_suppkey group by c),
hourly as (
  select user_id as c, count(*) over (partition by user_id order by ts
    range between interval 1 hour preceding and current row) as n from events),
velocity as (
  select c, count(*) filter (where n >= 3) / cast(count(*) as double) as r from hourly group by c),
scored as (
  select c_custkey as cliente_id,
    round(coalesce(amount.r, 0), 4) as tasa_monto,
    round(coalesce(geo.r, 0), 4) as tasa_geo,
    round(coalesce(velocity.r, 0), 4) as tasa_frecuencia,
    round(0.4::double * coalesce(amount.r, 0) + 0.3::double * coalesce(geo.r, 0)
      + 0.3::double * coalesce(velocity.r, 0), 4) as score
  from customer
  left join amount on amount.c = c_custkey
  left join geo on geo.c = c_custkey
  left join velocity on velocity.c = c_custkey)
"""

_DORMANT = f"""
moves as (select l_orderkey, max(l_shipdate) as last from lineitem group by 1),
dormant as (
  select o_orderkey as cuenta_id, o_custkey as cliente_id, {_ESTADO} as estado,
    cast(last as date) as ultimo_movimiento,
    datediff('day', cast(last as date), (select cast(max(l_shipdate) as date) from lineitem)) as dias,
    last is null as nunca
  from orders left join moves on l_orderkey = o_orderkey)
"""

_CHURN = """
churned as (
  select o_custkey as cliente_id, cast(max(o_orderdate) as date) as ultimo_movimiento,
    datediff('day', cast(max(o_orderdate) as date),
      (select cast(max(o_orderdate) as date) from orders)) as dias
  from orders group by 1)
"""

_SEGMENTS = f"""
rfm as (
  select o_custkey as cliente_id,
    datediff('day', cast(max(o_orderdate) as date),
      (select cast(max(o_orderdate) as date) from orders)) as recencia,
    count(*) as frecuencia, cast(sum({_dec('o_totalprice')}) as double) as monto
  from orders group by 1),
cuts as (
  select quantile_cont(recencia, [0.25, 0.5, 0.75]) as qr,
    quantile_cont(frecuencia, [0.25, 0.5, 0.75]) as qf,
    quantile_cont(monto, [0.25, 0.5, 0.75]) as qm from rfm),
bands as (
  select rfm.*,
    4 - (recencia > qr[1])::bigint - (recencia > qr[2])::bigint - (recencia > qr[3])::bigint as r,
    1 + (frecuencia > qf[1])::bigint + (frecuencia > qf[2])::bigint + (frecuencia > qf[3])::bigint as f,
    1 + (monto > qm[1])::bigint + (monto > qm[2])::bigint + (monto > qm[3])::bigint as m
  from rfm, cuts),
segments as (select *, r * 100 + f * 10 + m as segmento_rfm from bands)
"""

# The same over the rows up to a day; ages are counted from that day.
_UNTIL = """
orders_until as (select * from orders where o_orderdate < timestamp '1999-07-01'),
lineitem_until as (select * from lineitem where l_shipdate < timestamp '1999-07-01'),
events_until as (select * from events where ts < timestamp '2024-01-16')
"""


def _as_of(text: str) -> str:
    """Facts cut at the day; accounts themselves (orders as accounts) are not facts."""
    return (
        text.replace("from lineitem join orders", "from lineitem_until join orders")
        .replace("from lineitem group", "from lineitem_until group")
        .replace("from events)", "from events_until)")
        .replace("from orders group", "from orders_until group")
        .replace("(select cast(max(l_shipdate) as date) from lineitem)", "date '1999-06-30'")
        .replace("(select cast(max(o_orderdate) as date) from orders)", "date '1999-06-30'")
    )


SQL: dict[str, str] = {
    "bronze_scan": f"""
select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
  cast({_dec('o_totalprice')} as varchar) as o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority,
  'orders.parquet' as source_file, date '2025-01-01' as ingest_date
from orders""",
    "json_extract": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "filter_active": f"""
select o_orderkey as cuenta_id, o_custkey as cliente_id, o_orderpriority as tipo_cuenta,
  o_totalprice as saldo_inicial from orders where o_orderstatus = 'O'""",
    "account_country": """
select o_orderkey as cuenta_id, n_name as pais
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus = 'O'""",
    "filter_group_sum": f"""
select o_orderpriority as categoria, cast(sum({_dec('o_totalprice')}) as double) as monto
from orders where o_totalprice > 100000 group by 1""",
    "active_tx_semi": f"""
select {_TX_ID} as transaccion_id, l_orderkey as cuenta_id, l_extendedprice as monto
from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')""",
    "tx_direction": f"""
select l_returnflag as tipo_tx, cast(case when l_returnflag = 'R' then 1 else -1 end as bigint) as signo,
  count(*) as n_tx,
  cast(sum(case when l_returnflag = 'R' then {_dec('l_extendedprice')} else -{_dec('l_extendedprice')} end)
    as double) as flujo
from lineitem group by 1, 2""",
    "table_counts": " union all ".join(
        f"select '{t}' as tabla, count(*) as n_rows from {t}"
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")
    ),
    "key_format": """
select *, regexp_full_match(cliente, 'CLI[0-9]{6,}') as cliente_ok,
  regexp_full_match(transaccion, 'TX[0-9]{10,}') as transaccion_ok,
  regexp_full_match(sin_relleno, 'TX[0-9]{10,}') as sin_relleno_ok
from (select o_orderkey, printf('CLI%06d', o_custkey) as cliente,
  printf('TX%010d', o_orderkey * 10000000) as transaccion, 'TX' || o_orderkey as sin_relleno from orders)""",
    "ts_arith": """
select o_orderkey, cast(o_orderdate as date) + cast(o_orderkey % 400 as integer) as fecha_mas,
  o_orderdate + to_seconds(o_orderkey % 100000) as ts_mas,
  datediff('day', date '1995-01-01', cast(o_orderdate as date)) as dias,
  datediff('second', timestamp '1995-01-01', o_orderdate + to_seconds(o_orderkey % 100000)) as segundos
from orders""",
    "tx_home_country": f"""
select l_orderkey as cuenta_id, {_TX_ID} as transaccion_id, n_name as pais
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey where o_orderstatus = 'O'""",
    "enrich_tx": f"""
select l_orderkey as cuenta_id, {_TX_ID} as transaccion_id, l_shipdate as timestamp_tx,
  l_extendedprice as monto, l_returnflag as tipo_tx, sn.n_name as pais_tx, o_custkey as cliente_id,
  o_orderpriority as tipo_cuenta, {_MONEDA} as moneda, {_ESTADO} as estado, cn.n_name as pais,
  c_mktsegment as segmento
from lineitem join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey
join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation cn on c_nationkey = cn.n_nationkey""",
    "never_moved": f"""
select o_orderkey as cuenta_id, o_custkey as cliente_id, {_ESTADO} as estado
from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "type_validation": f"""
with spoiled as (
  select event_id,
    case when {_u('event_id', 'texto')} < 0.02 then 'abc'
      when {_u('event_id', 'vacio')} < 0.02 then ''
      else cast({_dec('value')} as varchar) end as m,
    case when {_u('event_id', 'fecha')} < 0.02 then '2022-13-45'
      else cast(cast(ts as date) as varchar) end as f
  from events)
select cast(event_id as varchar) as transaccion_id,
  cast(try_cast(m as decimal(18,2)) as double) as monto, try_cast(f as date) as fecha,
  concat_ws(',', case when m = 'abc' then 'tipo:monto' end, case when m = '' then 'nulo:monto' end,
    case when f = '2022-13-45' then 'tipo:fecha' end) as motivos
from spoiled""",
    "silver_reconciliation": f"""
with t as (
  select concat_ws('-', l_orderkey, l_linenumber) as k, {_TX_ID} as id from lineitem),
m as (
  select k, case when {_u('id', 'texto')} < 0.02 then 'tipo:monto'
    when {_u('id', 'vacio')} < 0.02 then 'nulo:monto' else '' end as destino from t),
c as (
  select count(*) as todas, count(*) filter (where destino = '') as tipadas,
    count(distinct case when destino = '' then k end) as aceptadas from m)
select 'transacciones' as tabla, 'recibidas' as destino, todas as n_filas from c
union all select 'transacciones', 'aceptadas', aceptadas from c
union all select 'transacciones', 'copias', tipadas - aceptadas from c
union all select 'transacciones', destino, count(*) from m where destino <> '' group by destino""",
    "dedup_tx": """
select * exclude (rn) replace (l_linenumber::bigint as l_linenumber)
from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc,
    l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) as rn from lineitem)
where rn = 1""",
    "quarantine_nulls": f"select * replace (cast(monto as double) as monto) from ({_NULLED}) where monto is null",
    "dq_not_null": f"""
with t as ({_NULLED})
select 'not_null:transaccion_id' as "check", count(*) as n_rows,
  count(*) filter (where transaccion_id is null) as n_failed from t
union all select 'not_null:cliente_id', count(*), count(*) filter (where cliente_id is null) from t
union all select 'not_null:timestamp_tx', count(*), count(*) filter (where timestamp_tx is null) from t
union all select 'not_null:monto', count(*), count(*) filter (where monto is null) from t""",
    "dq_unique": """
select 'unique:lineitem' as "check", count(*) as n_rows,
  count(*) - count(distinct (l_orderkey, l_linenumber)) as n_failed from lineitem
union all
select 'unique:orders', count(*), count(*) - count(distinct o_orderkey) from orders""",
    "dq_relationships": """
select 'relationship:tx.cuenta' as "check", count(*) as n_rows,
  count(*) filter (where l_orderkey not in (select o_orderkey from orders)) as n_failed from lineitem
union all
select 'relationship:tx.cuenta_activa', count(*),
  count(*) filter (where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O'))
from lineitem
union all
select 'relationship:cuenta.cliente', count(*),
  count(*) filter (where o_custkey not in (select c_custkey from customer)) from orders""",
    "dq_temporal": """
select 'temporal:tx_antes_de_apertura' as "check", count(*) as n_rows,
  count(*) filter (where cast(l_shipdate as date) < cast(o_orderdate as date)) as n_failed
from lineitem left join orders on l_orderkey = o_orderkey""",
    "dq_inactive_account_tx": """
select 'inactive_account_tx' as "check", count(*) as n_rows,
  count(*) filter (where o_orderstatus <> 'O') as n_failed
from lineitem left join orders on l_orderkey = o_orderkey""",
    "dq_accepted_values": f"""
select 'accepted:estado' as "check", count(*) as n_rows,
  count(*) filter (where o_orderstatus not in ('O', 'F', 'P')) as n_failed from orders
union all select 'accepted:moneda', count(*),
  count(*) filter (where {_u('o_orderkey', 'moneda_mala')} < 0.02) from orders
union all select 'accepted:tipo_cuenta', count(*),
  count(*) filter (where o_orderpriority = '5-LOW') from orders""",
    "dq_pair_in_seed": f"""
with seed as (select r_name as region, n_name as pais from nation join region on n_regionkey = r_regionkey),
placed as (
  select r_name as region, n_name as pais from customer join nation on c_nationkey = n_nationkey
  join region on r_regionkey = (n_regionkey + case when {_u('c_custkey', 'region')} < 0.02 then 1 else 0 end) % 5)
select 'pair:region_pais' as "check", count(*) as n_rows,
  count(*) filter (where (region, pais) not in (select (region, pais) from seed)) as n_failed from placed""",
    "dq_range_by_type": """
select 'range:monto' as "check", count(*) as n_rows, count(*) filter (where case event_type
  when 'signup' then value not between 0.05 and 300
  when 'error' then value not between 0.01 and 250.5
  when 'view' then value not between 1 and 200
  when 'purchase' then value not between 5 and 500
  when 'click' then value not between 0.01 and 100 else false end) as n_failed from events""",
    "dq_conditional_null": f"""
select 'conditional_null:monto' as "check", count(*) as n_rows,
  count(*) filter (where {_u('event_id', 'condicional')} < 0.02) as n_failed from events""",
    "weighted_choice": f"""
select o_orderkey, case when {_u('o_orderkey', 'segmento')} < 0.75 then 'PERSONAL'
    when {_u('o_orderkey', 'segmento')} < 0.9 then 'PREMIUM' else 'BUSINESS' end as segmento,
  round(100::double + 49900::double * {_u('o_orderkey', 'saldo')}, 2) as saldo,
  cast(floor({_u('o_orderkey', 'dia')} * 1461) as bigint) as dia
from orders""",
    "sample_n": f"""
select o_orderkey, o_custkey from (
  select *, row_number() over (order by {_u('o_orderkey', 'muestra')}, o_orderkey) as rn,
    count(*) over () as n from orders)
where rn <= floor(0.01 * n)""",
    "null_inject": f"select * replace (cast(monto as double) as monto) from ({_NULLED})",
    "dup_inject": f"""
with t as (select o_orderkey as transaccion_id, o_custkey as cliente_id, o_orderdate as timestamp_tx,
  o_totalprice as monto from orders)
select * from t union all select * from t where {_u('transaccion_id', 'copias')} < 0.01""",
    "assign_fk": f"""
with parents as (select c_custkey,
  row_number() over (order by {_u('c_custkey', 'titular')}, c_custkey) - 1 as i from customer),
draws as (select o_orderkey, cast(floor({_u('o_orderkey', 'titular:draw')} * n) as bigint) as i
  from orders, (select count(*) as n from customer))
select o_orderkey, c_custkey from draws join parents using (i)""",
    "fan_out": f"""
select c_custkey, unnest(range(1, 2 + cast(floor({_u('c_custkey', 'cuentas')} * 3) as bigint))) as n_cuenta
from customer""",
    "foreign_candidates": f"""
with names as (select list(n_name order by n_name) as l from nation),
t as (select c_custkey as cliente_id, n_name as pais, list_filter(l, lambda x: x <> n_name) as o
  from customer join nation on c_nationkey = n_nationkey, names)
select cliente_id, pais, array_to_string(o, ',') as candidatos,
  case when {_u('cliente_id', 'lugar')} < 0.95 then pais
    else o[1 + cast(floor({_u('cliente_id', 'lugar:pick')} * len(o)) as bigint)] end as pais_tx
from t""",
    "daily_tx": f"""
select cast(o_orderdate as date) as fecha, n_name as pais, c_mktsegment as segmento, count(*) as n_tx,
  count(distinct o_custkey) as n_clientes, cast(sum({_dec('o_totalprice')}) as double) as monto_total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1, 2, 3""",
    "daily_tx_as_of": f"""
select cast(o_orderdate as date) as fecha, n_name as pais, c_mktsegment as segmento, count(*) as n_tx,
  count(distinct o_custkey) as n_clientes, cast(sum({_dec('o_totalprice')}) as double) as monto_total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderdate < timestamp '1999-07-01' group by 1, 2, 3""",
    "daily_tx_by_client": f"""
select cast(o_orderdate as date) as fecha, n_name as pais, c_mktsegment as segmento,
  o_custkey as cliente_id, count(*) as n_tx, cast(sum({_dec('o_totalprice')}) as double) as monto_total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1, 2, 3, 4""",
    "velocity_hourly": """
select user_id as cliente_id, cast(date_trunc('hour', ts) as timestamp) as hora, count(*) as n_tx
from events group by 1, 2""",
    "fraud_amount": """
select event_id as transaccion_id, user_id as cliente_id, value as monto, round(z, 4) as z from (
  select *, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as z
  from events window w as (partition by user_id))
where z > 3""",
    "fraud_burst": f"""
select cliente_id, timestamp_tx, max(n_tx) as n_tx, max(n_ventana) as n_ventana,
  cast(max(suma) as double) as suma_ventana
from (select user_id as cliente_id, ts as timestamp_tx,
    count(*) over (partition by user_id, ts) as n_tx, count(*) over w as n_ventana,
    sum({_dec('value')}) over w as suma
  from events window w as (partition by user_id order by ts
    range between interval 1 hour preceding and current row))
where n_ventana >= 2 group by 1, 2""",
    "fraud_velocity": """
select cliente_id, timestamp_tx, max(n_tx) as n_tx, max(n_ventana) as n_ventana
from (select user_id as cliente_id, ts as timestamp_tx,
    count(*) over (partition by user_id, ts) as n_tx,
    count(*) over (partition by user_id order by ts
      range between interval 1 hour preceding and current row) as n_ventana
  from events)
where n_ventana >= 3 group by 1, 2""",
    "fraud_burst_tx": f"""
select * from (select event_id as transaccion_id, user_id as cliente_id, ts as timestamp_tx, value as monto,
    count(*) over w as n_ventana, cast(sum({_dec('value')}) over w as double) as suma_ventana
  from events window w as (partition by user_id order by ts
    range between interval 1 hour preceding and current row))
where n_ventana >= 2""",
    "fraud_velocity_tx": """
select * from (select event_id as transaccion_id, user_id as cliente_id, ts as timestamp_tx,
    count(*) over (partition by user_id order by ts
      range between interval 1 hour preceding and current row) as n_ventana
  from events)
where n_ventana >= 3""",
    "fraud_travel_tx": f"""
with points as (
  select distinct l_orderkey as cuenta_id, l_shipdate as timestamp_tx, n_name as pais_tx
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
seen as (
  select *, lag(timestamp_tx) over w as timestamp_tx_previo, lag(pais_tx) over w as pais_tx_previo
  from points window w as (partition by cuenta_id order by timestamp_tx, pais_tx))
select {_TX_ID} as transaccion_id, cuenta_id, timestamp_tx, pais_tx, timestamp_tx_previo, pais_tx_previo
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
join seen on cuenta_id = l_orderkey and timestamp_tx = l_shipdate and pais_tx = n_name
where pais_tx <> pais_tx_previo and timestamp_tx - timestamp_tx_previo <= interval 1 day""",
    "fraud_amount_rate": """
select user_id as cliente_id,
  round(count(*) filter (where value > a + 3 * s) / cast(count(*) as double), 6) as tasa_monto
from (select user_id, value, avg(value) over w as a, stddev_samp(value) over w as s
  from events window w as (partition by user_id)) group by 1""",
    "fraud_geo": """
select o_custkey as cliente_id, count(*) as n_tx,
  count(*) filter (where s_nationkey <> c_nationkey) as n_fuera,
  round(count(*) filter (where s_nationkey <> c_nationkey) / cast(count(*) as double), 4) as proporcion_fuera
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join supplier on l_suppkey = s_suppkey group by 1""",
    "fraud_travel": """
with points as (
  select l_orderkey as cuenta_id, l_shipdate as timestamp_tx, n_name as pais_tx, count(*) as n_tx
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2, 3)
select * from (
  select *, lag(timestamp_tx) over w as timestamp_tx_previo, lag(pais_tx) over w as pais_tx_previo
  from points window w as (partition by cuenta_id order by timestamp_tx, pais_tx))
where pais_tx <> pais_tx_previo and timestamp_tx - timestamp_tx_previo <= interval 1 day""",
    "fraud_score": f"with {_SCORE} select * from scored",
    "fraud_score_as_of": f"with {_UNTIL}, {_as_of(_SCORE)} select * from scored",
    "fraud_top_clients": f"""
with {_SCORE} select cliente_id, score from scored order by score desc, cliente_id limit 20""",
    "retention_by_volume": f"""
with monthly as (
  select o_custkey as c, cast(date_trunc('month', o_orderdate) as date) as mes,
    cast(sum({_dec('o_totalprice')}) as double) as m from orders group by 1, 2),
cuts as (select mes, quantile_cont(m, [0.25, 0.5, 0.75]) as q from monthly group by 1),
banded as (
  select a.c, a.mes, 1 + (a.m > q[1])::bigint + (a.m > q[2])::bigint + (a.m > q[3])::bigint as banda,
    b.c is not null as sigue
  from monthly a join cuts on cuts.mes = a.mes
  left join monthly b on b.c = a.c and b.mes = cast(a.mes + interval 1 month as date))
select mes, banda, count(*) as n_clientes, count(*) filter (where sigue) as n_retenidos,
  round(count(*) filter (where sigue) / cast(count(*) as double), 4) as tasa
from banded where mes < (select max(mes) from monthly) group by 1, 2""",
    "dormant_accounts": f"with {_DORMANT} select * from dormant where nunca or dias >= 30",
    "churn": f"with {_CHURN} select *, dias >= 90 as churn from churned",
    "segmentation": f"with {_SEGMENTS} select * from segments",
    "finance_monthly": f"""
select cast(date_trunc('month', l_shipdate) as date) as mes, {_MONEDA} as moneda,
  o_orderpriority as tipo_cuenta, count(*) as n_tx,
  cast(sum(case when l_returnflag = 'R' then {_dec('l_extendedprice')} else 0 end) as double) as entradas,
  cast(sum(case when l_returnflag <> 'R' then {_dec('l_extendedprice')} else 0 end) as double) as salidas,
  cast(sum(case when l_returnflag = 'R' then {_dec('l_extendedprice')}
    else -{_dec('l_extendedprice')} end) as double) as neto
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3""",
    "client_features": f"""
with {_SCORE}, {_DORMANT}, {_CHURN}, {_SEGMENTS},
sleeping as (select cliente_id, count(*) as n from dormant where nunca or dias >= 30 group by 1)
select c_custkey as cliente_id, n_name as pais, c_mktsegment as segmento, scored.score,
  churned.dias >= 90 as churn, recencia, frecuencia, monto, segmento_rfm,
  coalesce(sleeping.n, 0) as cuentas_dormidas
from customer join nation on c_nationkey = n_nationkey
left join scored on scored.cliente_id = c_custkey
left join sleeping on sleeping.cliente_id = c_custkey
left join churned on churned.cliente_id = c_custkey
left join segments on segments.cliente_id = c_custkey""",
    "client_features_as_of": f"""
with {_UNTIL}, {_as_of(_SCORE)}, {_as_of(_DORMANT)}, {_as_of(_CHURN)}, {_as_of(_SEGMENTS)},
sleeping as (select cliente_id, count(*) as n from dormant where nunca or dias >= 30 group by 1)
select c_custkey as cliente_id, n_name as pais, c_mktsegment as segmento, scored.score,
  churned.dias >= 90 as churn, recencia, frecuencia, monto, segmento_rfm,
  coalesce(sleeping.n, 0) as cuentas_dormidas
from customer join nation on c_nationkey = n_nationkey
left join scored on scored.cliente_id = c_custkey
left join sleeping on sleeping.cliente_id = c_custkey
left join churned on churned.cliente_id = c_custkey
left join segments on segments.cliente_id = c_custkey""",
}

SQL["dq_unique_bitmap"] = SQL["dq_unique"]
SQL["dq_relationships_bitmap"] = SQL["dq_relationships"]
SQL |= {
    "monthly_clients_sketched": """
select cast(date_trunc('month', o_orderdate) as date) as mes, n_name as pais, count(distinct o_custkey) as n_clientes
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""",
    "retention_sketched": """
with m as (select distinct cast(date_trunc('month', o_orderdate) as date) as mes, o_custkey from orders)
select a.mes, count(*) as n_clientes, count(b.o_custkey) as n_retenidos
from m a left join m b on a.o_custkey = b.o_custkey and b.mes = a.mes + interval 1 month
where a.mes < (select max(mes) from m) group by 1""",
    "activity_rollup": f"""
select grouping(mes, pais, segmento) as nivel, mes, pais, segmento, count(*) as n_tx,
  count(distinct o_custkey) as n_clientes, cast(sum(monto) as double) as monto
from (select cast(date_trunc('month', o_orderdate) as date) as mes, n_name as pais, c_mktsegment as segmento, o_custkey,
    {_dec('o_totalprice')} as monto
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
group by rollup (mes, pais, segmento)""",
    "amount_quartiles": f"""
select year(mes) as anio, round(quantile_cont(monto, 0.25), 4) as q1, round(quantile_cont(monto, 0.5), 4) as q2,
  round(quantile_cont(monto, 0.75), 4) as q3
from (select o_custkey, date_trunc('month', o_orderdate) as mes, cast(sum({_dec('o_totalprice')}) as double) as monto
  from orders group by 1, 2) group by 1""",
    "fraud_amount_before": """
select event_id as transaccion_id, user_id as cliente_id, value as monto, n as n_previas, round(z, 4) as z from (
  select *, count(*) over w as n, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as z
  from events window w as (partition by user_id order by ts
    range between unbounded preceding and interval 1 microsecond preceding))
where n >= 10 and z > 3""",
    "tx_state_as_of": """
with v as (
  select o_custkey, o_orderdate, max_by(o_orderkey, o_orderkey) as ultima_cuenta,
    max_by(o_orderstatus, o_orderkey) as estado, max_by(o_orderpriority, o_orderkey) as tipo_cuenta
  from orders group by 1, 2),
t as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as transaccion_id, l_orderkey as cuenta_id,
    l_shipdate as timestamp_tx, o_custkey as cliente_id
  from lineitem join orders on l_orderkey = o_orderkey)
select t.*, v.o_orderdate as desde, v.ultima_cuenta, v.estado, v.tipo_cuenta
from t asof left join v on t.cliente_id = v.o_custkey and t.timestamp_tx >= v.o_orderdate""",
}
