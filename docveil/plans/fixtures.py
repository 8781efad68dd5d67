"""Texts with identifiers of known validity, computed from the TPC-H-like tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "c_custkey"
_S = lambda x: f"cast({x} as string)"
_PAD = lambda x, n: f"lpad({_S(x)}, {n}, '0')"
_DIGIT = lambda s, i: f"cast(substr({s}, {i}, 1) as int)"
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _doubled(d: str) -> str:
    return f"(cast(floor(2 * {d} / 10.0) as int) + (2 * {d}) % 10)"


_dni_no = f"({_K} * 7919 + 12345) % 100000000"
_nie_no = f"({_K} * 104729 + 77) % 10000000"
_letter = lambda n, wrong: f"substr('{LETTERS}', cast(({n} + case when {wrong} then 1 else 0 end) % 23 as int) + 1, 1)"
DNI = f"concat({_PAD(_dni_no, 8)}, {_letter(_dni_no, f'{_K} % 5 = 0')})"
NIE = f"concat('X', {_PAD(_nie_no, 7)}, {_letter(_nie_no, f'{_K} % 7 = 0')})"
_bban = f"concat('21000418', {_PAD(f'{_K} % 100', 2)}, {_PAD(f'({_K} * 1000003) % 10000000000', 10)})"
_rest = f"cast(cast(concat({_bban}, '142800') as decimal(38,0)) % 97 as int)"
IBAN = f"concat('ES', {_PAD(f'(98 - {_rest} + case when {_K} % 4 = 0 then 1 else 0 end)', 2)}, {_bban})"
_card15 = f"concat('4', {_PAD(f'({_K} * 7368787) % 100000000000000', 14)})"
_luhn = " + ".join(_doubled(_DIGIT("b", i)) if (15 - i) % 2 == 0 else _DIGIT("b", i) for i in range(1, 16))
_ten = f"concat('28', {_PAD(f'({_K} * 9973) % 100000000', 8)})"
NSS = f"concat(substr({_ten}, 1, 2), '/', substr({_ten}, 3, 8), '/', {_PAD(f'(cast(cast({_ten} as bigint) % 97 as int) + case when {_K} % 3 = 0 then 1 else 0 end) % 100', 2)})"
_seven = _PAD(f"({_K} * 7727) % 10000000", 7)
_cif_sum = " + ".join(_doubled(_DIGIT("b", i)) if i % 2 else _DIGIT("b", i) for i in range(1, 8))
_W = [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]
_ccc_dc = lambda s: f"(11 - ({' + '.join(f'{w} * {_DIGIT(s, i)}' for i, w in enumerate(_W, 1))}) % 11)"
_fix = lambda r: f"case when {r} = 11 then 0 when {r} = 10 then 1 else {r} end"

#: For each kind: a query of (doc_id, text, value, good), with which both engines begin.
SQL = {
    "dni": f"select {_K} as doc_id, concat('Cliente con DNI ', {DNI}, ', gracias') as text, {DNI} as value, {_K} % 5 <> 0 as good from customer",
    "nie": f"select {_K} as doc_id, concat('Su NIE es ', {NIE}, '.') as text, {NIE} as value, {_K} % 7 <> 0 as good from customer",
    "iban": f"select {_K} as doc_id, concat('Pague en ', {IBAN}, ' hoy') as text, {IBAN} as value, {_K} % 4 <> 0 as good from customer",
    "card": f"select doc_id, concat('Tarjeta ', value, ' caduca') as text, value, good from (select k as doc_id, concat(b, cast(((10 - ({_luhn}) % 10) % 10 + case when k % 6 = 0 then 1 else 0 end) % 10 as string)) as value, k % 6 <> 0 as good from (select {_K} as k, {_card15} as b from customer) t) u",
    "nss": f"select {_K} as doc_id, concat('Seguridad Social ', {NSS}, ' del trabajador') as text, {NSS} as value, {_K} % 3 <> 0 as good from customer",
    "cif": f"select doc_id, concat('con CIF ', value, ', que') as text, value, good from (select k as doc_id, concat('B', b, cast(((10 - ({_cif_sum}) % 10) % 10 + case when k % 4 = 0 then 1 else 0 end) % 10 as string)) as value, k % 4 <> 0 as good from (select {_K} as k, {_seven} as b from customer) t) u",
    "ccc": f"select doc_id, concat('cuenta ', value, ' del cliente') as text, value, good from (select k as doc_id, concat(a, cast(({_fix('d1')} + case when k % 6 = 0 then 1 else 0 end) % 10 as string), cast({_fix('d2')} as string), c) as value, k % 6 <> 0 as good from (select k, a, c, {_ccc_dc('x')} as d1, {_ccc_dc('c')} as d2 from (select {_K} as k, '21000418' as a, '0021000418' as x, {_PAD(f'({_K} * 1000003) % 10000000000', 10)} as c from customer) t) u) v",
    "phone": f"select {_K} as doc_id, concat('Llame al ', value, ' hoy') as text, value, true as good from (select {_K}, concat('6', {_PAD(f'{_K} % 100', 2)}, ' ', {_PAD(f'({_K} * 31) % 1000', 3)}, ' ', {_PAD(f'({_K} * 17) % 1000', 3)}) as value from customer) t",
    "plate": f"select {_K} as doc_id, concat('coche ', value, '.') as text, value, true as good from (select {_K}, concat({_PAD(f'{_K} % 10000', 4)}, ' ', substr('BCDFGHJKLMNPRSTVWXYZ', cast({_K} % 20 as int) + 1, 1), substr('BCDFGHJKLMNPRSTVWXYZ', cast({_K} % 17 as int) + 1, 1), 'Z') as value from customer) t",
    "cp": f"select {_K} as doc_id, case when {_K} % 3 = 0 then concat('ref ', value, ' de la') else concat('en ', value, ' Madrid') end as text, value, {_K} % 3 <> 0 and cast(value as int) between 1000 and 52999 as good from (select {_K}, {_PAD(f'({_K} * 37) % 60000', 5)} as value from customer) t",
    "born": f"select {_K} as doc_id, concat('nacido el ', d, '/', m, '/', y, ', vecino') as text, concat(d, '/', m, '/', y) as value, d, m, y from (select {_K}, {_PAD(f'{_K} % 31 + 1', 2)} as d, {_PAD(f'{_K} % 12 + 1', 2)} as m, {_S(f'1950 + {_K} % 50')} as y from customer) t",
    "money": f"select o_orderkey as doc_id, concat('Total: ', value, ' al mes') as text, value from (select o_orderkey, concat(case when i >= 1000 then concat({_S('cast(floor(i / 1000.0) as bigint)')}, '.', {_PAD('i % 1000', 3)}) else {_S('i')} end, ',', {_PAD('c % 100', 2)}, ' €') as value from (select o_orderkey, c, cast(floor(c / 100.0) as bigint) as i from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c from orders) t) u) v",
    "spans": "select l_orderkey as doc_id, l_linenumber as n, cast(l_partkey % 60 as int) as start, cast(l_partkey % 60 + 2 + l_suppkey % 7 as int) as end_, case when l_quantity > 35 then 'alta' when l_quantity > 15 then 'media' else 'baja' end as confidence, case cast(l_partkey % 4 as int) when 0 then 'nombre' when 1 then 'dni' when 2 then 'email' else 'telefono' end as type from lineitem",
    "files": f"select o_orderkey as id, concat('/data/', {_S('o_custkey % 7')}, '/Nomina_', {_S('o_orderkey')}, case cast(o_orderkey % 5 as int) when 0 then '.PDF' when 1 then '.docx' when 2 then '.jpeg' when 3 then '.csv' else '.zip' end) as path, o_orderdate as modified, cast(o_totalprice as bigint) as bytes from orders",
    "clauses": f"select o_orderkey as doc_id, concat(case cast(o_orderkey % 4 as int) when 0 then concat({_S('o_custkey % 20 + 1')}, '. ') when 1 then 'TERCERA. ' when 2 then 'Artículo 5.º - ' else '' end, 'Renta: Pago de ', {_S('o_custkey')}, ' euros;') as text, concat('renta: pago de ', {_S('o_custkey')}, ' euros') as key from orders",
}


def fixture(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name = "orders" if kind in ("money", "files", "clauses") else "lineitem" if kind == "spans" else "customer"
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[kind].replace(f"from {name}", "from {src}"), src=df)
