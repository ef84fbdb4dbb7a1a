"""Texts with known entities, as SQL that Spark and other engines read alike. Tables stand in braces."""

from __future__ import annotations


def dot(column: str, weights, at: int = 1) -> str:
    return "(" + " + ".join(f"CAST(substr({column}, {at + i}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def low(rest: str) -> str:
    return f"(CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END)"


def number(key: str, digits: int, factor: int = 7919, add: int = 123456789) -> str:
    return f"lpad(CAST(({key} * {factor} + {add}) % {10**digits} AS STRING), {digits}, '0')"


def spoiled(last: str, key: str) -> str:
    """The last check digit, wrong for every third key."""
    return f"CAST(CASE WHEN {key} % 3 = 0 THEN ({last} + 1) % 10 ELSE {last} END AS STRING)"


#: id, name, raw (11 digits), cpf (with signs), good
CPF = f"""
SELECT id, name, n || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS raw,
  substr(n, 1, 3) || '.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-' || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS cpf, id % 3 <> 0 AS good
FROM (SELECT *, {dot("n || CAST(d1 AS STRING)", range(11, 1, -1))} * 10 % 11 % 10 AS d2
  FROM (SELECT *, {dot('n', range(10, 1, -1))} * 10 % 11 % 10 AS d1
    FROM (SELECT c_custkey AS id, c_name AS name, {number('c_custkey', 9)} AS n FROM {{customer}}) a) b) c
"""
#: Of every kind of number: id, raw, good.
NUMBERS = {
    "pis": f"SELECT id, n || {spoiled('d', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, {low(dot('n', (3, 2, *range(9, 1, -1))) + ' % 11')} AS d FROM (SELECT c_custkey AS id, {number('c_custkey', 10)} AS n FROM {{customer}}) a) b WHERE d < 10",
    "cns": f"SELECT id, n || {spoiled('d', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, {low(dot('n', range(15, 1, -1)) + ' % 11')} AS d FROM (SELECT c_custkey AS id, '7' || {number('c_custkey', 13)} AS n FROM {{customer}}) a) b WHERE d < 10",
    "cnh": f"SELECT id, n || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, {low('(' + dot('n', range(1, 10)) + ' + d1 * 10) % 11')} AS d2 FROM (SELECT *, {low(dot('n', range(9, 0, -1)) + ' % 11')} AS d1 FROM (SELECT c_custkey AS id, {number('c_custkey', 9)} AS n FROM {{customer}}) a) b) c WHERE d1 < 10 AND d2 < 10",
    "voter": f"SELECT id, n || s || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, ({dot('s', (7, 8))} + d1 * 9) % 11 % 10 AS d2 FROM (SELECT *, {dot('n', range(2, 10))} % 11 % 10 AS d1 FROM (SELECT c_custkey AS id, {number('c_custkey', 8)} AS n, lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS s FROM {{customer}}) a) b) c",
    "cnpj_reference": f"SELECT id, n || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, {low(dot('n || CAST(d1 AS STRING)', (5, 6, 7, 8, 9, *range(2, 10))) + ' % 11')} AS d2 FROM (SELECT *, {low(dot('n', (6, 7, 8, 9, *range(2, 10))) + ' % 11')} AS d1 FROM (SELECT c_custkey AS id, {number('c_custkey', 12)} AS n FROM {{customer}}) a) b WHERE d1 < 10) c WHERE d2 < 10",
    "cnpj_official": f"SELECT id, n || CAST(d1 AS STRING) || {spoiled('d2', 'id')} AS raw, id % 3 <> 0 AS good FROM (SELECT *, {low(dot('n || CAST(d1 AS STRING)', (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)) + ' % 11')} AS d2 FROM (SELECT *, {low(dot('n', (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)) + ' % 11')} AS d1 FROM (SELECT c_custkey AS id, {number('c_custkey', 12)} AS n FROM {{customer}}) a) b WHERE d1 < 10) c WHERE d2 < 10",
}
#: id, head, body, tail, good: the text is head || body || tail and body is the entity where good.
TEMPLATES = {
    "cpf_detect": ("CPF", f"SELECT id, 'Cliente ' || name || ', CPF ' AS head, cpf AS body, '' AS tail, good FROM ({CPF}) x"),
    "cpf_relabel": ("CPF", f"SELECT id, 'Portador da CNH ' AS head, raw AS body, ' em dia' AS tail, true AS good FROM ({CPF}) x"),
    "phone_gate": ("TELEFONE", f"SELECT o_orderkey AS id, 'Pedido ' || CAST(o_orderkey % 1000 AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN ' n. ' ELSE ' telefone ' END AS head, '(11) 9' || substr(n, 1, 4) || '-' || substr(n, 5, 4) AS body, '' AS tail, o_orderkey % 4 <> 0 AS good FROM (SELECT *, {number('o_orderkey', 8)} AS n FROM {{orders}}) a"),
    "bank_detect": ("DADOS_BANCARIOS", f"SELECT s_suppkey AS id, 'Agência central, conta ' AS head, substr(n, 1, 5) || '-' || substr(n, 6, 1) AS body, ' ativa' AS tail, true AS good FROM (SELECT *, {number('s_suppkey', 6)} AS n FROM {{supplier}}) a"),
    "postcode_detect": ("ENDEREÇO", f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'Lote ' ELSE 'Rua das Flores, CEP ' END AS head, substr(n, 1, 5) || '-' || substr(n, 6, 3) AS body, ' fim' AS tail, s_suppkey % 5 <> 0 AS good FROM (SELECT *, {number('s_suppkey', 8)} AS n FROM {{supplier}}) a"),
    "birth_date_gate": ("DATA_NASCIMENTO", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Data de nascimento: ' ELSE 'Emissão: ' END AS head, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING) AS body, '' AS tail, o_orderkey % 2 = 0 AS good FROM {orders}"),
    "siape_detect": ("SIAPE", f"SELECT s_suppkey AS id, 'Servidor, matrícula SIAPE ' AS head, {number('s_suppkey', 7)} AS body, ' lotado' AS tail, true AS good FROM {{supplier}}"),
    "passport_detect": ("PASSAPORTE", f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Chave ' ELSE 'Passaporte ' END AS head, 'AB' || {number('s_suppkey', 6)} AS body, ' emitido' AS tail, s_suppkey % 3 <> 0 AS good FROM {{supplier}}"),
    "rg_detect": ("RG", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Valor ' ELSE 'Identidade ' END AS head, substr(n, 1, 2) || '.' || substr(n, 3, 3) || '.' || substr(n, 6, 3) || '-' || substr(n, 9, 1) AS body, ' do titular' AS tail, p_partkey % 4 <> 0 AS good FROM (SELECT *, {number('p_partkey', 9)} AS n FROM {{part}}) a"),
    "geo_detect": ("GEO_COORD", f"SELECT s_suppkey AS id, 'Ponto em ' AS head, '-15.' || {number('s_suppkey', 4)} || ', -47.' || {number('s_suppkey', 4, 31)} AS body, ' no mapa' AS tail, true AS good FROM {{supplier}}"),
    "cid_detect": ("CID", "SELECT p_partkey AS id, 'Laudo com CID ' AS head, 'F' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') || '.' || CAST(p_partkey % 10 AS STRING) AS body, ' confirmado' AS tail, true AS good FROM {part}"),
    "reservista_detect": ("RESERVISTA", f"SELECT s_suppkey AS id, 'Certificado de reservista ' AS head, {number('s_suppkey', 6)} || '-' || {number('s_suppkey', 12)} AS body, '.' AS tail, true AS good FROM {{supplier}}"),
    "rg_foreign_detect": ("RG", f"SELECT s_suppkey AS id, 'Estrangeiro com ' AS head, 'CRNM ' || {number('s_suppkey', 7)} AS body, ' ok' AS tail, true AS good FROM {{supplier}}"),
    "voter_detect": ("TITULO_ELEITOR", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Lote ' ELSE 'Inscrição eleitoral ' END AS head, raw AS body, ' ativa' AS tail, id % 4 <> 0 AS good FROM ({NUMBERS['voter']}) x"),
    "pis_detect": ("PIS", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Lote ' ELSE 'PIS ' END AS head, raw AS body, ' ativo' AS tail, good AND id % 4 <> 0 AS good FROM ({NUMBERS['pis']}) x"),
    "cns_detect": ("CNS", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Lote ' ELSE 'Cartão nacional de saúde ' END AS head, raw AS body, ' ativo' AS tail, good AND id % 4 <> 0 AS good FROM ({NUMBERS['cns']}) x"),
    "cnh_detect": ("CNH", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Lote ' ELSE 'Habilitação ' END AS head, raw AS body, ' em dia' AS tail, id % 4 <> 0 AS good FROM ({NUMBERS['cnh']}) x"),
    "passport_foreign_detect": ("PASSAPORTE", f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Chave ' ELSE 'Passport: ' END AS head, 'K' || {number('s_suppkey', 8)} AS body, ' emitido' AS tail, s_suppkey % 3 <> 0 AS good FROM {{supplier}}"),
}
TABLE = f"SELECT id, name, cpf, 'm' || CAST(id AS STRING) || '@x.org' AS mail, '| Nome | CPF | Email |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || name || ' | ' || cpf || ' | m' || CAST(id AS STRING) || '@x.org |' AS text FROM ({CPF}) x WHERE good"
#: Ground truth and predictions: some shifted, some dropped, some spurious.
TRUTH = "SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'CPF' WHEN 1 THEN 'EMAIL' ELSE 'RG' END AS tp_entidade, CAST(l_linenumber * 12 AS INT) AS start_entidade, CAST(l_linenumber * 12 + 10 AS INT) AS end_entidade FROM {lineitem}"
FOUND = """
SELECT id, tp_entidade, CAST(start_entidade + start_entidade / 12 % 5 AS INT) AS start_entidade, CAST(end_entidade + start_entidade / 12 % 5 AS INT) AS end_entidade
FROM ({truth}) t WHERE (id + start_entidade) % 7 <> 0
UNION ALL SELECT id, 'CNH', CAST(start_entidade + 5000 AS INT), CAST(end_entidade + 5000 AS INT) FROM ({truth}) t WHERE (id + start_entidade) % 11 = 0
UNION ALL SELECT id, tp_entidade, CAST(start_entidade + 9000 AS INT), CAST(end_entidade + 9000 AS INT) FROM ({truth}) t WHERE (id + start_entidade) % 13 = 0
""".replace("{truth}", TRUTH).replace("start_entidade / 12 % 5", "(start_entidade - start_entidade % 12) / 12 % 5")
#: Three paragraphs, an entity in the first and in the third.
PARAGRAPHS = "SELECT c_custkey AS id, 'Primeiro ' || c_name || chr(10) || 'Segundo' || chr(10) || 'Terceiro ' || c_name AS text, length(c_name) AS n FROM {customer}"
