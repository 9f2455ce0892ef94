"""Fixed business values.

Everything below must equal the source application's values for results to
match, so it is stated plainly, in natural order, in one place.
"""

from __future__ import annotations

# --- fixed values: boleta file contract (21 text columns, in file order) ---
BOLETA_COLUMNS = [
    "identificador_externo", "fundo_cnpj", "classe_codigo", "data_aquisicao",
    "tipo_ativo", "numero_titulo", "numero_parcela", "total_parcelas",
    "cedente_documento", "cedente_nome", "sacado_documento", "sacado_nome",
    "data_emissao", "data_vencimento", "valor_face", "valor_aquisicao",
    "taxa_desconto_aa", "indexador", "percentual_indexador", "coobrigacao",
    "conta_liquidacao",
]

# --- fixed values: enumerations ---
TIPOS_ATIVO = ["DUPLICATA", "CCB", "CARTAO", "CHEQUE", "NOTA_PROMISSORIA", "CONTRATO"]
INDEXADORES = ["PRE", "CDI", "IPCA", "IGPM", "SELIC"]
COOBRIGACAO_TRUE = ["S", "SIM", "TRUE", "1"]
TIPOS_CLASSE = ["SENIOR", "MEZANINO", "SUBORDINADA"]

# --- fixed values: rejection messages, in rule order (first failing rule wins) ---
MSG_ID_AUSENTE = "identificador_externo ausente"
MSG_CNPJ_INVALIDO = "fundo_cnpj inválido"
MSG_FUNDO_INATIVO = "fundo não encontrado ou inativo"
MSG_CLASSE_AUSENTE = "classe_codigo ausente"
MSG_CLASSE_FORA = "classe não pertence ao fundo"
MSG_DATA_AQ = "data_aquisicao inválida"
MSG_TIPO = "tipo_ativo inválido"
MSG_NUMERO = "numero_titulo ausente"
MSG_CED_DOC = "cedente_documento inválido"
MSG_CED_NOME = "cedente_nome ausente"
MSG_SAC_DOC = "sacado_documento inválido"
MSG_SAC_NOME = "sacado_nome ausente"
MSG_DATA_VENC = "data_vencimento inválida"
MSG_VF = "valor_face inválido"
MSG_VA = "valor_aquisicao inválido"
MSG_VA_MAIOR = "valor_aquisicao maior que valor_face"
MSG_VENC_ANTES = "data_vencimento anterior à data_aquisicao"
MSG_INDEXADOR = "indexador inválido"
MSG_DUPLICADO = "identificador_externo duplicado no arquivo"

# --- fixed values: provision bands (minimum days in arrears, fraction, rating) ---
PDD_BANDS = [
    (15, "0.0100", "B"),
    (31, "0.0300", "C"),
    (61, "0.1000", "D"),
    (91, "0.3000", "E"),
    (121, "0.5000", "F"),
    (151, "0.7000", "G"),
    (181, "1.0000", "H"),
]

# --- fixed values: dated holiday table seeded by the source application ---
SEEDED_HOLIDAYS = [
    "2025-01-01", "2025-03-03", "2025-03-04", "2025-04-18", "2025-04-21", "2025-05-01",
    "2025-06-19", "2025-09-07", "2025-10-12", "2025-11-02", "2025-11-15", "2025-11-20",
    "2025-12-25",
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-04-03", "2026-04-21", "2026-05-01",
    "2026-06-04", "2026-09-07", "2026-10-12", "2026-11-02", "2026-11-15", "2026-11-20",
    "2026-12-25",
    "2027-01-01", "2027-02-08", "2027-02-09", "2027-03-26", "2027-04-21", "2027-05-01",
    "2027-05-27", "2027-09-07", "2027-10-12", "2027-11-02", "2027-11-15", "2027-11-20",
    "2027-12-25",
]

# --- fixed values: day count and par ---
MSG_COLUNAS = "Colunas obrigatórias ausentes no arquivo: "
MSG_ORDEM_COLUNAS = "Colunas fora de ordem."
DU_ANO = 252
#: States of a stored close that count as a close.
CLOSED_STATUS = ("PROCESSADO", "SELADO")
PAR = "1.000000000000"

# --- fixed values: title events ---
EVENT_STATUS = {"PAGAMENTO": "LIQUIDADO", "BAIXA": "BAIXADO", "RECOMPRA": "RECOMPRADO"}
EVENT_CASH_KINDS = ["PAGAMENTO", "RECOMPRA"]
TITLE_EVENT_KINDS = ["PAGAMENTO", "PAGAMENTO_PARCIAL", "BAIXA", "RECOMPRA", "ATRASO", "AJUSTE"]
MSG_EVENTO_TIPO = "Tipo de evento inválido."
MSG_EVENTO_NAO_ENCONTRADO = "Direito creditório não encontrado."
MSG_EVENTO_AMBIGUO = "Identificador ambíguo (mais de um título). Refine a busca."

# --- fixed values: report residual row ---
RESIDUAL_DOC = "—"
RESIDUAL_NAME = "Não atribuído a cotista"
RESIDUAL_EPS = "0.000001"

# --- fixed values: registry messages ---
MSG_FUNDO_CNPJ = "CNPJ inválido: informe 14 dígitos."
MSG_FUNDO_NOME = "Informe o nome do fundo."
MSG_FUNDO_DUP = "Já existe um fundo com este CNPJ."
MSG_CLASSE_COD = "Informe o código da classe."
MSG_CLASSE_TIPO = "Tipo inválido (SENIOR, MEZANINO ou SUBORDINADA)."
MSG_CLASSE_FUNDO = "Fundo não encontrado."
MSG_CLASSE_DUP = "Já existe uma classe com este código neste fundo."
MSG_COTISTA_DOC = "Documento inválido: informe um CPF (11 dígitos) ou CNPJ (14 dígitos)."
MSG_COTISTA_NOME = "Informe o nome do cotista."
MSG_COTISTA_DUP = "Já existe cotista com este documento."

# --- fixed values: seal outcomes ---
MSG_SEAL_MISSING = "Fechamento não encontrado."
MSG_SEAL_SEALED = "Fechamento já está selado."

# --- fixed values: order rejection ---
MSG_SALDO_INSUFICIENTE = "Saldo insuficiente"
MSG_ORDEM_CLASSE = "Classe não encontrada."
MSG_ORDEM_COTISTA = "Cotista não encontrado."
