"""Labels, their priority and windows, aliases and vocabularies: data only.

Fixed values: every list below decides results and must hold these entries.
"""

LABELS = ["CPF", "RG", "SIAPE", "ENDEREÇO", "TELEFONE", "EMAIL", "DADOS_BANCARIOS", "CNH", "GEO_COORD", "CID", "PASSAPORTE", "TITULO_ELEITOR", "DATA_NASCIMENTO", "PIS", "CNS", "RESERVISTA"]
GENERIC = ("LOC", "MISC", "ORG", "PER")
#: Best first.
PRIORITY = ["PASSAPORTE", "CPF", "ENDEREÇO", "CNH", "SIAPE", "RG", "TELEFONE", "DADOS_BANCARIOS", "EMAIL", "DATA_NASCIMENTO", "TITULO_ELEITOR", "GEO_COORD", "CID", "PIS", "CNS", "RESERVISTA"]
ALIASES = {
    "CPF/FISTEL": "CPF", "FISTEL": "CPF", "Título de eleitor": "TITULO_ELEITOR", "Passaporte": "PASSAPORTE", "Matrícula SIAPE": "SIAPE", "Data de Nascimento": "DATA_NASCIMENTO",
    "Dados Bancários": "DADOS_BANCARIOS", "E-mail": "EMAIL", "Telefone": "TELEFONE", "Endereço": "ENDEREÇO", "ENDERECO": "ENDEREÇO", "PASEP": "PIS", "NIT": "PIS",
}
#: Code points before and after a span.
WINDOWS = {
    "CPF": (80, 20), "FISTEL": (80, 20), "ENDEREÇO": (80, 20), "RG": (100, 50), "RNE": (100, 50), "CNH": (80, 20), "SIAPE": (80, 20), "TELEFONE": (100, 20), "DATA_NASCIMENTO": (80, 10), "PASSAPORTE": (100, 20),
    "TITULO_ELEITOR": (50, 20), "DADOS_BANCARIOS": (80, 10), "GEO_COORD": (100, 50), "CID": (100, 50), "PIS": (80, 20), "CNS": (80, 20), "RESERVISTA": (80, 50), "EMAIL": (50, 50),
}
#: A context holds a word if it is a substring of it, whatever stands beside.
WORDS = {
    "CPF": ["cpf", "fistel"],
    "ENDEREÇO": ["cep", "postal", "rua", "avenida", "av.", "endereço", "endereco", "logradouro", "bairro", "residência", "residencia", "domicílio", "domicilio", "alameda", "travessa", "rodovia", "estrada", "praça", "quadra", "complemento", "cidade"],
    "RG": ["rg", "identidade", "registro geral", "carteira de identidade", "rg número", "número do rg", "rg nº", "rg n", "documento de identidade", "identidade número", "mg-", "carteira de identidade nacional", "nova identidade", "rg digital", "rg eletrônico", "rg físico", "registro civil", "identificação civil"],
    "RNE": ["rne", "crnm", "registro nacional de estrangeiro", "registro nacional de migratório", "registro nacional migratório", "estrangeiro", "migratório", "migrante", "imigrante", "documento migratório", "carteira de registro nacional migratório", "número do rne", "número do crnm", "nº do rne", "nº do crnm"],
    "CNH": ["cnh", "habilitação", "habilitacao", "habilita", "condutor", "condutora", "carteira de motorista", "carteira nacional", "registro de habilitação", "registro de habilitacao"],
    "SIAPE": ["siape", "matrícula", "matricula", "mat.", "mat:"],
    "TELEFONE": ["telefone", "whatsapp", "fone", "ramal", "celular", "fax", "tel.", "tel:", "tel ", "contato", "fixo", "móvel", "movel", "wpp", "ddd"],
    "DATA_NASCIMENTO": ["nascimento", "nascido", "nascida", "nasc.", "nasc:", "dt nasc", "dt. nasc", "d.n.", "dn:", "data de nascimento"],
    "DATA_EXCLUDE": [
        "início", "termino", "vigência", "validade", "contrato", "término", "processo", "protocolo", "publicação", "publicado", "publicada", "diário", "ofício", "certidão", "certame", "edital", "inicio", "fim", "reunião", "reuniao",
        "pagamento", "vencimento", "audiência", "audiencia", "prazo", "assinatura", "despacho", "emissão", "emissao", "expedição", "expedicao", "admissão", "admissao", "aposentadoria", "nomeação", "nomeacao", "posse", "exercício", "exercicio",
        "contribuição", "contribuicao", "ingresso", "vacância", "vacancia", "férias", "ferias", "licença", "licenca", "frequência", "frequencia", "período", "periodo", "gravação", "gravacao", "programação", "programacao", "centenário", "centenario",
    ],
    "PASSAPORTE": ["passaporte", "passport", "documento de viagem", "travel document", "número do passaporte", "passport number", "passport no", "passaporte n", "passaporte nº"],
    "TITULO_ELEITOR": ["título", "eleitor", "inscrição", "eleitoral"],
    "DADOS_BANCARIOS": ["banco", "conta", "agencia", "agência", "bancário", "bancario", "bancários", "bancarios", "pix", "poupança", "poupanca", "corrente", "c/c", "operação", "operacao", "código do banco", "codigo do banco"],
    "GEO_COORD": ["coordenada", "latitude", "longitude", "lat", "long", "posição", "localização", "gps", "geográfica", "geográfico", "utm", "graus", "minutos", "segundos", "norte", "sul", "leste", "oeste", "coordenadas", "posicionamento"],
    "PIS": ["pis", "pasep", "nit", "inscrição do trabalhador", "inscricao do trabalhador", "programa de integração social", "programa de integracao social", "número do pis", "numero do pis", "pis/pasep"],
    "CNS": ["cns", "cartão nacional de saúde", "cartao nacional de saude", "número do cns", "numero do cns", "cns:", "sus", "sistema único de saúde", "sistema unico de saude"],
    "RESERVISTA": ["reservista", "certificado de reservista", "certificado de alistamento militar", "certificado de dispensa de incorporação", "cam", "cda", "cdi", "alistamento militar", "serviço militar", "servico militar"],
    "CID": [
        "cid", "cid-10", "cid10", "diagnóstico", "doença", "patologia", "enfermidade", "diagnóstico médico", "classificação", "código médico", "código cid", "laudo", "atestado", "relatório médico", "prontuário", "história clínica",
        "quadro clínico", "condição médica", "morbidade", "nosologia", "diagnostic", "disease",
    ],
}
CID_TRAPS = ["A12", "B12", "C12", "D12", "E12", "F12", "G12", "H12"]
TABLE_WORDS = ["cpf", "rg", "titulo", "documento", "passaporte", "cnh", "siape", "identificacao", "email", "fistel", "telefone"]
STATES = "AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO"
COUNCILS = "CRM|CRO|CRP|CREA|CRF|CRESS|CRECI|COREN|CRMV|OAB"
ISSUERS = "SSP|SDS|DETRAN|IFP|PC|SESP|SEJUSP|ITEP|IGP|DGPC|SSDS?"
