"""Domain values: states, ranks, and the word lists and alias tables that results depend on."""

from __future__ import annotations

PRIORITIES = ("P1_CRITICO", "P2_ESTRATEGICO", "P3_MONITORAMENTO")
IRRELEVANT = "IRRELEVANTE"
ACTIVE, ARCHIVED, DISCARDED = "ativo", "arquivado", "descartado"
PENDING, READY, DONE, FAILED = "pendente", "pronto_agrupar", "processado", "erro"
NATIONAL_TYPES = ("nacional", "brasil_fisico", "brasil_online")
DEFAULT_TAG = "Internacional (Economia e Política)"
DEBT_TAG = "Dívida Ativa e Créditos Públicos"

_POLITICS = "Política Econômica (Brasil)"
_TECH = "Tecnologia e Setores Estratégicos"
_LEGAL = "Jurídico, Falências e Regulatório"
_MARKET = "Mercado de Capitais e Finanças Corporativas"
_DEALS = "M&A e Transações Corporativas"

# Keyword -> tag, in the order in which keywords are tried.
TAG_KEYWORDS = {
    "governo e politica": _POLITICS, "governo e política": _POLITICS, "política": _POLITICS, "politica": _POLITICS, "governo": _POLITICS,
    "política econômica": _POLITICS, "politica economica": _POLITICS, "política pública": _POLITICS, "política publica": _POLITICS,
    "economia e tecnologia": DEFAULT_TAG, "economia": DEFAULT_TAG, "tecnologia": _TECH, "tech": _TECH, "ia": _TECH, "inteligência artificial": _TECH,
    "inteligencia artificial": _TECH, "cripto": DEFAULT_TAG, "criptomoedas": DEFAULT_TAG, "bitcoin": DEFAULT_TAG,
    "judicionario": _LEGAL, "judiciário": _LEGAL, "judicial": _LEGAL, "justiça": _LEGAL, "justica": _LEGAL, "tribunal": _LEGAL, "stf": _LEGAL, "stj": _LEGAL,
    "supremo": _LEGAL, "superior tribunal": _LEGAL, "tj": _LEGAL, "trf": _LEGAL, "vara": _LEGAL, "recuperação judicial": _LEGAL, "recuperacao judicial": _LEGAL,
    "falência": _LEGAL, "falencia": _LEGAL, "legislativo": _LEGAL, "congresso": _LEGAL, "senado": _LEGAL, "câmara": _LEGAL, "camara": _LEGAL,
    "empresas privadas": _MARKET, "empresas": _MARKET, "corporativo": _MARKET, "negócios": _MARKET, "negocios": _MARKET, "mercado": _MARKET, "setor privado": _MARKET,
    "m&a": _DEALS, "fusão": _DEALS, "fusao": _DEALS, "aquisição": _DEALS, "aquisicao": _DEALS,
}

# Words and patterns of advertisements.
AD_WORDS = ("anúncio", "anuncio", "publicitário", "publicitario", "promoção", "promocao", "oferta", "imperdível", "imperdivel", "liquidação", "liquidacao", "cupom",
            "desconto", "brinde", "compre", "ingressos", "ingresso", "cadastre-se", "cadastre se", "inscreva-se", "inscreva se", "patrocinado", "publi")
RETAIL_WORDS = ("supermarket", "supermercado", "hipermercado", "loja", "shopping", "farmácia", "farmacia", "eletro", "móveis", "moveis")
AD_SIGNS = (
    r"\b\d{1,2}h\s*(às|as)\s*\d{1,2}h\b",
    r"\b(?:r\.|rua|av\.|avenida|praça|praca|centro|shopping)\b",
    r"\bwhatsapp\b",
    r"\b(?:\(\d{2}\)\s*\d{4,5}-\d{4})\b",
    r"\br\$\s*\d+[\.\d]*\b",
)
# Patterns of text that is not news.
NOISE_PATTERNS = (
    r"\b(?:hor[oó]scopo|signo|astr[oó]logo|signo de)\b",
    r"\b(?:classificados|an[uú]ncios? classificados?)\b",
    r"\b(?:obitu[aá]rio|faleceu|missa de s[eé]timo)\b",
    r"\b(?:palavras? cruzadas?|sudoku|quadrinhos|tirinhas?)\b",
    r"\b(?:resultado do jogo|placar final|campeonato brasileiro|libertadores|s[eé]rie [ab])\b",
    r"\b(?:big brother|bbb\d+|novela|capitulo de)\b",
    r"\b(?:receita de bolo|culinaria|gastronomia)\b",
    r"\b(?:previs[aã]o do tempo|meteorologia|chuva forte)\b",
)
# Phrases of financial statements.
FINANCIAL_PHRASES = (
    "demonstrações financeiras", "demonstracoes financeiras", "notas explicativas às demonstrações", "notas explicativas as demonstracoes",
    "balanço patrimonial", "balanco patrimonial", "demonstração do resultado", "demonstracao do resultado", "demonstração de fluxo de caixa",
    "demonstracao de fluxo de caixa", "demonstração das mutações do patrimônio", "demonstracao das mutacoes", "relatório dos auditores independentes",
    "relatorio dos auditores", "valores expressos em milhares de reais", "controladora consolidado",
)
# Titles that say nothing.
GENERIC_TITLES = ("sem título", "sem titulo", "notícia sem título", "noticias sem titulo", "novo cluster", "grupo lote")
# The pattern of public debt.
DEBT_PATTERN = r"(?i)\b(certid[aã]o\s+de\s+d[ií]vida\s+ativa|\bCDA\b|d[ií]vida\s+ativa|protesto\s+de\s+CDA|securitiza[cç][aã]o\s+de\s+d[ií]vida\s+ativa|precat[óo]ri|\bFCVS\b)\b"

# Outlets by normal form, and the names they are shown by, in the order in which names are tried.
OUTLET_ALIASES = {
    "o estado de s paulo": "estadao", "estado de s paulo": "estadao", "estadao": "estadao", "valor economico": "valor economico", "valor": "valor economico",
    "valor pro": "valor economico", "valor economico pro": "valor economico", "brazil journal": "brazil journal", "folha de s paulo": "folha", "folha": "folha",
    "exame": "exame", "infomoney": "infomoney", "investing": "investing",
}
OUTLET_NAMES = {
    "estadao": "O Estado de S.Paulo", "o estado de s paulo": "O Estado de S.Paulo", "estado de s paulo": "O Estado de S.Paulo", "valor economico": "Valor Econômico",
    "valor": "Valor Econômico", "valor pro": "Valor Econômico", "folha": "Folha de S.Paulo", "folha de s paulo": "Folha de S.Paulo", "brazil journal": "Brazil Journal",
    "exame": "Exame", "infomoney": "InfoMoney", "investing": "Investing.com", "bloomberg": "Bloomberg", "reuters": "Reuters", "financial times": "Financial Times",
    "conjur": "Conjur", "jota": "JOTA", "migalhas": "Migalhas", "neofeed": "NeoFeed", "pipeline": "Pipeline Valor", "capital aberto": "Capital Aberto",
    "o globo": "O Globo", "gazeta": "Gazeta do Povo", "correio braziliense": "Correio Braziliense", "broadcast": "Broadcast", "reset": "Reset",
    "wall street journal": "The Wall Street Journal", "wsj": "The Wall Street Journal", "new york times": "The New York Times", "nyt": "The New York Times",
}
# Patterns of names that are no outlet.
OUTLET_JUNK = "(?i)" + "|".join((
    r"^[a-z0-9_]{2,20}$", r"^json.?dump$", r"^fonte.?desconhecida$", r"^n/?a$", r"^sem.?fonte$", r"^unknown$", r"^dump.?crawlers", r"^noticias_.+_paginated$", r"^noticias_.+_ultimas",
))
# Foreign outlets, short list.
FOREIGN_OUTLETS_SHORT = (
    "financial times", "ft ", " ft", "ft.com", "ft weekend", "ftweekend", "bloomberg", "reuters", "associated press", "ap ", "ap news", "wall street journal", "wsj",
    "new york times", "nyt", "washington post", "wapo", "the guardian", "guardian", "bbc", "cnn", "cnbc", "the economist", "forbes", "marketwatch", "barron", "barron's",
    "the telegraph", "the times", "usa today", "los angeles times", "la times", "chicago tribune", "axios", "politico", "the hill", "nikkei", "japan times",
    "south china morning post", "scmp", "al jazeera", "sky news", "the hindu", "times of india",
)
# Foreign outlets.
FOREIGN_OUTLETS = (
    "new york times", "nyt", "wall street journal", "wsj", "financial times", "ft", "bloomberg", "reuters", "associated press", "ap", "washington post", "the guardian",
    "bbc", "cnn", "cnbc", "the economist", "forbes", "business insider", "marketwatch", "barrons", "barron's", "the telegraph", "the times", "daily mail", "usa today",
    "los angeles times", "chicago tribune", "boston globe", "miami herald", "axios", "politico", "the hill", "foreign policy", "foreign affairs", "the atlantic", "vox",
    "vice", "buzzfeed", "huffpost", "huffington post", "daily beast", "slate", "salon", "mother jones", "the intercept", "propublica", "npr", "pbs", "abc news",
    "nbc news", "cbs news", "fox news", "msnbc", "sky news", "al jazeera", "russia today", "rt", "sputnik", "china daily", "xinhua", "nikkei", "japan times",
    "korea herald", "south china morning post", "scmp", "the hindu", "times of india", "dawn", "the nation", "jerusalem post", "haaretz", "al arabiya", "gulf news",
    "arab news", "the national", "daily star", "the star",
)
# National outlets.
NATIONAL_OUTLETS = (
    "folha", "folha de s. paulo", "folha de são paulo", "folha de s.paulo", "estadao", "estadão", "estado de s. paulo", "estado de são paulo", "o estado de s. paulo",
    "globo", "o globo", "g1", "valor", "valor economico", "valor econômico", "uol", "r7", "veja", "exame", "istoé", "istoe", "época", "epoca", "correio braziliense",
    "correio", "zero hora", "gazeta do povo", "metrópoles", "metropoles", "poder360", "infomoney", "investing.com brasil", "brasil 247", "carta capital",
    "cartacapital", "agência brasil", "agencia brasil", "bbc brasil", "cnn brasil", "diário do comércio", "diario do comercio", "dci", "monitor mercantil",
    "brazil journal", "jota", "conjur", "consultor jurídico", "migalhas", "capital reset", "neo feed", "neofeed", "the brazilian report",
)
# Frequent words of Portuguese, with the blanks around them.
PORTUGUESE_WORDS = (
    " de ", " do ", " da ", " dos ", " das ", " que ", " em ", " para ", " por ", " com ", " não ", " ao ", " aos ", " aos ", " uma ", " sua ", " seu ", " seus ",
    " suas ", " é ", " foi ", " são ", " estar ", " como ", " sobre ", " entre ", " contra ", " pela ", " pelas ",
)
# Stop-words.
STOPWORDS = ("de", "da", "do", "dos", "das", "e", "em", "o", "a", "os", "as", "um", "uma", "para", "com", "por", "no", "na", "nos", "nas", "ao", "se", "que", "como",
             "mais", "entre", "sobre", "sua", "seu", "ser", "ter", "foi", "sao", "tem")
# Entity names by normal form.
ENTITY_ALIASES = {
    "lula": "Luiz Inacio Lula da Silva", "presidente lula": "Luiz Inacio Lula da Silva", "luiz inacio": "Luiz Inacio Lula da Silva", "haddad": "Fernando Haddad",
    "fernando haddad": "Fernando Haddad", "ministro haddad": "Fernando Haddad", "galipolo": "Gabriel Galipolo", "gabriel galipolo": "Gabriel Galipolo",
    "campos neto": "Roberto Campos Neto", "roberto campos neto": "Roberto Campos Neto", "tarcisio": "Tarcisio de Freitas", "tarcisio de freitas": "Tarcisio de Freitas",
    "bc": "Banco Central do Brasil", "bacen": "Banco Central do Brasil", "banco central": "Banco Central do Brasil", "cvm": "Comissao de Valores Mobiliarios",
    "stf": "Supremo Tribunal Federal", "stj": "Superior Tribunal de Justica", "carf": "Conselho Administrativo de Recursos Fiscais",
    "pgfn": "Procuradoria-Geral da Fazenda Nacional", "receita federal": "Receita Federal do Brasil", "bndes": "Banco Nacional de Desenvolvimento",
    "anatel": "Agencia Nacional de Telecomunicacoes", "aneel": "Agencia Nacional de Energia Eletrica", "ans": "Agencia Nacional de Saude Suplementar",
    "anvisa": "Agencia Nacional de Vigilancia Sanitaria", "petrobras": "Petrobras S.A.", "vale": "Vale S.A.", "itau": "Itau Unibanco S.A.",
    "itau unibanco": "Itau Unibanco S.A.", "bradesco": "Bradesco S.A.", "btg": "BTG Pactual", "btg pactual": "BTG Pactual", "americanas": "Americanas S.A.",
    "oi": "Oi S.A.", "gol": "GOL Linhas Aereas", "azul": "Azul S.A.", "latam": "LATAM Airlines", "jbs": "JBS S.A.", "ambev": "Ambev S.A.",
    "eletrobras": "Eletrobras S.A.", "sabesp": "Sabesp S.A.",
}
# Companies.
COMPANIES = ("petrobras", "vale", "itau", "bradesco", "btg pactual", "americanas", "oi", "gol", "azul", "latam", "jbs", "ambev", "eletrobras", "sabesp", "magazine luiza",
             "via varejo", "renner", "marfrig", "minerva", "suzano", "klabin", "cemig", "copel", "equatorial", "neoenergia", "hapvida", "rede d'or", "fleury", "dasa",
             "embraer", "weg", "localiza", "movida", "cosan", "rumo", "raizen")
# Agencies.
AGENCIES = ("banco central", "bacen", "cvm", "carf", "stf", "stj", "pgfn", "receita federal", "bndes", "cade", "anatel", "aneel", "copom", "tesouro nacional", "b3")
# Prices in USD of a million tokens (in, out).
MODEL_PRICES = ((2.50, 15.00), (0.30, 2.50), (0.10, 0.40), (0.15, 0.60))

# The canonical tags.
NATIONAL_TAGS = (
    "M&A e Transações Corporativas", "Jurídico, Falências e Regulatório", "Dívida Ativa e Créditos Públicos", "Distressed Assets e NPLs",
    "Mercado de Capitais e Finanças Corporativas", "Política Econômica (Brasil)", "Internacional (Economia e Política)", "Tecnologia e Setores Estratégicos",
    "Divulgação de Resultados", "IRRELEVANTE",
)
INTERNATIONAL_TAGS = (
    "Global M&A and Corporate Transactions", "Global Legal and Regulatory", "Sovereign Debt and Credit", "Global Distressed and Restructuring", "Global Capital Markets",
    "Central Banks and Monetary Policy", "Geopolitics and Trade", "Technology and Innovation", "IRRELEVANTE",
)
DEFAULT_INTERNATIONAL_TAG = "Geopolitics and Trade"
# Tags of an earlier version -> canonical tags.
OLD_TAGS = {
    "Economia e Tecnologia": "Internacional (Economia e Política)", "Governo e Politica": "Política Econômica (Brasil)", "Judicionario": "Jurídico, Falências e Regulatório",
    "Empresas Privadas": "Mercado de Capitais e Finanças Corporativas",
}
# Scores of migrated records by priority, and of any other priority.
MIGRATED_SCORES = {"P1_CRITICO": 85.0, "P2_ESTRATEGICO": 65.0}
MIGRATED_SCORE, MIGRATED_PRIORITY, MIGRATED_REASON = 35.0, "P3_MONITORAMENTO", "Migrado: Classificado como "
LEGACY_TAG, UNKNOWN = "Empresas Privadas", "N/A"

# Patterns of the names of papers and files that a channel's listener keeps.
JOURNAL_PATTERNS = (
    r"valor\s*(econ[oô]mico)?", r"folha\s*(de?\s*s\.?\s*paulo)?", r"estado\s*(de?\s*s\.?\s*paulo)?", r"estadao", r"gazeta", r"correio\s*braziliense", r"o\s*globo", r"jornal", r"broadcast", r"infomoney",
    r"capital\s*aberto", r"brazil\s*journal", r"pipeline", r"reset", r"neofeed", r"bloomberg", r"reuters", r"financial\s*times", r"\.pdf$",
)
