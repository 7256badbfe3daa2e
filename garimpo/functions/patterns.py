"""Text rules: fixed patterns and word lists, in the order in which they apply.

All patterns are Java regular expressions for Unicode text; (?U) makes their classes and
word borders Unicode-aware.
"""

from __future__ import annotations

# Letter classes of the glue rules.
UPPER = "[A-ZÁÉÍÓÚÀÈÌÒÙÃÕÂÊÎÔÛÇ]"
LOWER = "[a-záéíóúàèìòùãõâêîôûç]"
_ANY = "[A-Za-zÀ-ÿ]"
_DAY, _MONTH = "(?:0?[1-9]|[12]\\d|3[01])", "(?:0?[1-9]|1[0-2])"
_MONTHS = "janeiro|fevereiro|marco|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_DMY = "\\d{1,2}\\s*/\\s*\\d{1,2}\\s*/\\s*\\d{2,4}"

# Fixed values: (pattern, replacement) of words that stick together.
GLUE = [
    (f"([A-Za-záéíóúàèìòùãõâêîôûç]+)(\\d+)({UPPER}{{4,}})", "$1 $2 $3"),
    (f"(\\d+)({UPPER}{{4,}})", "$1 $2"),
    (f"({LOWER}+)\\.({UPPER}{{4,}})", "$1. $2"),
    (f"({UPPER}{{2,}})\\.({UPPER}{{5,}})", "$1. $2"),
    ("_{3,}", " "),
    (f"({UPPER}+)(\\d{{1,2}})(\\s*/\\s*\\d{{1,2}}\\s*/\\s*\\d{{2,4}}\\b)", "$1 $2$3"),
    (f"({_DMY})({UPPER}+)", "$1 $2"),
    (f"({_ANY}{{2,}})\\.({UPPER}{LOWER}+)", "$1. $2"),
    (f"({_ANY}{{2,}}),(?={_ANY})", "$1, "),
    ("(\\d{1,2}\\s*/\\s*\\d{1,2}),(\\d{1,2}\\s*/\\s*\\d{1,2})", "$1, $2"),
    (f"(\\d+)\\.({UPPER}{{4,}})", "$1. $2"),
]

# Dates, date with time first.
DATES = [
    ("\\b\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(?::\\d{2})?\\b", "__DATA__ __HORA__"),
    ("\\b\\d{4}-\\d{2}-\\d{2}\\b", "__DATA__"),
    (f"\\b{_DMY}\\s+\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\b", "__DATA__ __HORA__"),
    (f"\\b{_DMY}\\b", "__DATA__"),
    *[(f"\\b(?:{_DAY}\\s*{s}\\s*{_MONTH}|{_MONTH}\\s*{s}\\s*{_DAY})\\s*{s}\\s*\\d{{2,4}}\\b", "__DATA__") for s in ("[-–]", "\\\\")],
    (f"\\b(?:{_DAY}\\.{_MONTH}|{_MONTH}\\.{_DAY})\\.\\d{{2,4}}\\b(?!\\.\\d)", "__DATA__"),
    (f"(?i)\\b{_DAY}\\s+DE\\s+(?:{_MONTHS})\\s+DE\\s+\\d{{4}}\\b", "__DATA__"),
]

# Times of day.
HOURS = [
    ("\\b\\d{1,2}:\\d{1,2}:\\d{1,2}[.,]\\d{1,3}\\b", "__HORA__"),
    ("\\b\\d{1,2}:\\d{1,2}:\\d{1,2}\\b", "__HORA__"),
    ("(?i)\\b\\d{1,2}:\\d{1,2}\\s*(?:AM|PM|a\\.m\\.|p\\.m\\.)\\b", "__HORA__"),
    ("(?i)\\b\\d{1,2}:\\d{1,2}h\\b", "__HORA__"),
    ("(?<!\\d)\\d{1,2}:\\d{1,2}(?!\\d)", "__HORA__"),
    ("(?i)\\b\\d{1,2}h\\s*\\d{1,2}\\s*(?:min|m)\\s*\\d{1,2}\\b", "__HORA__"),
    ("(?i)\\b\\d{1,2}h\\s*\\d{1,2}\\s*(?:min|m)\\b", "__HORA__"),
    ("(?i)\\b\\d{1,2}h\\d{1,2}\\b", "__HORA__"),
    ("(?i)\\b\\d{1,2}h\\b", "__HORA__"),
    ("(?i)\\bàs\\s+\\d{1,2}\\s+horas?\\b", "__HORA__"),
]

# The taxpayer number.
CPF = [("\\b\\d{3}\\.\\d{3}\\.\\d{3}[-.]\\d{2}\\b", "__CPF__"), ("(?i)(\\bCPF\\s*[:\\-]?\\s*)\\b\\d{11}\\b", "$1__CPF__")]

# Telephone numbers; the rule of announced numbers runs first, so that no later rule takes its tail.
_KIN = "NETA|NETO|FILHA|FILHO|MAE|MÃE|PAI|IRMAO|IRMÃO|IRMA|IRMÃ|ESPOSO|ESPOSA|CONJUGE|CÔNJUGE|FAMILIAR|RESPONSAVEL|RESPONSÁVEL|TEL|FONE|CELULAR|CEL|CONTATO"
PHONES = [
    (f"(?i)((?:{_KIN})\\s+)\\d{{2}}\\s*-\\s*\\d+\\.\\d+\\s*-\\s*\\d{{4}}", "$1__TELEFONE__"),
    ("\\(\\d{2}\\)\\s*\\d{4,5}\\s*-\\s*\\d{4}", "__TELEFONE__"),
    ("\\(\\d{2}\\)\\s*\\d{4,5}\\.\\d{4}", "__TELEFONE__"),
    ("\\(\\d{2}\\)\\s*\\d{4,5}\\s+\\d{4}", "__TELEFONE__"),
    ("\\(\\d{2}\\)\\s*\\d{8,9}", "__TELEFONE__"),
    ("\\b\\d{2}\\s+9\\s+\\d{4}\\s+\\d{4}\\b", "__TELEFONE__"),
    ("\\b\\d{2}\\s+\\d{4,5}\\s+-\\s+\\d{4}\\b", "__TELEFONE__"),
    ("\\b\\d{2}\\s*\\d{4,5}\\s*-\\s*\\d{4}\\b", "__TELEFONE__"),
    ("\\b\\d{2}\\s+\\d{9}\\b", "__TELEFONE__"),
    ("\\b\\d{10,11}\\b", "__TELEFONE__"),
    ("\\b\\d{4,5}\\.\\d{4}\\b", "__TELEFONE__"),
    ("(?<!(?i:\\bRG)\\s{0,9}[:\\-]?\\s{0,9})\\b9\\d{8}\\b", "__TELEFONE__"),
    ("\\b3\\d{7}\\b", "__TELEFONE__"),
    ("(?<!(?i:\\bCEP)\\s{0,9}[:\\-]?\\s{0,9})\\b\\d{4,5}\\s*-\\s*\\d{4}\\b", "__TELEFONE__"),
]

# Postal codes and e-mail addresses.
CEP = [("\\b\\d{5}-\\d{3}\\b", "__CEP__"), ("(?i)((?:CEP|ENDERE[CÇ]O|END\\.?|RUA|AV\\.?|AVENIDA|BAIRRO|LOGRADOURO)\\s*[:\\-]?\\s*)\\b\\d{8}\\b", "$1__CEP__")]
EMAIL = [("[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}", "__EMAIL__")]

# Token patterns of the corpus and of the annotation tool's import.
_W = "[\\p{L}\\p{N}_]"
TOKEN = f"__[A-Z]+__|\\p{{Nd}}{{4}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{2}}|\\p{{Nd}}{{2}}:\\p{{Nd}}{{2}}|{_W}+(?:[.,]{_W}+)*|[^\\p{{L}}\\p{{N}}_\\s]"
TOKEN_FUSED = f"__{_W}+__|" + TOKEN.split("|", 1)[1]
TOKEN_IMPORT = f"__[A-Z]+__|{_W}+(?:[.,]{_W}+)*|[^\\p{{L}}\\p{{N}}_\\s]"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Dr Dra Prof Sr Sra LPP SVD AVP SNE SNG BIC BH HTX NPT TOT TQT GTT VNI UTI PA FC FR TAX SAT CN VM ABD RH SIC HDA HPP MID".split()
# Marks of structured templates.
TEMPLATE_MARKS = ["( X )", "[ X ]", "(X)", "[X]", "SINAIS VITAIS:"]

# Placeholders and entity types, and the markers that stand for them.
PLACEHOLDERS = {"__TELEFONE__": "[CONTATO]", "__EMAIL__": "[CONTATO]", "__CPF__": "[DOCUMENTO]", "__CEP__": "[ENDEREÇO]", "__DATA__": "[DATA]", "__HORA__": "[HORA]"}
MARKERS = {"PESSOA": "[PESSOA]", "DOCUMENTO": "[DOCUMENTO]", "ENDERECO": "[ENDEREÇO]", "INSTITUICAO": "[INSTITUIÇÃO]", "CONTATO": "[CONTATO]", "DATA": "[DATA]", "HORA": "[HORA]"}
REGEX_TYPES = ["DATA", "HORA", "CONTATO"]
CONTEXT_TYPES = ["PESSOA", "ENDERECO", "DOCUMENTO", "INSTITUICAO"]
ENTITY_TYPES = ["PESSOA", "DATA", "ENDERECO", "CONTATO", "DOCUMENTO", "HORA", "INSTITUICAO"]

# Detectors of protected information in a sentence, with default quotas.
_C = "[A-ZÁÉÍÓÚÂÊÎÔÛÃÕÀÇ]"
DETECTORS = {
    "CONTATO": ("(?i)__TELEFONE__|__EMAIL__", 300),
    "DOCUMENTO": ("\\b[A-Z]{0,2}\\d{1,2}[.\\-]\\d{3}[.\\-]\\d{3}[\\-.]?\\w{0,2}\\b|\\b\\d{15}\\b|CNH|RG\\s*:?\\s*\\d|CNS\\s*:?\\s*\\d", 300),
    "ENDERECO": ("(?i)\\b(RUA|AV\\.?|AVENIDA|BAIRRO|TRAVESSA|ALAMEDA|RODOVIA|ESTRADA|VILA|DISTRITO|LOTEAMENTO)\\b|__CEP__|N[°º]\\.?\\s*\\d+", 300),
    "PESSOA": (
        "(?i)\\b(DR\\.?|DRA\\.?|SR\\.?|SRA\\.?|PACIENTE|PT\\.?|FAMILIAR|RESPONSAVEL|ACOMPANHANTE|FILHO|FILHA|ESPOSO|ESPOSA|MAE|PAI)\\b" f"|(?<!\\w){_C}{{3,}}(?:\\s+{_C}{{2,}})+",
        300,
    ),
    "INSTITUICAO": (
        "(?i)\\b(HOSPITAL|UPA|UPINHA|CLINICA|CLÍNICA|SANTA\\s+CASA|UBS|CAPS|PRONTO.SOCORRO|MATERNIDADE|HEMOCENTRO|SAMU|CACON|HINSG|HESVV|HUCAM|HMRP|HMS|HRAS)\\b",
        300,
    ),
    "DATA": ("\\b\\d{4}-\\d{2}-\\d{2}\\b|__DATA__", 200),
    "HORA": ("\\b\\d{2}:\\d{2}\\b|__HORA__", 100),
}
