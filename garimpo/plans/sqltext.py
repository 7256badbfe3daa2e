"""Building blocks of the DuckDB SQL that checks the core queries."""

from __future__ import annotations

from garimpo.functions import patterns as P

_GUARD = "QZQ"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: White space as Unicode has it; DuckDB's \\s is ASCII only.
BLANKS = "\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

BLANKS_IN_LINE = BLANKS.replace("\\s", " \\t\\r\\f")


def _sub(expr: str, pattern: str, to: str) -> str:
    for k in range(9, 0, -1):
        to = to.replace(f"${k}", f"\\{k}")
    return f"regexp_replace({expr}, {quote(pattern.replace(chr(92) + 's', f'[{BLANKS}]'))}, {quote(to)}, 'g')"


def rules(expr: str, which: list[tuple[str, str]]) -> str:
    """The rules as nested RE2 replacements; look-around becomes captures or guards."""
    for pattern, to in which:
        if pattern.endswith("(?=[A-Za-zÀ-ÿ])"):
            head = pattern[: -len("(?=[A-Za-zÀ-ÿ])")]
            for _ in range(2):
                expr = _sub(expr, head + "([A-Za-zÀ-ÿ])", to.rstrip() + " $2")
        elif pattern.endswith("\\b(?!\\.\\d)"):
            head = pattern[: -len("\\b(?!\\.\\d)")]
            expr = _sub(_sub(_sub(expr, f"({head})(\\.\\d)", f"$1{_GUARD}$2"), head + "\\b", to), _GUARD, "")
        elif pattern.startswith("(?<!\\d)"):
            body = pattern[len("(?<!\\d)") : -len("(?!\\d)")]
            for _ in range(2):
                expr = _sub(expr, f"(^|[^0-9]){body}($|[^0-9])", f"$1{to}$2")
        elif pattern.startswith("(?<!(?i:\\b"):
            word = pattern[len("(?<!(?i:\\b") :].split(")", 1)[0]
            body = pattern.split("{0,9})\\b", 1)[1]
            expr = _sub(_sub(_sub(expr, f"(?i)(\\b{word}\\s{{0,9}}[:\\-]?\\s{{0,9}})({body})", f"$1{_GUARD}$2"), "\\b" + body, to), _GUARD, "")
        else:
            expr = _sub(expr, pattern, to)
    return expr


MASKS = [*P.DATES, *P.HOURS, *P.CPF, *P.PHONES, *P.CEP, *P.EMAIL]

NOTES = """notes AS (
  SELECT nr_registro, cd_paciente, dt_atendimento, ds_evolucao AS texto, ds_especialid_atendimento AS especialidade, ds_multi_empresa AS hospital, 'prescricao' AS doc_type FROM prescricoes
  UNION ALL
  SELECT nr_registro, cd_paciente, dt_atendimento, ds_parecer, ds_especialid_atendimento, ds_multi_empresa, 'parecer' FROM pareceres)"""

WRITTEN_NOTES = f"{NOTES}, an AS (SELECT nr_registro, doc_type, translate(texto, '０１２３４５６７８９', '0123456789') AS t FROM notes WHERE texto IS NOT NULL)"

COUNTS = f"""{NOTES}, c AS (SELECT *,
  CASE WHEN texto IS NULL THEN 0 ELSE len(list_filter(string_split_regex(texto, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{85}}\\x0B]+'), lambda x: x <> '')) END AS tok,
  coalesce(length(texto), 0) AS car,
  coalesce(length(texto) - length(replace(texto, '.', '')) + 1, 0) AS sen,
  CASE WHEN texto IS NULL THEN 'desconhecido' WHEN contains(texto, '( X )') OR contains(texto, '[ X ]') OR contains(texto, '(X)') OR contains(texto, '[X]') OR contains(texto, 'SINAIS VITAIS:')
       THEN 'template_estruturado' ELSE 'texto_livre' END AS kind FROM notes)"""

LATEST = """latest AS (
  SELECT sentenca_id, anotador_id, posicao, lab AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY sentenca_id, anotador_id, posicao ORDER BY atualizado_em DESC NULLS LAST, criado_em DESC NULLS LAST, lab DESC) AS rn FROM (
      SELECT sentenca_id, anotador_id, posicao, atualizado_em, criado_em, coalesce(upper(strip_accents(trim(label))), '') AS lab FROM anotacao_token))
  WHERE rn = 1 AND lab <> '')"""

GRID = f"""{LATEST},
two AS (SELECT * FROM (SELECT sentenca_id, anotador_id, row_number() OVER (PARTITION BY sentenca_id ORDER BY anotador_id) AS o FROM (SELECT DISTINCT sentenca_id, anotador_id FROM latest)) WHERE o <= 2),
wide AS (SELECT sentenca_id, posicao, max(CASE WHEN o = 1 THEN label END) AS a1, max(CASE WHEN o = 2 THEN label END) AS a2 FROM latest JOIN two USING (sentenca_id, anotador_id) GROUP BY ALL),
tok AS (SELECT sentenca_id, sessao_id, unnest(range(len(tokens)))::INT AS posicao, unnest(tokens) AS token FROM sentenca WHERE sentenca_id IN (SELECT sentenca_id FROM latest)),
grid AS (SELECT t.sentenca_id, sessao_id, t.posicao, token, coalesce(a1, 'O') AS a1, coalesce(a2, 'O') AS a2 FROM tok t LEFT JOIN wide w ON w.sentenca_id = t.sentenca_id AND w.posicao = t.posicao)"""

DECIDED = """decided AS (SELECT sentenca_id, posicao, label FROM (
  SELECT sentenca_id, posicao, upper(strip_accents(trim(label))) AS label, row_number() OVER (PARTITION BY sentenca_id, posicao ORDER BY criado_em DESC NULLS LAST, upper(strip_accents(trim(label))) DESC) AS rn
  FROM adjudicacao_token WHERE label IS NOT NULL) WHERE rn = 1)"""

GOLD = f"""{GRID}, {DECIDED},
gold AS (SELECT g.sentenca_id, g.sessao_id, g.posicao, g.token, coalesce(d.label, g.a1) AS label FROM grid g LEFT JOIN decided d ON d.sentenca_id = g.sentenca_id AND d.posicao = g.posicao)"""


def spans(source: str, label: str, mode: str, name: str, tipo: str | None = None) -> str:
    """CTEs that end in `name` with the spans of a label column."""
    live = f"({label} LIKE 'B-%' OR {label} LIKE 'I-%')" + (f" AND substr({label}, 3) = '{tipo}'" if mode == "typed-run" else "")
    follows = "(pp IS NOT NULL AND pos0 = posicao - 1)"
    opens = f"(p = 'B' OR NOT {follows})" if mode in ("run", "typed-run") else f"(p = 'B' OR NOT ({follows} AND pk = k))"
    strict = "WHERE first = 'B'" if mode == "strict" else ""
    return f"""{name}_1 AS (SELECT sentenca_id, posicao, token, CASE WHEN {live} THEN substr({label}, 1, 1) END AS p, CASE WHEN {live} THEN substr({label}, 3) END AS k FROM {source}),
{name}_2 AS (SELECT *, lag(p) OVER w AS pp, lag(k) OVER w AS pk, lag(posicao) OVER w AS pos0 FROM {name}_1 WINDOW w AS (PARTITION BY sentenca_id ORDER BY posicao)),
{name}_3 AS (SELECT *, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY sentenca_id ORDER BY posicao) AS run FROM {name}_2 WHERE p IS NOT NULL),
{name} AS (SELECT sentenca_id, inicio, fim, tipo, texto FROM (SELECT sentenca_id, run, min(posicao) AS inicio, max(posicao) + 1 AS fim, arg_min(p, posicao) AS first, arg_max(k, posicao) AS tipo,
  string_agg(token, ' ' ORDER BY posicao) AS texto FROM {name}_3 GROUP BY sentenca_id, run) {strict})"""
