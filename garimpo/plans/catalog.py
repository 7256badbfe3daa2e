"""Queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.functions import text as T
from garimpo.functions import vocab as V
from garimpo.functions.fold import strip_accents
from garimpo.operators import anonymize, audit, corpus, labels, metrics, profile, remap, sampling, spans
from garimpo.plans import sqltext as S
from garimpo.session import table
from garimpo.shared import materialize
from garimpo.sources import rawload

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# -- raw records ------------------------------------------------------------------------

_FIELD = '(?:"(?:[^"]|"")*"|[^";][^;]*|)'
_RAW = f"""raw AS (SELECT linha_id, arquivo, coalesce(linha, '') AS l FROM registros_brutos),
parsed AS (SELECT *, regexp_full_match(l, '{_FIELD}(?:;{_FIELD})*') AS quoted, regexp_full_match(l, '{_FIELD}(?:;{_FIELD}){{4}}') AS five,
  {", ".join(f"regexp_extract(l, '^({_FIELD}){''.join(f';({_FIELD})' for _ in range(4))}$', {k + 1}) AS r{k}" for k in range(5))} FROM raw),
fields AS (SELECT *, {", ".join(f"CASE WHEN r{k} LIKE '\"%' THEN replace(substr(r{k}, 2, length(r{k}) - 2), '\"\"', '\"') ELSE r{k} END AS f{k}" for k in range(5))} FROM parsed),
timed AS (SELECT *, CASE WHEN regexp_full_match(f1, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime(f1, '%d/%m/%Y')
  WHEN regexp_full_match(f1, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}') THEN try_strptime(f1, '%d/%m/%Y %H:%M')
  WHEN regexp_full_match(f1, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN try_strptime(f1, '%Y-%m-%d %H:%M:%S') END AS t_at FROM fields),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'aspas' WHEN NOT five THEN 'colunas'
  WHEN NOT (regexp_full_match(f0, '[0-9]{{1,12}}') AND NOT regexp_full_match(f0, '0+')) OR t_at IS NULL OR year(t_at) NOT BETWEEN 2010 AND 2025 THEN 'valor' END AS motivo FROM timed)"""
_MISSING = ", ".join(S.quote(m) for m in rawload.MISSING)


def _valid_sql(file: str, text: str) -> str:
    names = ["cd_paciente", "dt_atendimento", text, "ds_especialid_atendimento", "ds_multi_empresa"]
    cols = ", ".join(f"CASE WHEN f{k} NOT IN ({_MISSING}) THEN f{k} END AS {n}" for k, n in enumerate(names))
    return f"WITH {_RAW} SELECT linha_id, {cols} FROM judged WHERE motivo IS NULL AND arquivo = '{file}'"


@query(f"WITH {_RAW} SELECT linha_id, motivo FROM judged WHERE motivo IS NOT NULL")
def p7_found(spark, d):
    return rawload.rejected_records(table(spark, d, "registros_brutos"))


@query(_valid_sql("prescricoes.csv", "ds_evolucao"))
def p7_prescricoes(spark, d):
    return rawload.valid_records(table(spark, d, "registros_brutos"), "prescricoes.csv")


@query(_valid_sql("pareceres.csv", "ds_parecer"))
def p7_pareceres(spark, d):
    return rawload.valid_records(table(spark, d, "registros_brutos"), "pareceres.csv")


# -- profile ----------------------------------------------------------------------------


def _notes(spark, d) -> DataFrame:
    return profile.notes(table(spark, d, "prescricoes"), table(spark, d, "pareceres"))


@query(f"WITH {S.NOTES} SELECT coalesce(doc_type, 'total') AS doc_type, count(*) AS registros FROM notes GROUP BY ROLLUP (doc_type)")
def q_count_records(spark, d):
    return profile.record_counts(_notes(spark, d))


@query(f"WITH {S.NOTES} SELECT count(DISTINCT cd_paciente) AS pacientes FROM notes")
def q_distinct_patients(spark, d):
    return profile.distinct_patients(_notes(spark, d))


_AT = "coalesce(try_strptime(dt_atendimento, '%Y-%m-%d %H:%M:%S'), try_strptime(dt_atendimento, '%d/%m/%Y %H:%M'), try_strptime(dt_atendimento, '%d/%m/%Y'))"


@query(f"WITH {S.NOTES} SELECT min({_AT}) AS inicio, max({_AT}) AS fim FROM notes")
def q_period(spark, d):
    return profile.period(_notes(spark, d))


@query(f"WITH {S.NOTES} SELECT especialidade AS valor, count(*) AS registros FROM notes WHERE especialidade IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_top_specialities(spark, d):
    return profile.top_values(_notes(spark, d), "especialidade")


@query(f"WITH {S.NOTES} SELECT count(DISTINCT hospital) AS hospitais FROM notes")
def q_hospitals(spark, d):
    return profile.hospitals(_notes(spark, d))


def _distribution_sql(v: str) -> str:
    return f"""WITH {S.COUNTS} SELECT doc_type, min({v}) AS min, round(avg({v}), 1) AS media, max({v}) AS max, trunc(quantile_cont({v}, 0.25))::INT AS p25,
      trunc(quantile_cont({v}, 0.5))::INT AS mediana, trunc(quantile_cont({v}, 0.75))::INT AS p75 FROM c GROUP BY 1"""


for _name, _col, _value in (("q_token_profile", "tok", profile.token_count), ("q_char_profile", "car", profile.char_count), ("q_sentence_profile", "sen", profile.stop_count)):
    query(_distribution_sql(_col), _name)(lambda spark, d, value=_value: profile.distribution(_notes(spark, d), value(F.col("texto")), ["doc_type"]))


@query(f"""WITH {S.COUNTS} SELECT doc_type, count(*) AS textos, count_if(kind = 'template_estruturado') AS templates, count_if(kind = 'texto_livre') AS livres,
  count_if(kind = 'desconhecido') AS desconhecidos, round(100 * count_if(kind = 'template_estruturado') / count(*), 1) AS pct_template, round(100 * count_if(kind = 'texto_livre') / count(*), 1) AS pct_livre
  FROM c GROUP BY 1""")
def q_text_type(spark, d):
    return profile.type_shares(_notes(spark, d), ["doc_type"])


@query(f"""WITH {S.COUNTS}, e AS (SELECT min(tok)::DOUBLE AS lo, greatest((max(tok) - min(tok)) / 10.0, 1e-9)::DOUBLE AS w FROM c),
  n AS (SELECT greatest(0, least(9, ceil((tok - lo) / w)::INT - 1)) AS faixa, count(*) AS n FROM c, e GROUP BY 1)
  SELECT f.faixa, round(lo + f.faixa * w, 3) AS de, round(lo + f.faixa * w + w, 3) AS ate, coalesce(n.n, 0) AS textos FROM (SELECT unnest(range(10))::INT AS faixa) f CROSS JOIN e LEFT JOIN n USING (faixa)""")
def q_histogram(spark, d):
    return profile.histogram(_notes(spark, d), profile.token_count(F.col("texto")))


_T1 = {"registros": "count(*)", "pacientes": "count(DISTINCT cd_paciente)", "hospitais": "count(DISTINCT hospital)"}
for _c in ("tok", "car", "sen"):
    _T1 |= {f"{_c}_media": f"round(avg({_c}), 1)", f"{_c}_mediana": f"quantile_cont({_c}, 0.5)", f"{_c}_min": f"min({_c})", f"{_c}_max": f"max({_c})"}
_T1 |= {k: f"count_if(kind = '{k}')" for k in ("template_estruturado", "texto_livre", "desconhecido")}


@query(f"""WITH {S.COUNTS}, w AS (SELECT doc_type, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _T1.items())} FROM c GROUP BY 1), l AS (UNPIVOT w ON {", ".join(_T1)} INTO NAME caracteristica VALUE valor)
  SELECT caracteristica, max(CASE WHEN doc_type = 'prescricao' THEN valor END) AS prescricao, max(CASE WHEN doc_type = 'parecer' THEN valor END) AS parecer FROM l GROUP BY 1""")
def q_table1(spark, d):
    return profile.table_one(_notes(spark, d))


# -- text rules ---------------------------------------------------------------------------

# DuckDB's patterns know no Unicode digits at word borders, so the 10 full-width digits, and nothing else, are given as plain ones on both sides.
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"


def _written(spark, d) -> DataFrame:
    """The notes that are not null, as they are but for full-width digits."""
    return _notes(spark, d).where("texto is not null").select("nr_registro", "doc_type", F.translate("texto", _WIDE, _PLAIN).alias("t"))


_STEPS = {
    "q_glue": (P.GLUE, T.split_glued),
    "q_mask_dates": (P.DATES, T.mask_dates),
    "q_mask_hours": (P.HOURS, T.mask_hours),
    "q_mask_cpf": (P.CPF, T.mask_cpf),
    "q_mask_phone": (P.PHONES, T.mask_phones),
    "q_mask_cep": (P.CEP, T.mask_ceps),
    "q_mask_email": (P.EMAIL, T.mask_emails),
    "q_mask_all": (S.MASKS, T.mask_all),
}
for _name, (_rules, _step) in _STEPS.items():
    query(f"WITH {S.WRITTEN_NOTES} SELECT nr_registro, {S.rules('t', _rules)} AS texto FROM an", _name)(
        lambda spark, d, step=_step: _written(spark, d).select("nr_registro", step(F.col("t")).alias("texto"))
    )

_DONE = S.rules(S.rules("t", P.GLUE), S.MASKS)


@query(f"""WITH {S.WRITTEN_NOTES}, m AS (SELECT doc_type, unnest(regexp_extract_all({_DONE}, '__(?:DATA|HORA|TELEFONE|CPF|CEP|EMAIL)__')) AS marca FROM an)
  SELECT doc_type, marca, count(*) AS vezes FROM m GROUP BY ALL""")
def q_placeholder_counts(spark, d):
    masked = T.mask_all(T.split_glued(F.col("t")))
    found = F.regexp_extract_all(masked, F.lit("__(?:DATA|HORA|TELEFONE|CPF|CEP|EMAIL)__"), F.lit(0))
    return _written(spark, d).select("doc_type", F.explode(found).alias("marca")).groupBy("doc_type", "marca").agg(F.count(F.lit(1)).alias("vezes"))


@query(f"""WITH {S.NOTES} SELECT nr_registro, regexp_replace(regexp_replace(nfc_normalize(replace(coalesce(texto, ''), chr(9), ' ')), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}--\\n]', '', 'g'), ' +', ' ', 'g') AS texto FROM notes""".replace("[\\p{Cc}\\p{Cf}\\p{Co}--\\n]", "[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x{9F}\\p{Cf}\\p{Co}]"))
def q_clean(spark, d):
    c = F.regexp_replace(T.drop_controls(T.nfc(F.col("texto"))), " {2,}", " ")
    return _notes(spark, d).select("nr_registro", c.alias("texto"))


@query(f"WITH {S.WRITTEN_NOTES} SELECT nr_registro, regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '(?m)^[{S.BLANKS_IN_LINE}]+|[{S.BLANKS_IN_LINE}]+$', '', 'g') AS texto FROM an")
def q_spaces(spark, d):
    return _written(spark, d).select("nr_registro", T.collapse_spaces(F.col("t")).alias("texto"))


_ABBR = "|".join(P.ABBREVIATIONS)
_KEPT = f"regexp_replace(t, '\\b({_ABBR})\\.', '\\1' || chr(2), 'g')"
_SENT = f"""{S.WRITTEN_NOTES}, k AS (SELECT nr_registro, doc_type, {_KEPT} AS t, contains(t, '( X )') OR contains(t, '[ X ]') OR contains(t, '(X)') OR contains(t, '[X]') OR contains(t, 'SINAIS VITAIS:') AS templ FROM an),
  p AS (SELECT nr_registro, doc_type, CASE WHEN templ THEN string_split(t, chr(10)) ELSE string_split(regexp_replace(t, '([.!?])[{S.BLANKS}]+', '\\1' || chr(1), 'g'), chr(1)) END AS parts FROM k),
  s AS (SELECT nr_registro, doc_type, list_filter(list_transform(parts, lambda x: replace(regexp_replace(x, '^[{S.BLANKS}]+|[{S.BLANKS}]+$', '', 'g'), chr(2), '.')), lambda x: x <> '' AND len(list_filter(string_split_regex(x, '[{S.BLANKS}]+'), lambda y: y <> '')) >= 3) AS ss FROM p),
  sent AS (SELECT nr_registro, doc_type, (unnest(range(len(ss))))::INT AS ordem, unnest(ss) AS sentenca FROM s)"""


@query(f"WITH {_SENT} SELECT nr_registro, ordem, sentenca FROM sent")
def q_sentences(spark, d):
    return _written(spark, d).select("nr_registro", F.posexplode(T.sentences(F.col("t"))).alias("ordem", "sentenca"))


@query(f"WITH {_SENT} SELECT nr_registro, ordem, regexp_extract_all(sentenca, {S.quote(P.TOKEN)}) AS tokens FROM sent")
def q_tokens(spark, d):
    return q_sentences(spark, d).select("nr_registro", "ordem", T.word_tokens(F.col("sentenca")).alias("tokens"))


@query(f"""WITH {_SENT} SELECT doc_type, count(DISTINCT nr_registro) AS documentos, count(*) AS sentencas, sum(len(regexp_extract_all(sentenca, {S.quote(P.TOKEN)})))::BIGINT AS tokens FROM sent GROUP BY 1""")
def q_corpus_totals(spark, d):
    s = _written(spark, d).select("nr_registro", "doc_type", F.explode(T.sentences(F.col("t"))).alias("sentenca"))
    return corpus.corpus_totals(s.withColumn("tokens", T.word_tokens(F.col("sentenca"))))


@query()
def q_normalize(spark, d):
    return _notes(spark, d).select("nr_registro", T.normalize(F.col("texto")).alias("texto"))


@query()
def q_iso_dates(spark, d):
    return _notes(spark, d).where("texto is not null").select("nr_registro", T.dates_to_iso("texto").alias("texto"))


@query()
def q_corpus(spark, d):
    return corpus.note_tokens(_notes(spark, d)).select("nr_registro", "doc_type", "ordem", "tokens")


@query()
def q_features(spark, d):
    s = table(spark, d, "sentenca")
    return s.select("sentenca_id", F.posexplode(T.token_features(F.col("tokens"))).alias("posicao", "f")).select("sentenca_id", "posicao", "f.*")


@query("""WITH t AS (SELECT sentenca_id, unnest(range(len(tokens)))::INT AS posicao, unnest(tokens) AS token FROM sentenca)
  SELECT sentenca_id, posicao, lower(token) AS atual, lower(lag(token) OVER w) AS anterior, lower(lag(token, 2) OVER w) AS anterior2, lower(lead(token) OVER w) AS seguinte,
  lower(lead(token, 2) OVER w) AS seguinte2, posicao = 0 AS bos, lead(token) OVER w IS NULL AS eos FROM t WINDOW w AS (PARTITION BY sentenca_id ORDER BY posicao)""")
def q_neighbours(spark, d):
    f = F.posexplode(T.token_features(F.col("tokens"))).alias("posicao", "f")
    cols = {"atual": "lower", "anterior": "prev_lower", "anterior2": "prev2_lower", "seguinte": "next_lower", "seguinte2": "next2_lower", "bos": "BOS", "eos": "EOS"}
    return table(spark, d, "sentenca").select("sentenca_id", f).select("sentenca_id", "posicao", *[F.col(f"f.{v}").alias(k) for k, v in cols.items()])


@query("SELECT DISTINCT cd_paciente, sha256('sal' || cd_paciente) AS pseudonimo FROM sentenca WHERE cd_paciente IS NOT NULL")
def q_pseudonym(spark, d):
    return table(spark, d, "sentenca").where("cd_paciente is not null").select("cd_paciente", T.pseudonym(F.col("cd_paciente"), "sal").alias("pseudonimo")).distinct()


@query()
def q_indel_distance(spark, d):
    n = _written(spark, d).withColumn("m", T.mask_all(F.col("t")))
    return n.select("nr_registro", metrics.indel_distance("t", "m").alias("distancia"))


@query(f"""WITH {S.WRITTEN_NOTES}, k AS (SELECT nr_registro, list_transform(regexp_extract_all({_DONE}, {S.quote(P.TOKEN)}), lambda x: CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PLACEHOLDERS.items())} ELSE x END) AS w,
  len(list_filter(regexp_extract_all({_DONE}, {S.quote(P.TOKEN)}), lambda x: x IN ({", ".join(S.quote(k) for k in P.PLACEHOLDERS)}))) AS n FROM an)
  SELECT nr_registro, array_to_string(w, ' ') AS texto_anonimizado, n::INT AS n_phi_regex FROM k""")
def q_anonymize_regex(spark, d):
    tok = T.word_tokens(T.mask_all(T.split_glued(F.col("t"))))
    holders = F.array(*[F.lit(p) for p in P.PLACEHOLDERS])
    base = _written(spark, d).select("nr_registro", tok.alias("tok"))
    return base.select("nr_registro", F.array_join(spans.placeholders_to_markers(F.col("tok")), " ").alias("texto_anonimizado"), F.size(F.filter("tok", lambda t: F.array_contains(holders, t))).alias("n_phi_regex"))


@query()
def q_anonymize(spark, d):
    return anonymize.anonymise(_notes(spark, d).where("texto is not null")).select("nr_registro", "texto_anonimizado", "n_phi_regex", "n_phi_ner", "n_phi_total")


# -- annotation ----------------------------------------------------------------------------


def _grid(spark, d) -> DataFrame:
    return labels.token_grid(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"))


def _gold(spark, d) -> DataFrame:
    return labels.gold(_grid(spark, d), labels.adjudications(table(spark, d, "adjudicacao_token")))


@query(f"WITH {S.LATEST} SELECT sentenca_id, anotador_id, posicao, label FROM latest")
def q_latest(spark, d):
    return labels.latest_annotations(table(spark, d, "anotacao_token")).select("sentenca_id", "anotador_id", "posicao", "label")


@query(f"WITH {S.GRID} SELECT sentenca_id, posicao, token, a1, a2 FROM grid")
def q_grid(spark, d):
    return _grid(spark, d).select("sentenca_id", "posicao", "token", "a1", "a2")


def _kappa_sql(by: str) -> str:
    k, g, j = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    return f"""WITH {S.GRID}, n AS (SELECT {k}a1, a2, count(*)::DOUBLE AS n FROM grid GROUP BY ALL), t AS (SELECT {k}sum(n) AS tokens, sum(CASE WHEN a1 = a2 THEN n ELSE 0 END) AS c FROM n {g}),
      l AS (SELECT {k}a1 AS x, sum(n) AS n1 FROM n GROUP BY ALL), r AS (SELECT {k}a2 AS x, sum(n) AS n2 FROM n GROUP BY ALL), m AS (SELECT {k}sum(n1 * n2) AS met FROM l JOIN r USING ({k}x) {g}),
      v AS (SELECT t.*, c / tokens AS po, coalesce(met, 0) / (tokens * tokens) AS pe FROM t LEFT JOIN m {j}), w AS (SELECT *, CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kp FROM v)
      SELECT {k}tokens::BIGINT AS tokens, c::BIGINT AS concordancias, round(po, 4) AS po, round(pe, 4) AS pe, round(kp, 4) AS kappa, kp >= 0.8 AS meta_atingida FROM w"""


@query(_kappa_sql(""))
def q_kappa(spark, d):
    return labels.kappa(_grid(spark, d))


@query(_kappa_sql("sessao_id"))
def q_kappa_sessions(spark, d):
    return labels.kappa(_grid(spark, d), ["sessao_id"])


@query(f"WITH k AS ({_kappa_sql('sessao_id')}) SELECT sessao_id, CASE WHEN kappa < 0 THEN 'sem concordancia' WHEN kappa < 0.2 THEN 'minima' WHEN kappa < 0.4 THEN 'razoavel' WHEN kappa < 0.6 THEN 'moderada' WHEN kappa < 0.8 THEN 'substancial' ELSE 'quase perfeita' END AS faixa FROM k")
def q_kappa_band(spark, d):
    return q_kappa_sessions(spark, d).select("sessao_id", labels.kappa_band(F.col("kappa")).alias("faixa"))


@query(f"WITH {S.GRID} SELECT sentenca_id, count(*) AS n, string_agg(posicao || ':' || token || ':' || a1 || ':' || a2, ' ' ORDER BY posicao) AS posicoes FROM grid WHERE a1 <> a2 GROUP BY 1")
def q_disagreements(spark, d):
    shown = F.transform("posicoes", lambda x: F.concat_ws(":", x["posicao"].cast("string"), x["token"], x["a1"], x["a2"]))
    return labels.disagreements(_grid(spark, d)).select("sentenca_id", "n", F.array_join(shown, " ").alias("posicoes"))


@query(f"WITH {S.GOLD} SELECT sentenca_id, posicao, token, label FROM gold")
def q_gold(spark, d):
    return _gold(spark, d).select("sentenca_id", "posicao", "token", "label")


@query(f"""WITH {S.GOLD} SELECT sentenca_id, string_agg(token || chr(9) || label, chr(10) ORDER BY posicao) AS value FROM gold GROUP BY 1""")
def q_gold_conll(spark, d):
    from garimpo.sources.files import conll_lines

    g = _gold(spark, d).groupBy("sentenca_id").agg(F.array_sort(F.collect_list(F.struct("posicao", "token", "label"))).alias("x"))
    g = g.select("sentenca_id", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["label"]).alias("labels"))
    return g.select("sentenca_id", F.array_join(F.zip_with("tokens", "labels", lambda t, x: F.concat(t, F.lit("\t"), x)), "\n").alias("value"))


@query("SELECT sessao_id, arg_min(ordem, (ordem, sentenca_id)) AS ordem, arg_min(sentenca_id, (ordem, sentenca_id)) AS sentenca_id FROM sentenca WHERE sentenca_id NOT IN (SELECT sentenca_id FROM anotacao_token WHERE anotador_id = 101) GROUP BY 1")
def q_queue(spark, d):
    return labels.next_sentence(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"), 101)


_PROGRESS = """t AS (SELECT sessao_id, count(*) AS total FROM sentenca GROUP BY 1), d AS (SELECT sessao_id, anotador_id, count(*) AS anotadas FROM (SELECT DISTINCT sentenca_id, anotador_id FROM anotacao_token) JOIN (SELECT sentenca_id, sessao_id FROM sentenca) USING (sentenca_id) GROUP BY ALL),
  p AS (SELECT sessao_id, anotador_id, total, anotadas, total - anotadas AS pendentes, round(100 * anotadas / total, 1) AS pct FROM d JOIN t USING (sessao_id))"""


@query(f"WITH {_PROGRESS} SELECT * FROM p")
def q_progress(spark, d):
    return labels.progress(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"))


@query(f"WITH {_PROGRESS} SELECT sessao_id, count(*) AS anotadores, count(*) >= 2 AND min(pendentes = 0) AS concluida FROM p GROUP BY 1")
def q_completion(spark, d):
    return labels.completion(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"))


@query("SELECT sessao_id, sentenca_id, lag(sentenca_id) OVER (PARTITION BY sessao_id ORDER BY ordem, sentenca_id) AS anterior FROM sentenca")
def q_previous(spark, d):
    return labels.previous_sentence(table(spark, d, "sentenca"))


@query(f"WITH {S.LATEST} SELECT sentenca_id, count(*) AS rotulos, string_agg(posicao || '=' || label, ',' ORDER BY posicao) AS resumo FROM latest WHERE anotador_id = 107 GROUP BY 1")
def q_reopen(spark, d):
    m = labels.saved_labels(labels.latest_annotations(table(spark, d, "anotacao_token")), 107)
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return m.select("sentenca_id", F.size("labels").cast("bigint").alias("rotulos"), F.array_join(pairs, ",").alias("resumo"))


@query("""WITH p AS (SELECT sentenca_id, anotador_id, count(*) AS linhas, list(DISTINCT posicao) AS ps FROM anotacao_token GROUP BY ALL), j AS (SELECT p.*, len(tokens) AS tokens, range(len(tokens)) AS want FROM p JOIN sentenca USING (sentenca_id)),
  c AS (SELECT sentenca_id, anotador_id, tokens::INT AS tokens, linhas, linhas - len(ps) AS repetidas, len(list_filter(want, lambda x: NOT list_contains(ps, x)))::INT AS faltantes, len(list_filter(ps, lambda x: NOT list_contains(want, x)))::INT AS extras FROM j)
  SELECT *, repetidas = 0 AND faltantes = 0 AND extras = 0 AS ok FROM c""")
def q_integrity(spark, d):
    return labels.integrity(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"))


@query("SELECT s.sessao_id, nome, experimento_id, count(sentenca_id) AS sentencas FROM sessao_anotacao s LEFT JOIN sentenca t ON s.sessao_id = t.sessao_id GROUP BY ALL")
def q_sessions(spark, d):
    return labels.session_listing(table(spark, d, "sessao_anotacao"), table(spark, d, "sentenca"))


@query("SELECT sentenca_id, anotador_id, posicao FROM anotacao_token WHERE sentenca_id NOT IN (SELECT sentenca_id FROM sentenca WHERE sessao_id = 3)")
def q_delete_session(spark, d):
    return labels.without_session(table(spark, d, "anotacao_token"), table(spark, d, "sentenca"), 3).select("sentenca_id", "anotador_id", "posicao")


# -- spans -----------------------------------------------------------------------------------


def _gold_spans(spark, d, mode="strict", tipo=None) -> DataFrame:
    return spans.bio_spans(_gold(spark, d), mode, tipo)


for _mode, _tipo in (("strict", None), ("seqeval", None), ("run", None), ("typed-run", "ENDERECO")):
    query(f"WITH {S.GOLD}, {S.spans('gold', 'label', _mode, 'sp', _tipo)} SELECT sentenca_id, inicio, fim, tipo, texto FROM sp", f"q_bio_{_mode.replace('-', '_')}")(
        lambda spark, d, mode=_mode, tipo=_tipo: _gold_spans(spark, d, mode, tipo)
    )

_BOTH = f"{S.GRID}, {S.spans('grid', 'a1', 'seqeval', 'x')}, {S.spans('grid', 'a2', 'seqeval', 'y')}, m AS (SELECT coalesce(x.tipo, y.tipo) AS tipo, x.tipo IS NOT NULL AS g, y.tipo IS NOT NULL AS f FROM x FULL JOIN y ON x.sentenca_id = y.sentenca_id AND x.inicio = y.inicio AND x.fim = y.fim AND x.tipo = y.tipo)"
_PRF = """tp AS (SELECT {k}count_if(g AND f) AS tp, count_if(f AND NOT g) AS fp, count_if(g AND NOT f) AS fn FROM m {w} {g}), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM tp)"""


@query(f"WITH {_BOTH}, {_PRF.format(k='', w='', g='')} SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, tp + fn AS support FROM pr")
def q_entity_f1(spark, d):
    return metrics.entity_scores(*metrics.compared_spans(_grid(spark, d), "seqeval"))


_BY_TYPE = f"WITH {_BOTH}, {_PRF.format(k='tipo, ', w='', g='GROUP BY tipo')} SELECT tipo, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, tp + fn AS support FROM pr"


@query(_BY_TYPE)
def q_entity_f1_by_type(spark, d):
    return metrics.entity_scores(*metrics.compared_spans(_grid(spark, d), "seqeval"), by_type=True)


@query(f"""WITH {S.GRID}, {S.spans('grid', 'a1', 'strict', 'x')}, {S.spans('grid', 'a2', 'strict', 'y')}, m AS (SELECT coalesce(x.tipo, y.tipo) AS tipo, x.tipo IS NOT NULL AS g, y.tipo IS NOT NULL AS f FROM x FULL JOIN y ON x.sentenca_id = y.sentenca_id AND x.inicio = y.inicio AND x.fim = y.fim AND x.tipo = y.tipo),
  {_PRF.format(k='', w="WHERE tipo IN ('PESSOA', 'ENDERECO', 'DOCUMENTO', 'INSTITUICAO')", g='')}, q AS (SELECT tp, fp, fn, round(r, 4) AS coverage, round(p, 4) AS precision_anon FROM pr)
  SELECT *, round(CASE WHEN coverage + precision_anon > 0 THEN 2 * coverage * precision_anon / (coverage + precision_anon) ELSE 0 END, 4) AS f1_anon FROM q""")
def q_privacy(spark, d):
    return metrics.privacy_scores(*metrics.compared_spans(_grid(spark, d), "strict"), P.CONTEXT_TYPES)


@query(f"""WITH {S.GRID}, n AS (SELECT a1, a2, count(*) AS n FROM grid GROUP BY ALL), l AS (SELECT DISTINCT unnest([a1, a2]) AS x FROM n),
  s AS (SELECT x, sum(CASE WHEN a1 = x AND a2 = x THEN n ELSE 0 END) AS tp, sum(CASE WHEN a1 = x THEN n ELSE 0 END) AS su, sum(CASE WHEN a2 = x THEN n ELSE 0 END) AS pr FROM l CROSS JOIN n GROUP BY 1), f AS (SELECT *, CASE WHEN su + pr > 0 THEN 2.0 * tp / (su + pr) ELSE 0 END AS f1 FROM s)
  SELECT round(avg(f1), 4) AS f1_macro, round(sum(f1 * su) / sum(su), 4) AS f1_weighted, sum(su)::BIGINT AS tokens FROM f""")
def q_token_f1(spark, d):
    return metrics.token_scores(_grid(spark, d))


@query(f"""WITH p AS ({_BY_TYPE}), t AS (SELECT recall * support AS tp, support - recall * support AS fn, CASE WHEN precision > 0 THEN recall * support * (1 / precision - 1) ELSE 0 END AS fp FROM p), s AS (SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM t),
  v AS (SELECT tp / (tp + fn) AS r, tp / (tp + fp) AS p FROM s) SELECT round(r, 4) AS coverage, round(p, 4) AS precision, round(2 * p * r / (p + r), 4) AS f1 FROM v""")
def q_micro_report(spark, d):
    return metrics.micro_from_report(metrics.entity_scores(*metrics.compared_spans(_grid(spark, d), "seqeval"), by_type=True))


_STRICT = f"{S.GOLD}, {S.spans('gold', 'label', 'strict', 'sp')}"


@query(f"""WITH {_STRICT}, f AS (SELECT sentenca_id, texto, max(inicio) AS t_at, arg_max(tipo, inicio) AS tipo FROM sp GROUP BY ALL), n AS (SELECT sentenca_id, texto, '[' || tipo || '_' || row_number() OVER (PARTITION BY sentenca_id, tipo ORDER BY t_at DESC) || ']' AS marcador FROM f)
  SELECT sp.sentenca_id, inicio, fim, sp.tipo, sp.texto, marcador FROM sp JOIN n ON n.sentenca_id = sp.sentenca_id AND n.texto = sp.texto""")
def q_markers_numbered(spark, d):
    return spans.numbered(_gold_spans(spark, d)).select("sentenca_id", "inicio", "fim", "tipo", "texto", "marcador")


@query()
def q_markers_simple(spark, d):
    sp = _gold_spans(spark, d).where(~F.col("tipo").isin(P.REGEX_TYPES))
    s = table(spark, d, "sentenca").join(table(spark, d, "anotacao_token").select("sentenca_id").distinct(), "sentenca_id", "left_semi")
    return spans.replace_spans(s, sp.withColumn("marcador", spans.simple_marker(F.col("tipo"))))


# -- audits ------------------------------------------------------------------------------------


@query(f"WITH {S.GOLD} SELECT sentenca_id, posicao, token, label FROM gold WHERE substr(label, 3) IN ('DATA', 'HORA', 'CONTATO')")
def q_audit_forbidden(spark, d):
    return audit.forbidden_labels(_gold(spark, d), P.REGEX_TYPES)


@query(f"WITH {S.GOLD}, p AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY sentenca_id ORDER BY posicao), 'O') AS anterior FROM gold) SELECT sentenca_id, posicao, token, label, anterior FROM p WHERE label LIKE 'I-%' AND substr(anterior, 3) <> substr(label, 3)")
def q_audit_orphan(spark, d):
    return audit.orphan_inside(_gold(spark, d))


@query(f"WITH {_STRICT}, p AS (SELECT upper(trim(texto)) AS texto, tipo, count(DISTINCT sentenca_id) AS sentencas FROM sp GROUP BY ALL) SELECT * FROM p WHERE texto IN (SELECT texto FROM p GROUP BY 1 HAVING count(*) > 1)")
def q_audit_conflict(spark, d):
    return audit.type_conflicts(_gold_spans(spark, d))


_LEAD = "n AS (SELECT *, lead(token) OVER w AS seguinte, lead(label) OVER w AS l2 FROM gold WINDOW w AS (PARTITION BY sentenca_id ORDER BY posicao)), t AS (SELECT * FROM n WHERE lower(replace(token, '.', '')) IN ('sr', 'sra', 'dr', 'dra'))"


@query(f"WITH {S.GOLD}, {_LEAD} SELECT sentenca_id, posicao, token, seguinte FROM t WHERE label = 'O' AND l2 = 'O' AND regexp_full_match(seguinte, '\\p{{Lu}}\\p{{L}}{{2,}}')")
def q_audit_missed_names(spark, d):
    return audit.missed_names(_gold(spark, d))


@query(f"WITH {S.GOLD}, {_LEAD} SELECT sentenca_id, posicao, token, seguinte FROM t WHERE label NOT LIKE '%PESSOA' AND l2 LIKE '%PESSOA'")
def q_audit_titles(spark, d):
    return audit.titles_before_names(_gold(spark, d))


@query(f"WITH {S.GOLD}, {_LEAD} SELECT sentenca_id, posicao, token, label, seguinte, l2 AS label_seguinte FROM t")
def q_audit_all_titles(spark, d):
    return audit.all_titles(_gold(spark, d))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(S.quote(w) for w in words) + ")"


def _bare(c: str) -> str:
    return f"upper(regexp_replace({c}, '^[.,;:()]+|[.,;:()]+$', '', 'g'))"


@query(f"WITH {_STRICT}, w AS (SELECT *, string_split(texto, ' ') AS ws FROM sp) SELECT sentenca_id, inicio, fim, tipo, texto FROM w WHERE {_bare('ws[1]')} IN {_in(V.BORDER_WORDS)} OR {_bare('ws[-1]')} IN {_in(V.BORDER_WORDS)}")
def q_audit_border(spark, d):
    return audit.border_words(_gold_spans(spark, d))


@query(f"WITH {_STRICT} SELECT sentenca_id, inicio, fim, texto FROM sp WHERE tipo = 'PESSOA' AND len(list_filter(string_split(texto, ' '), lambda x: {_bare('x')} IN {_in(V.KINSHIP)})) > 0")
def q_audit_kinship(spark, d):
    return audit.kinship_in_names(_gold_spans(spark, d))


@query(f"WITH {_STRICT} SELECT sentenca_id, inicio, tipo, texto FROM sp WHERE fim - inicio = 1 AND (length(texto) <= 2 OR NOT regexp_matches(texto, '\\p{{L}}'))")
def q_audit_tiny(spark, d):
    return audit.tiny_spans(_gold_spans(spark, d))


@query(f"WITH {_STRICT}, r AS (SELECT tipo, fim - inicio AS tamanho, sentenca_id, inicio, texto, row_number() OVER (PARTITION BY tipo ORDER BY fim - inicio DESC, sentenca_id, inicio) AS lugar FROM sp) SELECT tipo, tamanho, sentenca_id, inicio, texto, lugar FROM r WHERE lugar <= 3")
def q_audit_longest(spark, d):
    return audit.longest_spans(_gold_spans(spark, d))


@query(f"WITH {_STRICT} SELECT fim - inicio AS tamanho, count(*) AS spans FROM sp WHERE tipo = 'DATA' GROUP BY 1")
def q_audit_date_lengths(spark, d):
    return audit.span_lengths(_gold_spans(spark, d), "DATA")


@query(f"WITH {_STRICT} SELECT sentenca_id, inicio, fim, tipo, texto FROM sp WHERE tipo = 'DOCUMENTO'")
def q_audit_documents(spark, d):
    return _gold_spans(spark, d).where("tipo = 'DOCUMENTO'")


@query(f"""WITH {_STRICT} SELECT 'tokens:' || label AS medida, count(*)::DOUBLE AS valor FROM gold GROUP BY 1 UNION ALL SELECT 'spans:' || tipo, count(*)::DOUBLE FROM sp GROUP BY 1 UNION ALL SELECT 'tamanho:' || tipo, round(avg(fim - inicio), 2) FROM sp GROUP BY 1
  UNION ALL SELECT 'sentencas', count(DISTINCT sentenca_id)::DOUBLE FROM gold UNION ALL SELECT 'tokens', count(*)::DOUBLE FROM gold""")
def q_audit_counters(spark, d):
    g = _gold(spark, d)
    return audit.audit_counters(g, spans.bio_spans(g))


_INSTITUTIONS = ["UPA", "UBS", "CAPS", "HOSPITAL", *V.HOSPITAL_ACRONYMS]


@query(f"WITH {S.GOLD} SELECT {_bare('token')} AS sigla, label, count(*) AS tokens FROM gold WHERE {_bare('token')} IN {_in(_INSTITUTIONS)} GROUP BY ALL")
def q_audit_acronyms(spark, d):
    return audit.acronym_labels(_gold(spark, d), _INSTITUTIONS)


@query(f"WITH {S.GOLD} SELECT g.sentenca_id, g.posicao, g.token, array_to_string(s.tokens[greatest(g.posicao - 5, 0) + 1 : g.posicao + 6], ' ') AS contexto FROM gold g JOIN sentenca s USING (sentenca_id) WHERE {_bare('g.token')} IN {_in(_INSTITUTIONS)} AND label = 'O'")
def q_audit_acronym_context(spark, d):
    return audit.acronyms_outside(_gold(spark, d), table(spark, d, "sentenca"), _INSTITUTIONS)


@query(f"""WITH {_STRICT} SELECT sentenca_id, inicio, fim, texto FROM sp JOIN (SELECT sentenca_id, tokens FROM sentenca) USING (sentenca_id) WHERE tipo = 'ENDERECO' AND fim - inicio <= 3
  AND len(list_filter(tokens[greatest(inicio - 3, 0) + 1 : inicio], lambda x: {_bare('x')} IN {_in(V.TOWN_TRIGGERS)})) > 0 AND len(list_filter(tokens, lambda x: upper(x) IN {_in(V.STREET_MARKS)})) = 0""")
def q_audit_towns(spark, d):
    return audit.isolated_towns(_gold_spans(spark, d), table(spark, d, "sentenca"))


@query(f"WITH {_STRICT} SELECT sentenca_id, inicio, texto, len(list_filter(string_split(texto, ' '), lambda x: upper(x) IN {_in(V.STREET_MARKS)})) > 0 AS marcado, length(texto)::INT AS tamanho FROM sp WHERE tipo = 'ENDERECO'")
def q_audit_addresses(spark, d):
    return audit.addresses(_gold_spans(spark, d))


@query(f"""WITH {S.GOLD}, pl AS (SELECT sentenca_id, posicao AS p FROM gold WHERE label = 'B-DATA') SELECT pl.sentenca_id, p AS posicao, string_agg(CASE WHEN label = 'O' THEN token ELSE '[' || token || '/' || label || ']' END, ' ' ORDER BY g.posicao) AS contexto
  FROM pl JOIN gold g ON g.sentenca_id = pl.sentenca_id AND abs(g.posicao - p) <= 4 GROUP BY ALL""")
def q_audit_context(spark, d):
    g = _gold(spark, d)
    return audit.marked_context(g, g.where("label = 'B-DATA'"))


@query(f"WITH {S.GOLD} SELECT substr(label, 3) AS tipo, count(*) AS tokens FROM gold WHERE label <> 'O' GROUP BY 1")
def q_entity_tokens(spark, d):
    return audit.labels_of_entities(_gold(spark, d))


@query(f"WITH {S.GOLD}, l AS (SELECT DISTINCT label FROM gold) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM l")
def q_label_ids(spark, d):
    from pyspark.sql import Window

    known = _gold(spark, d).select("label").distinct()  # at most the label domain
    return known.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("id"))


# -- samples and splits ---------------------------------------------------------------------------


@query("WITH s AS (SELECT array_to_string(tokens, ' ') AS t, sentenca_id FROM sentenca) SELECT min(sentenca_id) AS sentenca_id FROM s GROUP BY t")
def q_dedup(spark, d):
    return sampling.first_of_content(table(spark, d, "sentenca").select("sentenca_id", "tokens"), F.md5(F.array_join("tokens", " ")), "sentenca_id").select("sentenca_id")


@query()
def q_phi_detect(spark, d):
    return sampling.with_types(table(spark, d, "sentenca").select("sentenca_id", "tokens")).select("sentenca_id", "tipos")


@query()
def q_quota_sample(spark, d):
    return sampling.quota_sample(table(spark, d, "sentenca"), total=1500)


@query()
def q_quota_report(spark, d):
    return sampling.quota_report(table(spark, d, "sentenca"))


@query()
def q_selected_distribution(spark, d):
    s = table(spark, d, "sentenca")
    return sampling.selected_distribution(s, sampling.quota_sample(s))


_RAND = "md5('42|' || sentenca_id)"


@query(f"""WITH k AS (SELECT count(DISTINCT doc_type) AS k FROM sentenca WHERE doc_type IS NOT NULL), r AS (SELECT sentenca_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY substr({_RAND}, 1, 15), sentenca_id) AS r FROM sentenca WHERE doc_type IS NOT NULL)
  SELECT sentenca_id, doc_type FROM r, k WHERE r <= floor(500 / k)""")
def q_equal_allocation(spark, d):
    return sampling.equal_allocation(table(spark, d, "sentenca").select("sentenca_id", "doc_type"), "doc_type", "sentenca_id", 500)


@query(f"WITH r AS (SELECT sentenca_id, sessao_id, (row_number() OVER (PARTITION BY sessao_id ORDER BY substr({_RAND}, 1, 15), sentenca_id) - 1)::INT AS ordem FROM sentenca) SELECT * FROM r")
def q_session_order(spark, d):
    return sampling.session_order(table(spark, d, "sentenca").select("sentenca_id", "sessao_id"), "sessao_id", "sentenca_id")


@query(f"WITH {S.NOTES}, r AS (SELECT nr_registro, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY substr(md5('42|' || nr_registro), 1, 15), nr_registro) AS r FROM notes) SELECT nr_registro, doc_type FROM r WHERE r <= 300")
def q_type_sample(spark, d):
    return sampling.sample_per_type(_notes(spark, d).select("nr_registro", "doc_type"), "doc_type", "nr_registro", 300)


@query(f"WITH r AS (SELECT sentenca_id, row_number() OVER (ORDER BY substr({_RAND}, 1, 15), sentenca_id) AS r FROM sentenca) SELECT unnest([1000, 2000, 3000, 5000])::INT AS tamanho, sentenca_id FROM r QUALIFY r <= tamanho".replace("SELECT unnest([1000, 2000, 3000, 5000])::INT AS tamanho, sentenca_id FROM r QUALIFY r <= tamanho", "SELECT t.tamanho, sentenca_id FROM r JOIN (SELECT unnest([1000, 2000, 3000, 5000])::INT AS tamanho) t ON r <= t.tamanho"))
def q_learning_curve(spark, d):
    return sampling.learning_curve(table(spark, d, "sentenca"), "sentenca_id", [1000, 2000, 3000, 5000])


def _labelled(spark, d) -> DataFrame:
    return labels.gold_types(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"), labels.adjudications(table(spark, d, "adjudicacao_token")))


@query()
def q_split(spark, d):
    return sampling.reserved_split(_labelled(spark, d))


@query()
def q_split_check(spark, d):
    x = materialize(_labelled(spark, d), "labelled")
    return sampling.split_check(x, sampling.reserved_split(x))


@query(f"""WITH {S.GOLD}, e AS (SELECT DISTINCT sentenca_id, substr(label, 3) AS tipo FROM gold WHERE label <> 'O'), j AS (SELECT e.*, particao FROM e JOIN divisao USING (sentenca_id)),
  w AS (SELECT tipo, count_if(particao = 'treino') AS treino, count_if(particao = 'dev') AS dev, count_if(particao = 'teste') AS teste FROM j GROUP BY 1) SELECT *, treino > 0 AND dev > 0 AND teste > 0 AS ok FROM w""")
def q_given_split_check(spark, d):
    return sampling.split_check(_labelled(spark, d), table(spark, d, "divisao").select("sentenca_id", "particao"))


# -- maintenance ------------------------------------------------------------------------------------


@query()
def q_remap(spark, d):
    g = _gold(spark, d).groupBy("sentenca_id").agg(F.array_sort(F.collect_list(F.struct("posicao", "token", "label"))).alias("x"))
    s = g.select("sentenca_id", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["label"]).alias("labels"))
    return remap.remap_plan(s)


@query(f"""WITH {_STRICT}, f AS (SELECT sentenca_id, inicio, fim FROM sp WHERE tipo = 'HORA') SELECT g.sentenca_id, g.posicao, g.token, CASE WHEN f.inicio IS NOT NULL THEN 'O' ELSE label END AS label FROM gold g LEFT JOIN f ON f.sentenca_id = g.sentenca_id AND g.posicao >= inicio AND g.posicao < fim""")
def q_erase_spans(spark, d):
    g = _gold(spark, d)
    return remap.erase_spans(g, spans.bio_spans(g).where("tipo = 'HORA'")).select("sentenca_id", "posicao", "token", "label")


@query(f"""WITH {S.GOLD}, c AS (SELECT DISTINCT sentenca_id, token, label FROM gold WHERE label = 'B-CONTATO') SELECT sentenca_id, posicao, token, CASE WHEN label = 'B-CONTATO' THEN 'B-DOCUMENTO' ELSE label END AS label FROM gold""")
def q_relabel(spark, d):
    g = _gold(spark, d)
    fix = g.where("label = 'B-CONTATO'").select("sentenca_id", "token", F.col("label").alias("label_antigo"), F.lit("B-DOCUMENTO").alias("label_novo")).distinct()
    return remap.relabel(g, fix).select("sentenca_id", "posicao", "token", "label")


# -- provenance ---------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT sessao_id, count(*) AS sentencas FROM sentenca GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY experimento_id ORDER BY criado_em DESC NULLS LAST, sessao_id DESC) AS rn FROM sessao_anotacao)
  SELECT experimento_id, r.sessao_id, nome, encerrada, coalesce(sentencas, 0) AS sentencas FROM r LEFT JOIN n USING (sessao_id) WHERE rn = 1""")
def q_dashboard(spark, d):
    last = labels.latest_rows(table(spark, d, "sessao_anotacao"), ["experimento_id"], ["criado_em", "sessao_id"])
    n = table(spark, d, "sentenca").groupBy("sessao_id").agg(F.count(F.lit(1)).alias("sentencas"))
    return last.join(n, "sessao_id", "left").select("experimento_id", "sessao_id", "nome", "encerrada", F.coalesce("sentencas", F.lit(0)).alias("sentencas"))


@query("SELECT sessao_id, CASE WHEN nome IS NULL THEN '' ELSE regexp_replace(trim(regexp_replace(nome, '[^\\p{L}\\p{N}_\\s-]', '', 'g')), '\\s+', '_', 'g') || '_' END AS prefixo FROM sessao_anotacao")
def q_slug(spark, d):
    return table(spark, d, "sessao_anotacao").select("sessao_id", T.slug(F.col("nome")).alias("prefixo"))


# -- tables of experiments, imports, models ------------------------------------------------------------


@query("""WITH n AS (SELECT sessao_id, count(*) AS k FROM sentenca GROUP BY 1) SELECT experimento_id, count(*) AS sessoes, sum(coalesce(k, 0))::BIGINT AS sentencas, epoch(max(criado_em))::BIGINT AS ultima,
  string_agg(s.sessao_id::VARCHAR, ',' ORDER BY s.sessao_id) AS ids FROM sessao_anotacao s LEFT JOIN n USING (sessao_id) GROUP BY 1""")
def q_experiment_detail(spark, d):
    n = table(spark, d, "sentenca").groupBy("sessao_id").agg(F.count(F.lit(1)).alias("_k"))
    s = table(spark, d, "sessao_anotacao").join(n, "sessao_id", "left")
    return s.groupBy("experimento_id").agg(
        F.count(F.lit(1)).alias("sessoes"), F.sum(F.coalesce("_k", F.lit(0))).alias("sentencas"), F.unix_timestamp(F.max("criado_em")).alias("ultima"),
        F.array_join(F.transform(F.array_sort(F.collect_list("sessao_id")), lambda x: x.cast("string")), ",").alias("ids"),
    )


@query(f"WITH p AS ({_BY_TYPE}), t AS (SELECT tipo AS modelo, f1, precision, recall, support FROM p) SELECT modelo, f1, precision, recall, support, row_number() OVER (ORDER BY f1 DESC NULLS LAST, modelo)::INT AS lugar FROM t")
def q_comparison_table(spark, d):
    from pyspark.sql import Window

    t = metrics.entity_scores(*metrics.compared_spans(_grid(spark, d), "seqeval"), by_type=True)  # one row per type
    return t.select(F.col("tipo").alias("modelo"), "f1", "precision", "recall", "support").withColumn("lugar", F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), "modelo")))


@query(f"""WITH {S.WRITTEN_NOTES}, b AS (SELECT nr_registro, 'rua' AS bloco FROM an WHERE regexp_matches(t, '(?i)\\b(rua|avenida|cep)\\b') UNION ALL SELECT nr_registro, 'documento' FROM an WHERE regexp_matches(t, '(?i)\\b(rg|cns|cnh)\\b') UNION ALL SELECT nr_registro, 'qualquer' FROM an),
  r AS (SELECT *, row_number() OVER (PARTITION BY bloco ORDER BY substr(md5('42|' || nr_registro), 1, 15), nr_registro) AS r FROM b) SELECT bloco, nr_registro FROM r WHERE r <= 200""")
def q_extraction(spark, d):
    a = _written(spark, d)
    rules = {"rua": r"(?i)\b(rua|avenida|cep)\b", "documento": r"(?i)\b(rg|cns|cnh)\b"}
    blocks = a.select("nr_registro", F.lit("qualquer").alias("bloco"))
    for name, rx in rules.items():
        blocks = blocks.unionByName(a.where(F.col("t").rlike(rx)).select("nr_registro", F.lit(name).alias("bloco")))
    return sampling.sample_per_type(blocks, "bloco", "nr_registro", 200).select("bloco", "nr_registro")


@query(f"""WITH {S.GOLD}, c AS (SELECT sentenca_id, posicao, token, label, regexp_full_match(token, '[0-9]{{3}}\\.[0-9]{{3}}\\.[0-9]{{3}}') AS hit FROM gold),
  e AS (SELECT sentenca_id, posicao, 0 AS half, CASE WHEN hit THEN substr(token, 1, 3) ELSE token END AS token, label FROM c UNION ALL SELECT sentenca_id, posicao, 1, substr(token, 5), label FROM c WHERE hit)
  SELECT sentenca_id, (row_number() OVER (PARTITION BY sentenca_id ORDER BY posicao, half) - 1)::INT AS posicao, token, label FROM e""")
def q_split_tokens(spark, d):
    g = _gold(spark, d).select("sentenca_id", "posicao", "token", "label")
    cut = g.where(F.col("token").rlike(r"^[0-9]{3}\.[0-9]{3}\.[0-9]{3}$")).select(
        "sentenca_id", "posicao", "token", F.substring("token", 1, 3).alias("prefixo"), F.col("label").alias("label1"), F.expr("substring(token, 5)").alias("sufixo"), F.col("label").alias("label2")
    )
    return remap.split_tokens(g, cut)


@query()
def q_import_spans(spark, d):
    from garimpo.sources.files import import_spans

    found = _gold_spans(spark, d)
    s = table(spark, d, "sentenca").select("sentenca_id", F.array_join("tokens", " ").alias("text"), F.transform("tokens", lambda t: F.length(t)).alias("n"))
    start = F.aggregate(F.slice("n", 1, F.col("inicio")), F.lit(0), lambda a, x: a + x + 1)
    stop = F.aggregate(F.slice("n", 1, F.col("fim")), F.lit(0), lambda a, x: a + x + 1) - 1
    each = found.join(s, "sentenca_id").select("sentenca_id", "text", F.array(start.cast("string"), stop.cast("string"), "tipo").alias("x"))
    return import_spans(each.groupBy("sentenca_id", "text").agg(F.array_sort(F.collect_list("x")).alias("label")))


def _labelled_sentences(spark, d) -> DataFrame:
    g = _gold(spark, d).groupBy("sentenca_id").agg(F.array_sort(F.collect_list(F.struct("posicao", "token", "label"))).alias("x"))
    return g.select("sentenca_id", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["label"]).alias("labels"))


@query()
def q_crf_predict(spark, d):
    from garimpo.operators import crf

    s = _labelled_sentences(spark, d)
    model = crf.fit_crf(crf.training_sample(s))
    return s.select("sentenca_id", "tokens", anonymize.tagger_column(model.tag)("tokens").alias("labels"))
